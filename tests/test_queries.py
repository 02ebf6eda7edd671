"""Every query with SQL, against DuckDB on the same tables."""

import hashlib
import os

import duckdb
import pandas as pd
import pytest

from strandlake import catalog

FOLDER = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, FOLDER).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-6, atol=2e-5)


def test_ledger_chain_breaks_where_a_payload_changes(spark):
    from strandlake.operators import integrity

    entries = spark.createDataFrame([(1, i, f"p{i}") for i in range(5)], "ledger long, idx int, payload string")
    chain = integrity.chained(entries).join(entries, ["ledger", "idx"])
    assert integrity.verified(chain).first()["broken"] == 0
    assert integrity.verified(chain.replace("p2", "x", "payload")).first()["broken"] == 1


def test_vcf_and_bed(spark):
    from strandlake.sources import bed_positions, vcf_calls

    lines = spark.createDataFrame([("##x",), ("\t".join(["1", "7", ".", "A", "G", "50", "PASS", ".", "GT:DP", "0/1:33"]),), ("short",)], "value string")
    assert [tuple(x) for x in vcf_calls(lines).collect()] == [("1", 7, "A", "G", 50.0, "0/1", 33)]
    assert [x["pos"] for x in bed_positions(spark.createDataFrame([("1\t3\t5",)], "value string")).collect()] == [3, 4, 5]


def test_bind_circular_all_has_every_vector(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    got = {(r["vec_id"], r["pos"]): r["value"] for r in catalog.queries()["bind_circular_all"](spark, FOLDER).collect()}
    assert len(got) == 64 * len(vectors)
    last = max(vectors)
    for i in (0, 63):
        assert abs(got[last, i] - sum(vectors[last][j] * vectors[1][(i - j) % 64] for j in range(64))) < 2e-5


def test_quantize_int8_all_scales_by_the_maximum(spark, tmp_path):
    rows = [(1, [0.5, -2.0, 1.0] + [0.0] * 6 + [1.5]), (2, [0.0] * 10)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["vec_id"], r["pos"]): r["q"] for r in catalog.queries()["quantize_int8_all"](spark, str(tmp_path)).collect()}
    assert [got[1, i] for i in range(10)] == [32, -127, 64, 0, 0, 0, 0, 0, 0, 95]
    assert [got[2, i] for i in range(10)] == [0] * 10


def test_pii_all_has_four_kinds(spark, tmp_path):
    texts = ["mail a.b@c.org or 555-123-4567", "from 10.0.0.255, not 10.0.0.256x", "ssn 123-45-6789.", "nothing 12-34", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {tuple(r) for r in catalog.queries()["pii_detect_all"](spark, str(tmp_path)).collect()}
    assert found == {(0, 1, 1, 0, 0), (1, 0, 0, 1, 0), (2, 0, 0, 0, 1)}
    redacted = {r["doc_id"]: r["redacted"] for r in catalog.queries()["pii_redact_all"](spark, str(tmp_path)).collect()}
    want = {0: "mail [EMAIL] or [PHONE]", 1: "from [IPV4], not 10.0.0.256x", 2: "ssn [SSN]."}
    assert redacted == {i: hashlib.md5(x.encode()).hexdigest() for i, x in want.items()}


def test_one_to_many_top10_keeps_ten_rows(spark):
    counts = catalog.queries()["one_to_many_top10"](spark, FOLDER).groupBy("l_suppkey").count()
    assert counts.agg({"count": "max"}).first()[0] == 10

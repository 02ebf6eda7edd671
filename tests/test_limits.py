"""Limits and drift alerts: batches against plain folds, and streams against batches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.streaming import limits

S = limits.SECOND


def events(seed, keys=4, n=300, step=3):
    rng, at = random.Random(seed), 1_700_000_000 * S
    rows = []
    for i in range(n):
        at += rng.choice([0, 0, S // 2, S, step * S])
        rows.append((rng.choice([1, 1, *range(keys)]), at, i, rng.random()))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "key long, at long, id long, value double")


def said(df):
    return {(r["key"], r["id"]): tuple(r)[3:] for r in df.collect()}


def plain_bucket(rows, rate, capacity):
    out, state = {}, {}
    for key, at, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        tokens, before = state.get(key, (capacity, at))
        tokens = min(capacity, tokens + (at - before) / S * rate)
        out[key, i] = (tokens >= 1, "" if tokens >= 1 else "rate")
        state[key] = (tokens - (tokens >= 1), at)
    return out


def plain_window(rows, seconds, most):
    out = {}
    kept = {}
    for key, at, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        own = [t for t in kept.get(key, []) if at - t < seconds * S]
        out[key, i] = (len(own) < most, min(len(own) + 1, most))
        kept[key] = [*own, at] if len(own) < most else own
    return out


def test_batches_equal_plain_folds(spark):
    rows = events(1)
    assert said(limits.folded(frame(spark, rows), limits.token_bucket(0.4, 3.0))) == plain_bucket(rows, 0.4, 3.0)
    got = said(limits.folded(frame(spark, rows), limits.accepted_window(6.0, 4)))
    assert got == plain_window(rows, 6.0, 4) and {a for a, _ in got.values()} == {True, False}


def test_strikes_block(spark):
    rows = [(1, i * S, i, 0.0) for i in range(12)]
    got = said(limits.folded(frame(spark, rows), limits.token_bucket(0.1, 1.0, strikes=2, blocked_seconds=4)))
    assert [got[1, i] for i in range(12)] == [(True, ""), (False, "rate"), (False, "rate"), *[(False, "blocked")] * 3, (False, "rate"), (False, "rate"), *[(False, "blocked")] * 3, (True, "")]


def test_nulls_large_keys_and_no_rows(spark):
    big = 2**62 + 1
    rows = [(None, 0, 1, None), (None, 1, 2, None), (big, None, 3, 0.5), (big + 2, 5, 4, None)]
    got = said(limits.folded(frame(spark, rows), limits.token_bucket(0.001, 1.0)))
    assert got == {(None, 1): (True, ""), (None, 2): (False, "rate"), (big, 3): (True, ""), (big + 2, 4): (True, "")}
    assert limits.folded(frame(spark, []), limits.accepted_window()).count() == 0
    assert limits.folded(spark.createDataFrame([("a", 1, "x")], "key string, at long, id string"), limits.accepted_window()).count() == 1


def test_drift_monitor_equals_slices(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.random(300), rng.random(300) * 1.5])
    rows = [(1, i * 10 * S, i, float(v)) for i, v in enumerate(values)] + [(2, i, i, None) for i in range(50)]
    base = (0.5, 0.288675, 0.25, 0.5, 0.75)
    got = said(limits.folded(frame(spark, rows), limits.drift_monitor(base, window=100, every=20, least=40, threshold=0.3, cooldown_seconds=500)))
    want, until = {}, -1
    for n in range(40, 601, 20):
        drift = limits.drift_of(values[max(0, n - 100) : n], base)
        if drift >= 0.3 and (n - 1) * 10 >= until:
            want[1, n - 1] = (n, drift, limits.severity(drift))
            until = (n - 1) * 10 + 500
    assert got == want and len(want) > 2


def test_late_events_count_as_now():
    rule = limits.token_bucket(1.0, 2.0)
    state, _ = rule.step(rule.start, 10 * S, 0.0)
    state, first = rule.step(state, 2 * S, 0.0)  # from before
    state, second = rule.step(state, 3 * S, 0.0)
    assert first == (True, "") and second == (False, "rate") and state[1] == 10 * S


@pytest.mark.parametrize("name,rule", [("bucket", limits.token_bucket(0.4, 3.0, strikes=3, blocked_seconds=5)), ("window", limits.accepted_window(6.0, 4)), ("drift", limits.drift_monitor((0.4, 0.3, 0.2, 0.4, 0.7), window=60, every=10, least=20, threshold=0.1, cooldown_seconds=20))])
def test_streams_equal_batches(spark, tmp_path, name, rule):
    rows = events(3, n=240)
    limits.rocksdb(spark)
    for i in range(3):  # three micro-batches, in order of time
        frame(spark, rows[80 * i : 80 * i + 80]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        __import__("time").sleep(1.1)  # files are read by age
    source = spark.readStream.schema("key long, at long, id long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = limits.streamed(source, rule, late_seconds=10_000).writeStream.format("memory").queryName(f"limits_{name}").option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert said(spark.table(f"limits_{name}")) == said(limits.folded(frame(spark, rows), rule))


def test_state_goes_when_it_no_longer_matters(spark, tmp_path):
    limits.rocksdb(spark)
    for i, at in enumerate((5000, 6000, 7000)):
        spark.createDataFrame([(i, at * S, i, 0.0)], "key long, at long, id long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        __import__("time").sleep(1.1)
    source = spark.readStream.schema("key long, at long, id long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = limits.streamed(source, limits.accepted_window(10.0, 2), late_seconds=1).writeStream.format("memory").queryName("limits_state").option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert spark.table("limits_state").where(F.col("allowed")).count() == 3
    assert rows[0] > 0 and rows[-1] <= rows[0]  # three keys have been seen, of which the last at most has a state

"""Genome vectors and spline layers against direct computation."""

import random

import numpy as np
import pytest

from strandlake.operators import genome_vectors as G
from strandlake.operators.splines import basis, spline_encode, spline_layer

KINDS = [*G.TYPES, None, "odd"]


def variants(n):
    rng = random.Random(8)
    return [(rng.choice(["a", "b", None]), rng.choice(["chr1", "1", "X", "chrY", "MT", None, "CHR7"]), rng.choice([rng.randrange(10**9), None]), rng.choice(["A", "C", "AT", None]), rng.choice(["G", "T", "", None]), rng.choice(KINDS)) for _ in range(n)]


def convolved(a, b):
    n = len(a)
    return np.array([sum(a[j] * b[(i - j) % n] for j in range(n)) for i in range(n)])


def direct(rows, dimension):
    book = G.Codebook(dimension)
    number = lambda c: {"1": 1, "7": 7, "X": 23, "Y": 24}.get((c or "").upper().removeprefix("CHR"), 25)
    out = {}
    for sample, chrom, pos, ref, alt, kind in rows:
        v = convolved(book.types[kind if kind in G.TYPES else "SNP"], np.roll(book.position, int((pos or 0) / 1e9 * 1000)))
        if ref in G.BASES:
            v = convolved(v, book.bases[ref])
        if alt in G.BASES:
            v = convolved(v, np.roll(book.bases[alt], 1))
        v = v + book.chromosome(number(chrom))
        n, s = out.get(sample, (0, 0))
        out[sample] = (n + 1, s + v / np.linalg.norm(v))
    for sample, (n, s) in out.items():
        r = s
        for i in range(3):
            r = convolved(r, np.roll(s, dimension // 2 ** (i + 1)))
        out[sample] = (n, r / np.linalg.norm(r))
    return out


def test_genomes_equal_direct_sums_however_they_are_dealt(spark, monkeypatch):
    rows = variants(60)
    rows += rows[:5]
    want = direct(rows, 32)
    seen = []
    for parts, held in ((1, 64), (7, 64), (3, 1)):
        monkeypatch.setattr(G, "HELD", held)
        df = spark.createDataFrame(rows, "sample string, chrom string, pos long, ref string, alt string, kind string").repartition(parts)
        got = {r["sample"]: (r["n"], r["vector"]) for r in G.genome_vectors(df, dimension=32).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(np.allclose(got[k][1], want[k][1], atol=1e-9) for k in want)
        seen.append(got)
    assert seen[0] == seen[1] == seen[2]  # to the last bit
    assert G.genome_vectors(df.limit(0), dimension=32).count() == 0


def test_sequences_equal_moved_sums(spark):
    rows = [(1, "ACGTNacgt" * 9), (2, ""), (3, None), (4, "NNé-"), (5, "G" * 100_000)]
    got = {r["id"]: np.array(r["vector"]) for r in G.sequence_vectors(spark.createDataFrame(rows, "id long, text string"), dimension=16).collect()}
    book = G.Codebook(16)
    for i, text in rows:
        v = np.zeros(16)
        for j, letter in enumerate((text or "").upper()):
            if letter in G.BASES:
                v = v + np.roll(book.bases[letter], j)
        want = v / np.linalg.norm(v) if np.linalg.norm(v) else v
        assert np.allclose(got[i], want, atol=1e-9)


def cox_de_boor(x, t, i, p):
    if p == 0:
        return float(t[i] <= x < t[i + 1])
    return (x - t[i]) / (t[i + p] - t[i]) * cox_de_boor(x, t, i, p - 1) + (t[i + p + 1] - x) / (t[i + p + 1] - t[i + 1]) * cox_de_boor(x, t, i + 1, p - 1)


@pytest.mark.parametrize("knots,degree", [(10, 3), (4, 1), (6, 2), (2, 3)])
def test_basis_equals_the_recursion(spark, knots, degree):
    h = 2 / (knots - 1)
    t = [-1 + h * (i - degree) for i in range(knots + 2 * degree)]
    xs = [-1.0, -0.999, -0.3, 0.0, 0.123, 0.5, 0.998, 1.0, 7.0, -7.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, b in df.select("x", basis(df["x"], knots, degree)).collect():
        inside = min(max(x, -1.0), 1 - 1e-12)
        want = [cox_de_boor(inside, t, i, degree) for i in range(knots + degree - 1)]
        got = [0.0] * len(want)
        for k, w in b:
            got[k] += w
        assert abs(sum(got) - 1) < 1e-9 and np.allclose(got, want, atol=1e-9)


def test_layers(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(2, 3, 12))
    layer = spark.createDataFrame([(o, i, k, float(c[o, i, k])) for o in range(2) for i in range(3) for k in range(12)], "output int, input int, k int, c double")
    rows = [(1, [0.1, -0.5, 0.9]), (2, [2.0, None, -1.0]), (3, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    t = [-1 + 2 / 9 * (i - 3) for i in range(16)]
    clamp = lambda x: min(max(x or 0.0, -1.0), 1 - 1e-12)
    want = {i: [np.tanh(sum(c[o, j, k] * cox_de_boor(clamp(v[j]), t, k, 3) for j in range(3) for k in range(12))) for o in range(2)] for i, v in rows if v}
    got = {r["id"]: r["vector"] for r in spline_layer(df, layer).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-9) for i in want)
    assert spline_encode(df, []).count() == 3


def test_biological_similarities(spark):
    from pyspark.sql import functions as F

    from strandlake.functions import encoders as E

    rows = [(1, [1.0, 2.0, 2.0, 4.0], [0.5, 9.0, 3.0, 3.0]), (2, [1.0, 1.0], [2.0, 3.0]), (3, [0.0, 0.0], [0.0, 0.0]), (4, [], [])]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = {r[0]: tuple(r)[1:] for r in df.select("id", E.spearman(a, b), E.haplotype(a, b), E.structural(a, b)).collect()}
    ranks = np.corrcoef([1, 2.5, 2.5, 4], [1, 4, 2.5, 2.5])[0, 1]
    assert np.allclose(got[1], (ranks, 0.0, (0.5 + 2 + 2 + 3) / 9))
    assert np.allclose(got[2], (0.0, 0.0, 1.0)) and np.allclose(got[3], (0.0, 1.0, 0.0)) and got[4] == (0.0, None, 0.0)

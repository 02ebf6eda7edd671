"""Bottleneck distances against all matchings, and slices of signals in batches and streams."""

import itertools
import math
import random

import numpy as np
import pytest

from strandlake.operators.diagrams import bottleneck, bottleneck_distances
from strandlake.sources.signals import signal_files, signal_slices


def all_matchings(a, b):
    """The least largest cost over all matchings, where each side has a place on the diagonal for every point of the other."""
    left = [*map(tuple, a), *[None] * len(b)]
    right = [*map(tuple, b), *[None] * len(a)]
    cost = lambda p, q: 0.0 if p is None and q is None else (q[1] - q[0]) / 2 if p is None else (p[1] - p[0]) / 2 if q is None else max(abs(p[0] - q[0]), abs(p[1] - q[1]))
    return min((max((cost(p, q) for p, q in zip(left, order, strict=True)), default=0.0) for order in itertools.permutations(right)), default=0.0)


def diagram(rng, n):
    return np.array([(x, x + rng.randint(0, 6) / 2) for x in (rng.randint(0, 6) / 2 for _ in range(n))], float).reshape(-1, 2)


def test_bottleneck_equals_all_matchings():
    rng = random.Random(1)
    for _ in range(250):
        a, b = diagram(rng, rng.randint(0, 3)), diagram(rng, rng.randint(0, 3))
        assert bottleneck(a, b) == pytest.approx(all_matchings(a, b))


def test_bottleneck_of_larger_diagrams():
    rng = np.random.default_rng(0)
    a = np.sort(rng.random((300, 2)) * 10, 1)
    assert bottleneck(a, a[rng.permutation(300)]) == 0.0
    assert bottleneck(a, a + 0.01) == pytest.approx(0.01, abs=1e-9)
    deaths = np.c_[np.zeros(50), np.sort(rng.random(50))], np.c_[np.zeros(40), np.sort(rng.random(40))]
    x, y = np.pad(deaths[0][::-1, 1], (0, 10)), np.pad(deaths[1][::-1, 1], (0, 20))
    assert bottleneck(*deaths) == pytest.approx(max(min(abs(p - q), max(p, q) / 2) for p, q in zip(x, y, strict=True)))


def test_bottleneck_distances(spark):
    rows = [("a", 0.0, 2.0), ("a", 1.0, None), ("b", 0.0, 2.5), ("b", 1.5, None), ("c", 0.0, 1.0), (None, 0.0, 2.0), ("a", None, 1.0)]
    diagrams = spark.createDataFrame(rows, "diagram string, birth double, death double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "missing"), ("missing", "none")], "a string, b string")
    got = {(r["a"], r["b"]): r["distance"] for r in bottleneck_distances(diagrams, pairs).collect()}
    assert got == {("a", "b"): 0.5, ("a", "c"): math.inf, ("c", "missing"): 0.5, ("missing", "none"): 0.0}


def slices_of(samples, size, overlap):
    return [(i, s, min(s + size, len(samples)), samples[s : s + size].tolist()) for i, s in enumerate(range(0, len(samples), size - overlap))]


def write(folder, name, samples, more=b""):
    (folder / f"{name}.i16").write_bytes(samples.astype("<i2").tobytes() + more)


def test_slices_in_batches_and_streams_once_each(spark, tmp_path):
    rng = np.random.default_rng(5)
    folder = tmp_path / "reads"
    folder.mkdir()
    reads = {f"r{n}": rng.integers(-32768, 32768, n) for n in (0, 1, 90, 100, 101, 1234)}
    for name, samples in reads.items():
        write(folder, name, samples)
    write(folder, "odd", np.array([1, 2]), b"\x07")
    (folder / "other.txt").write_text("no signal")
    want = sorted((name, *x) for name, s in (reads | {"odd": np.array([1, 2])}).items() for x in slices_of(s, 100, 10))
    rows = lambda df: sorted((r["read"], r["slice"], r["start"], r["stop"], list(r["samples"])) for r in df.collect())
    assert rows(signal_slices(signal_files(spark, str(folder)), 100, 10)) == want

    def run():
        stream = signal_slices(signal_files(spark, str(folder), stream=True, files_a_time=2), 100, 10)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return rows(spark.read.parquet(str(tmp_path / "out")))

    assert run() == want
    late = rng.integers(-5, 5, 205)
    write(folder, "late", late)
    assert run() == sorted([*want, *(("late", *x) for x in slices_of(late, 100, 10))])  # after a restart only the new file
    with pytest.raises(ValueError, match="overlap"):
        signal_slices(signal_files(spark, str(folder)), 10, 10)

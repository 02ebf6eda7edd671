"""Random projections of vectors, without a shuffle: the matrix is drawn from its seed in every task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("sparse", "gaussian", "orthogonal")


def matrix(kind: str, rows: int, size: int, seed: int = 0, sparsity: float = 0.1) -> np.ndarray:
    """rows x size: signs at a share of the places (sparse), normal numbers (gaussian), or orthonormal rows or columns, whichever are fewer (orthogonal).

    Sparse and gaussian ones are scaled by 1 / sqrt(share * size) and 1 / sqrt(size), so a component keeps its expected size.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown projection: {kind}")
    rng = np.random.default_rng([seed, KINDS.index(kind), rows, size])
    if kind == "gaussian":
        return rng.standard_normal((rows, size)) / np.sqrt(size)
    if kind == "sparse":
        if not 0 < sparsity <= 1:
            raise ValueError("sparsity must be above 0 and at most 1")
        u = rng.random((rows, size))
        return ((u < sparsity / 2) * 1.0 - ((u >= sparsity / 2) & (u < sparsity))) / np.sqrt(sparsity * size)
    q, r = np.linalg.qr(rng.standard_normal((max(rows, size), min(rows, size))))
    q = q * np.where(np.diag(r) < 0, -1.0, 1.0)  # one answer, whatever signs the factorisation takes
    return q if rows >= size else q.T


def project(vectors: DataFrame, rows: int, size: int, kind: str = "sparse", seed: int = 0, sparsity: float = 0.1) -> DataFrame:
    """vectors (id, vector) of `size` components to (id, vector) of `rows`; a null vector, or one with another size or null components, is null."""
    matrix(kind, 1, 1, seed, sparsity)  # a wrong kind fails here
    of = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matrix(kind, rows, size, seed, sparsity).T
        for batch in batches:
            lists = batch.column(1).to_pylist()
            good = [i for i, v in enumerate(lists) if v is not None and len(v) == size and None not in v]
            out: list = [None] * len(lists)
            if good:
                for i, v in zip(good, (np.array([lists[i] for i in good], float) @ m).tolist(), strict=True):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["id", "vector"])

    return vectors.select("id", "vector").mapInArrow(run, f"id {of}, vector array<double>")

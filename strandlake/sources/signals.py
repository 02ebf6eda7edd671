"""Raw signals of reads as overlapping slices: the same function for a batch of files and for a stream of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Samples of all slices in a batch that comes back.
BATCH_SAMPLES = 1 << 20
SCHEMA = "read string, slice long, start long, stop long, samples array<short>"


def signal_files(spark: SparkSession, folder: str, stream: bool = False, files_a_time: int = 1000) -> DataFrame:
    """The files <read>.i16 of a folder, as Spark's binary files: partitioned by files, and as a stream each file once, also after a restart."""
    if not stream:
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.i16").load(folder)
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.i16").option("maxFilesPerTrigger", files_a_time).load(folder)


def signal_slices(files: DataFrame, size: int = 50_000, overlap: int = 1_000) -> DataFrame:
    """Files (path, content: little-endian 16-bit samples) to (read, slice from 0, start, stop, samples).

    A slice has `size` samples and begins size - overlap after the one before it; slices begin as long as there is a sample, so the last
    ones are short. An empty file has no slice; an odd last byte is left out. A file is one value, which Spark bounds at 2 GB.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                samples = np.frombuffer(data, "<i2", len(data) // 2) if data is not None else np.zeros(0, "<i2")
                read = path.rsplit("/", 1)[-1].removesuffix(".i16")
                starts = np.arange(0, len(samples), size - overlap)
                some = max(1, BATCH_SAMPLES // size)
                for i in range(0, len(starts), some):
                    own = starts[i : i + some]
                    stops = np.minimum(own + size, len(samples))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(stops - own)]), pa.int32()), pa.array(np.concatenate([samples[a:b] for a, b in zip(own, stops, strict=True)]).astype(np.int16)))
                    yield pa.RecordBatch.from_arrays([pa.array([read] * len(own)), pa.array(np.arange(i, i + len(own))), pa.array(own), pa.array(stops), lists], ["read", "slice", "start", "stop", "samples"])

    return files.select("path", "content").mapInArrow(cut, SCHEMA)

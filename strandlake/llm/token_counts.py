"""Token counts of whole texts, by a public tokenizer in Arrow batches that return lengths only.

Texts are cut at safe boundaries: before a single space, tab or line feed between two characters that aren't
white space, and after a full-width stop or comma before a letter. The byte-level pre-tokenizer starts a new piece at
each of these, whatever stands around it, and no special token of these vocabularies holds one, so counts of the parts
add up to the text's count. So prose is cut into words. Parts recur: each distinct one is encoded once per
task as long as it fits a bounded memo, and unknown ones are encoded in batches of about equal bytes.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import byte_chunks

#: Bytes of texts that are looked at together, bytes in a call of the encoder, distinct parts in the memo, and the longest part it keeps.
BATCH_BYTES, CALL_BYTES, MEMO, LONGEST = 1 << 20, 1 << 16, 300_000, 64
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n]\S)|(?<=[。！？，、；：])(?=[^\W\d_])")


def parts_of(text: str) -> list[str]:
    """text, cut at its safe boundaries; the parts are the whole text in order."""
    return _SAFE.split(text)


class Counter:
    """Counts tokens with one tokenizer, which is loaded once in a worker process."""

    _loaded: dict[str, Counter] = {}

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(public_tokenizers.path(name))
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.memo: dict[str, int] = {}

    @classmethod
    def of(cls, name: str) -> Counter:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel already
        if name not in cls._loaded:
            cls._loaded[name] = cls(name)
        return cls._loaded[name]

    def lengths(self, parts: list[str]) -> list[int]:
        """The count of each part, encoded in calls of about CALL_BYTES."""
        out, start = [], 0
        sizes = [len(x.encode()) for x in parts]
        while start < len(parts):
            end, held = start, 0
            while end < len(parts) and (end == start or held + sizes[end] <= CALL_BYTES):
                held += sizes[end]
                end += 1
            out += [len(x) for x in self.encoder.encode_batch_fast(parts[start:end], add_special_tokens=False)]
            start = end
        return out

    def count(self, texts: list[str]) -> list[int]:
        parts = [parts_of(x) for x in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list({p for x in parts for p in x}.difference(self.memo))
        self.memo.update(zip(new, self.lengths(new), strict=True))
        out = [sum(map(self.memo.__getitem__, x)) for x in parts]
        for p in new:
            if len(p) > LONGEST:
                del self.memo[p]
        return out


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as an empty one: 0 and 0. Ids are passed through, null and repeated ones too.
    No begin, end or other special tokens are added; strings of special tokens inside a text are what
    the library takes them for by default. Nothing is truncated or padded: a very long text is counted in parts, and
    one without a safe boundary as a whole. An empty table gives no rows; other columns aren't read.
    """

    def run(batches):
        counter = Counter.of(tokenizer)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for _, part in byte_chunks(batch.column(1), BATCH_BYTES):
                n_bytes += pa.compute.binary_length(part).to_pylist()
                n_tokens += counter.count(part.to_pylist())
            over = np.array(n_tokens, np.int64) > limit
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

"""Toxicity of whole texts, by averaged subword-bag embeddings and a linear softmax.

A text's words are runs of bytes between white space and ASCII punctuation, A-Z lower-cased. A word's units
are itself and its n-grams of bytes, with a mark at both ends; each unit is a hashed row of an embedding
table, so a misspelling that was never seen shares most of its vectors with the word. The units of a passage
of a few words are averaged and classified by a softmax over two classes. Embeddings and softmax are trained
jointly in numpy. Labels hold for texts, not passages, so each round takes the passage that looks most toxic
of each toxic text and all passages of the others. A text's score is that of its most toxic passage,
calibrated on whole texts.

Once trained, the softmax applied to one row of the table is a number, and a passage's logit is the mean of
those: scoring needs no vectors, only one lookup a unit.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import _LOWER, _power, byte_chunks, mix

#: Size of the table, of a vector, n-grams, words of a passage.
BUCKETS, DIM, GRAMS, PASSAGE = 1 << 18, 4, (3, 4, 5), 12
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Values of the bytes; all that isn't part of a word is one mark.
_VALUE = mix(np.where(_WORD, _LOWER, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per unit of a chunk of texts: its bucket and its passage; and the first passage of each text (one more at the end)."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    # one mark before each text and one at the end
    at = offsets - offsets[0]
    raw = np.insert(raw, at, 0x20)
    at = at + np.arange(n + 1)
    word = _WORD[raw]
    starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    first = np.searchsorted(starts, at)
    counts = np.diff(first)
    passages = np.append(0, np.cumsum(-(-counts // PASSAGE)))
    own = np.arange(len(starts)) - np.repeat(first[:-1], counts)
    passage = np.repeat(passages[:-1], counts) + own // PASSAGE  # of each word
    up, down = _power(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[: len(raw)], out=sums[1:])
    mask = np.uint64(BUCKETS - 1)
    buckets, where = [mix((sums[ends] - sums[starts]) * down[starts]) & mask], [passage]
    begun = np.zeros(len(raw) + 1, np.int64)
    begun[1:] = np.cumsum(np.concatenate([[False], word[1:] & ~word[:-1]]))
    marks = np.zeros(len(raw) + 1, np.int32)
    marks[1:] = np.cumsum(~word)
    for size in GRAMS:
        m = len(raw) - size + 1
        if m <= 0:
            continue
        # no mark but at the ends, and a word of at least size - 2 bytes in it
        ok = np.flatnonzero(marks[size - 1 : size - 1 + m] == marks[1 : m + 1])
        buckets.append(mix((sums[ok + size] - sums[ok]) * down[ok] + np.uint64(size)) & mask)
        where.append(passage[begun[ok + 2] - 1])
    return np.concatenate(buckets), np.concatenate(where), passages


@dataclass
class Model:
    """weight of each bucket and bias: a passage's logit; slope and shift: from a text's highest logit to its score's."""

    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def passages(self, bucket: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
        counts = np.bincount(passage, minlength=n)
        return np.bincount(passage, self.weight[bucket], n) / np.maximum(counts, 1) + self.bias

    def highest(self, texts: pa.Array) -> np.ndarray:
        """The highest logit of the passages of each text of a chunk; the bias for a text without words."""
        bucket, passage, first = units(texts)
        logits = np.append(self.passages(bucket, passage, first[-1]), self.bias)
        out = np.maximum.reduceat(logits, first[:-1]) if len(first) > 1 else np.zeros(0)
        return np.where(np.diff(first) > 0, out, self.bias)

    def score(self, texts: pa.Array) -> np.ndarray:
        z = np.clip(self.slope * self.highest(texts) + self.shift, -40, 40)
        return 1 / (1 + np.exp(-z))


class Sums:
    """Sums of rows by group, many times over the same pairs (row, group)."""

    def __init__(self, row: np.ndarray, group: np.ndarray, groups: int):
        order = np.argsort(group, kind="stable").astype(np.int32)
        self.row, counts = row[order], np.bincount(group, minlength=groups)
        self.some = np.flatnonzero(counts)
        self.first = np.append(0, np.cumsum(counts))[self.some]
        self.groups = groups

    def of(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((self.groups, rows.shape[1]), np.float32)
        if len(self.some):
            for d in range(rows.shape[1]):  # a column at a time is several times faster than rows of a few numbers
                out[self.some, d] = np.add.reduceat(np.ascontiguousarray(rows[:, d])[self.row], self.first)
        return out


def train(texts: pa.Array, labels: np.ndarray, rounds: int = 5, steps: int = 10, rate: float = 0.1, decay: float = 0.5, least: int = 5, seed: int = 11) -> Model:
    """A model from whole texts and their labels, by full-batch Adam. Without both labels, a constant one.

    A unit of fewer than least texts has a zero vector: it can say nothing beyond the texts it stands in. Half
    of this will do with few toxic texts. Vectors of a passage are summed over its words, and a word's over its units.
    """
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    constant = Model(np.zeros(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share))))
    if not 0 < labels.sum() < len(labels):
        return constant
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    ids: dict[bytes, int] = {}
    found, counts = array("i"), []
    for x in texts:
        own = re.findall(rb"[0-9a-z\x80-\xff]+", str(x).encode().lower())
        found.extend(ids.setdefault(w, len(ids)) for w in own)
        counts.append(len(own))
    words, counts = np.array(found, np.int32), np.array(counts)
    doc_of_word = np.repeat(np.arange(len(labels), dtype=np.int32), counts)
    per_doc = -(-counts // PASSAGE)
    first = np.append(0, np.cumsum(per_doc))
    passage = (first[doc_of_word] + (np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)) // PASSAGE).astype(np.int32)
    doc, n = np.repeat(np.arange(len(labels)), per_doc), int(first[-1])
    bucket, word = [], []
    base = 0
    for _, part in byte_chunks(pa.array([w.decode(errors="replace") for w in ids], pa.large_string())):
        b, w, _ = units(part)
        bucket.append(b.astype(np.int32))
        word.append((w + base).astype(np.int32))
        base += len(part)
    bucket, word = np.concatenate(bucket), np.concatenate(word)
    size = np.maximum(np.bincount(passage, np.bincount(word, minlength=len(ids))[words], n), 1)[:, None].astype(np.float32)
    # how many texts have a unit, a few texts at a time
    lists = np.argsort(word, kind="stable").astype(np.int32)
    starts = np.searchsorted(word[lists], np.arange(len(ids) + 1))
    spread_over = np.zeros(BUCKETS, np.int32)
    ends = np.append(0, np.cumsum(counts))
    for d in range(len(labels)):
        own = np.unique(words[ends[d] : ends[d + 1]])
        if len(own):
            spread_over[np.unique(bucket[np.concatenate([lists[starts[w] : starts[w + 1]] for w in own])])] += 1
    known = spread_over[bucket] >= (least if labels.sum() >= 100 else max(2, least // 2))
    if not known.any():
        return constant
    used, bucket = np.unique(bucket[known], return_inverse=True)
    bucket = bucket.astype(np.int32)
    to_word, to_unit = Sums(bucket, word[known], len(ids)), Sums(word[known], bucket, len(used))
    to_passage, back_to_word = Sums(words, passage, n), Sums(passage, words, len(ids))
    rng = np.random.default_rng(seed)
    table = (rng.normal(size=(len(used), DIM)) * 0.1).astype(np.float32)
    softmax = (rng.normal(size=(DIM, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (table, softmax, bias)]
    toxic, step = labels[doc] == 1, 0
    for turn in range(rounds):
        chosen = np.ones(n, bool)
        if turn:
            z = to_passage.of(to_word.of(table)) / size @ softmax + bias
            logit = z[:, 1] - z[:, 0]
            top = np.full(len(labels), -np.inf)
            np.maximum.at(top, doc, logit)
            chosen = logit >= top[doc]
        # a text's most toxic passage stands for it; of the others' all passages count, and that one as much as the rest of its text's together
        one = np.where(toxic, chosen, 1 / per_doc[doc] + (chosen if turn else 0))
        weight = (one / np.where(toxic, one[toxic].sum(), one[~toxic].sum())).astype(np.float32)
        target = np.stack([~toxic, toxic], axis=1).astype(np.float32)
        for _ in range(steps):
            step += 1
            mean = to_passage.of(to_word.of(table)) / size
            z = mean @ softmax + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (p - target) * weight[:, None]
            grads = [to_unit.of(back_to_word.of((error @ softmax.T) / size)) + decay / len(used) * table, mean.T @ error, error.sum(axis=0)]
            for x, g, s in zip((table, softmax, bias), grads, state, strict=True):
                s[0] += 0.1 * (g - s[0])
                s[1] += 0.01 * (g * g - s[1])
                x -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-7)
    weight = np.zeros(BUCKETS)
    weight[used] = table @ (softmax[:, 1] - softmax[:, 0])
    model = Model(weight, float(bias[1] - bias[0]))
    # calibration on whole texts: logistic regression on the highest logit, by Newton's steps
    x = np.concatenate([model.highest(part) for _, part in byte_chunks(texts)])
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    theta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.eye(2) * 1e-1
        theta -= np.linalg.solve(h, a.T @ ((p - labels)) + 1e-1 * theta)
    model.slope, model.shift = float(theta[0] / scale), float(theta[1])
    return model


def fit_rows(docs: DataFrame, labels: DataFrame, most: int, folds: int, held_out: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """At most most labelled rows outside the held-out fold, up to a quarter of them toxic, the first by a hash of the id."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~in_fold(F.col("id"), folds, held_out))
    usable = usable.groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.lit(23), "id")
    some = usable.where("label = 1").orderBy(order).limit(most // 4).unionByName(usable.where("label = 0").orderBy(order).limit(most - most // 4))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # most rows at most are broadcast; an id that docs repeat is fitted on once, by the smallest of its texts
    return texts.join(F.broadcast(some), "id").groupBy("id", "label").agg(F.min("text").alias("text"))


def in_fold(id_, folds: int, fold: int):
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def _trainer(batches):
    """mapInArrow over (id, label, text), in order: one row with the trained model."""
    parts = [(x.column(1).to_numpy(), x.column(2).cast(pa.large_string()).fill_null("")) for x in batches]
    labels, texts = zip(*parts, strict=True) if parts else ((np.zeros(0, int),), (pa.array([], pa.large_string()),))
    model = train(pa.concat_arrays(texts), np.concatenate(labels).astype(int))
    weight = pa.array([model.weight.astype(np.float32).tobytes()], pa.binary())
    yield pa.RecordBatch.from_arrays([weight, *(pa.array([float(x)]) for x in (model.bias, model.slope, model.shift))], ["weight", "bias", "slope", "shift"])


def fitted(rows: DataFrame) -> Model:
    """The model over fit_rows, trained by one task: what it reads is bounded, and the driver sees weights only."""
    ordered = rows.select(F.xxhash64("id").alias("id"), F.col("label").cast("int").alias("label"), "text").repartition(1).sortWithinPartitions("id", F.xxhash64("text"))
    found = ordered.mapInArrow(_trainer, "weight binary, bias double, slope double, shift double").collect()
    if not found:  # no task ran, as there are no rows
        return train(pa.array([], pa.large_string()), np.zeros(0, int))
    return Model(np.frombuffer(found[0]["weight"], np.float32).astype(float), found[0]["bias"], found[0]["slope"], found[0]["shift"])


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = 2000, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", through: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id (or the columns of docs in through), held_out, score (0 to 1), predicted (1 if score >= 0.5).

    The model is fitted on at most most labelled rows whose crc32(id as text) mod folds isn't held_out; all rows
    are scored on whole texts, each by itself, repeated ones too. Labels that are null or neither 0 nor 1 are
    ignored; of several for an id the highest holds. A null or wordless text gets the score of a passage without
    units. Without labels all scores are 0.5. An empty table gives no rows.
    """
    model = fitted(fit_rows(docs, labels, most, folds, held_out, id_col, text_col, label_col))
    given = docs.sparkSession.sparkContext.broadcast(model)

    # a text that goes through is sent to Python once
    inside = text_col in through and docs.schema[text_col].dataType.simpleString() == "string"

    def run(batches):
        model = given.value
        for batch in batches:
            texts = batch.column(0).field(text_col) if inside else batch.column(2)
            score = np.concatenate([model.score(part) for _, part in byte_chunks(texts)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["row", "held_out", "score", "predicted"])

    row = F.struct(*through or [id_col])
    pairs = docs.select(row.alias("row"), in_fold(F.col(id_col), folds, held_out).alias("held_out"), *([] if inside else [F.col(text_col).cast("string").alias("text")]))
    kind = pairs.schema["row"].dataType.simpleString()
    return pairs.mapInArrow(run, f"row {kind}, held_out boolean, score double, predicted int").select("row.*", "held_out", "score", "predicted")

"""Language-model scores from a probabilistic suffix tree over words.

Symbols are lower-cased words and one end mark per text. The root is the add-one unigram base. A state is a
context of the last words of a text, with counts of its own for some next symbols. It is retained if its
next-symbol distribution diverges from that of its longest retained suffix by at least divergence (relative
entropy, in base-10 units). A symbol is scored in the state of the longest retained suffix, where

    P(w | s) = (C(s, w) + (C(s) - sum of own counts + BACK) * P(w | suffix of s)) / (C(s) + BACK)

which sums to one, as the root does over V words and one unknown word.

The tree has two parts. Frequent contexts, of one to depth words, are those whose share of all training symbols
is at least p_context; they have own counts for next words whose joint share is at least p_next. There are at most
depth / p_context of them and depth / p_next counts, so they are broadcast. Every other context of two words is kept by
a constant count, so what is learnt from these grows with the corpus: it needs LEAST occurrences and a next word
seen LEAST times behind it, be it frequent or rare. They are tables, dealt by the hash of the context into buckets of a bounded size, and
symbols behind them meet them there; as frequent contexts are left out, no bucket is hot.

Counts of single words grow with the corpus too: the most frequent ones are broadcast, all that can reach p_next among them, and each other word
of a text meets its count in a join. So do such words that have own counts in the tables: a symbol's probability in the
states above is a known multiple of what the root gives it, and the table's bucket is sent the word's count.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .frames import kept
from .words import _BASE, byte_chunks, hashed, mix

BACK = 2.0
#: Words that are broadcast at least, if there are as many. If FREQUENT isn't None, only so many words have own counts.
BROADCAST, FREQUENT = 262_144, None
#: Occurrences that a context of the tables needs, and a word behind it for an own count.
LEAST = 2
#: Symbols a bucket of the tables has, about; bits of the broadcast filter for each context, and the most of all (128 MB).
BUCKET, FILTER_BITS, FILTER_LOG = 1 << 17, 8, 30
#: Gains that a task holds before it adds them up by text.
HELD = 4_000_000
#: Bytes of text whose symbols are worked on at once, and what marks the codes of words that aren't broadcast.
CHUNK, RARE = 1 << 16, np.uint64(1 << 63)
DIVERGENCE = 0.05
END = np.uint64(0x5851F42D4C957F2D)
NONE = np.zeros(0, np.uint64)


def symbols(texts: pa.Array):
    """Per chunk: the hash of each symbol, and the first symbol of each text (one more at the end)."""
    for _, part in byte_chunks(texts, CHUNK):
        words, first = hashed(part)
        ends = first[1:] + np.arange(len(part))
        out = np.full(len(words) + len(part), END, np.uint64)
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside] = words
        yield out, np.concatenate([[0], ends + 1])


def contexts(words: np.ndarray, first: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each depth from 1, the hash of as many symbols before each symbol of the same text; 0 where there are fewer."""
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    out, grams = [], words
    for d in range(1, depth + 1):
        grams = mix(grams[:-1] * _BASE + words[d - 1 :]) if d > 1 else words
        s = np.zeros(len(words), np.uint64)
        s[d:] = grams[: max(0, len(words) - d)]
        s[place < d] = 0
        out.append(s)
    return out


class Index:
    """Sorted hashes, and where each run of equal leading bits starts: hashes spread evenly, so a few steps find one."""

    def __init__(self, table: np.ndarray):
        self.table, self.shift = np.append(table, ~np.uint64(0)), np.uint64(63 - len(table).bit_length())
        runs = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.start = np.searchsorted(table, runs).astype(np.int32)

    def place(self, values: np.ndarray) -> np.ndarray:
        """The place of each value in the table, or -1."""
        at = self.start[(values >> self.shift).astype(np.int64)]
        found = self.table[at]
        todo = np.flatnonzero(found < values)
        while len(todo):
            at[todo] += 1
            found[todo] = self.table[at[todo]]
            todo = todo[found[todo] < values[todo]]
        return np.where((found == values) & (at < len(self.table) - 1), at, -1)


def joint_key(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(s * np.uint64(3) + w)


@dataclass
class Level:
    """Retained contexts of one depth: sorted hashes, counts, sums of own counts; sorted keys of (context, word) and own counts."""

    contexts: np.ndarray
    total: np.ndarray
    own: np.ndarray
    keys: np.ndarray
    joint: np.ndarray

    @cached_property
    def by_context(self) -> Index:
        return Index(self.contexts)

    @cached_property
    def by_key(self) -> Index:
        return Index(self.keys)


@dataclass
class Tree:
    """words: sorted hashes of the most frequent symbols; n symbols and v different ones in training; frequent: the contexts of two words that aren't for the tables."""

    words: np.ndarray
    counts: np.ndarray
    n: int
    v: int
    frequent: np.ndarray = field(default_factory=lambda: NONE)
    levels: list[Level] = field(default_factory=list)

    @cached_property
    def by_word(self) -> Index:
        return Index(self.words)

    @cached_property
    def by_frequent(self) -> Index:
        return Index(self.frequent)

    def root(self, words: np.ndarray) -> np.ndarray:
        return self.root_at(self.by_word.place(words))

    def root_at(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.counts[at] + 1, 1) / (self.n + self.v + 1) if len(self.words) else np.full(len(at), 1 / (self.n + self.v + 1))

    def behind(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the contexts of two words before symbols, the places of those for the tables, and these mixed once more."""
        place = np.flatnonzero((pairs != 0) & (self.by_frequent.place(pairs) < 0))
        return place, mix(pairs[place])

    def climb(self, p: np.ndarray, found: list[np.ndarray], words: np.ndarray) -> np.ndarray:
        """p at the root -> p in the state of the longest retained suffix; found as from contexts()."""
        p = p.copy()
        for level, s in zip(self.levels, found, strict=False):
            at = level.by_context.place(s)
            ok = np.flatnonzero(at >= 0)
            if len(ok):
                at = at[ok]
                key = level.by_key.place(joint_key(s[ok], words[ok]))
                c = np.where(key >= 0, level.joint[key], 0)
                p[ok] = (c + (level.total[at] - level.own[at] + BACK) * p[ok]) / (level.total[at] + BACK)
        return p


def _unsigned(column) -> np.ndarray:
    return np.asarray(column, np.int64).view(np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _word_counts(batches):
    for batch in batches:
        words = [w for w, _ in symbols(batch.column(0))]
        values, counts = np.unique(np.concatenate(words or [NONE]), return_counts=True)
        yield pa.RecordBatch.from_arrays([_signed(values), pa.array(counts, pa.int64())], ["w", "c"])


def _joint_counts(depth: int, given):
    """Counts by k of (candidate context of this depth, next word): the context's place times the allowed words and one, and the word's place and one; words that can't reach p_next count together as 0."""

    def run(batches):
        candidates, allowed = (Index(x) for x in given.value)
        size = len(given.value[1]) + 1
        for batch in batches:
            held = [np.zeros(0, np.int64)]
            for words, first in symbols(batch.column(0)):
                at = candidates.place(contexts(words, first, depth)[-1])
                ok = np.flatnonzero(at >= 0)
                held.append(at[ok].astype(np.int64) * size + allowed.place(words[ok]) + 1)
            k, c = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c, pa.int64())], ["k", "c"])

    return run


def _level(tree: Tree, candidates: np.ndarray, suffixes: list[np.ndarray], total: np.ndarray, at: np.ndarray, w: np.ndarray, c: np.ndarray, divergence: float) -> Level:
    """The contexts that the divergence test retains. Of each candidate, sorted, its suffixes and total; of each pair its candidate's place, the next word and the count."""
    s, n = candidates[at], len(candidates)
    back = tree.climb(tree.root(w), [u[at] for u in suffixes], w)
    here = c / total[at]
    mass, below = np.bincount(at, here, n), np.bincount(at, back, n)
    rest, rest_below = np.maximum(1 - mass, 0), np.maximum(1 - below, 1e-12)
    kl = np.bincount(at, here * np.log10(here / back), n) + np.where(rest > 0, rest * np.log10(np.maximum(rest, 1e-12) / rest_below), 0)
    keep = (kl >= divergence) & (mass > 0)
    mine = keep[at]
    keys = joint_key(s[mine], w[mine])
    place = np.argsort(keys)
    own = np.bincount(at, c, n).astype(np.int64)
    return Level(candidates[keep], total[keep], own[keep], keys[place], c[mine][place].astype(np.int64))


def learn(texts: DataFrame, depth: int = 3, p_context: float = 2e-5, p_next: float = 5e-6, divergence: float = DIVERGENCE) -> tuple[Tree, DataFrame]:
    """The tree over a one-column DataFrame of texts, and the counts (w, c) of all symbols."""
    context = texts.sparkSession.sparkContext
    counts = kept(texts.mapInArrow(_word_counts, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")))
    all_ = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    # no more than 1 / p_next words reach that share, so all that can have own counts behind a frequent context are among these
    top = counts.orderBy(F.desc("c"), "w").limit(FREQUENT or max(BROADCAST, int(1 / p_next))).toPandas()
    order = np.argsort(_unsigned(top["w"]))
    tree = Tree(_unsigned(top["w"])[order], top["c"].to_numpy(np.int64)[order], all_["n"] or 0, all_["v"])
    least, least_next = (max(2, math.ceil(p * tree.n)) for p in (p_context, p_next))
    candidates, allowed = tree.words[(tree.counts >= least) & (tree.words != END)], tree.words[tree.counts >= least_next]
    suffixes: list[np.ndarray] = []
    size = len(allowed) + 1
    for d in range(1, depth + 1):
        given = context.broadcast((candidates, allowed))
        joint = kept(texts.mapInArrow(_joint_counts(d, given), "k long, c long").groupBy("k").agg(F.sum("c").alias("c")))
        totals = joint.groupBy(F.expr(f"k div {size}").alias("s")).agg(F.sum("c").alias("total")).toPandas()
        pairs = joint.where((F.col("k") % size != 0) & (F.col("c") >= least_next)).orderBy("k").toPandas()
        total = np.zeros(len(candidates), np.int64)
        total[totals["s"].to_numpy(np.int64)] = totals["total"].to_numpy(np.int64)
        k, c = pairs["k"].to_numpy(np.int64), pairs["c"].to_numpy(float)
        at, w = k // size, allowed[k % size - 1]
        tree.levels.append(_level(tree, candidates, suffixes, total, at, w, c, divergence))
        more = (c >= least) & (w != END)
        at, w = at[more], w[more]
        longer = mix(candidates[at] * _BASE + w)
        order = np.argsort(longer)
        suffixes = [x[order] for x in (w, *(mix(u[at] * _BASE + w) for u in suffixes))]
        candidates = longer[order]
        if d == 1:
            tree.frequent = candidates
        if not len(candidates):
            break
    return tree, counts


def _dealt(h: np.ndarray, bits: int) -> tuple[np.ndarray, list[int], np.ndarray]:
    """The order by bucket (the hash's first bits) that keeps rows of one bucket as they stand, the buckets that occur, and where each starts (one more at the end)."""
    bucket = (h >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32) if bits else np.zeros(len(h), np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order].astype(np.int64)
    start = np.flatnonzero(np.diff(bucket, prepend=-1))
    return order, bucket[start].tolist(), np.append(start, len(h))


def _summed(h: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (h, w) in order, with their sums of c."""
    order = np.argsort(h)
    h, w, c = h[order], w[order], c[order]
    same = h[1:] == h[:-1]
    several = np.flatnonzero(np.append(same, False) | np.append(False, same))
    order = several[np.lexsort((w[several], h[several]))]
    w[several], c[several] = w[order], c[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]))) if len(h) else np.zeros(0, int)
    return h[new], w[new], np.add.reduceat(c, new, dtype=np.int32) if len(new) else c


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower and upper 16 bits of integers: the upper ones are few different values, which the shuffle compresses."""
    return x.astype(np.uint16), (x >> 16).astype(np.uint16)


def _whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) | high.astype(np.int64) << 16


def _coded(low: np.ndarray, high: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Codes of words: their places among the broadcast ones, and the marked hashes of all others, whose place is -1."""
    at = _whole(low, high)
    code = at.astype(np.uint64)
    code[at == 0xFFFFFFFF] = rare | RARE
    return code


def _packed(buckets: list[int], parts: list[list[np.ndarray]]) -> list[pa.Array]:
    return [pa.array(buckets, pa.int64()), pa.array([[x.tobytes() for x in row] for row in parts], pa.list_(pa.binary()))]


def _by_bucket(batches, names: tuple[str, ...], key: str = "bucket"):
    """(bucket, its rows as tuples of the named columns) of batches that are sorted by bucket, or by another key."""
    now, rows = None, []
    for batch in batches:
        for bucket, *row in zip(batch.column(key).to_pylist(), *(batch.column(x).to_pylist() for x in names), strict=True):
            if bucket != now and rows:
                yield now, rows
                rows = []
            now = bucket
            rows.append(row)
    if rows:
        yield now, rows


def _joined(parts: list[list[bytes]], types: tuple) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(p[i], t) for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate(types)]


_PAIRS, _TABLE, _RARE = (np.uint64, np.uint16, np.uint16, np.uint16, np.uint16, np.uint64), (np.uint64, np.int64, np.int32, np.uint64, np.int32), (np.uint64, np.int64)
_MET, _GAINS = (np.uint16, np.uint16, np.uint64, np.uint16, np.uint16, np.float32, np.uint64), (np.uint16, np.uint16, np.float32)


def _rare_parts(rare: np.ndarray, start: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """The hashes of the rare words of each bucket."""
    ends = np.append(0, np.cumsum(rare))[start]
    words = words[rare]
    return [words[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _pairs(given, bits: int):
    """Per batch and bucket: contexts for the tables, next words and counts."""

    def run(batches):
        tree = given.value
        for batch in batches:
            found = []
            for words, first in symbols(batch.column(0)):
                place, h = tree.behind(contexts(words, first, 2)[1])
                at = tree.by_word.place(words[place])
                found.append((h, np.where(at >= 0, at.astype(np.uint64), words[place] | RARE)))
            if not found:
                continue
            h, w = (np.concatenate(x) for x in zip(*found, strict=True))
            order, buckets, start = _dealt(h, bits)
            h, w = h[order], w[order]
            parts = []
            for a, b in zip(start[:-1], start[1:], strict=True):
                s, next_, c = _summed(h[a:b], w[a:b], np.ones(b - a, np.int32))
                rare = next_ >= RARE
                parts.append([s, *_halves(np.where(rare, -1, next_.astype(np.int64))), *_halves(c), next_[rare]])
            yield pa.RecordBatch.from_arrays(_packed(buckets, parts), ["bucket", "parts"])

    return run


def _bucket_table(rare: bool):
    """Per bucket: the contexts that may be retained, occurrences, how many own counts; and codes of next words and counts of these. Rare words have own counts if rare."""

    def run(batches):
        for bucket, rows in _by_bucket(batches, ("parts",)):
            h, low, high, c, more, words = _joined([r[0] for r in rows], _PAIRS)
            h, w, c = _summed(h, _coded(low, high, words), _whole(c, more))
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            own = (c >= LEAST) & (rare | (w < RARE))
            many = np.add.reduceat(own, new, dtype=np.int32)
            table = [h[new][many > 0], np.add.reduceat(c, new, dtype=np.int64)[many > 0], many[many > 0], w[own], c[own]]
            if len(table[0]):
                yield pa.RecordBatch.from_arrays(_packed([bucket], [table]), ["bucket", "parts"])

    return run


def _rare_words(batches):
    """(bucket, w): the rare words that have own counts in a bucket, marked."""
    for batch in batches:
        for bucket, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = np.frombuffer(parts[3], np.uint64)
            w = np.unique(w[w >= RARE])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), bucket)), _signed(w)], ["bucket", "w"])


def _rare_counts(batches):
    """(bucket, w, c) -> per bucket the words and counts, of as many rows at once as a task holds gains."""
    held: list[list[np.ndarray]] = []

    def packed():
        bucket, w, c = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(bucket, kind="stable")
        bucket, w, c = bucket[order], w[order], c[order]
        start = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        parts = [[w[a:b], c[a:b]] for a, b in zip(start[:-1], start[1:], strict=True)]
        return pa.RecordBatch.from_arrays(_packed(bucket[start[:-1]].tolist(), parts), ["bucket", "parts"])

    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in range(3)])
        if sum(len(x[0]) for x in held) > HELD:
            yield packed()
    if held:
        yield packed()


def _filter_slices(bits: int, log: int):
    def run(batches):
        for batch in batches:
            for bucket, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flags = np.zeros(1 << (log - bits), bool)
                flags[((np.frombuffer(parts[0], np.uint64) << np.uint64(bits)) >> np.uint64(64 - log + bits)).astype(np.int64)] = True
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([np.packbits(flags).tobytes()], pa.binary())], ["bucket", "slice"])

    return run


def tables(texts: DataFrame, given, n: int) -> tuple[DataFrame, int, np.ndarray]:
    """The contexts of the tables by bucket, the bits of a bucket, and a filter that passes each of these contexts and few others.

    Buckets grow in number, not in size. The filter has FILTER_BITS to twice as many bits a context up to 2 ** FILTER_LOG; beyond
    that it passes more symbols to the buckets, where all that have no context there come to nothing.
    """
    bits = min(24, max(0, math.ceil(math.log2(max(n, 1) / BUCKET))))
    dealt = texts.mapInArrow(_pairs(given, bits), "bucket long, parts array<binary>").repartition("bucket").sortWithinPartitions("bucket")
    table = kept(dealt.mapInArrow(_bucket_table(FREQUENT is None), "bucket long, parts array<binary>"))
    contexts_ = table.agg(F.sum(F.length(F.col("parts")[0]) / 8)).first()[0] or 0
    log = min(FILTER_LOG, max(bits + 3, math.ceil(math.log2(max(contexts_, 1) * FILTER_BITS))))
    passed = np.zeros(1 << (log - 3), np.uint8)
    size = 1 << (log - bits - 3)
    for row in table.mapInArrow(_filter_slices(bits, log), "bucket long, slice binary").toLocalIterator():
        passed[row["bucket"] * size : (row["bucket"] + 1) * size] = np.frombuffer(row["slice"], np.uint8)
    return table, bits, passed


def _passes(passed: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(62 - len(passed).bit_length())).astype(np.int64)
    return (passed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _gains(table: list[bytes], known: list[list[bytes]], met: list[list[bytes]], bits: int, divergence: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, gain) of a bucket's symbols: what they are likelier in retained contexts than in these contexts' suffixes, in log10."""
    s, total, many, w, c = _joined([table], _TABLE)
    own_at = np.repeat(np.arange(len(s)), many)
    own = np.bincount(own_at, c, len(s))
    # rows of a batch count from its first one
    row = np.concatenate([np.frombuffer(p[0], np.int64)[0] + _whole(np.frombuffer(p[1], np.uint16), np.frombuffer(p[2], np.uint16)) for p in met])
    _, _, h, low, high, p, rare = _joined([x[1:] for x in met], _MET)
    next_ = _coded(low, high, rare)
    at = Index(s << np.uint64(bits)).place(h << np.uint64(bits))
    ok = np.flatnonzero(at >= 0)
    row, at, next_, p = row[ok], at[ok], next_[ok], p[ok].astype(float)
    keys = joint_key(s[own_at], w)
    order = np.argsort(keys)
    pair = Index(keys[order]).place(joint_key(s[at], next_))
    has = np.flatnonzero(pair >= 0)
    own_pair = order[pair[has]]
    # what the states above give a rare word is as for a word without any count, times its count and one
    word, count = _joined(known, _RARE)
    of = np.argsort(word)
    lift = np.ones(len(w))
    lift[w >= RARE] = count[of][np.searchsorted(word[of], w[w >= RARE])] + 1
    p = p[has] * lift[own_pair]
    here = c / total[own_at]
    back = here.copy()
    back[own_pair] = p
    rest, below = np.maximum(1 - np.bincount(own_at, here, len(s)), 0), np.maximum(1 - np.bincount(own_at, back, len(s)), 1e-12)
    kl = np.bincount(own_at, here * np.log10(here / back), len(s)) + np.where(rest > 0, rest * np.log10(np.maximum(rest, 1e-12) / below), 0)
    ratio = (total - own + BACK)[at]
    ratio[has] += c[own_pair] / p
    gain = np.where(kl[at] >= divergence, np.log10(ratio / (total[at] + BACK)), 0)
    some = np.flatnonzero(gain)
    return row[some], gain[some]


def _met(given, bits: int, kind: pa.DataType):
    """Per batch a row for each text, with its scores in the broadcast part, and one for each bucket that its symbols meet."""

    def run(batches):
        tree, passed = given.value
        for batch in batches:
            texts, behind = [], []
            before = 0
            for words, first in symbols(batch.column("text")):
                at = tree.by_word.place(words)
                root = tree.root_at(at)
                found = contexts(words, first, max(2, len(tree.levels)))
                p = tree.climb(root, found, words)
                rare = at < 0
                logs = np.log10(root)
                base = np.where(rare, 0, logs)
                score = np.log10(p) - np.where(rare, logs, 0)
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                # of a text's rare words each one, and how often it has it
                mine, words_ = text[rare], words[rare]
                _, one, times = np.unique(mix(words_ + mix(mine.astype(np.uint64))), return_index=True, return_counts=True)
                order = np.argsort(one)
                one, times = one[order], times[order]
                sums = [np.bincount(text, x, len(first) - 1) for x in (~rare, base, score)]
                texts.append((np.diff(first), *sums, np.bincount(mine[one], minlength=len(first) - 1), words_[one], times))
                place, h = tree.behind(found[1])
                ok = _passes(passed, h)
                place, h = place[ok], h[ok]
                behind.append((text[place] + before, h, at[place], p[place].astype(np.float32), words[place]))
                before += len(first) - 1
            if not texts:
                continue
            n, known, base, score, lengths, rare, times = (np.concatenate(x) for x in zip(*texts, strict=True))
            row = batch.column("row").to_numpy()
            i, h, at, p, words = (np.concatenate(x) for x in zip(*behind, strict=True))
            order, buckets, start = _dealt(h, bits)
            i, h, at, p, words = i[order], h[order], at[order], p[order], words[order]
            columns = (*_halves(i), h, *_halves(at), p)
            parts = [[row[:1], *(x[a:b] for x in columns), r] for a, b, r in zip(start[:-1], start[1:], _rare_parts(at < 0, start, words), strict=True)]
            m, none = len(buckets), lambda size, of: pa.nulls(size, of)
            packed = _packed(buckets, parts)
            ends = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
            rare, times = pa.ListArray.from_arrays(ends, _signed(rare)), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))
            own = [row, none(before, pa.list_(pa.binary())), batch.column("id"), batch.column("held_out"), n.astype(np.int64), known.astype(np.int64), base.astype(float), score.astype(float), rare, times]
            lists = pa.list_(pa.int64())
            met = [packed[0], packed[1], none(m, kind), *(none(m, x) for x in (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), lists, lists))]
            for kind_, columns in ((3, [-1 - own[0], *own[1:]]), (2, met)):
                arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns]
                yield pa.RecordBatch.from_arrays([arrays[0], pa.array(np.full(len(arrays[0]), kind_, np.int32)), *arrays[1:]], ["bucket", "kind", "parts", *_SCORES])

    return run


_SCORES = ["id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times"]


def _settled(bits: int, divergence: float):
    """Buckets to gains, packed for each batch of texts under its first row; rows of texts, whose bucket is -1 - row, as they are."""

    def run(batches):
        def others():
            for batch in batches:
                is_text = batch.column("kind").to_numpy() == 3
                if is_text.any():
                    texts = batch.filter(pa.array(is_text))
                    waiting.append([pa.array(-1 - texts.column("bucket").to_numpy()), *(texts.column(x) for x in _SCORES), pa.nulls(len(texts.column(0)), pa.list_(pa.binary()))])
                yield batch.filter(pa.array(~is_text))

        waiting, held, names, sources = [], [], ["row", *_SCORES, "gains"], np.zeros(0, np.int64)

        def summed():
            row, of = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            gain = np.bincount(of, np.concatenate([x for _, x in held]), len(row)).astype(np.float32)
            held.clear()
            source = np.searchsorted(sources, row, "right") - 1
            start = np.append(np.flatnonzero(np.diff(source, prepend=-1)), len(row))
            first = sources[source[start[:-1]]]
            parts = [[*_halves(row[a:b] - f), gain[a:b]] for a, b, f in zip(start[:-1], start[1:], first, strict=True)]
            first, parts = _packed(first.tolist(), parts)
            return pa.RecordBatch.from_arrays([first, *(pa.nulls(len(first), x) for x in types), parts], names)

        for _, rows in _by_bucket(others(), ("kind", "parts")):
            while waiting:
                yield pa.RecordBatch.from_arrays(waiting.pop(), names)
            table, known, met = ([x for k, x in rows if k == kind] for kind in range(3))
            if table and met:
                sources = np.union1d(sources, np.concatenate([np.frombuffer(x[0], np.int64) for x in met]))
                held.append(_gains(table[0], known, met, bits, divergence))
            if sum(len(x) for x, _ in held) > HELD:
                yield summed()
        while waiting:
            yield pa.RecordBatch.from_arrays(waiting.pop(), names)
        if held:
            yield summed()

    types = []
    return run, types


def _added(batches):
    """(row, gain) of packed gains that are sorted by row, the first one of a batch of texts."""
    for first, rows in _by_bucket(batches, ("gains",), "row"):
        low, high, gain = _joined([x for (x,) in rows], _GAINS)
        i, of = np.unique(_whole(low, high), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(first + i), pa.array(np.bincount(of, gain, len(i)))], ["row", "gain"])


def suffix_tree_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, **options) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(id as text) mod folds isn't held_out; a row with a null id is learnt from.
    A null or wordless text is one end mark. Each row is scored by itself, repeated ones too. With nothing
    to learn from, every symbol is unknown: log10(1 / 1) = 0. An empty table gives no rows; texts are scored whole,
    however long, and other columns aren't read.
    """
    context = docs.sparkSession.sparkContext
    out_of = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == held_out, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), out_of.alias("held_out"))
    texts = rows.where(~F.col("held_out")).select("text")
    tree, counts = learn(texts, **options)
    table, bits, passed = tables(texts, context.broadcast(tree), tree.n)

    id_type = rows.schema["id"].dataType
    scores = f"id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, times array<long>"
    met = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_met(context.broadcast((tree, passed)), bits, to_arrow_type(id_type)), f"bucket long, kind int, parts array<binary>, {scores}")
    settle, types = _settled(bits, options.get("divergence", DIVERGENCE))
    types += [to_arrow_type(f.dataType) for f in met.schema.fields[3:]]
    known = table.mapInArrow(_rare_words, "bucket long, w long").join(counts.select(F.col("w").bitwiseOR(F.lit(-(1 << 63))).alias("w"), "c"), "w").select("bucket", "w", "c").mapInArrow(_rare_counts, "bucket long, parts array<binary>")
    dealt = met.unionByName(table.withColumn("kind", F.lit(0)), allowMissingColumns=True).unionByName(known.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "kind")
    scored = kept(dealt.mapInArrow(settle, f"row long, {scores}, gains array<binary>"))
    own = scored.where("held_out IS NOT NULL").drop("gains")
    gains = scored.where("gains IS NOT NULL").select("row", "gains").repartition("row").sortWithinPartitions("row").mapInArrow(_added, "row long, gain double")
    rare = own.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("w"), F.col("x.times").alias("tf"))
    of = math.log10(tree.n + tree.v + 1)
    known = rare.join(counts, "w", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more"),
        F.sum(F.col("tf") * (F.log10(F.coalesce("c", F.lit(0)) + 1.0) - of)).alias("add"),
    )
    out = own.join(known, "row", "left").join(gains, "row", "left")
    more, add, gain = F.coalesce("more", F.lit(0)), F.coalesce("add", F.lit(0.0)), F.coalesce("gain", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(tree.n).cast("long").alias("train_tokens"), (F.col("base") + add).alias("base_score"), (F.col("score") + add + gain).alias("score")
    )

"""Genomes as vectors: variants are bound from position, alleles and kind, bundled per sample, and reduced.

Binding is circular convolution, so in the frequency domain a product. Sums are taken in whole numbers (fixed point), which
makes a genome's vector the same however its variants are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units of a component in the sums; 2**21 variants of a sample can't overflow them.
UNIT = float(1 << 42)
#: Variants whose vectors a task holds at a time, and their components.
HELD, CELLS = 4096, 1 << 20
#: Tasks that share a sample.
SALTS = 16
BASES = ("A", "T", "G", "C")
TYPES = ("SNP", "INS", "DEL", "DUP", "INV")


class Codebook:
    """The vectors of bases, kinds and chromosomes, drawn from a seed, and of positions, a sinusoid; all as spectra."""

    def __init__(self, dimension: int, seed: int = 0):
        self.dimension = dimension
        draw = lambda *key: np.random.default_rng([seed, *key])
        unit = lambda v: v / np.linalg.norm(v)
        self.bases = {}
        for i, base in enumerate(BASES):
            rng, v = draw(1, i), np.zeros(dimension)
            some = rng.permutation(dimension)[: max(1, dimension // 4)]
            v[some] = rng.standard_normal(len(some))
            self.bases[base] = unit(v)
        self.types = {t: unit(draw(2, i).standard_normal(dimension)) for i, t in enumerate(TYPES)}
        at = np.arange(dimension)
        slow = np.exp(np.repeat(np.arange(0, dimension, 2), 2)[:dimension] * -(np.log(10000.0) / dimension))
        self.position = np.where(at % 2 == 0, np.sin(at * slow), np.cos(at * slow))
        self._draw, self._unit = draw, unit
        self._parts, self._chromosomes = {}, {}

    def chromosome(self, number: int) -> np.ndarray:
        return self._unit(self._draw(3, number).standard_normal(self.dimension))

    def variant(self, number: int, steps: int, ref: str, alt: str, kind: str) -> np.ndarray:
        """The vector of a variant of length one; steps is its position in millionths of 10**12."""
        return self.variants([(number, steps, ref, alt, kind)])[0]

    def variants(self, keys: list[tuple[int, int, str, str, str]]) -> np.ndarray:
        """The vectors of many variants, a row each; a row's figures don't depend on the others.

        A moved position is a phase of its spectrum only in whole numbers of places, so it is rolled by an index, and what depends on a chromosome, or on alleles and kind, is taken once.
        """
        at = np.arange(self.dimension)
        numbers, parts = [k[0] for k in keys], [k[2:] for k in keys]
        moved = self.position[(at - np.array([k[1] % self.dimension for k in keys])[:, None]) % self.dimension]
        for part in set(parts) - self._parts.keys():
            ref, alt, kind = part
            spectrum = np.fft.rfft(self.types[kind])
            if ref in self.bases:
                spectrum = spectrum * np.fft.rfft(self.bases[ref])
            if alt in self.bases:  # moved by one, to tell it from the reference
                spectrum = spectrum * np.fft.rfft(np.roll(self.bases[alt], 1))
            if len(self._parts) >= 4096:  # alleles of any letters
                self._parts.clear()
            self._parts[part] = spectrum
        for number in set(numbers) - self._chromosomes.keys():
            self._chromosomes[number] = self.chromosome(number)
        v = np.fft.irfft(np.fft.rfft(moved, axis=1) * np.stack([self._parts[p] for p in parts]), self.dimension, axis=1)
        v += np.stack([self._chromosomes[n] for n in numbers])
        return v / np.sqrt((v * v).sum(1))[:, None]

    def reduced(self, v: np.ndarray) -> np.ndarray:
        """v bound with itself moved by a half, a quarter and an eighth, at length one."""
        spectrum = np.fft.rfft(v)
        for i in (1, 2, 3):
            spectrum = spectrum * np.fft.rfft(np.roll(v, self.dimension // 2**i))
        out = np.fft.irfft(spectrum, self.dimension)
        length = np.linalg.norm(out)
        return out / length if length > 0 else out


def chromosome_number(name) -> F.col:
    """1 to 22 by name, X 23, Y 24, any other 25; a leading chr doesn't count."""
    bare = F.upper(F.regexp_replace(name, "^(?i)chr", ""))
    number = F.when(bare.rlike("^[0-9]{1,2}$"), bare.cast("int"))
    return F.when(bare == "X", 23).when(bare == "Y", 24).when(number.between(1, 24), number).otherwise(25)


def _partial(dimension: int, seed: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by sample: the vectors of a strip's different variants are made at once, and added up by runs of a sample."""
        book, strip = Codebook(dimension, seed), min(HELD, max(1, CELLS // dimension))
        at, n, v, kind = None, 0, None, pa.null()
        for batch in batches:
            kind = batch.column(0).type
            samples = batch.column(0).to_pylist()
            keys = list(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True))
            for a in range(0, len(keys), strip):
                own, some = samples[a : a + strip], keys[a : a + strip]
                place = {}
                which = [place.setdefault(k, len(place)) for k in some]
                units = np.round(book.variants(list(place)) * UNIT).astype(np.int64)[which]
                first = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1])]
                out = []
                for sample, count, total in zip((own[i] for i in first), np.diff([*first, len(own)]).tolist(), np.add.reduceat(units, first, axis=0), strict=True):
                    if n and sample == at:
                        n, v = n + count, v + total
                        continue
                    if n:
                        out.append((at, n, v))
                    at, n, v = sample, count, total
                if out:
                    yield _sums(out, kind)
        if n:
            yield _sums([(at, n, v)], kind)

    return sums


def _sums(held: list, kind: pa.DataType) -> pa.RecordBatch:
    cells = np.stack([v for *_, v in held])
    ends = pa.array(np.arange(len(held) + 1, dtype=np.int32) * cells.shape[1])
    return pa.RecordBatch.from_arrays([pa.array([x for x, *_ in held], kind), pa.array([n for _, n, _ in held], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(cells.ravel()))], ["sample", "n", "v"])


def _finish(dimension: int, seed: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial sums come by sample: those of one are added up and reduced."""
        book, at, n, v, kind = Codebook(dimension, seed), None, 0, None, pa.null()

        def whole(held):
            vectors = [book.reduced(v / UNIT).tolist() for *_, v in held]
            return pa.RecordBatch.from_arrays([pa.array([x for x, *_ in held], kind), pa.array([n for _, n, _ in held], pa.int64()), pa.array(vectors, pa.list_(pa.float64()))], ["sample", "n", "vector"])

        for batch in batches:
            kind, held = batch.column(0).type, []
            rows = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            for sample, count, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), rows, strict=True):
                if n and sample == at:
                    n, v = n + count, v + row
                    continue
                if n:
                    held.append((at, n, v))
                at, n, v = sample, count, row
            if held:
                yield whole(held)
        if n:
            yield whole([(at, n, v)])

    return finish


def genome_vectors(variants: DataFrame, dimension: int = 10_000, seed: int = 0) -> DataFrame:
    """variants (sample, chrom, pos, ref, alt, kind) to (sample, n, vector): each sample's variants bundled and reduced, of length one.

    SALTS tasks add up what they hold of a sample, so one that has a third of all variants meets in no single task; its few partial
    sums meet in one. Positions count by millions. Alleles of more than one base, or none,
    are not bound; an unknown kind, or null, is a SNP; a null position is 0. Repeated variants count each time. A null
    sample is a sample. No variants give no rows.
    """
    kind = F.when(F.col("kind").isin(*TYPES), F.col("kind")).otherwise("SNP")
    steps = F.floor(F.coalesce(F.col("pos"), F.lit(0)) / 1_000_000).cast("long")
    rows = variants.select("sample", F.coalesce(chromosome_number(F.col("chrom")), F.lit(25)).alias("number"), steps.alias("steps"), F.coalesce(F.col("ref"), F.lit("")).alias("ref"), F.coalesce(F.col("alt"), F.lit("")).alias("alt"), kind.alias("kind"))
    of = variants.schema["sample"].dataType.simpleString()
    # each sample's variants lie together in a few tasks, so a task gives one sum for each sample that it has
    salt = F.pmod(F.xxhash64("number", "steps", "ref", "alt"), F.lit(SALTS))
    dealt = rows.withColumn("salt", salt).repartition("sample", "salt").sortWithinPartitions("sample").drop("salt")
    partial = dealt.mapInArrow(_partial(dimension, seed), f"sample {of}, n long, v array<bigint>")
    whole = partial.repartition("sample").sortWithinPartitions("sample")  # some SALTS rows of a sample
    return whole.mapInArrow(_finish(dimension, seed), f"sample {of}, n long, vector array<double>")


def _sequences(dimension: int, seed: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(dimension, seed)
        spectra = {ord(b): np.fft.rfft(book.bases[b]) for b in BASES}
        for batch in batches:
            for i in range(batch.num_rows):
                text = (batch.column(1)[i].as_py() or "").upper()
                letters = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
                at = np.arange(len(letters)) % dimension
                # the sum of a base's vector moved to each of its places is its convolution with how often each place has it
                spectrum = sum(s * np.fft.rfft(np.bincount(at[letters == b], minlength=dimension)) for b, s in spectra.items())
                v = np.fft.irfft(spectrum, dimension)
                length = np.linalg.norm(v)
                v = v / length if np.isin(letters, list(spectra)).any() and length > 0 else np.zeros(dimension)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([v.tolist()], pa.list_(pa.float64()))], ["id", "vector"])

    return encode


def sequence_vectors(sequences: DataFrame, dimension: int = 10_000, seed: int = 0) -> DataFrame:
    """sequences (id, text) to (id, vector): the sum of each base's vector moved by its place, at length one; zeros without any base.

    Letters count in either case, others hold their place only. Time grows with the length, not with length times dimension. A null text is empty.
    """
    of = sequences.schema["id"].dataType.simpleString()
    return sequences.select("id", "text").mapInArrow(_sequences(dimension, seed), f"id {of}, vector array<double>")

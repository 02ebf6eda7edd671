"""Secrets in texts: three fixed patterns, and formats inferred from what these find.

Credentials that the patterns label are examples of formats. Characters become classes (digit, a-f, other
lower-case letter, upper-case letter, each sign by itself), and for each kind a prefix tree of all different examples of the corpus is
counted. States whose counts are compatible by Hoeffding's bound, recursively, are merged in red-blue order
(ALERGIA), which gives a probabilistic automaton of the kind's format. Every run of credential
characters, those of the patterns too, is then scored by each automaton against what other runs of the corpus look like; those
that are likelier as a credential, by a margin that is set on held-out runs, are further secrets.

The tree isn't held anywhere whole: the automaton grows in rounds, and each walks all examples through the states
found so far and sums, by a shuffle, what passes them and the next levels of the tree below. Only these sums come to the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import kept

# The base patterns and the least length of what they find.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "format")
LEAST = {"assign": 12, "access": 18, "hex": 16}

LONG_HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
WORDS = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
#: Classes of characters: 0 for a digit, a for a-f, g for g-z, A for upper case; signs are themselves.
CLASS_OF = {**{c: "0" for c in "0123456789"}, **{c: "a" for c in "abcdef"}, **{c: "g" for c in "ghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}}
CLASSES = str.maketrans(CLASS_OF)
SYMBOLS = "0agA+/_.=-"
STOP = "$"
SYMBOLS_STOP = SYMBOLS + STOP
#: What is left to the end is told apart up to this many symbols.
LONGEST = 200
#: Levels of the prefix tree below the states that a round counts, and how many of them are left below a state that is merged.
LEVELS, LOOK = 16, 4
#: The share of a kind's symbols from which on a state differs from all others by itself, and a node of the tree is looked at below its state.
STATE_SHARE = 1e-4
#: Sums that a task holds before it hands them on.
MOST_SUMS = 500_000
#: Examples from which on two states' successors are compared as well, and what a margin has beyond the held-out others.
EVIDENCE, SLACK = 8, 0.01
#: The kind of runs that aren't credentials, the share of held-out ones that may pass a margin, and how many steps of gain make 1.
OTHER, RATE, STEPS = "other", 0.001, 10_000
#: The largest share of held-out others that are taken for credentials without a label, and how far (log10 a character) all others must lie from these.
UNLABELLED, VOID = 0.02, 0.2


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the base patterns' matches, by start, then kind as listed."""
    out = []
    if WORDS.search(text):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    # runs are maximal, so those of 16 or more are the same with the least length in the pattern
    out += [("hex", m.start(), m.end(), m[0]) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def tally(steps: list[dict[str, int]], symbols: str, n: int, sums: dict, kind: str) -> None:
    """Adds n strings to the states they pass and, from where no step goes on, to the next LEVELS nodes of the prefix tree below.

    Each place counts twice, by its next symbol (from 0) and by what is left to the end (below 0).
    """
    state, below = 0, ""
    for place, s in enumerate(symbols + STOP):
        sums[kind, state, below, SYMBOLS_STOP.index(s)] += n
        sums[kind, state, below, -1 - min(len(symbols) - place, LONGEST)] += n
        to = None if below else steps[state].get(s)
        if to is not None:
            state = to
        elif len(below) < LEVELS:
            below += s
        else:
            return


class Automaton:
    """A probabilistic automaton over class symbols, inferred from examples by merging states of their prefix tree.

    Two states are compatible if their next symbols, their stops and how much is left to the end from them differ by
    no more than Hoeffding's bound allows, and so down their subtrees while both have EVIDENCE examples (or their
    STATE_SHARE, if that is more). A state is merged with the compatible one whose rests are most alike, so formats of one length keep it;
    one with less than STATE_SHARE of all symbols always is merged, so there are at most 1 / STATE_SHARE states.
    """

    def __init__(self, total: int, alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.left: list[Counter] = [Counter()]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.least = STATE_SHARE * total
        self.done = False

    def _apart(self, a: int, b: int) -> float:
        """The largest difference of the two states' distributions of what is left to the end."""
        m, n = sum(self.left[a].values()), sum(self.left[b].values())
        x = y = most = 0.0
        for rest in sorted(self.left[a].keys() | self.left[b].keys()):
            x, y = x + self.left[a][rest] / m, y + self.left[b][rest] / n
            most = max(most, abs(x - y))
        return most

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            m, n = sum(self.count[a].values()), sum(self.count[b].values())
            slack = self.bound * (1 / math.sqrt(m) + 1 / math.sqrt(n))
            if any(abs(self.count[a][s] / m - self.count[b][s] / n) > slack for s in self.count[a].keys() | self.count[b].keys()) or self._apart(a, b) > slack:
                return False
            if min(m, n) >= max(EVIDENCE, self.least):
                todo += [(self.next[a][s], self.next[b][s]) for s in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree under b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a].update(self.count[b])
            self.left[a].update(self.left[b])
            for s, x in self.next[b].items():
                if s in self.next[a]:
                    todo.append((self.next[a][s], x))
                else:
                    self.next[a][s] = x

    def grow(self, nodes: dict[tuple[int, str], list[tuple[int, int]]]) -> None:
        """A round: states of the tree's next levels are merged or stand for themselves, the most frequent first, until one comes that isn't counted yet.

        Of states too rare to be told apart those that aren't counted wait, and the others are merged.
        nodes holds what tally counts of all examples, by state and way below it. A round that finds nothing to do has the
        whole counts of all states, and is the last.
        """
        states = len(self.next)
        self.count, self.left = [Counter() for _ in range(states)], [Counter() for _ in range(states)]
        place: dict[tuple[int, str], int] = {}
        levels: dict[int, int] = {}
        for (state, below), counts in sorted(nodes.items(), key=lambda x: (len(x[0][1]), x[0])):
            node = state
            if below:
                if (state, below[:-1]) not in place:
                    continue
                node = self.next[place[state, below[:-1]]][below[-1]] = len(self.next)
                self.next.append({})
                self.count.append(Counter())
                self.left.append(Counter())
                levels[node] = len(below)
            place[state, below] = node
            for what, n in counts:
                if what < 0:
                    self.left[node][-1 - what] = n
                else:
                    self.count[node][SYMBOLS_STOP[what]] = n
        red = dict.fromkeys(range(states))  # in order
        self.done = True
        waiting: set[tuple[int, str]] = set()
        while blue := min(((-n, r, s) for r in red for s, n in self.count[r].items() if s != STOP and self.next[r].get(s) not in red and (r, s) not in waiting), default=None):
            self.done = False
            n, r, s = -blue[0], *blue[1:]
            x = self.next[r].get(s)
            if x is None or (LEVELS - levels[x] < LOOK and n >= EVIDENCE):
                if n >= max(EVIDENCE, self.least):
                    break
                waiting.add((r, s))
                continue
            target = min((t for t in red if self._alike(t, x)), key=lambda t: (self._apart(t, x), t), default=None)
            if target is None and n < self.least:
                target = min(red, key=lambda t: (self._apart(t, x), t))
            if target is None:
                red[x] = None
            else:
                self.next[r][s] = target
                self._fold(target, x)
        place_of = {x: i for i, x in enumerate(red)}
        self.next = [{s: place_of[y] for s, y in self.next[x].items() if y in place_of} for x in red]
        self.count, self.left = [self.count[x] for x in red], [self.left[x] for x in red]
        self.logs = [{s: math.log10((c[s] + 0.1) / (sum(c.values()) + 0.1 * len(SYMBOLS_STOP))) for s in SYMBOLS_STOP} for c in self.count]

    def likelihood(self, symbols: str) -> float:
        """log10 of the probability of a whole string; a step that no example took leads back to the start."""
        state, total = 0, 0.0
        for s in symbols:
            total += self.logs[state][s]
            state = self.next[state].get(s, 0)
        return total + self.logs[state][STOP]


def gain(automaton: Automaton, other: Automaton, symbols: str) -> float:
    """How much likelier than by the others' automaton a run is, in log10 a character."""
    return (automaton.likelihood(symbols) - other.likelihood(symbols)) / len(symbols)


#: (kind, held out, class symbols, different values that have them)
Row = tuple[str, bool, str, int]


def _tallies(steps: dict[str, list[dict[str, int]]], rows: Iterable[Row]) -> Iterator[dict]:
    """Sums of what tally counts of the fitted rows of the kinds given, by (kind, state, below, what), in parts."""
    sums: dict = defaultdict(int)
    for kind, held, symbols, n in rows:
        if not held and kind in steps:
            tally(steps[kind], symbols, n, sums, kind)
            if len(sums) > MOST_SUMS:
                yield sums
                sums = defaultdict(int)
    yield sums


def _gains(automata: dict[str, Automaton], other: Automaton, rows: Iterable[Row]) -> Iterator[dict]:
    """Held-out rows by (kind, whether of this kind or other, steps of gain by the kind's automaton)."""
    sums: dict = defaultdict(int)
    for kind, held, symbols, n in rows:
        if held:
            for k in automata.keys() if kind == OTHER else automata.keys() & {kind}:
                sums[k, kind == k, math.floor(STEPS * gain(automata[k], other, symbols))] += n
    yield sums


class InMemory:
    """Rows of examples in a list, as learnt from by Formats."""

    def __init__(self, rows: list[Row]):
        self.rows = rows

    def sizes(self) -> dict[str, tuple[int, int]]:
        """For each kind its values, and the symbols and stops of the fitted ones."""
        out: dict = defaultdict(lambda: (0, 0))
        for kind, held, symbols, n in self.rows:
            out[kind] = (out[kind][0] + n, out[kind][1] + (0 if held else n * (len(symbols) + 1)))
        return dict(out)

    def tallies(self, automata: dict[str, Automaton]) -> dict[str, dict]:
        nodes: dict = defaultdict(lambda: defaultdict(list))
        for sums in _tallies({k: x.next for k, x in automata.items()}, self.rows):
            for (kind, state, below, what), n in sums.items():
                nodes[kind][state, below].append((what, n))
        return nodes

    def gains(self, automata: dict[str, Automaton], other: Automaton) -> list[tuple[str, bool, int, int]]:
        return [(*key, n) for sums in _gains(automata, other, self.rows) for key, n in sums.items()]


class InTable:
    """Rows of examples in a DataFrame; each task sums its own, and sums are shuffled."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def sizes(self) -> dict[str, tuple[int, int]]:
        fitted = F.when(~F.col("held"), F.col("n") * (F.length("symbols") + 1)).otherwise(0)
        return {kind: (n, total) for kind, n, total in self.rows.groupBy("kind").agg(F.sum("n"), F.sum(fitted)).collect()}

    def _summed(self, sums_of: Callable[[Iterator[Row]], Iterator[dict]], columns: dict[str, pa.DataType]) -> DataFrame:
        names = [*columns, "n"]

        def run(batches):
            rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            for sums in sums_of(rows):
                keys = list(zip(*sums, strict=True)) or [[]] * len(columns)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(keys, columns.values(), strict=True)), pa.array(sums.values(), pa.int64())], names)

        spelled = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean"}
        return self.rows.mapInArrow(run, ", ".join([*(f"{c} {spelled[t]}" for c, t in columns.items()), "n long"]))

    def tallies(self, automata: dict[str, Automaton]) -> dict[str, dict]:
        steps = {k: x.next for k, x in automata.items()}
        columns = {"kind": pa.string(), "state": pa.int32(), "below": pa.string(), "what": pa.int32()}
        sums = self._summed(lambda rows: _tallies(steps, rows), columns).repartition("kind", "state", "below").groupBy(*columns).agg(F.sum("n").alias("n"))
        counted = sums.groupBy("kind", "state", "below").agg(F.sum(F.when(F.col("what") >= 0, F.col("n"))).alias("total"), F.collect_list(F.struct("what", "n")).alias("counts"))
        least = F.create_map(*(F.lit(x) for k, a in automata.items() for x in (k, a.least)))
        nodes: dict = defaultdict(dict)
        for r in counted.where((F.length("below") < 2) | (F.col("total") >= least[F.col("kind")])).collect():
            nodes[r["kind"]][r["state"], r["below"]] = [tuple(x) for x in r["counts"]]
        return nodes

    def gains(self, automata: dict[str, Automaton], other: Automaton) -> list[tuple[str, bool, int, int]]:
        columns = {"kind": pa.string(), "own": pa.bool_(), "gain": pa.int32()}
        return [tuple(r) for r in self._summed(lambda rows: _gains(automata, other, rows), columns).groupBy(*columns).agg(F.sum("n")).collect()]


def grown(source: InMemory | InTable, sizes: dict[str, int]) -> dict[str, Automaton]:
    """The automata of kinds, by the symbols they have; all grow in the same rounds."""
    automata = {k: Automaton(n) for k, n in sizes.items()}
    while growing := {k: x for k, x in automata.items() if not x.done}:
        nodes = source.tallies(growing)
        for kind, automaton in growing.items():
            automaton.grow(nodes[kind] if kind in nodes else {})
    return automata


class Formats:
    """The kinds' automata, and the automaton of runs that aren't credentials.

    A fifth of the different values is held out, and automata have all the others. A kind's margin is set on all held-out ones: at most a share
    of RATE of the held-out others gains more than it, and it is never below SLACK, so what passes is likelier as a credential than as
    another run. A corpus holds credentials that no pattern labels, and those that are among the held-out others would push the margin above themselves. So where
    it leaves out a tenth of the held-out credentials, others that are likelier as credentials are taken for such, provided that they are
    at most UNLABELLED of all and stand apart: no more than RATE lie within VOID below 0. The margin is SLACK then, and false_rate is their share.
    A kind whose margin leaves out more than half of its own held-out credentials tells nothing apart, and isn't used; nor is one of
    fewer than ten values, or none held out. Gains are counted in steps of 1 / STEPS, so no list of them is sorted.
    """

    def __init__(self, examples: dict[str, list[str]], others: list[str], rate: float = RATE):
        rows = [(kind, i % 5 == 0, v.translate(CLASSES), 1) for kind, values in {**examples, OTHER: others}.items() for i, v in enumerate(values)]
        self._learn(InMemory(rows), rate)

    @classmethod
    def of_table(cls, rows: DataFrame, rate: float = RATE) -> Formats:
        """From rows (kind, held, symbols, n)."""
        formats = cls.__new__(cls)
        formats._learn(InTable(rows), rate)
        return formats

    def _learn(self, source: InMemory | InTable, rate: float) -> None:
        self.kinds: dict[str, tuple[Automaton, float]] = {}
        self.recall: dict[str, float] = {}
        self.false_rate: dict[str, float] = {}
        self.memo: dict[str, float] = {}
        sizes = source.sizes()
        automata = grown(source, {k: total for k, (n, total) in sizes.items() if k == OTHER or n >= 10} | ({OTHER: 0} if OTHER not in sizes else {}))
        self.other = automata.pop(OTHER)
        gains: dict[tuple[str, bool], Counter] = defaultdict(Counter)
        for kind, own, step, n in source.gains(automata, self.other) if automata else []:
            gains[kind, own][step] += n
        slack, void = round(SLACK * STEPS), round(VOID * STEPS)
        for kind in sorted(automata):
            mine, plain = gains[kind, True], gains[kind, False]
            if not mine:
                continue
            have, others = sum(mine.values()), sum(plain.values())
            margin, rank = slack, int(others * rate)
            for step in sorted(plain, reverse=True):  # the step of the others' first that may not pass
                rank -= plain[step]
                if rank < 0:
                    margin = max(0, step + 1) + slack
                    break
            from_step = lambda x, least: sum(n for step, n in x.items() if step >= least)
            if from_step(mine, margin) < 0.9 * have <= from_step(mine, slack):
                above = from_step(plain, slack)
                near = from_step(plain, -void) - above
                if above <= UNLABELLED * others and near <= rate * others:
                    margin = slack
            self.recall[kind] = from_step(mine, margin) / have
            self.false_rate[kind] = from_step(plain, margin) / max(1, others)
            if self.recall[kind] > 0.5:
                self.kinds[kind] = (automata[kind], margin / STEPS)

    def excess(self, run: str) -> float:
        """By how much the run's gain exceeds a margin, of the kind for which it does most; above 0 for what looks like a credential. Without automata minus infinity."""
        symbols = run.translate(CLASSES)
        known = self.memo.get(symbols)
        if known is None:
            known = max((gain(x, self.other, symbols) - margin for x, margin in self.kinds.values()), default=-math.inf)
            if len(self.memo) > 200_000:
                self.memo.clear()
            if len(symbols) <= 64:
                self.memo[symbols] = known
        return known

    def likely(self, run: str) -> bool:
        """Whether some kind's automaton makes the run likelier than the others' one does, by more than the kind's margin."""
        return self.excess(run) > 0


def _labelled(batches):
    """mapInArrow: a task's different credentials of each kind, and runs that overlap none (kind other)."""
    names = ["kind", "value"]

    def batch_of(found: set) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in list(zip(*found, strict=True)) or [[]] * 2], names)

    found: set[tuple[str, str]] = set()
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py() or ""
            spans = base_spans(text)
            found.update((k, value) for k, _, _, value in spans)
            if spans:
                found.update((OTHER, m[0]) for m in RUN.finditer(text) if not any(a < m.end() and m.start() < b for _, a, b, _ in spans))
            else:
                found.update((OTHER, x) for x in RUN.findall(text))
        if len(found) > MOST_SUMS:
            yield batch_of(found)
            found = set()
    yield batch_of(found)


def learn_formats(texts: DataFrame) -> Formats:
    """Automata and margins from all different examples of each kind and all different other runs of texts, whatever their length; a fifth, by a hash, is held out."""
    found = texts.mapInArrow(_labelled, "kind string, value string").distinct()
    symbols = F.translate("value", "".join(CLASS_OF), "".join(CLASS_OF.values()))
    rows = found.groupBy("kind", (F.crc32(F.col("value").cast("binary")) % 5 == 0).alias("held"), symbols.alias("symbols")).agg(F.count("*").alias("n"))
    return Formats.of_table(kept(rows.repartition(2 * texts.sparkSession.sparkContext.defaultParallelism)))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, spans as an array of (kind, start, end), by start, then kind; ends are exclusive, in code points; and likelihoods.

    Base kinds are assign, access and hex, each with leftmost matches that don't overlap; a format span is
    a run of 12 or more credential characters that overlaps no base span. likelihoods holds, for each span, by how much its credential
    exceeds the best automaton's margin, in log10 a character: above 0 for every format span, below it for a base span that doesn't look like the others,
    and null without any automaton. Ties don't matter: every run that exceeds a margin is a span. A null or empty text has no spans, and
    an empty table gives no rows. Without ten examples of a kind it has no automaton. Rows are scanned one by one: repeated ones, ones
    that repeat an id and null ids come back as they are; texts are scanned whole, and other columns aren't read.
    """
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    given = docs.sparkSession.sparkContext.broadcast(learn_formats(pairs.select("text")))
    kind = pairs.schema["id"].dataType.simpleString()

    def run(batches):
        formats = given.value
        for batch in batches:
            out, scores = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = [("format", m.start(), m.end(), m[0]) for m in RUN.finditer(text) if formats.likely(m[0])]
                spans = base + [x for x in more if not any(a < x[2] and x[1] < b for _, a, b, _ in base)]
                spans.sort(key=lambda x: (x[1], KINDS.index(x[0])))
                out.append([{"kind": k, "start": a, "end": b} for k, a, b, _ in spans])
                scores.append([formats.excess(v) if formats.kinds else None for *_, v in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))), pa.array(scores, pa.list_(pa.float64()))], ["id", "spans", "likelihoods"])

    return pairs.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:int,end:int>>, likelihoods array<double>").withColumnRenamed("id", id_col)

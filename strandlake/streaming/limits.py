"""Limits on requests and drift alerts: per-key state that depends on what was accepted before.

Each rule is one step from a state and an event to a state and an output. A stream applies it with transformWithState (in
RocksDB, with timers that drop what has run out), a batch as a fold over each key's events in order, so both give the
same rows. Events are (key, at in microseconds, id, value); equal times go by id.

A key is sequential by nature: its events are folded by one task, batch after batch, which holds the key's last state only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

SECOND = 1_000_000


@dataclass(frozen=True)
class Rule:
    """What a key keeps (state and its schema), what an event gives (output, its columns' schema), and how long a state matters after its last event (microseconds)."""

    start: tuple
    state: str
    output: str
    step: Callable[[tuple, int, float], tuple[tuple, tuple | None]]
    lasting: int


def token_bucket(rate: float = 5.0, capacity: float = 10.0, strikes: int = 0, blocked_seconds: float = 0.0) -> Rule:
    """Requests spend one token of a bucket that holds `capacity` and fills by `rate` a second; without a whole token they are refused.

    With strikes, so many refusals in a row block the key for blocked_seconds; blocked requests are refused and change nothing but the
    refill. Output: allowed, and why not ("", "rate" or "blocked"). An event from before the last one counts as at that time.
    """

    def step(state: tuple, at: int, _: float) -> tuple[tuple, tuple]:
        tokens, updated, refused, until = state
        at = at if updated is None else max(at, updated)
        tokens = capacity if updated is None else min(capacity, tokens + (at - updated) / SECOND * rate)
        if until is not None and at < until:
            return (tokens, at, refused, until), (False, "blocked")
        if tokens >= 1.0:
            return (tokens - 1.0, at, 0, None), (True, "")
        if strikes and refused + 1 >= strikes:
            return (tokens, at, 0, at + int(blocked_seconds * SECOND)), (False, "rate")
        return (tokens, at, refused + 1, None), (False, "rate")

    # a bucket that is full again and not blocked is as good as a new one, but for strikes
    lasting = int(max(capacity / rate, blocked_seconds) * SECOND) + 1
    return Rule((0.0, None, 0, None), "tokens double, updated long, refused int, until long", "allowed boolean, why string", step, lasting)


def accepted_window(seconds: float = 60.0, most: int = 100) -> Rule:
    """A request is accepted if fewer than `most` of its key's accepted ones lie within the last `seconds`; refused ones aren't counted. Output: allowed, and how many count."""

    def step(state: tuple, at: int, _: float) -> tuple[tuple, tuple]:
        (times,) = state
        at = max([at, *times[-1:]])
        times = [t for t in times if at - t < seconds * SECOND]
        allowed = len(times) < most
        times = [*times, at] if allowed else times
        return (times,), (allowed, len(times))

    return Rule(([],), "times array<long>", "allowed boolean, counted int", step, int(seconds * SECOND) + 1)


def severity(x: float) -> str:
    return next((name for least, name in ((0.75, "critical"), (0.5, "high"), (0.25, "medium"), (0.1, "low")) if x >= least), "none")


def drift_of(values: np.ndarray, baseline: tuple[float, ...]) -> float:
    """The mean's shift in baseline deviations, and the mean change of the quartiles."""
    mean, sd, *quartiles = baseline
    return abs(values.mean() - mean) / (sd + 1e-8) + float(np.abs(np.quantile(values, [0.25, 0.5, 0.75]) - quartiles).mean())


def drift_monitor(baseline: tuple[float, ...], window: int = 1000, every: int = 100, least: int = 100, threshold: float = 0.15, cooldown_seconds: float = 3600.0) -> Rule:
    """A ring of a key's last `window` values; each `every`-th event it is held against the baseline (mean, deviation, three quartiles).

    From `threshold` on there is an alert, after which a key isn't checked for cooldown_seconds. Output, for alerts only: n
    (events so far), drift, severity. Null and NaN values are events that add nothing to the ring.
    """

    def step(state: tuple, at: int, value: float) -> tuple[tuple, tuple | None]:
        ring, n, until = state
        ring = [*ring, float(value)][-window:] if value is not None and value == value else ring
        n += 1
        if n % every or len(ring) < least or (until is not None and at < until):
            return (ring, n, until), None
        drift = drift_of(np.array(ring), baseline)
        if drift < threshold:
            return (ring, n, until), None
        return (ring, n, at + int(cooldown_seconds * SECOND)), (n, drift, severity(drift))

    return Rule(([], 0, None), "ring array<double>, n long, until long", "n long, drift double, severity string", step, 0)


def _keyed(events: DataFrame) -> DataFrame:
    value = F.col("value").cast("double") if "value" in events.columns else F.lit(None).cast("double")
    return events.select("key", F.col("at").cast("long").alias("at"), "id", value.alias("value"))


def _row(values: tuple) -> tuple:
    """A state as Spark gives it back, with lists for arrays."""
    return tuple(list(x) if isinstance(x, (list, tuple, np.ndarray)) else x for x in values)


def folded(events: DataFrame, rule: Rule) -> DataFrame:
    """(key, id, at, ..) of a batch: the rule's output for each event in its key's order. Null keys are a key; null times come first and count as 0."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = f"key {kinds['key']}, id {kinds['id']}, at long, {rule.output}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = object(), rule.start
        for batch in batches:
            out = []
            for key, at, event, value in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != own:
                    own, state = key, rule.start
                state, said = rule.step(state, at or 0, value)
                if said is not None:
                    out.append((key, event, at, *said))
            columns = zip(*out, strict=True) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return _keyed(events).repartition("key").sortWithinPartitions("key", "at", "id").mapInArrow(run, schema)


class _Keyed(StatefulProcessor):
    """A rule as a stateful processor: a key's events of a micro-batch are sorted, then stepped through."""

    def __init__(self, rule: Rule, late: int):
        self.rule, self.late = rule, late

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.rule.state)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = _row(self.kept.get()) if self.kept.exists() else self.rule.start
        out, last = [], None
        for at, event, value in pd.concat(rows).sort_values(["at", "id"])[["at", "id", "value"]].itertuples(index=False, name=None):
            state, said = self.rule.step(state, int(at), value)
            last = int(at)
            if said is not None:
                out.append((key[0], event, int(at), *said))
        self.kept.update(state)
        if self.rule.lasting and last is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer((last + self.rule.lasting + self.late) // 1000 + 1)
        yield pd.DataFrame(out, columns=["key", "id", "at", *(x.split()[0] for x in self.rule.output.split(", "))])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def streamed(events: DataFrame, rule: Rule, late_seconds: int = 600) -> DataFrame:
    """What folded gives, of a stream of events (key, at, id, value) as they come.

    Within a micro-batch a key's events are taken in order; one that comes in a later batch than a younger one is stepped through
    when it comes. Events older than the watermark (late_seconds behind the youngest) are dropped by Spark. A key's
    state goes when the watermark passes the time after which it no longer matters; a drift monitor keeps its ring.
    Needs the RocksDB state store (see rocksdb).
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    marked = _keyed(events).withColumn("_time", F.timestamp_micros("at")).withWatermark("_time", f"{late_seconds} seconds")
    schema = f"key {kinds['key']}, id {kinds['id']}, at long, {rule.output}"
    return marked.groupBy("key").transformWithStateInPandas(_Keyed(rule, late_seconds * SECOND), schema, "append", "EventTime")


def rocksdb(spark) -> None:
    """Lets this session keep stream state in RocksDB, which state with timers and lists needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

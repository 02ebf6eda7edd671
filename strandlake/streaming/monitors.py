"""Monitors over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, mean_value) by tumbling windows; a stream drops what comes later than late."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def anomalies(events: DataFrame, least: int = 30, limit: float = 3.0) -> DataFrame:
    """(user_id, event_id, value, z) of events whose value is over limit deviations from what its user's stream had before.

    State is a count, a mean and a sum of squares for each user (Welford's update), so it is bounded by the users.
    """

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean, squares = state.get if state.exists else (0, 0.0, 0.0)
        out = []
        for frame in frames:
            for event, value in frame.sort_values("event_id")[["event_id", "value"]].itertuples(index=False):
                if n >= least and squares > 0:
                    z = (value - mean) / (squares / n) ** 0.5
                    if abs(z) > limit:
                        out.append((key[0], event, value, z))
                n += 1
                delta = value - mean
                mean += delta / n
                squares += delta * (value - mean)
        state.update((n, mean, squares))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "value", "z"])

    return events.select("user_id", "event_id", "value").groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, value double, z double", "n long, mean double, squares double", "append", "NoTimeout")

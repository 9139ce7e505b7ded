"""The same usage figures over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_cost(events: DataFrame, ts: str, amount: str, by: str, late: str = "14 days") -> DataFrame:
    """Tumbling days by ``by``; rows later than ``late`` are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), by).agg(F.count("*").alias("n"), F.sum(amount).alias("cost")).select(F.col("window.start").alias("day"), by, "n", "cost")


def spend_sessions(events: DataFrame, key: str, ts: str, amount: str, gap: str = "3 hours", late: str = "14 days") -> DataFrame:
    """Spending sessions that a gap of more than ``gap`` closes."""
    grouped = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap))
    return grouped.agg(F.count("*").alias("events"), F.sum(amount).alias("spent")).select(key, F.col("session_window.start").alias("start"), "events", "spent")


def once(events: DataFrame, keys: list[str], ts: str, late: str = "14 days") -> DataFrame:
    """The first row of each key; rows of a fallback log that were merged twice count once."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def rounds(events: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, round, ask) for every event: the running count of the key, kept as state."""

    def counted(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for frame in frames:
            n = range(seen + 1, seen + len(frame) + 1)
            seen += len(frame)
            yield pd.DataFrame({key: [of[0]] * len(frame), "round": list(n), "ask": [i > most for i in n]})
        state.update((seen,))

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(counted, f"{key} {kind}, round long, ask boolean", "seen long", "append", GroupStateTimeout.NoTimeout)

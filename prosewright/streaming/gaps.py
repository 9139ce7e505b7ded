"""Gaps and rounds of each key over a stream, with state that expires.

Rows wait in state until the watermark has passed them and then leave in the order of their times, so late rows within the
watermark count where they belong.  A key's state is its last time and its round; a timer drops both once the key has been silent for
``keep``, after which it starts anew, as the batch figures (``usage.fresh_gaps``) say too: whether state is still there
makes no difference to the result.  Needs the RocksDB state store, whose state lives in the query's checkpoint.

Rows without a key or a time are left out; rows that come later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from prosewright.functions.text import gap_bucket

KEEP_SECONDS = 14 * 86_400
MOST_ROUNDS = 3


class GapsOfKey(StatefulProcessor):
    def __init__(self, key: str, ts: str, order: str, keep_seconds: int):
        self.names, self.keep = (key, ts, order), keep_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, round long")
        self.waiting = handle.getListState("waiting", "at long, no long")

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(micros // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, ts, order = self.names
        for frame in rows:
            at = frame[ts].to_numpy("datetime64[us]").astype("i8").tolist()
            for row in zip(at, frame[order].tolist(), strict=True):
                self.waiting.appendValue((int(row[0]), int(row[1])))
            self._wake(min(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready, rest = [r for r in rows if r[0] < passed], [r for r in rows if r[0] >= passed]
        at, n = self.last.get() if self.last.exists() else (None, 0)
        out = []
        for now, no in ready:
            gap = None if at is None or now - at > self.keep else (now - at) / 1e6
            n = 1 if gap is None else n + 1
            at = now
            out.append((key[0], pd.Timestamp(now, unit="us"), no, gap, n))
        if ready:
            self.last.update((at, n))
            self.waiting.clear()
            for r in rest:
                self.waiting.appendValue(r)
            self._wake(at + self.keep)
        if rest:
            self._wake(rest[0][0])
        elif not ready and at is not None and at + self.keep < passed:
            self.last.clear()
        if out:
            yield pd.DataFrame(out, columns=[*self.names, "gap", "round"]).astype({"gap": "float64"})

    def close(self) -> None:
        pass


def gaps(events: DataFrame, key: str, ts: str, order: str, late: str = "1 hour", keep_seconds: int = KEEP_SECONDS, most: int = MOST_ROUNDS) -> DataFrame:
    """(key, ts, order, gap, bucket, round, ask) of every row; ``order`` (a whole number) decides between equal times."""
    own = events.select(key, ts, F.col(order).cast("long").alias(order)).where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(order).isNotNull()).withWatermark(ts, late)
    schema = T.StructType([own.schema[key], own.schema[ts], own.schema[order], T.StructField("gap", T.DoubleType()), T.StructField("round", T.LongType())])
    told = own.groupBy(key).transformWithStateInPandas(GapsOfKey(key, ts, order, keep_seconds), schema, "append", "EventTime")
    return told.select(key, ts, order, "gap", gap_bucket("gap").alias("bucket"), "round", (F.col("round") > most).alias("ask"))

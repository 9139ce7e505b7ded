"""Spans of a line: one sort by start tells what overlaps, covers, merges and wins, without a join of ranges.

Spans are half open, [start, end), and belong to a line (any key columns).  Two running values are enough: how far the spans that start no
later reach, and where the next one starts.  Rows of a key meet in one window, which is a line's or a short document's
spans.  A null start or end overlaps nothing; equal spans cover each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(keys: list[str], *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def against(spans: DataFrame, others: DataFrame, keys: list[str], start: Column | str = "start", end: Column | str = "end") -> DataFrame:
    """``spans`` with two flags: ``overlaps`` any of ``others`` (keys, start, end) of its key, and is ``covered`` by one of them.

    ``start`` and ``end`` may be expressions over a span's columns, such as a widened span.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    mine = spans.select(*keys, as_column(start).alias("_start"), as_column(end).alias("_end"), F.lit(True).alias("_own"), F.struct(*spans.columns).alias("_row"))
    theirs = others.where("start < end").select(*keys, F.col("start").alias("_start"), F.col("end").alias("_end"), F.lit(False).alias("_own"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"))
    both = mine.union(theirs.select(*[F.col(c).cast(mine.schema[c].dataType) for c in mine.columns]))
    up_to = Window.unboundedPreceding, Window.currentRow
    reach = F.max(F.when(~F.col("_own"), F.col("_end"))).over(_before(keys, "_start").rangeBetween(*up_to))
    following = F.min(F.when(~F.col("_own"), F.col("_start"))).over(_before(keys, F.desc("_start")).rangeBetween(*up_to))
    told = both.withColumns({"_reach": reach, "_following": following}).where("_own")
    overlaps = (F.col("_start") < F.col("_end")) & ((F.col("_reach") > F.col("_start")) | (F.col("_following") < F.col("_end")))
    return told.select("_row.*", F.coalesce(overlaps, F.lit(False)).alias("overlaps"), F.coalesce(F.col("_reach") >= F.col("_end"), F.lit(False)).alias("covered"))


def without_overlaps(spans: DataFrame, others: DataFrame, keys: list[str], start: Column | str = "start", end: Column | str = "end") -> DataFrame:
    """Spans that overlap none of ``others``."""
    return against(spans, others, keys, start, end).where("NOT overlaps").select(*spans.columns)


def with_longest(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``spans`` with the span that wins over each: ``long_start`` and ``long_end`` of the longest one that covers it, itself if none does.

    Spans that no other covers rise in start and end alike, so the last of them before a span reaches furthest.
    """
    order = _before(keys, "start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    wins = F.coalesce(F.max("end").over(order) < F.col("end"), F.lit(True))
    marked = spans.withColumn("_wins", wins)
    last = F.last(F.when(F.col("_wins"), F.struct("start", "end")), ignorenulls=True).over(_before(keys, "start", F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("_last", last).select(*spans.columns, F.col("_last.start").alias("long_start"), F.col("_last.end").alias("long_end"))


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, n): what runs of overlapping spans cover together, and of how many spans; spans that only touch stay apart."""
    order = _before(keys, "start", "end")
    opens = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    numbered = spans.select(*keys, "start", "end").withColumn("_opens", opens.cast("int")).withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_run")

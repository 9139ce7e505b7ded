"""Mixing sources to target weights along a time-varying curriculum, with built-in functions only.

Targets: every source has a weight and shares the total size by it, but no more than ``most`` times its own size; what
is over goes to the others by weight, until none is above (with sources in the order of limit over weight this is one
running sum).  Each source's documents, in the order of a hash of doc_id, form one line of words that is taken from its
start, again from the start when used up, until the target is met; the document at the end is taken in part.
The hash is that of doc_id and text, so a common or missing doc_id is no common key.

Curriculum: a source's weight changes over training time t from 0 to 1 by a piecewise linear schedule.  Its integral,
scaled to the target, is the source's cumulative demand of words; inverting it at the middle of a document's words gives
the document's training position, and the result is range-sorted by it.

The running sum within a source goes over hash ranges first, so a source of any size is spread over tasks.
Null text has size 0; null source is a source of its own, after the others; null doc_id and null text hash as empty ones;
repeated rows are documents of their own; an empty table gives no rows.  Documents of which nothing is taken have
a null position and come last, spread over the partitions by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosewright.llm.common import Scratch

WEIGHTS = (5, 2, 1)
MOST = 3
#: training time and weight, by place in WEIGHTS: the first source kind fades, the last one grows
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (0.5, 1.5), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))

ROWS_A_RANGE, MOST_RANGES = 256, 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def segments(schedule: tuple[tuple[float, float], ...]) -> list[tuple[float, ...]]:
    """(t, weight, slope, share of demand before, share at end) of each piece, the whole demand being 1."""
    area = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False)]
    whole, before, out = sum(area), 0.0, []
    for ((t0, w0), (t1, w1)), a in zip(zip(schedule, schedule[1:], strict=False), area, strict=True):
        out.append((t0, w0 / whole, (w1 - w0) / (t1 - t0) / whole, before, before + a / whole))
        before += a / whole
    return out


def position(kind: Column, demand: Column, schedules=SCHEDULES) -> Column:
    """Training time at which the demand (share of the source's whole, 0 to 1) is reached."""
    out = F.lit(None).cast("double")
    for k, schedule in enumerate(schedules):
        inner = None
        for t0, w, slope, before, end in reversed(segments(schedule)):
            part = demand - F.lit(before)
            t = F.lit(t0) + F.lit(2.0) * part / (F.lit(w) + F.sqrt(F.lit(w * w) + F.lit(2 * slope) * part))
            inner = t if inner is None else F.when(demand < F.lit(end), t).otherwise(inner)
        out = F.when(kind == k, inner).otherwise(out)
    return out


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to kind (place in weights) and target; the table has one row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = sources.withColumn("kind", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    weight = F.element_at(F.lit(list(weights)).cast("array<bigint>"), F.col("kind") + 1)
    by_limit = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = (
        kinds.withColumn("w", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("left", F.sum("source_size").over(everything) - F.sum("cap").over(by_limit.rowsBetween(Window.unboundedPreceding, 0)) + F.col("cap"))
        .withColumn("w_left", F.sum("w").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("rate", F.col("left") / F.col("w_left"))
        .withColumn("capped", F.col("rate") * F.col("w") >= F.col("cap"))
        .withColumn("common", F.min(F.when(~F.col("capped"), F.struct(F.col("w_left") * -1, "rate"))).over(everything)["rate"])
    )
    return shared.select("source", "source_size", "kind", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("common") * F.col("w")).alias("target"))


def _ranges(rows: int) -> int:
    n = 1
    while n < MOST_RANGES and n * ROWS_A_RANGE < rows:
        n *= 2
    return n


def demand(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, h: hex hash) rows with source_size, kind, target, words wanted and words before the document."""
    ranges = _ranges(sized.count())
    placed = sized.withColumn("part", F.shiftright(F.conv(F.substring("h", 1, 3), 16, 10).cast("int"), 12 - (ranges.bit_length() - 1)))
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("name")  # null as a key of its own
    parts = placed.groupBy(name, "source", "part").agg(F.sum("size").alias("part_size"))
    sources = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    wanted = targets(sources, weights, most).select(name, "source_size", "kind", "target")
    before = F.sum("part_size").over(Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("part_size")
    starts = parts.select("name", "part", before.alias("part_start")).join(wanted, "name")
    inside = Window.partitionBy("name", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.select("*", name)
        .join(starts, ["name", "part"])
        .withColumn("start", F.col("part_start") + F.sum("size").over(inside) - F.col("size"))
        .withColumn("words", F.round("target").cast("long"))
        .drop("name", "part", "part_start")
    )


def taken(size: Column, start: Column, source_size: Column, words: Column) -> Column:
    """Words of a document that lie in the first ``words`` of its source's endless line."""
    rounds = F.when(source_size > 0, F.floor(words / F.greatest(source_size, F.lit(1)))).otherwise(F.lit(0)).cast("long")
    rest = words - rounds * source_size
    return rounds * size + F.greatest(F.lit(0), F.least(size, rest - start)).cast("long")


def _sized(docs: DataFrame, *more: str) -> DataFrame:
    hashed = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary"))
    return docs.select("doc_id", "source", word_count(F.col("text").cast("string")).alias("size"), hashed.alias("h"), *more)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, schedules=SCHEDULES) -> DataFrame:
    """Size, source_size, target, words taken and first training position of every document, in training order."""
    scratch = Scratch(docs.sparkSession, "mixing")
    lines = demand(scratch.write(_sized(docs), "sizes"), weights, most)
    got = lines.withColumn("taken", taken(F.col("size"), F.col("start"), F.col("source_size"), F.col("words")))
    middle = (F.col("start") + F.least("size", "taken") / 2) / F.col("words")
    out = got.withColumn("position", F.when(F.col("taken") > 0, F.round(position(F.col("kind"), middle, schedules), 9)))
    spread = F.conv(F.substring("h", 1, 12), 16, 10).cast("double") / 2.0**48
    return out.orderBy(F.coalesce("position", F.lit(2.0) + spread), "h").select("doc_id", "size", "source_size", "target", "taken", "position")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, schedules=SCHEDULES) -> DataFrame:
    """The documents themselves, each as often as the mix takes it whole or by at least half, in training order.

    The columns are those of ``docs``.  Empty documents are taken once.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    marked = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c).cast("string"))]  # the hash itself skips nulls
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.xxhash64(*marked).alias("_row"))
    lines = demand(scratch.write(_sized(packed.select("_row", "_doc.doc_id", "_doc.source", "_doc.text"), "_row"), "sizes"), weights, most)
    times = F.when(F.col("source_size") > 0, F.floor((F.col("words") - F.col("start") - F.col("size") / 2) / F.greatest("source_size", F.lit(1))) + 1).otherwise(F.lit(1))
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.least(F.greatest(times, F.lit(0)), F.lit(most)))
    first = F.min(F.struct("start", "kind", "size", "source_size", "words", "times", "h"))  # equal rows are taken equally often
    copies = lines.withColumn("times", times.cast("int")).where("times > 0").groupBy("_row").agg(first.alias("_line"))
    occurrences = packed.join(copies, "_row").select("_doc", "_line.*", F.explode(F.sequence(F.lit(0), F.col("_line.times") - 1)).alias("round"))
    at = F.least((F.col("round") * F.col("source_size") + F.col("start") + F.col("size") / 2) / F.greatest("words", F.lit(1)), F.lit(1.0))
    placed = occurrences.withColumn("_at", F.coalesce(position(F.col("kind"), at, schedules), F.lit(1.0)))
    return placed.repartitionByRange("_at", "h").sortWithinPartitions("_at", "h").select("_doc.*")


def mix_sql(weights: tuple[int, ...] = WEIGHTS, most: int = MOST, schedules=SCHEDULES) -> str:
    """``mix`` over ``documents`` in DuckDB's SQL."""
    kinds = []
    for k, schedule in enumerate(schedules):
        cases = [f"WHEN u < {end!r} THEN {t0!r} + 2.0 * (u - {before!r}) / ({w!r} + sqrt({w * w!r} + {2 * slope!r} * (u - {before!r})))" for t0, w, slope, before, end in segments(schedule)]
        cases[-1] = cases[-1].replace(cases[-1][: cases[-1].index(" THEN")], "ELSE").replace("ELSE THEN", "ELSE")
        kinds.append(f"WHEN kind = {k} THEN " + (f"CASE {' '.join(cases)} END" if len(cases) > 1 else cases[0].removeprefix("ELSE ")))
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} AS INT) AS kind FROM s),
w AS (SELECT *, {list(weights)}[kind + 1] AS w, source_size * {most} AS cap FROM k),
l AS (
  SELECT *, sum(source_size) OVER () - sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING) + cap AS left_over,
    sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w),
r AS (SELECT *, CAST(left_over AS DOUBLE) / CAST(w_left AS DOUBLE) AS rate FROM l),
c AS (SELECT *, rate * w >= cap AS capped FROM r),
t AS (
  SELECT source, source_size, kind, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE (SELECT arg_max(rate, w_left) FROM c WHERE NOT capped) * w END AS target FROM c),
j AS (
  SELECT d.*, t.source_size, t.kind, t.target, CAST(round(t.target) AS BIGINT) AS words,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS rounds FROM j),
a AS (
  SELECT *, CAST(rounds * size + greatest(0, least(size, words - rounds * source_size - start)) AS BIGINT) AS taken FROM g),
u AS (SELECT *, (start + least(size, taken) / 2) / words AS u FROM a)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(CASE {" ".join(kinds)} END, 9) END AS position FROM u"""

"""Events in time: gaps, spending sessions, costs by period, latest state, one for each key, reversals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosewright.functions.text import gap_bucket

FRESH = "INTERVAL 14 DAYS"
SESSION_GAP_SECONDS = 3 * 3600


def fresh(rows: DataFrame, ts: str, now: Column, keep_days: int = 14) -> DataFrame:
    return rows.where(F.col(ts) >= now - F.make_dt_interval(F.lit(keep_days)))


def gaps(events: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """Adds ``gap`` (seconds since the key's last event) and its bucket."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, order))
    seconds = (F.unix_micros(ts) - F.unix_micros(before)) / 1e6
    return events.withColumn("gap", seconds).withColumn("bucket", gap_bucket("gap"))


def fresh_gaps(events: DataFrame, key: str, ts: str, order: str, keep_seconds: int = 14 * 86_400, most: int = 3) -> DataFrame:
    """(key, ts, order, gap, bucket, round, ask): gaps and rounds of each key, which starts anew after a silence of over ``keep_seconds``."""
    w = Window.partitionBy(key).orderBy(ts, order)
    since = (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))) / 1e6
    gapped = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(order).isNotNull()).withColumn("gap", F.when(since <= keep_seconds, since))
    run = F.count_if(F.col("gap").isNull()).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = gapped.withColumn("_run", run).withColumn("round", F.row_number().over(Window.partitionBy(key, "_run").orderBy(ts, order)).cast("long"))
    return numbered.select(key, ts, F.col(order).cast("long").alias(order), "gap", gap_bucket("gap").alias("bucket"), "round", (F.col("round") > most).alias("ask"))


def gap_histogram(events: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    return gaps(events, key, ts, order).groupBy("bucket").agg(F.count("*").alias("events"), F.countDistinct(key).alias("keys"))


def sessions(events: DataFrame, key: str, ts: str, order: str, amount: str, gap: int = SESSION_GAP_SECONDS) -> DataFrame:
    """(key, session, start, end, events, spent); a gap of exactly ``gap`` seconds does not close a session."""
    own = Window.partitionBy(key).orderBy(ts, order)
    apart = (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(own))) > gap * 1_000_000
    marked = events.withColumn("new", F.coalesce(apart.cast("int"), F.lit(0)))
    numbered = marked.withColumn("session", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("events"), F.round(F.sum(amount), 4).alias("spent"))


def open_spend(events: DataFrame, key: str, ts: str, order: str, amount: str, now: Column, gap: int = SESSION_GAP_SECONDS) -> DataFrame:
    """(key, spent) of the session still open at ``now``; 0 if the last event is older than the gap."""
    last = sessions(events, key, ts, order, amount, gap).groupBy(key).agg(F.max_by(F.struct("end", "spent"), "session").alias("s"))
    still = (F.unix_micros(now) - F.unix_micros("s.end")) <= gap * 1_000_000
    return last.select(key, F.when(still, F.col("s.spent")).otherwise(0.0).alias("spent"))


def cost_by_period(events: DataFrame, ts: str, amount: str, unit: str, by: str) -> DataFrame:
    """Rows and sums by period and ``by``, with subtotals and the grand total (nulls)."""
    period = F.date_format(F.date_trunc(unit, ts), "yyyy-MM-dd")
    return events.withColumn("period", period).rollup("period", by).agg(F.count("*").alias("n"), F.round(F.sum(amount), 4).alias("cost"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in append order; one aggregation."""
    others = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *others)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def first_of_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *others)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def as_of(points: DataFrame, states: DataFrame, key: str, ts: str) -> DataFrame:
    """Each point with the key's last state at or before it: one union and one window, no range join."""
    extra = [c for c in states.columns if c not in (key, ts)]
    own = [c for c in points.columns if c not in (key, ts)]
    left = points.select(key, ts, F.struct(*own).alias("p"), F.lit(None).cast(states.select(F.struct(*extra)).schema[0].dataType).alias("s"), F.lit(1).alias("side"))
    right = states.select(key, ts, F.lit(None).cast(points.select(F.struct(*own)).schema[0].dataType).alias("p"), F.struct(*extra).alias("s"), F.lit(0).alias("side"))
    seen = F.last("s", ignorenulls=True).over(Window.partitionBy(key).orderBy(ts, "side").rowsBetween(Window.unboundedPreceding, 0))
    return left.union(right).withColumn("state", seen).where("side = 1").select(key, ts, "p.*", *[F.col("state").getField(c).alias(c) for c in extra])


def reversals(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, changes, reversals): how often the value changes, and goes A, B, A."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = rows.withColumn("last", F.lag(value).over(w)).where(F.col("last").isNull() | (F.col(value) != F.col("last")))
    back = changed.withColumn("b1", F.lag(value, 1).over(w)).withColumn("b2", F.lag(value, 2).over(w))
    return back.groupBy(key).agg(F.count_if(F.col("b1").isNotNull()).alias("changes"), F.count_if(F.col("b2") == F.col(value)).alias("reversals"))


def round_numbers(rows: DataFrame, key: str, order: list[str], most: int = 3) -> DataFrame:
    """Adds ``round`` and ``ask``: beyond ``most`` rounds a person is asked."""
    return rows.withColumn("round", F.row_number().over(Window.partitionBy(key).orderBy(*order))).withColumn("ask", F.col("round") > most)


def period_summary(events: DataFrame, ts: str, since: Column, until: Column, amount: str, key: str) -> DataFrame:
    own = events.where((F.col(ts) >= since) & (F.col(ts) < until))
    return own.agg(F.count("*").alias("events"), F.countDistinct(key).alias("keys"), F.round(F.sum(amount), 4).alias("spent"), F.min(ts).alias("first"), F.max(ts).alias("last"))

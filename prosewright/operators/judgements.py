"""State of judgements kept by batches: a ledger's new rows change a few keys, and the ledger itself is not read again.

A batch becomes one row for each key it speaks of, a *change*:

    (kind, doc_key, key, phrase, last_when, last_seq, body, closed)

``kind`` is ``line`` and ``form`` (judged, ``key`` is the line's or the form's), ``approved``, ``ask`` or ``fix`` (``key`` is the line's).
Changes of one key meet by largest time, largest place in the ledger with its body, and "closed by anyone".  These are maxima, so
the order of batches, late rows and rows that come twice make no difference, and any part can be merged before the rest.

On disk a batch is one Parquet partition ``changes/batch=n`` that a repeated batch replaces; ``compact`` folds all of them into
``states/upto=n``.  A reader takes the last folded state and the batches behind it.  Freshness is asked when reading, since it
depends on the present time; only folding forgets what can never be fresh again.

Rows without a document or a key are left out; a ledger row with a null ``ok`` was not judged; an empty batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prosewright.operators.ledger import FRESH_SECONDS

BODY = "struct<line:int,phrase:string,text:string>"
ITEMS = "array<struct<line_key:string,line:int,phrase:string,text:string>>"
LEDGER = f"seq long, when double, doc_key string, ok boolean, seen array<string>, seen_form array<string>, asks {ITEMS}, fixes {ITEMS}"
DECISIONS = "doc_key string, kind string, line_key string, phrase string"
CHANGE = f"kind string, doc_key string, key string, phrase string, last_when double, last_seq long, body {BODY}, closed boolean"
KEYS = ["kind", "doc_key", "key", "phrase"]


def changes(ledger: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """One change a key of a batch: ledger rows (LEDGER) and what persons decided (DECISIONS).

    A decision's kind is ``ask`` or ``fix``, which it closes, or ``approved`` (a line a person wrote).  Columns beyond those named are not used.
    """
    no_body = F.lit(None).cast(BODY)

    def keys(kind: str, column: str) -> Column:
        return F.transform(F.coalesce(column, F.array()), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"), F.lit("").alias("phrase"), no_body.alias("body")))

    def items(kind: str, column: str) -> Column:
        body = lambda i: F.struct(i["line"].alias("line"), i["phrase"].alias("phrase"), i["text"].alias("text")).cast(BODY)
        return F.transform(column, lambda i: F.struct(F.lit(kind).alias("kind"), i["line_key"].alias("key"), F.coalesce(i["phrase"], F.lit("")).alias("phrase"), body(i).alias("body")))

    told = F.concat(keys("line", "seen"), keys("form", "seen_form"), F.coalesce(items("ask", "asks"), F.array()), F.coalesce(items("fix", "fixes"), F.array()))
    rows = ledger.where("ok").select("doc_key", F.col("when").cast("double").alias("last_when"), F.col("seq").cast("long").alias("last_seq"), F.inline(told))
    out = rows.select(*KEYS, "last_when", "last_seq", "body", F.lit(False).alias("closed"))
    if decisions is not None:
        shut = F.col("kind").isin("ask", "fix")
        phrase = F.when(shut, F.coalesce("phrase", F.lit(""))).otherwise("")
        out = out.union(decisions.select("kind", "doc_key", F.col("line_key").alias("key"), phrase.alias("phrase"), F.lit(None).cast("double"), F.lit(None).cast("long"), no_body, shut))
    return merged(out.where("doc_key IS NOT NULL AND key IS NOT NULL"))


def merged(rows: DataFrame) -> DataFrame:
    """Changes met by key.  Of rows with one place in the ledger the largest body counts, so the result does not depend on order."""
    latest = F.max(F.when(F.col("last_seq").isNotNull(), F.struct("last_seq", "body")))
    met = rows.groupBy(*KEYS).agg(F.max("last_when").alias("last_when"), latest.alias("_latest"), F.bool_or("closed").alias("closed"))
    return met.select(*KEYS, "last_when", F.col("_latest.last_seq").alias("last_seq"), F.col("_latest.body").alias("body"), "closed")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The partitioned table at the path; none if nothing was written there yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    part = "upto" if path.endswith("states") else "batch"
    return spark.read.schema(f"{CHANGE}, {part} long").parquet(path)


def _write(rows: DataFrame, path: str, part: str, number: int) -> None:
    """Replaces one partition and leaves the others; it becomes visible whole, when the job commits."""
    rows.withColumn(part, F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def _upto(spark: SparkSession, root: str) -> int:
    states = _read(spark, f"{root}/states")
    last = states.agg(F.max("upto")).first()[0] if states is not None else None
    return -1 if last is None else last


def add_batch(spark: SparkSession, root: str, batch: int, ledger: DataFrame, decisions: DataFrame | None = None) -> None:
    """Takes a batch into the state; a batch that is repeated replaces itself, or is folded in already and is left out."""
    if batch > _upto(spark, root):
        _write(changes(ledger, decisions), f"{root}/changes", "batch", batch)


def state(spark: SparkSession, root: str) -> DataFrame:
    """All keys' present state: the last folded one and the batches behind it, in one aggregation."""
    upto = _upto(spark, root)
    old, new = _read(spark, f"{root}/states"), _read(spark, f"{root}/changes")
    parts = [df for df in (old and old.where(F.col("upto") == upto).drop("upto"), new and new.where(F.col("batch") > upto).drop("batch")) if df is not None]
    if not parts:
        return spark.createDataFrame([], CHANGE)
    return merged(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))


def compact(spark: SparkSession, root: str, now: float) -> int:
    """Folds all batches into one state, without judged lines and forms that are stale for good; returns the last batch folded.

    Run it between batches.  Earlier states and folded batches are not read any more and may be deleted by whoever owns the folder.
    """
    upto = _upto(spark, root)
    new = _read(spark, f"{root}/changes")
    last = new.agg(F.max("batch")).first()[0] if new is not None else None
    if last is None or last <= upto:
        return upto
    stale = F.col("kind").isin("line", "form") & (F.coalesce("last_when", F.lit(float("-inf"))) < now - FRESH_SECONDS)
    _write(state(spark, root).where(~stale), f"{root}/states", "upto", last)
    return last


def touched(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """(doc_key) of the documents a batch changed: only their open lines, questions and fixes have to be told anew."""
    new = _read(spark, f"{root}/changes")
    if new is None:
        return spark.createDataFrame([], "doc_key string")
    return new.where(F.col("batch") == batch).select("doc_key").distinct()


def judged_lines(kept: DataFrame, now: Column | float) -> DataFrame:
    """(doc_key, line_key) judged lately or approved by a person, as ``ledger.judged`` tells from the whole ledger."""
    own = kept.where((F.col("kind") == "approved") | ((F.col("kind") == "line") & (F.col("last_when") >= now - FRESH_SECONDS)))
    return own.select("doc_key", F.col("key").alias("line_key")).distinct()


def judged_forms(kept: DataFrame, now: Column | float) -> DataFrame:
    """(doc_key, form_key), as ``ledger.judged_forms`` tells."""
    return kept.where((F.col("kind") == "form") & (F.col("last_when") >= now - FRESH_SECONDS)).select("doc_key", F.col("key").alias("form_key"))


def open_items(kept: DataFrame, kind: str) -> DataFrame:
    """(doc_key, line_key, line, phrase, text, seq) of questions (``ask``) or fixes (``fix``) nobody has closed; they do not grow stale."""
    own = kept.where((F.col("kind") == kind) & ~F.col("closed") & F.col("last_seq").isNotNull())
    return own.select("doc_key", F.col("key").alias("line_key"), "body.line", "body.phrase", "body.text", F.col("last_seq").alias("seq"))


def keep_state(ledger: DataFrame, root: str, checkpoint: str, every: int = 100, now: Column | None = None, **trigger) -> StreamingQuery:
    """Keeps the state over a stream of ledger rows, folding it every so many batches; restarts go on where they stopped.

    ``now`` is a constant Column of epoch seconds; the clock by default.
    """
    clock = F.unix_timestamp().cast("double") if now is None else now

    def take(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        add_batch(spark, root, batch, rows)
        if batch % every == every - 1:
            compact(spark, root, spark.range(1).select(clock).first()[0])

    return ledger.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

"""Corpus management: catalogue, copies, samples, passages, snapshots, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosewright.functions.text import content_digest, hangul_count, size_bucket, squeeze


def catalog(documents: DataFrame) -> DataFrame:
    """(doc_key, source, raw) to size, hash, line and Hangul counts; narrow."""
    n_bytes = F.octet_length("raw").cast("long")
    return documents.select(
        "doc_key", "source", n_bytes.alias("bytes"), F.sha2(F.col("raw").cast("binary"), 256).alias("sha256"), content_digest("raw").alias("digest"),
        F.size(F.split("raw", "\n")).cast("long").alias("line_count"), hangul_count("raw").cast("long").alias("hangul"), size_bucket(n_bytes).alias("size_bucket"),
    )


def stratified_sample(rows: DataFrame, strata: list[str], order: list[str], n: int) -> DataFrame:
    """Round robin over the strata, in the order of ``order`` within each, until ``n`` are taken."""
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    first = rows.withColumn("turn", turn).where(F.col("turn") <= n)  # Spark keeps so many of a stratum before the shuffle
    return first.orderBy("turn", *strata).limit(n)


def quota_sample(rows: DataFrame, group: str, order: list[str], quota: int, whole: str | None = None) -> DataFrame:
    """At most ``quota`` rows of each group; the group named ``whole`` is taken whole."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    keep = F.col("_nth") <= quota
    if whole is not None:
        keep = keep | (F.col(group) == whole)
    return rows.withColumn("_nth", turn).where(keep).drop("_nth")


def mark_copies(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds ``canonical``: ``name`` of the first row in ``order`` with the same key; one aggregation, so no window holds a group."""
    first = rows.groupBy(key).agg(F.min(F.struct(*order, F.col(name).alias("chosen"))).alias("f"), F.count("*").alias("copies")).select(key, F.col("f.chosen").alias("canonical"), "copies")
    return rows.join(first, key).withColumn("is_copy", F.col(name) != F.col("canonical"))


def upsert(rows: DataFrame, key: str, priority: str) -> DataFrame:
    """The row of lowest priority number for each key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(priority, *[c for c in others if c != priority])).alias("r")).select(key, "r.*").select(*rows.columns)


def with_provenance(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Documents whose front matter names a model and a time of making."""
    head = F.regexp_extract(raw, r"(?s)^---\n(.*?)\n---", 1)
    field = lambda name: F.regexp_extract(head, rf"(?m)^{name}:\s*(\S.*)$", 1)
    return rows.withColumn("model", field("model")).withColumn("generated_at", field("generated_at")).where("model != '' AND generated_at != ''")


def keyword_passages(sections: DataFrame, categories: dict[str, str], text: str = "text") -> DataFrame:
    """Sections that hold phrases of some category: score is distinct phrases plus twice the categories."""
    phrases = {name: F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.lower)) for name, pattern in categories.items()}
    hit = [F.when(F.size(p) > 0, F.lit(name)) for name, p in phrases.items()]
    found = sections.withColumn("categories", F.array_compact(F.array(*hit))).withColumn("phrases", F.array_distinct(F.flatten(F.array(*phrases.values()))))
    return found.where(F.size("categories") > 0).withColumn("score", (F.size("phrases") + 2 * F.size("categories")).cast("long")).withColumn("passage_hash", F.sha2(squeeze(text).cast("binary"), 256))


def best_passages(passages: DataFrame, name: str) -> DataFrame:
    """One row for each passage hash: that of highest score (ties: smallest name), and the number of names that have it."""
    best = passages.groupBy("passage_hash").agg(F.max("score").alias("score"), F.min(F.struct((-F.col("score")).alias("s"), F.col(name).alias("n"))).alias("b"), F.count("*").alias("uses"))
    return best.select("passage_hash", "score", F.col("b.n").alias(name), "uses")


def passage_aliases(passages: DataFrame, name: str) -> DataFrame:
    """(passage_hash, name): every name of each passage, as rows, as a common passage has names without bound."""
    return passages.select("passage_hash", name).distinct()


def verify_manifest(found: DataFrame, manifest: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """Entries whose hash is missing or another: none if all is well."""
    return manifest.join(found.select(key, digest), [key, digest], "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed."""
    both = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key, "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select(key, "change")


def transcript_coverage(turns: DataFrame) -> DataFrame:
    """By role: turns, conversations, empty and repeated turns, characters, share of all turns."""
    again = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")) == F.col("text")
    by_role = turns.withColumn("again", F.coalesce(again, F.lit(False))).groupBy("role").agg(
        F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty_turns"),
        F.count_if("again").alias("repeats_before"), F.sum(F.length("text")).alias("chars"),
    )
    total = turns.agg(F.count("*").alias("all_turns"))
    return by_role.join(F.broadcast(total)).withColumn("turn_share", F.round(F.col("turns") / F.col("all_turns"), 6)).drop("all_turns")


def uptake(rows: DataFrame, ts: str, change: Column, session: str, used: Column) -> DataFrame:
    """Before and after a change: rows, sessions, uses and their rate."""
    bucket = F.when(F.col(ts) < change, "before").otherwise("after")
    return rows.groupBy(bucket.alias("period")).agg(F.count("*").alias("n"), F.countDistinct(session).alias("sessions"), F.count_if(used).alias("used"), F.round(F.avg(used.cast("double")), 6).alias("rate"))


def last_by_stage(rows: DataFrame, keys: list[str], stage: str, stages: list[str], verdict: str, order: str) -> DataFrame:
    """The last verdict of each key at each stage, one column a stage."""
    return rows.groupBy(*keys).pivot(stage, stages).agg(F.max_by(verdict, order))

"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join of its possible hits.

A listed entry is a host and a path prefix; it fits its host and all subdomains if the URL's path starts with its
path, and the longest fitting entry decides.  A URL therefore has a few candidate keys: each suffix of its host
joined with each prefix of its path that is as long as some listed path.  Filter blocks are four 64-bit words, a key
sets one bit in each word of its block.  Candidates that pass are joined with the list itself, which removes the false
positives.  Blocks and list are broadcast while they are under a checked size, and joined by a shuffle beyond it.

Null URL or one without ``://``: host and path empty, no rule.  Verdict without a rule: ``allow``.  Repeated pages are
judged each; empty tables (pages or list) are no special case.  Equal entries with both actions: block wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_KEYS = 16  # listed keys a block of 256 bits is made for
BROADCAST_ROWS = 200_000  # blocks or list entries, under 40 MB


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(action, host, path) rows as a table."""
    rows = [F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _bits(key: str, blocks: int) -> list[Column]:
    """Block number and the bit in each of its words."""
    inside = f"xxhash64({key}, 7L)"
    words = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned({inside}, {8 * j}) & 63 AS INT))").alias(f"m{j}") for j in range(4)]
    return [F.expr(f"pmod(xxhash64({key}), {blocks}L)").alias("block"), *words]


def judge_urls(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule (host and path of the entry that decides, else null) and verdict of every page."""
    listed = listed.select("action", "host", "path", F.concat("host", "path").alias("key")).where(F.col("key").isNotNull())
    facts = listed.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.length("path"))).alias("lengths")).first()
    blocks = max(1, -(-facts["n"] // BLOCK_KEYS))
    small = lambda n, df: F.broadcast(df) if n <= BROADCAST_ROWS else df

    host, path = url_parts(F.col("url"))
    parted = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.filter(F.lit(facts["lengths"]).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n)))))
    candidates = parted.where(F.col("host") != "").select("url", F.explode(F.array_distinct(keys)).alias("key"))

    filled = listed.select(*_bits("key", blocks)).groupBy("block").agg(*[F.bit_or(f"m{j}").alias(f"w{j}") for j in range(4)])
    probes = candidates.select("url", "key", *_bits("key", blocks))
    passes = probes["block"] == filled["block"]
    for j in range(4):
        passes &= filled[f"w{j}"].bitwiseAND(probes[f"m{j}"]) == probes[f"m{j}"]
    possible = probes.join(small(blocks, filled), passes).select("url", probes["key"])

    hits = possible.join(small(facts["n"], listed.select("key", "action")), "key")
    best = hits.groupBy("url").agg(F.max(F.struct(F.length("key").alias("n"), "key", "action")).alias("best"))
    return parted.join(best, "url", "left").select(
        "page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit("allow")).alias("verdict")
    )

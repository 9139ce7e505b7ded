"""Similar lines of one document by a filtered join: only pairs that can reach the ratio are compared.

The ratio is that of Ratcliff and Obershelp, 2 M / (a + b) for M matching characters; M is at most the number of characters the two
lines have in common, each counted as often as both have it.  A line is therefore a set of numbered characters (the
third ``e`` is a token of its own), and a pair of ratio t shares at least t / (2 - t) of either line's tokens.  If tokens are ordered from
the document's rarest on, such a pair has MET tokens in common among the first ones of both (the prefix), so prefixes are joined
by (document, token), an inverted index inside each document, and pairs that meet less often are left.  Pairs whose lengths rule them out are left; a bound by counts
precedes the exact ratio of each survivor.  Nothing else is cut, so the result is that of all pairs.

Equal lines meet by an equi join and are not compared.  Null and empty lines are like nothing.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosewright.functions.spans import pandas_function, similarity

MET = 4  # tokens that prefixes are long enough to share


@pandas_function("array<bigint>")
def numbered(texts: pd.Series) -> pd.Series:
    """The characters of a line, each with how often it has come before."""

    def one(text):
        seen: Counter = Counter()
        out = []
        for c in text or "":
            out.append(ord(c) << 32 | seen[c])
            seen[c] += 1
        return out

    return texts.map(one)


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(doc_key, a, b) of distinct unequal lines of ``left`` (doc_key, a) and ``right`` (doc_key, b) that may have the ratio."""
    side = lambda df, c: df.select("doc_key", F.col(c).alias("line"), F.lit(c).alias("side")).where("line != ''").distinct()
    tokens = side(left, "a").union(side(right, "b")).select("*", F.explode(numbered("line")).alias("token"))
    rare = tokens.withColumn("n", F.count("*").over(Window.partitionBy("doc_key", "token")))
    ordered = rare.groupBy("doc_key", "side", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda t: t["token"]).alias("tokens"))
    shared = F.greatest(F.ceil(F.length("line") * (least / (2 - least)) - 1e-9), F.lit(1)).cast("int")  # tokens that a partner must share at least
    sized = ordered.withColumns({"shared": shared, "met": F.least(shared, F.lit(MET))})
    prefix = sized.select("doc_key", "side", "line", "met", F.explode(F.slice("tokens", F.lit(1), F.length("line") - F.col("shared") + F.col("met"))).alias("token"))
    a = prefix.where("side = 'a'").select("doc_key", "token", F.col("line").alias("a"), F.col("met").alias("met_a"))
    b = prefix.where("side = 'b'").select("doc_key", "token", F.col("line").alias("b"), F.col("met").alias("met_b"))
    near = 2 * F.least(F.length("a"), F.length("b")) >= least * (F.length("a") + F.length("b"))
    met = a.join(b, ["doc_key", "token"]).where(near & (F.col("a") != F.col("b"))).groupBy("doc_key", "a", "b").agg(F.count("*").alias("n"), F.min(F.least("met_a", "met_b")).alias("met"))
    return met.where("n >= met").select("doc_key", "a", "b")


def similar_pairs(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_key, a, b, ratio) of all lines of ``left`` (doc_key, a) and ``right`` (doc_key, b) with at least this ratio, over 0."""
    if not 0 < least <= 1 or math.isnan(least):
        raise ValueError("the ratio must lie over 0 and be at most 1")

    @pandas_function("double")
    def exact(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y, least) for x, y in zip(a, b, strict=True)], dtype=float)

    a, b = left.select("doc_key", "a").where("a != ''").distinct(), right.select("doc_key", "b").where("b != ''").distinct()
    equal = a.join(b.withColumn("a", F.col("b")), ["doc_key", "a"]).select("doc_key", "a", "b", F.lit(1.0).alias("ratio"))
    like = candidates(a, b, least).withColumn("ratio", exact("a", "b")).where(F.col("ratio") >= least)
    return equal.union(like)

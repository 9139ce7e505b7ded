"""Planted defects and what a detector makes of them, net of what it also says of the clean twin.

A specimen is a block of lines with one defect and its clean twin of as many lines.  Each document gets one specimen of
each family; which one goes by turns, so that all are planted as often.  The two texts of a document differ in the planted
blocks only, so whatever a detector says of both is not owed to the defect.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Specimen(NamedTuple):
    """``note`` is the start of the finding's note, for kinds that stand for several patterns."""

    family: str
    kind: str
    bad: str
    good: str
    note: str = ""


def families(specimens: list[Specimen]) -> dict[str, list[Specimen]]:
    """Specimens by family, in the order given; a twin must have as many lines as the defect."""
    out: dict[str, list[Specimen]] = {}
    for s in specimens:
        if s.bad.count("\n") != s.good.count("\n"):
            raise ValueError(f"{s.kind}: defect and twin differ in their number of lines")
        out.setdefault(s.family, []).append(s)
    return out


def planted_rows(documents: DataFrame, specimens: list[Specimen], turn: Column, after: Column) -> DataFrame:
    """Documents (doc_key, raw) as (doc_key, raw, at, bad, good, plants), a row for each.

    The blocks of either side go behind line ``at`` of the text; plants are an array of (family, kind, note, first_line,
    last_line).  Blocks go behind line ``after`` (0: in front), one after the other between empty lines; the specimen of a
    family is number ``turn`` modulo their number.  A document without text has the blocks alone; without a turn it has the
    first specimens; a place beyond the end is the end.  Rows that share a doc_key are planted each for itself.
    """
    by = families(specimens)
    lines = F.split(F.coalesce("raw", F.lit("")), "\n")
    at = F.greatest(F.lit(0), F.least(F.coalesce(after, F.lit(0)).cast("int"), F.size(lines)))
    chosen = []
    for own in by.values():
        each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in s._asdict().items()], F.lit(s.bad.count("\n") + 1).alias("n")) for s in own])
        chosen.append(F.get(each, F.pmod(F.coalesce(turn, F.lit(0)), F.lit(len(own))).cast("int")))
    rows = documents.select("doc_key", F.coalesce("raw", F.lit("")).alias("raw"), at.alias("at"), F.array(*chosen).alias("blocks"))
    block = lambda side: F.array_join(F.transform("blocks", lambda b: F.concat(F.lit("\n"), b[side], F.lit("\n"))), "\n").alias(side)
    ahead = lambda i: F.aggregate(F.slice("blocks", F.lit(1), i), F.col("at") + 2, lambda n, b: n + b["n"] + 2)
    placed = F.transform("blocks", lambda b, i: F.struct(b["family"].alias("family"), b["kind"].alias("kind"), b["note"].alias("note"), ahead(i).alias("first_line"), (ahead(i) + b["n"] - 1).alias("last_line")))
    return rows.select("doc_key", "raw", "at", block("bad"), block("good"), placed.alias("plants"))


def plant(documents: DataFrame, specimens: list[Specimen], turn: Column, after: Column) -> tuple[DataFrame, DataFrame]:
    """Texts (doc_key, side, raw) and plants (doc_key, family, kind, note, first_line, last_line) of ``planted_rows``."""
    rows = planted_rows(documents, specimens, turn, after).withColumn("lines", F.split("raw", "\n"))

    def text(side: str) -> Column:
        return F.array_join(F.concat(F.slice("lines", F.lit(1), F.col("at")), F.array(side), F.slice("lines", F.col("at") + 1, F.size("lines"))), "\n")

    sides = F.array(*[F.struct(F.lit(s).alias("side"), text(s).alias("raw")) for s in ("bad", "good")])
    return rows.select("doc_key", F.inline(sides)), rows.select("doc_key", F.inline("plants"))


def owed(bad: DataFrame, good: DataFrame, short: int = 20) -> DataFrame:
    """Findings (doc_key, line_no, kind, match, note) of the defective text that its twin does not have, by kind and quotation.

    Quotations over ``short`` characters change with the line they quote, so of these the kind alone is compared.
    """
    quoted = F.when(F.length("match") <= short, F.col("match")).otherwise("")
    known = good.select("doc_key", "kind", F.coalesce(quoted, F.lit("")).alias("quoted")).distinct()
    return bad.withColumn("quoted", F.coalesce(quoted, F.lit(""))).join(known, ["doc_key", "kind", "quoted"], "left_anti").drop("quoted")


def caught(plants: DataFrame, bad: DataFrame, good: DataFrame, short: int = 20) -> DataFrame:
    """Plants with ``found``, whether a finding of the planted kind lies in the block (or has no line), and ``net``, whether
    one does that the twin does not have.

    A document has one plant of each family, so plants meet findings by document and kind.
    """
    keys = ["doc_key", "family", "kind", "note", "first_line", "last_line"]

    def hit(findings: DataFrame, name: str) -> DataFrame:
        own = findings.select("doc_key", "kind", "line_no", F.col("note").alias("said")).distinct()
        inside = F.col("line_no").isNull() | F.col("line_no").between(F.col("first_line"), F.col("last_line"))
        met = plants.select(*keys).distinct().join(own, ["doc_key", "kind"]).where(inside & F.startswith(F.coalesce("said", F.lit("")), F.col("note")))
        return met.select(*keys).distinct().withColumn(name, F.lit(True))

    out = plants.join(hit(bad, "found"), keys, "left").join(hit(owed(bad, good, short), "net"), keys, "left")
    return out.withColumn("found", F.coalesce("found", F.lit(False))).withColumn("net", F.coalesce("net", F.lit(False)))


def recall(hits: DataFrame, by: list[str]) -> DataFrame:
    """(by, planted, found, net, recall, net_recall) of ``caught``'s rows."""
    counts = hits.groupBy(*by).agg(F.count("*").alias("planted"), F.count_if("found").alias("found"), F.count_if("net").alias("net"))
    return counts.select("*", F.round(F.col("found") / F.col("planted"), 6).alias("recall"), F.round(F.col("net") / F.col("planted"), 6).alias("net_recall"))

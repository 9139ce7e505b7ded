"""State of judgements over an append-only ledger: judged and open lines, open questions and fixes, lineage, passes.

Ledger rows are (seq, when, doc_key, ok, seen array<string>, seen_form array<string>, asks, fixes); seq is the order of appending.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosewright.functions.spans import pandas_function, similarity
from prosewright.functions.text import form_key, line_key
from prosewright.operators.similarity import similar_pairs

FRESH_SECONDS = 14 * 86_400
MOST_ROUNDS = 3
SPLIT_FRESH = 0.4


def key_matches(row_key: Column | str, key: Column | str, sep: str = "::") -> Column:
    """A row's key names the document: the same key, or an old one of the path alone (keys are path, ``sep``, repository)."""
    row, own = (F.col(c) if isinstance(c, str) else c for c in (row_key, key))
    legacy = ~F.contains(row, F.lit(sep)) & F.contains(own, F.lit(sep)) & (F.substring_index(own, sep, 1) == row)
    return F.coalesce((row == own) | legacy, F.lit(False))


def rows_of(ledger: DataFrame, documents: DataFrame, sep: str = "::") -> DataFrame:
    """Ledger rows of the documents (doc_key) under their present keys, old keys read as well: two equi joins."""
    own = documents.select(F.col("doc_key").alias("_key"), F.substring_index("doc_key", sep, 1).alias("_path")).distinct()
    same = ledger.join(own.select("_key"), F.col("doc_key") == F.col("_key"))
    old = ledger.where(~F.contains("doc_key", F.lit(sep))).join(own.where("_key != _path"), F.col("doc_key") == F.col("_path")).drop("_path")
    return same.union(old).withColumn("doc_key", F.col("_key")).drop("_key")


@pandas_function("array<boolean>")
def heirs(parent: pd.Series, rivals: pd.Series, held: pd.Series) -> pd.Series:
    """Which of the lines that claim one parent, likest first, go on with it.

    The first does.  A later one only if the line was split: at least SPLIT_FRESH of the parent's letters and digits it
    shares were not taken yet.  None does if the parent itself still stands (``held``).
    """

    def shared(p: str, line: str) -> set[int]:
        blocks = difflib.SequenceMatcher(None, p, line, autojunk=False).get_matching_blocks()
        return {i for b in blocks if b.size >= 2 for i in range(b.a, b.a + b.size) if p[i].isalnum()}

    def chosen(p, lines, stands):
        taken: set[int] = set()
        out = []
        for line in lines:
            mine = set() if stands else shared(p, line)
            goes_on = bool(mine) and (not taken or len(mine - taken) >= SPLIT_FRESH * len(mine))
            taken |= mine if goes_on else set()
            out.append(goes_on)
        return out

    return pd.Series([chosen(p or "", list(r), bool(h)) for p, r, h in zip(parent, rivals, held, strict=True)])


def split_inheritance(claims: DataFrame, standing: DataFrame) -> DataFrame:
    """(doc_key, parent, line, goes_on) of claims (doc_key, parent, line, ratio): each parent's heirs; ``standing`` are lines (doc_key, line)."""
    still = standing.select("doc_key", F.col("line").alias("parent")).distinct().withColumn("held", F.lit(True))
    likest = F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("r"), "line")))
    grouped = claims.groupBy("doc_key", "parent").agg(likest.alias("c")).join(still, ["doc_key", "parent"], "left").withColumn("lines", F.transform("c", lambda c: c["line"]))
    judged_lines = grouped.withColumn("ok", heirs("parent", "lines", F.coalesce("held", F.lit(False))))
    return judged_lines.select("doc_key", "parent", F.inline(F.arrays_zip(F.col("lines").alias("line"), F.col("ok").alias("goes_on"))))


def fresh_rows(ledger: DataFrame, now: Column | float) -> DataFrame:
    return ledger.where(F.col("when") >= now - FRESH_SECONDS)


def judged(ledger: DataFrame, approved: DataFrame, now: Column | float) -> DataFrame:
    """(doc_key, line_key) seen by a good fresh judgement or approved by a person."""
    seen = fresh_rows(ledger.where("ok"), now).select("doc_key", F.explode("seen").alias("line_key"))
    return seen.union(approved.select("doc_key", "line_key")).distinct()


def judged_forms(ledger: DataFrame, now: Column | float) -> DataFrame:
    return fresh_rows(ledger.where("ok"), now).select("doc_key", F.explode("seen_form").alias("form_key")).distinct()


def open_lines(lines: DataFrame, base: DataFrame, ledger: DataFrame, approved: DataFrame, now: Column | float) -> DataFrame:
    """Lines with Hangul that are not in the base version, not judged, and not known in another form."""
    keyed = lines.withColumn("line_key", line_key("text")).withColumn("form_key", form_key("text")).where("line_key IS NOT NULL")
    old = base.withColumn("line_key", line_key("text")).select("doc_key", "line_key").distinct()
    out = keyed.join(old, ["doc_key", "line_key"], "left_anti").join(judged(ledger, approved, now), ["doc_key", "line_key"], "left_anti")
    return out.join(judged_forms(ledger, now), ["doc_key", "form_key"], "left_anti").select(*lines.columns, "line_key")


def attach(items: DataFrame, lines: DataFrame, decided: DataFrame) -> DataFrame:
    """Open questions (doc_key, line_key, phrase, …) on the current lines: by key, else the first line with the phrase; decided ones go."""
    keyed = lines.withColumn("line_key", line_key("text"))
    wanted = items.join(decided.select("doc_key", "line_key", "phrase"), ["doc_key", "line_key", "phrase"], "left_anti").dropDuplicates(["doc_key", "line_key", "phrase"])
    by_key = wanted.join(keyed.groupBy("doc_key", "line_key").agg(F.min("line_no").alias("line_no")), ["doc_key", "line_key"])
    rest = wanted.join(by_key.select("doc_key", "line_key", "phrase"), ["doc_key", "line_key", "phrase"], "left_anti")
    near = rest.join(keyed.select("doc_key", F.col("line_no").alias("at"), "text"), "doc_key").where(F.contains("text", F.col("phrase")))
    by_phrase = near.groupBy(*wanted.columns).agg(F.min("at").alias("line_no"))
    return by_key.select(*wanted.columns, "line_no").union(by_phrase.select(*wanted.columns, "line_no"))


def attach_fixes(fixes: DataFrame, lines: DataFrame, least: float = 0.5) -> DataFrame:
    """Open fixes (doc_key, line_key, line, phrase, text) by key, else on the like line with the phrase nearest to the old place."""
    keyed = lines.withColumn("line_key", line_key("text")).withColumnRenamed("text", "now_text")
    by_key = fixes.join(keyed.groupBy("doc_key", "line_key").agg(F.min("line_no").alias("line_no")), ["doc_key", "line_key"])
    rest = fixes.join(by_key.select("doc_key", "line_key", "phrase"), ["doc_key", "line_key", "phrase"], "left_anti")
    like = similar_pairs(rest.select("doc_key", F.col("text").alias("a")), keyed.select("doc_key", F.col("now_text").alias("b")), least).select("doc_key", F.col("a").alias("text"), F.col("b").alias("now_text"))
    near = rest.join(like, ["doc_key", "text"]).where(F.contains("now_text", F.col("phrase"))).join(keyed.select("doc_key", "now_text", F.col("line_no").alias("at")), ["doc_key", "now_text"])
    best = near.groupBy(*fixes.columns).agg(F.min_by("at", F.struct(F.abs(F.col("at") - F.col("line")), F.col("at"))).alias("line_no"))
    return by_key.select(*fixes.columns, "line_no").union(best.select(*fixes.columns, "line_no"))


@pandas_function("array<struct<old:int,new:int,ratio:double>>")
def successors(old: pd.Series, new: pd.Series) -> pd.Series:
    """For arrays of old and new lines: each changed old line's successor, the likest within its block (0.3) or anywhere (0.5)."""

    def follow(a, b):
        a, b, out = list(a), list(b), []
        for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            for x in range(i, j) if tag in ("replace", "delete") else ():
                inside = max(((similarity(a[x], b[y], 0.3), -y) for y in range(k, m)), default=(0.0, 0))
                best = inside if inside[0] >= 0.3 else max(((similarity(a[x], b[y], 0.5), -y) for y in range(len(b))), default=(0.0, 0))
                if best[0] >= (0.3 if best is inside else 0.5):
                    out.append((x, -best[1], round(best[0], 6)))
        return out

    return pd.Series([follow(x, y) for x, y in zip(old, new, strict=True)])


@pandas_function("array<struct<line:string,after:int>>")
def deletions(old: pd.Series, new: pd.Series) -> pd.Series:
    """Old lines that are gone, moved ones left out, with the new line they stood before."""

    def gone(a, b):
        a, b = list(a), list(b)
        kept = set(b)
        return [(x, k) for tag, i, j, k, _ in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag == "delete" for x in a[i:j] if x not in kept]

    return pd.Series([gone(x, y) for x, y in zip(old, new, strict=True)])


def line_arrays(lines: DataFrame, name: str) -> DataFrame:
    return lines.groupBy("doc_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]).alias(name))


def words_kept(line: Column | str, before: Column | str) -> Column:
    """The line is a part of an earlier one, or made of earlier ones' words only."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.contains(before, line) | (F.size(F.array_except(words(line), words(before))) == 0)


def lineage(targets: DataFrame, versions: DataFrame, least: float = 0.5, standing: DataFrame | None = None) -> DataFrame:
    """Rounds of the lines to be judged: (doc_key, text) follows the likest earlier version (doc_key, text, round, root).

    A line that keeps its predecessor's words keeps the round; else it is one higher; without a predecessor it is 1.  With the
    present text's lines (``standing``: doc_key, line), lines that share a predecessor follow it only if it was split into them:
    the likest does, others if they match other parts of it, and none if it still stands in a line that is not judged.
    """
    t = targets.select("doc_key", F.col("text").alias("target")).distinct()
    v = versions.select("doc_key", F.col("text").alias("old"), "round", "root")
    like = similar_pairs(t.withColumnRenamed("target", "a"), v.withColumnRenamed("old", "b"), least).withColumnsRenamed({"a": "target", "b": "old"})
    best = like.join(v, ["doc_key", "old"]).groupBy("doc_key", "target").agg(F.max(F.struct("ratio", "round", "root", "old")).alias("p"))
    if standing is not None:
        left = standing.select("doc_key", "line").join(t.withColumnRenamed("target", "line"), ["doc_key", "line"], "left_anti")
        claims = best.select("doc_key", F.col("p.old").alias("parent"), F.col("target").alias("line"), F.col("p.ratio").alias("ratio"))
        follow = split_inheritance(claims, left).where("goes_on").select("doc_key", F.col("line").alias("target"))
        best = best.join(follow, ["doc_key", "target"], "left_semi")
    out = targets.select("doc_key", F.col("text").alias("target")).join(best, ["doc_key", "target"], "left")
    next_round = F.when(F.col("p").isNull(), 1).when(words_kept("target", "p.old"), F.col("p.round")).otherwise(F.col("p.round") + 1)
    return out.select("doc_key", F.col("target").alias("text"), next_round.alias("round"), F.coalesce("p.root", "target").alias("root")).withColumn("ask", F.col("round") > MOST_ROUNDS)


def revived(fixes: DataFrame, versions: DataFrame) -> DataFrame:
    """Fixes (doc_key, root, fix) that bring back a phrase flagged at the root (doc_key, root, phrase)."""
    return fixes.join(versions.select("doc_key", "root", "phrase"), ["doc_key", "root"]).where(F.contains("fix", F.col("phrase")))


def still_flagged(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Flagged phrases (doc_key, line_no, phrase) that the edited line still has."""
    return findings.join(lines, ["doc_key", "line_no"]).where(F.contains("text", F.col("phrase"))).select(*findings.columns)


def pass_status(passes: DataFrame, now: Column | float, rules: str, free: str = "judgment") -> DataFrame:
    """(path, hash, stage, verdict): the last entry in append order, fresh and of the same rules; the ``free`` stage holds for any rules."""
    own = passes.where(F.col("when") >= now - FRESH_SECONDS).where((F.col("rules") == rules) | (F.col("stage") == free))
    return own.groupBy("path", "hash", "stage").agg(F.max_by("verdict", "seq").alias("verdict"))


def first_snapshot(snapshots: DataFrame) -> DataFrame:
    """(doc_key, line_hash) of each document's first snapshot in the ledger of old lines."""
    first = snapshots.groupBy("doc_key").agg(F.min(F.struct("at", "line_hashes")).alias("s"))
    return first.select("doc_key", F.explode(F.split("s.line_hashes", ",")).alias("line_hash"))


def merge_fallback(ledger: DataFrame, fallback: DataFrame) -> DataFrame:
    """The ledger with the rows of a fallback file, each once."""
    return ledger.unionByName(fallback).distinct()


def spend(ledger: DataFrame, unit: str) -> DataFrame:
    """Calls and cost by period and document, with totals (nulls)."""
    period = F.date_trunc(unit, F.timestamp_seconds("when"))
    return ledger.withColumn("period", period).rollup("period", "doc_key").agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"))


def over_budget(ledger: DataFrame, limit: float, gap: int = 3 * 3600) -> DataFrame:
    """(doc_key, spent) of documents whose open spending session has reached the limit."""
    w = Window.partitionBy("doc_key").orderBy(F.desc("when"))
    apart = F.coalesce((F.lag("when").over(w) - F.col("when") > gap).cast("int"), F.lit(0))
    now = ledger.withColumn("apart", apart).withColumn("back", F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("back = 0")
    return now.groupBy("doc_key").agg(F.sum("cost_usd").alias("spent")).where(F.col("spent") >= limit)


def version_components(edges: DataFrame) -> DataFrame:
    """(doc_key, text, root): versions of one line joined by (doc_key, before, after) edges, named by the first seen (seq).

    One group is one document's ledger.
    """

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        parent: dict = {}

        def find(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for r in frame.sort_values("seq").itertuples(index=False):
            a, b = find(r.before), find(r.after)
            if a != b:
                parent[b] = a
        return pd.DataFrame([(frame["doc_key"].iloc[0], x, find(x)) for x in parent], columns=["doc_key", "text", "root"])

    return edges.select("doc_key", "seq", "before", "after").groupBy("doc_key").applyInPandas(joined, "doc_key string, text string, root string")


def flip_flops(versions: DataFrame) -> DataFrame:
    """(doc_key, root, versions, reverts) of lines whose text went A, B, A: versions are (doc_key, root, seq, text)."""
    w = Window.partitionBy("doc_key", "root").orderBy("seq")
    changed = versions.withColumn("last", F.lag("text").over(w)).where(F.col("last").isNull() | (F.col("text") != F.col("last")))
    back = changed.withColumn("second_last", F.lag("text", 2).over(w))
    return back.groupBy("doc_key", "root").agg(F.count("*").alias("versions"), F.count_if(F.col("second_last") == F.col("text")).alias("reverts"))


def self_contradictions(fixes: DataFrame, least: int = 4, longer: int = 8) -> DataFrame:
    """(doc_key, root, fixes, contradicting) of fixes (doc_key, root, seq, text, phrase, fix) that take back an earlier fix of the line.

    A fix does so if an earlier one's wording still stands in the text and the phrase it objects to lies in that wording, or
    holds it and is at most ``longer`` characters longer.  Wordings and phrases under ``least`` characters, and fixes with a
    gap to fill, tell nothing.  A group is the history of one line.
    """
    before = Window.partitionBy("doc_key", "root").orderBy("seq", "phrase", "fix").rowsBetween(Window.unboundedPreceding, -1)
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    own = fixes.withColumn("phrase", blank("phrase")).withColumn("fix", blank("fix"))
    wording = F.when((F.length("fix") >= least) & ~F.contains("fix", F.lit("○")), F.col("fix"))
    told = own.withColumn("earlier", F.collect_set(wording).over(before))
    taken_back = lambda p: F.contains("text", p) & (F.contains(p, F.col("phrase")) | (F.contains("phrase", p) & (F.length("phrase") <= F.length(p) + longer)))
    again = (F.length("phrase") >= least) & F.coalesce(F.exists("earlier", taken_back), F.lit(False))
    return told.groupBy("doc_key", "root").agg(F.count("*").alias("fixes"), F.count_if(again).alias("contradicting"))

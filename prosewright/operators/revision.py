"""Two versions of a text: what was lost, added or changed.  Pairs are (pair_id, original, revised)."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright.functions.spans import numbers, pandas_function, ratio, similarity
from prosewright.functions.text import change_level, squeeze

# What a revision must keep, and the marks that carry meaning (Java syntax).
PROTECTED = (
    r"https?://[^\s<>()]+|`[^`\n]+`|\"[^\"\n]+\"|“[^”\n]+”|'[^'\n]+'|‘[^’\n]+’|「[^」\n]+」|『[^』\n]+』"
    r"|(?<![A-Za-z0-9])\d[\d.,~:+/%-]*(?:[A-Za-z%]+)?(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?:[A-Z]{2,}[A-Z0-9_.+-]*|[A-Za-z_][A-Za-z0-9_.+-]*\d[A-Za-z0-9_.+-]*|[A-Za-z0-9_.+-]+/[A-Za-z0-9_./+-]+)(?![A-Za-z0-9])"
)
MARKERS = {
    "cause_condition": r"(?:므로|라서|때문|덕분|탓에|니까|려면|할 때|경우|따라서|이므로|어서|[가-힣](?:으면|면)(?=[\s,·)\]]|$))",
    "plan_progress": r"(?:예정|계획|할 것|하고 있|하는 중|중이|진행 중)",
    "done_certain": r"(?:완료|했다|됐다|되었|끝냈|마쳤)",
    "negation_scope": r"(?:않|못하|없|아니|모두|전부|일부|대부분|만 )",
    "guess_reserve": r"(?:보인다|보임|듯|가능성|추정|일 수 있|것으로|[었았였했]을 수 있|못할 수 있)",
    "actor": r"[가-힣]{2,}(?:이|가)(?=\s)",
}
NON_PROSE = r"(?is)<style\b[^>]*>.*?</style>|<script\b[^>]*>.*?</script>|data:[^;,\s\"')]+;base64,[A-Za-z0-9+/=]+"
SAME_SENTENCE = 0.5


def tokens(text: Column | str, pattern: str = PROTECTED) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def token_changes(pairs: DataFrame, before: Column, after: Column) -> DataFrame:
    """(pair_id, token, removed, added): the multiset difference both ways, for tokens that differ in number."""
    one = lambda c, a, b: pairs.select("pair_id", F.explode(c).alias("token"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    counted = one(before, 1, 0).union(one(after, 0, 1)).groupBy("pair_id", "token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return counted.where("a != b").select("pair_id", "token", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("removed"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("added"))


def protected_status(pairs: DataFrame, expected: DataFrame | None = None, explicit: DataFrame | None = None) -> DataFrame:
    """preserved, removed or changed, with the tokens lost and added.

    ``expected`` (pair_id, token) are removals that were asked for; ``explicit`` tokens that must be kept.
    """
    own = pairs.withColumn("original", F.regexp_replace("original", NON_PROSE, "")).withColumn("revised", F.regexp_replace("revised", NON_PROSE, ""))
    changes = token_changes(own, tokens("original"), tokens("revised"))
    if expected is not None:
        changes = changes.join(expected.select("pair_id", "token", F.lit(True).alias("asked")), ["pair_id", "token"], "left").withColumn("removed", F.when(F.col("asked"), 0).otherwise(F.col("removed")))
    lost = changes.groupBy("pair_id").agg(
        F.array_sort(F.flatten(F.collect_list(F.array_repeat("token", F.col("removed").cast("int"))))).alias("removed"), F.array_sort(F.flatten(F.collect_list(F.array_repeat("token", F.col("added").cast("int"))))).alias("added")
    )
    out = own.join(lost, "pair_id", "left")
    must = F.lit(False)
    if explicit is not None:
        out = out.join(explicit.groupBy("pair_id").agg(F.collect_set("token").alias("must")), "pair_id", "left")
        must = F.coalesce(F.exists("must", lambda t: F.contains("original", t) & ~F.contains("revised", t)), F.lit(False))
    empty = F.array().cast("array<string>")
    out = out.withColumn("removed", F.coalesce("removed", empty)).withColumn("added", F.coalesce("added", empty))
    status = F.when((F.size("added") > 0) | must, "changed").when(F.size("removed") > 0, "removed").otherwise("preserved")
    return out.select("pair_id", status.alias("status"), "removed", "added")


def change_rate(pairs: DataFrame) -> DataFrame:
    """(pair_id, rate, level): one less the alignment ratio of the squeezed texts."""
    rate = F.round(1 - ratio(squeeze("original"), squeeze("revised")), 6)
    return pairs.select("pair_id", rate.alias("rate")).withColumn("level", change_level("rate"))


def edit_rate(pairs: DataFrame) -> DataFrame:
    """(pair_id, distance, rate): Levenshtein distance over the original's length."""
    distance = F.levenshtein("original", "revised")
    return pairs.select("pair_id", distance.alias("distance"), F.round(distance / F.greatest(F.length("original"), F.lit(1)), 6).alias("rate"))


def marker_drops(pairs: DataFrame) -> DataFrame:
    """(pair_id, marker, before, after) of marks that carry meaning and became fewer."""
    each = F.array(*[F.struct(F.lit(n).alias("marker"), F.regexp_count("original", F.lit(p)).alias("before"), F.regexp_count("revised", F.lit(p)).alias("after")) for n, p in MARKERS.items()])
    return pairs.select("pair_id", F.inline(each)).where("after < before")


@pandas_function("array<struct<original:string,revised:string,ratio:double>>")
def aligned_sentences(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sentences that were changed, paired with their best like (at least SAME_SENTENCE) within the changed block."""

    def aligned(x, y):
        p, q = ([s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", t or "") if s.strip()] for t in (x, y))
        out = []
        for tag, i, j, k, m in difflib.SequenceMatcher(None, p, q, autojunk=False).get_opcodes():
            if tag != "replace":
                continue
            left = list(q[k:m])
            for s in p[i:j]:
                best = max(left, key=lambda t: similarity(s, t, SAME_SENTENCE), default=None)
                if best is not None and (r := similarity(s, best, SAME_SENTENCE)) >= SAME_SENTENCE:
                    out.append((s, best, round(r, 6)))
                    left.remove(best)
        return out

    return pd.Series([aligned(x, y) for x, y in zip(a, b, strict=True)])


def modality_changes(pairs: DataFrame) -> DataFrame:
    """Marks that became fewer or more within a pair of aligned sentences."""
    each = pairs.select("pair_id", F.inline(aligned_sentences("original", "revised"))).drop("ratio")
    counts = F.array(*[F.struct(F.lit(n).alias("marker"), F.regexp_count("original", F.lit(p)).alias("before"), F.regexp_count("revised", F.lit(p)).alias("after")) for n, p in MARKERS.items()])
    return each.select("pair_id", "original", "revised", F.inline(counts)).where("before != after")


def fix_cascade(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair_id, kind, new): findings of the revised text beyond those of the original."""
    n = lambda df, name: df.groupBy("pair_id", "kind").agg(F.count("*").alias(name))
    both = n(after, "b").join(n(before, "a"), ["pair_id", "kind"], "left")
    return both.withColumn("new", F.col("b") - F.coalesce("a", F.lit(0))).where("new > 0").select("pair_id", "kind", "new")


def new_information(fixes: DataFrame) -> DataFrame:
    """(pair_id, kind, token): numbers, quoted names and Latin words of a fix that its document does not have.

    Numbers are compared by value and unit, so another spelling of a number is nothing new; a number of the document without
    a unit, or a fix's without one, is known by its value.  Numbers of list items and of lines do not count.
    """
    listless = F.regexp_replace("original", r"(?m)^\s*(?:[-*+]|\d+[.)])\s+", " ")
    valued = fixes.select("pair_id", "original", "revised", numbers(listless).alias("known"), numbers(F.regexp_replace("revised", r"\]\(#[^)]*\)", "]")).alias("told"))
    unit = lambda n: F.replace(n["unit"], F.lit("퍼센트"), F.lit("%"))
    is_known = lambda n: lambda d: (d["value"] == n["value"]) & (d["unit"].isNull() | n["unit"].isNull() | (unit(d) == unit(n)))
    fresh = F.filter("told", lambda n: ~F.exists("known", is_known(n)) & ~F.coalesce(n["unit"].isin("줄", "행"), F.lit(False)))
    figures = valued.select("pair_id", F.lit("number").alias("kind"), F.explode(F.transform(fresh, lambda n: n["shown"])).alias("token")).distinct()
    kinds = {"name": r"[「『“\"]([^」』”\"]+)[」』”\"]", "word": r"([A-Za-z][A-Za-z0-9+.-]{1,})"}
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("revised", F.lit(p), F.lit(1)).alias("found")) for k, p in kinds.items()])
    found = fixes.select("pair_id", "original", F.inline(each)).select("pair_id", "original", "kind", F.explode("found").alias("token")).distinct()
    bare = lambda c: F.lower(F.regexp_replace(c, r"[\s*_`]", ""))
    words = found.where((bare(F.col("token")) != "") & ~F.contains(bare(F.col("original")), bare(F.col("token")))).select("pair_id", "kind", "token")
    return figures.union(words)


def fix_guard(fixes: DataFrame) -> DataFrame:
    """(pair_id, marks_changed, heading_changed): fixes that alter the number of marks or a heading's level."""
    marks = lambda c: F.regexp_count(c, F.lit(r"[*_`「」『』\"()\[\]]"))
    level = lambda c: F.length(F.regexp_extract(c, r"^(#{1,6})\s", 1))
    return fixes.select("pair_id", (marks("original") != marks("revised")).alias("marks_changed"), (level("original") != level("revised")).alias("heading_changed"))

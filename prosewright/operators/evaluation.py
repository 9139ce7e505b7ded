"""Detector evaluation: recall and precision against labels, agreement, stability, intervals, tests."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosewright.functions.text import shares_run
from prosewright.operators import intervals


def confusion(scored: DataFrame, label: str, hit: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, recall and precision; rows whose label is null are counted apart."""
    yes, no = F.col(label) == 1, F.col(label) == 0
    out = scored.groupBy(*(by or [])).agg(
        F.count_if(yes & hit).alias("tp"), F.count_if(no & hit).alias("fp"), F.count_if(yes & ~hit).alias("fn"), F.count_if(no & ~hit).alias("tn"),
        F.count_if(F.col(label).isNull() & hit).alias("unlabelled_hits"),
    )
    ratio = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 6)
    return out.withColumn("recall", ratio("tp", "fn")).withColumn("precision", ratio("tp", "fp"))


def concerns(label: Column | str, finding: Column | str, n: int = 12) -> Column:
    """True, false or null (unknown): the finding's quoted term is in the label, or they share ``n`` characters in a row."""
    quoted = F.regexp_extract(finding, "「([^」]+)」", 1)
    return F.when(quoted != "", F.contains(label, quoted)).when(F.length(label) < n, F.lit(None)).otherwise(shares_run(finding, label, n))


def covers(label: Column | str, reported: Column | str, n: int = 6) -> Column:
    """A reported phrase means the labelled one: they share ``n`` characters in a row, or the whole label if that is shorter."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (label, reported))
    size = F.least(F.lit(n), F.length(a))
    run = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - size + 1)), lambda i: F.contains(b, F.substring(a, i, size)))
    return F.coalesce((F.length(a) > 0) & (F.length(b) > 0) & run, F.lit(False))


def sheet_recall(findings: DataFrame, missed: DataFrame, verdicts: DataFrame, layers: dict[str, str]) -> DataFrame:
    """(layer, caught, problems, recall, rejected, held) of review sheets.

    findings: (document_id, line_number, phrase, sources array, note, allowed); missed: lines where a reader noted what nobody
    found (document_id, line_number, note); verdicts: (document_id, line_number, slot, phrase, verdict).  A finding without a
    note is agreed to; one with a note goes by its verdict, and is held without one.  Layers name the sources' detectors;
    ``any`` counts problems that some layer caught.
    """
    own = verdicts.where("slot = 'finding'").select("document_id", "line_number", "phrase", "verdict")
    judged = findings.where("NOT allowed").join(own, ["document_id", "line_number", "phrase"], "left")
    judged = judged.withColumn("verdict", F.coalesce("verdict", F.when(F.coalesce("note", F.lit("")) == "", "agreed").otherwise("open")))
    totals = judged.agg(F.count_if(F.col("verdict") == "agreed").alias("agreed"), F.count_if(F.col("verdict") == "rejected").alias("rejected"), F.count_if(~F.col("verdict").isin("agreed", "rejected")).alias("held"))
    unseen = missed.where("coalesce(note, '') != ''").agg(F.count("*").alias("unseen"))
    named = F.create_map(*[F.lit(x) for kv in layers.items() for x in kv])
    own_layers = F.array_distinct(F.array_compact(F.transform("sources", lambda s: F.try_element_at(named, s))))
    hits = judged.where("verdict = 'agreed'").select(F.explode(F.when(F.size(own_layers) > 0, F.array_append(own_layers, "any")).otherwise(own_layers)).alias("layer")).groupBy("layer").agg(F.count("*").alias("caught"))
    every = judged.sparkSession.range(1).select(F.explode(F.lit([*dict.fromkeys(layers.values()), "any"])).alias("layer"))
    out = every.join(hits, "layer", "left").join(F.broadcast(totals)).join(F.broadcast(unseen)).withColumn("problems", F.col("agreed") + F.col("unseen")).withColumn("caught", F.coalesce("caught", F.lit(0)))
    return out.select("layer", "caught", "problems", F.round(F.try_divide("caught", "problems"), 3).alias("recall"), "rejected", "held")


def tool_summary(runs: DataFrame) -> DataFrame:
    """(tool, documents, scanned, unsupported, with_errors, with_warnings, errors, warnings, blind) of tool runs (tool, doc_key, status, errors, warnings, blind)."""
    done = F.col("status") == "scanned"
    total = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).alias(c)
    return runs.groupBy("tool").agg(
        F.count("*").alias("documents"), F.count_if(done).alias("scanned"), F.count_if(~done).alias("unsupported"), F.count_if(done & (F.col("errors") > 0)).alias("with_errors"),
        F.count_if(done & (F.col("warnings") > 0)).alias("with_warnings"), total("errors"), total("warnings"), total("blind"),
    )


def evaluate_labels(labels: DataFrame, findings: DataFrame) -> DataFrame:
    """Labels (doc_key, line_no, label) against findings: yes, no or unknown, and the recall's floor and ceiling over all."""
    joined = labels.join(findings.select("doc_key", "line_no", "message"), ["doc_key", "line_no"], "left")
    state = F.when(F.max(F.coalesce(concerns("label", "message"), F.lit(False))), "yes").when(F.count("message") == 0, "no").when(F.count_if(concerns("label", "message").isNull() & F.col("message").isNotNull()) > 0, "unknown").otherwise("no")
    each = joined.groupBy("doc_key", "line_no", "label").agg(state.alias("state"))
    return each.agg(
        F.count("*").alias("labels"), F.count_if(F.col("state") == "yes").alias("found"), F.count_if(F.col("state") == "unknown").alias("unknown"),
        F.avg((F.col("state") == "yes").cast("double")).alias("recall_floor"), F.avg((F.col("state") != "no").cast("double")).alias("recall_ceiling"),
    )


def unlabelled(findings: DataFrame, labels: DataFrame) -> DataFrame:
    return findings.join(labels.select("doc_key", "line_no"), ["doc_key", "line_no"], "left_anti")


def span_recall(truth: DataFrame, found: DataFrame, clean: DataFrame, slack: int = 2) -> DataFrame:
    """Planted spans (doc_key, line_no, family, start, end, width) hit by found ones; loose, strict (no slack, local) and net of
    what is also found on the clean twin.  A found span is local if it is no wider than 20 characters or 0.4 of the planted one's ``width``."""
    at = ["doc_key", "line_no"]
    keys = [*at, "width"]
    wide = {"start": F.col("start") - slack, "end": F.col("end") + slack}
    local = found.join(truth.select(*keys).distinct(), at).where((F.col("end") - F.col("start")) <= F.greatest(F.lit(20), 0.4 * F.col("width")))
    hit = intervals.against(truth.distinct(), found, at, **wide).withColumnRenamed("overlaps", "loose").drop("covered")
    hit = intervals.against(hit, clean, at, **wide).withColumnRenamed("overlaps", "noise").drop("covered")
    hit = intervals.against(hit, local, keys).withColumnRenamed("overlaps", "strict")
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return hit.groupBy("family").agg(F.count("*").alias("planted"), rate(F.col("loose")).alias("recall"), rate(F.col("strict")).alias("strict_recall"), rate(F.col("loose") & ~F.col("noise")).alias("net_recall"))


def planted_score(planted: DataFrame, findings: DataFrame) -> DataFrame:
    """tight (one text contains the other), loose (same line) or missed, for each planted phrase."""
    joined = planted.join(findings.select("doc_key", "line_no", F.col("phrase").alias("said")), ["doc_key", "line_no"], "left")
    tight = F.contains("phrase", F.col("said")) | F.contains("said", F.col("phrase"))
    best = F.max(F.when(F.col("said").isNull(), 0).when(tight, 2).otherwise(1))
    return joined.groupBy("doc_key", "line_no", "phrase").agg(best.alias("b")).select("doc_key", "line_no", "phrase", F.element_at(F.array(F.lit("missed"), F.lit("loose"), F.lit("tight")), F.col("b") + 1).alias("match"))


def noise_density(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_key, findings, hangul, density): findings for each 1,000 Hangul characters of every document of ``lines``."""
    from prosewright.functions.text import hangul_count

    size = lines.groupBy("doc_key").agg(F.sum(hangul_count("text")).alias("hangul"))
    out = size.join(findings.groupBy("doc_key").agg(F.count("*").alias("findings")), "doc_key", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))
    return out.select("doc_key", "findings", "hangul", F.round(F.try_divide(1000 * F.col("findings"), F.col("hangul")), 6).alias("density"))


def running_count(by: DataFrame, value: str, count: str, name: str) -> DataFrame:
    """Adds the sum of ``count`` over all rows of smaller ``value``; ranges between quantiles go to tasks, so none sees all values.

    ``by`` has one row for each value.  Sums of the ranges, one row each, are added up first.
    """
    ranges = max(1, int(by.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(by.agg(F.percentile_approx(value, shares, max(10_000, 20 * ranges)).alias("q")).first()["q"] or [])) if shares else []
    kind = by.schema[value].dataType
    at = F.size(F.filter(F.lit(bounds).cast(T.ArrayType(kind)), lambda b: b <= F.col(value))) if bounds else F.lit(0)
    placed = by.withColumn("_range", at)
    sums = placed.groupBy("_range").agg(F.sum(count).alias("_sum"))
    ahead = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inside = F.coalesce(F.sum(count).over(Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(ahead), "_range").withColumn(name, F.col("_ahead") + inside).drop("_range", "_ahead")


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """P(score of a positive > of a negative) + half of ties, by rank sums over distinct scores.

    Rows are first summed by score; the running sum goes over ranges of scores.
    """
    by = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    won = running_count(by, "s", "n", "below")
    return won.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.round(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), F.sum("p") * F.sum("n")), 6).alias("auc"))


def jaccard_stability(runs: DataFrame, item: str = "item") -> DataFrame:
    """Pairwise Jaccard of the repeats' sets: (run, item) rows to (a, b, both, either, jaccard)."""
    own = runs.select("run", item).distinct()
    size = own.groupBy("run").count()
    both = own.withColumnRenamed("run", "a").join(own.withColumnRenamed("run", "b"), item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    names = size.withColumnRenamed("run", "a").withColumnRenamed("count", "na").join(F.broadcast(size.withColumnRenamed("run", "b").withColumnRenamed("count", "nb")), F.expr("a < b"))
    out = names.join(both, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return out.withColumn("either", F.col("na") + F.col("nb") - F.col("both")).select("a", "b", "both", "either", F.round(F.try_divide(F.col("both"), F.col("either")), 6).alias("jaccard"))


def always_and_ever(runs: DataFrame, item: str = "item") -> DataFrame:
    """(item, runs, always): in how many of the repeats each item is found."""
    total = runs.agg(F.countDistinct("run").alias("t"))
    return runs.groupBy(item).agg(F.countDistinct("run").alias("runs")).join(F.broadcast(total)).select(item, "runs", (F.col("runs") == F.col("t")).alias("always"))


def agreement(judged: DataFrame) -> DataFrame:
    """(item, judge, correct) of two judges or more: shares of items that all, any, and equally judge correct."""
    per = judged.groupBy("item").agg(F.min(F.col("correct").cast("int")).alias("all"), F.max(F.col("correct").cast("int")).alias("any"))
    r = lambda c: F.round(F.avg(c.cast("double")), 6)
    return per.agg(F.count("*").alias("items"), r(F.col("all")).alias("all_correct"), r(F.col("any")).alias("any_correct"), r(F.col("all") == F.col("any")).alias("agreement"))


def win_rate(pairs: DataFrame) -> DataFrame:
    """(system, doc_key, verdict): wins count 1, ties a half."""
    value = F.when(F.col("verdict") == "win", 1.0).when(F.col("verdict") == "tie", 0.5).otherwise(0.0)
    return pairs.groupBy("system").agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("win_rate"))


def win_rate_interval(pairs: DataFrame, system: str, times: int = 1000, seed: int = 7) -> DataFrame:
    """(point, low, high) of one system's win rate over resampled documents."""
    value = F.when(F.col("verdict") == "win", 1.0).when(F.col("verdict") == "tie", 0.5).otherwise(0.0)
    per = pairs.where(F.col("system") == system).groupBy("doc_key").agg(F.sum(value).alias("won"), F.count("*").alias("n"))
    return cluster_bootstrap(per, "won", "n", times, seed)


def merge_overlapping(findings: DataFrame) -> DataFrame:
    """Of findings on one line and category that lie in one another the longest stays, with all sources.

    Findings with their places (start, end) are told by these, others by whether their phrases contain one another.
    """
    keys = ["doc_key", "line_no", "category"]
    if {"start", "end"} <= set(findings.columns):
        held = intervals.with_longest(findings, keys)
        longest = F.max_by("phrase", F.col("end") - F.col("start")).alias("phrase")
        return held.groupBy(*keys, F.col("long_start").alias("start"), F.col("long_end").alias("end")).agg(longest, F.array_sort(F.collect_set("source")).alias("sources"))
    longer = findings.select(*keys, F.col("phrase").alias("longer")).distinct()
    held = findings.join(longer, keys).where(F.contains("longer", F.col("phrase")))
    best = held.groupBy(*keys, "phrase", "source").agg(F.max(F.struct(F.length("longer").alias("n"), "longer")).alias("b"))
    return best.groupBy(*keys, F.col("b.longer").alias("phrase")).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def twins_score(pairs: DataFrame) -> DataFrame:
    """(pair, expect finding or clean, found): caught, false alarms and pairs told apart."""
    per = pairs.groupBy("pair").agg(F.max(F.when(F.col("expect") == "finding", F.col("found"))).alias("caught"), F.max(F.when(F.col("expect") == "clean", F.col("found"))).alias("alarm"))
    return per.agg(F.count("*").alias("pairs"), F.count_if("caught").alias("caught"), F.count_if("alarm").alias("false_alarms"), F.count_if(F.col("caught") & ~F.col("alarm")).alias("told_apart"))


def poisson_weights(row: Column, times: int, seed: int) -> Column:
    """``times`` Poisson(1) numbers of a row, from hashes of its key, so that a retried task draws the same."""
    u = lambda i: (F.shiftrightunsigned(F.xxhash64(row, F.lit(seed), i), 11)).cast("double") / 2.0**53
    steps, mass, term = [], 0.0, math.exp(-1.0)
    for k in range(1, 16):
        mass += term
        steps.append(mass)
        term /= k
    return F.transform(F.sequence(F.lit(1), F.lit(times)), lambda i: F.aggregate(F.lit(steps).cast("array<double>"), F.lit(0), lambda n, m: n + F.when(u(i) >= m, 1).otherwise(0)))


def cluster_bootstrap(per_doc: DataFrame, part: str, whole: str, times: int = 1000, seed: int = 7, key: str = "doc_key") -> DataFrame:
    """(point, low, high): ratio of sums and its 95% percentile interval over resampled clusters, one row of ``key`` each.

    Every cluster draws its Poisson weights for all repeats in its own row; the sums of the repeats are one aggregation with
    ``times`` groups, whatever the number of clusters.
    """
    rows = per_doc.select(F.col(part).cast("double").alias("a"), F.col(whole).cast("double").alias("b"), poisson_weights(F.col(key).cast("string"), times, seed).alias("w"))
    # outer, though no row is without weights: else a filter on their number goes before the caller's grouping, and draws for each row there
    each = rows.select("a", "b", F.posexplode_outer("w").alias("repeat", "w")).where("w > 0")
    ratios = each.groupBy("repeat").agg(F.try_divide(F.sum(F.col("a") * F.col("w")), F.sum(F.col("b") * F.col("w"))).alias("ratio"))
    ends = ratios.agg(F.percentile("ratio", 0.025).alias("low"), F.percentile("ratio", 0.975).alias("high"))
    point = per_doc.agg(F.try_divide(F.sum(F.col(part).cast("double")), F.sum(whole)).alias("point"))
    return point.join(F.broadcast(ends)).select("point", "low", "high")


def paired_bootstrap(per_doc: DataFrame, a: str, b: str, whole: str, times: int = 1000, seed: int = 7, key: str = "doc_key") -> DataFrame:
    """Difference of two systems' ratios over the same resampled clusters."""
    return cluster_bootstrap(per_doc.select((F.col(a) - F.col(b)).alias("d"), whole, key), "d", whole, times, seed, key)


def interval_verdict(low: Column, high: Column) -> Column:
    return F.when(low > 0, "high").when(high < 0, "low").otherwise("undecided")


def permutation_test(a: list[float], b: list[float], most: int = 16) -> float | None:
    """One-sided exact p that ``a``'s mean is as high by chance, over all splits of up to ``most`` pooled values."""
    pooled = [*a, *b]
    if len(pooled) > most or not a or not b:
        return None
    whole, seen = sum(a), [sum(c) for c in itertools.combinations(pooled, len(a))]
    return sum(s >= whole - 1e-12 for s in seen) / len(seen)


def ranges_verdict(a: list[float], b: list[float]) -> str:
    """Which of two sets of repeats lies wholly above the other; undecided if their ranges overlap or one is empty."""
    if not a or not b:
        return "undecided"
    return "a" if min(a) > max(b) else "b" if min(b) > max(a) else "undecided"


def compare_runs(runs: DataFrame, targets: list[str], floors: dict[str, float], ceilings: dict[str, float], least: int) -> DataFrame:
    """(experiment, conclusion, reason, accuracy, exploratory, verdicts) of runs (experiment, side, run, done, metric, value) by a rule set beforehand.

    Sides are ``base`` and ``new``; runs not done do not count.  ``targets`` should fall: a side is less or more if its range lies
    wholly beyond the other's.  Guards may not fall under the base's least value less their tolerance (``floors``), nor rise over
    its greatest and theirs (``ceilings``).  With twice ``least`` base runs or more their halves, by run, are compared too; a
    target on which these differ is undecided.  Too few runs or a target without a value in some run decide nothing; a guard
    without a value leaves the accuracy unknown, so that the conclusion is never ``better``.  More runs than were set make the
    conclusion exploratory.
    """
    role = {**dict.fromkeys(targets, "target"), **dict.fromkeys(floors, "floor"), **dict.fromkeys(ceilings, "ceiling")}
    done = runs.where("done")
    side = lambda name: F.col("side") == name
    counted = done.select("experiment", "side", "run").distinct()
    turn = F.row_number().over(Window.partitionBy("experiment", "side").orderBy("run"))
    placed = counted.withColumn("turn", turn)
    sizes = runs.select("experiment").distinct().join(counted.groupBy("experiment").agg(F.count_if(side("base")).alias("n_base"), F.count_if(side("new")).alias("n_new")), "experiment", "left").fillna(0, ["n_base", "n_new"])
    listed = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(r).alias("role"), F.lit(float(floors.get(m, ceilings.get(m, 0.0)))).alias("tolerance")) for m, r in role.items()])
    wanted = sizes.select("*", F.inline(listed))
    values = done.where("value IS NOT NULL").join(placed, ["experiment", "side", "run"]).join(sizes, "experiment")
    half = F.floor(F.col("n_base") / 2)
    parts = {"base": side("base"), "new": side("new"), "early": side("base") & (F.col("turn") <= half), "late": side("base") & (F.col("turn") > half) & (F.col("turn") <= 2 * half)}
    ranges = [f(F.when(c, F.col("value"))).alias(f"{name}_{what}") for name, c in parts.items() for what, f in (("min", F.min), ("max", F.max))]
    have = [F.countDistinct(F.when(side(s), F.col("run"))).alias(f"have_{s}") for s in ("base", "new")]
    seen = wanted.join(values.groupBy("experiment", "metric").agg(*ranges, *have), ["experiment", "metric"], "left").fillna(0, ["have_base", "have_new"])
    apart = lambda a, b: F.when(F.col(f"{b}_max") < F.col(f"{a}_min"), "less").when(F.col(f"{b}_min") > F.col(f"{a}_max"), "more").otherwise("undecided")
    checked = (F.col("n_base") >= 2 * least) & (apart("early", "late") != "undecided")
    judged = seen.withColumn("missing", (F.col("have_base") < F.col("n_base")) | (F.col("have_new") < F.col("n_new"))).withColumn("verdict", F.when(F.col("missing"), "no value").when(checked, "undecided: base differs").otherwise(apart("base", "new")))
    guard, target = F.col("role") != "target", F.col("role") == "target"
    fell = F.when(F.col("role") == "floor", F.col("new_min") < F.col("base_min") - F.col("tolerance")).when(F.col("role") == "ceiling", F.col("new_max") > F.col("base_max") + F.col("tolerance"))
    any_ = lambda c, name: F.coalesce(F.max(c), F.lit(False)).alias(name)
    by = judged.groupBy("experiment", "n_base", "n_new").agg(
        any_(target & F.col("missing"), "lacking"), any_(guard & F.col("missing"), "blind"), any_(guard & ~F.col("missing") & fell, "worse"), any_(target & (F.col("verdict") == "more"), "more"), any_(target & (F.col("verdict") == "less"), "less"),
        F.map_from_entries(F.array_compact(F.collect_list(F.when(target, F.struct("metric", "verdict"))))).alias("verdicts"),
    )
    few = (F.col("n_base") < least) | (F.col("n_new") < least)
    reason = F.when(few, "too few runs").when(F.col("lacking"), "a target has no value").when(~F.col("worse") & ~F.col("more") & F.col("less") & F.col("blind"), "no accuracy")
    conclusion = F.when(few | F.col("lacking"), "undecided").when(F.col("worse"), "accuracy worse").when(F.col("more"), "worse").when(F.col("less") & ~F.col("blind"), "better").otherwise("undecided")
    accuracy = F.when(few | F.col("lacking"), F.lit(None)).when(F.col("worse"), "worse").when(F.col("blind"), "unknown").otherwise("kept")
    exploratory = ~few & ((F.col("n_base") > 2 * least) | (F.col("n_new") > least))
    return by.select("experiment", conclusion.alias("conclusion"), reason.alias("reason"), accuracy.alias("accuracy"), exploratory.alias("exploratory"), "verdicts")


def rule_share(findings: DataFrame) -> DataFrame:
    """(kind, n, share)."""
    by = findings.groupBy("kind").agg(F.count("*").alias("n"))
    return by.join(F.broadcast(by.agg(F.sum("n").alias("t")))).select("kind", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def same_signature(a: DataFrame, b: DataFrame, points: float = 0.01) -> DataFrame:
    """Kinds whose share differs by more than ``points`` between two runs: none if they have one signature."""
    both = a.select("kind", F.col("share").alias("x")).join(b.select("kind", F.col("share").alias("y")), "kind", "full")
    return both.where(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))) > points)


def owner_coverage(rows: DataFrame, owner: str = "owner", round_: str = "round") -> DataFrame:
    return rows.groupBy(round_).pivot(owner).count()


def replay_tally(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums by mode, and the cases for which all modes sent one prompt."""
    tally = rows.groupBy("mode").agg(F.count("*").alias("n"), F.sum("findings").alias("findings"), F.sum("cost_usd").alias("cost_usd"))
    same = rows.groupBy("case").agg(F.countDistinct("prompt").alias("prompts"), F.countDistinct("mode").alias("modes")).where("prompts = 1 AND modes > 1").select("case")
    return tally, same


def edit_quota(edits: DataFrame, quota: int) -> DataFrame:
    """Equal edits of all flows pooled, then at most ``quota`` for each flow and class."""
    pooled = edits.groupBy("before", "after", "class").agg(F.array_sort(F.collect_set("flow")).alias("flows"))
    each = pooled.select("*", F.explode("flows").alias("flow"))
    turn = F.row_number().over(Window.partitionBy("flow", "class").orderBy(F.sha2(F.concat_ws("|", "before", "after"), 256)))
    return each.withColumn("turn", turn).where(F.col("turn") <= quota).drop("turn")


def edit_class(before: Column | str, after: Column | str) -> Column:
    """Class of an edit by its words: none for markup only."""
    bare = lambda c: F.regexp_replace(c, r"[*_`#>|\s-]", "")
    n = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    a, b = n(before), n(after)
    return F.when(bare(before) == bare(after), F.lit(None)).when(a == 0, "inserted").when(b == 0, "deleted").when(a == b, "replaced").otherwise("rewritten")


def probe_patterns(lines: DataFrame, patterns: list[tuple[str, str, str]], group: str) -> DataFrame:
    """(group, name, narrow, wide, lines): matches of candidate rules, each as a narrow and a wide pattern, in each corpus."""
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    each = F.array(*[F.struct(F.lit(name).alias("name"), n(a).alias("narrow"), n(b).alias("wide")) for name, a, b in patterns])
    return lines.select(group, F.inline(each)).groupBy(group, "name").agg(F.sum("narrow").alias("narrow"), F.sum("wide").alias("wide"), F.count_if(F.col("wide") > 0).alias("lines"))


def shared_word_runs(documents: DataFrame, items: DataFrame, n: int, most: int = 2_000_000) -> DataFrame:
    """(doc_key, item, shared_runs) of documents (doc_key, w) and items (item, w), arrays of words, that share ``n`` words in a row.

    Runs meet by 64-bit hashes, one number a run; the items' hashes are broadcast while they are at most ``most``, which is
    16 MB of numbers, and shuffled beyond.  Only places that meet go back to their documents, once a document, for the words
    that confirm them; so the work is linear in a document's length.
    """
    starts = F.sequence(F.lit(1), F.size("w") - (n - 1))
    run = lambda i: F.slice("w", i, F.lit(n))
    long = documents.where(F.size("w") >= n)
    named = F.transform(starts, lambda i: F.struct(F.xxhash64(run(i)).alias("h"), F.array_join(run(i), " ").alias("run")))
    own = items.where(F.size("w") >= n).select("item", F.inline(named)).distinct()
    hashes = own.select("h").distinct()
    few = hashes.count() <= most
    each = long.select(F.col("doc_key").alias("_key"), F.posexplode(F.transform(starts, lambda i: F.xxhash64(run(i)))).alias("at", "h"))
    met = each.join(F.broadcast(hashes) if few else hashes, "h", "left_semi").groupBy("_key").agg(F.collect_set("at").alias("places"))
    back = long.join(met, F.col("doc_key").eqNullSafe(F.col("_key")))
    said = back.select("doc_key", F.explode(F.transform(F.filter("places", lambda i: i + n <= F.size("w")), lambda i: F.array_join(run(i + 1), " "))).alias("run")).distinct()
    return said.join(own.select("item", "run"), "run").groupBy("doc_key", "item").agg(F.count("*").alias("shared_runs"))


def samples_of(lines: DataFrame, pattern: str, n: int = 5) -> DataFrame:
    """The first ``n`` lines of each document that match: samples to read."""
    turn = F.row_number().over(Window.partitionBy("doc_key").orderBy("line_no"))
    return lines.where(F.col("text").rlike(pattern)).withColumn("nth", turn).where(F.col("nth") <= n).drop("nth")


def correction_score(cases: DataFrame, found: DataFrame) -> DataFrame:
    """(family, cases, recall, exact) of wrong sentences (case, family, text, start, end, correct) against findings (case, start, end, fix):
    spans hit, and sentences that are right once the fixes are applied."""
    from prosewright.functions.spans import apply_fixes

    hit = cases.join(found.select("case", F.col("start").alias("f_start"), F.col("end").alias("f_end")), "case", "left")
    hit = hit.groupBy("case", "family", "text", "correct", "start", "end").agg(F.max(F.coalesce((F.col("f_start") < F.col("end") + 2) & (F.col("start") - 2 < F.col("f_end")), F.lit(False))).alias("hit"))
    fixes = found.where("fix IS NOT NULL").groupBy("case").agg(F.collect_list(F.struct("start", "end", "fix")).alias("fixes"))
    none = F.array().cast("array<struct<start:int,end:int,fix:string>>")
    fixed = cases.select("case", "text", "correct").distinct().join(fixes, "case", "left").withColumn("right", apply_fixes("text", F.coalesce(F.col("fixes").cast("array<struct<start:int,end:int,fix:string>>"), none)) == F.col("correct"))
    both = hit.join(fixed.select("case", "right"), "case")
    return both.groupBy("family").agg(F.countDistinct("case").alias("cases"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("recall"), F.round(F.avg(F.col("right").cast("double")), 6).alias("exact"))


def inject_defects(lines: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """One defect of each family in each document: (family, pattern, replacement) on the family's first matching line.

    Returns (doc_key, line_no, family, clean, broken); the first match of the line is replaced.
    """
    each = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(p).alias("pattern"), F.lit(r).alias("replacement")) for f, p, r in rules])
    hits = lines.select("doc_key", "line_no", "text", F.inline(each)).where(F.rlike("text", F.col("pattern")))
    first = hits.groupBy("doc_key", "family").agg(F.min(F.struct("line_no", "text", "pattern", "replacement")).alias("h")).select("doc_key", "family", "h.*")
    broken = F.regexp_replace("text", F.concat(F.lit("(?s)^(.*?)(?:"), F.col("pattern"), F.lit(")(.*)$")), F.concat(F.lit("$1"), F.col("replacement"), F.lit("$2")))
    return first.select("doc_key", "line_no", "family", F.col("text").alias("clean"), broken.alias("broken")).where("clean != broken")

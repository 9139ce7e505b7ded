"""Finding algebra: first of a kind, document form, notice frame, selection, summary, condensing, gates."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosewright.functions.text import line_key, shown, squeeze
from prosewright.operators import structure

BY_MESSAGE = ["register_mix", "plain_speech", "narrative_ending"]
FORM_ONLY = ["narrative_ending", "narrative_paragraph", "heading_narrative", "heading_not_nominal", "heading_form_check", "lede_missing", "lede_narrative", "lede_not_nominal", "lede_form_check"]
APP_DROPS = ["lede_missing", "lede_narrative", "lede_not_nominal", "lede_form_check"]
NOTICE_DROPS = ["lede_missing", "narrative_ending", "narrative_paragraph"]
INSTRUCTION_DROPS = ["plain_speech", "register_mix", "narrative_ending", "form_undeclared"]
INSTRUCTION_FILE = r"(?i)(?:^|/)(?:agents|skill|rules|instructions)\.md$|/(?:agents|skills|hooks)/"


def first_of_kind(findings: DataFrame) -> DataFrame:
    """The first finding of each line and kind; kinds in BY_MESSAGE count as different by their match."""
    part = F.when(F.col("kind").isin(BY_MESSAGE), F.col("match")).otherwise("")
    others = [c for c in findings.columns if c not in ("doc_key", "line_no", "kind")]
    keyed = findings.withColumn("part", part).groupBy("doc_key", "line_no", "kind", "part").agg(F.min(F.struct("severity", *[c for c in others if c != "severity"])).alias("f"))
    return keyed.select("doc_key", "line_no", "kind", "f.*").select(*findings.columns)


GREETING = r"^(?:안녕하세요|안녕하십니까)|감사합니다\.?$|드림$"


def _facts(documents: DataFrame, body: DataFrame) -> DataFrame:
    """(doc_key, declared, share, polite_lines, first, last) of every document: what its form and a notice's frame are told by."""
    some = shown("text")
    matter = F.when(structure.of_matter(), F.col("line_no"))
    by = body.groupBy("doc_key").agg(
        F.avg(F.when(some, structure.flowing().cast("double"))).alias("share"), F.count_if(F.trim("text").rlike(GREETING)).alias("polite_lines"), F.min(matter).alias("first"), F.max(matter).alias("last")
    )
    return documents.select("doc_key", structure.declared_form("raw").alias("declared")).join(by, "doc_key", "left").fillna(0, ["share", "polite_lines"])


def _form(errs: Column, told: Column, share: Column, polite_lines: Column) -> Column:
    prose = (share >= 0.30) | ((told >= 10) & (2 * told >= errs)) | ((share >= 0.20) & (told >= 3) & (2 * told >= errs))
    return F.when(polite_lines >= 2, "notice").when(prose, "prose").otherwise("structured")


def _errs() -> Column:
    return F.count_if(F.col("severity") == "err")


def _told() -> Column:
    return F.count_if((F.col("severity") == "err") & F.col("kind").isin("narrative_ending", "narrative_paragraph"))


def guess_form(documents: DataFrame, findings: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """(doc_key, declared, form): the declared form, or prose by share of flowing lines or narrative errors, or notice by greeting and closing."""
    body = structure.body_lines(documents) if parsed is None else parsed.where("NOT fenced").drop("fenced")
    errs = findings.groupBy("doc_key").agg(_errs().alias("errs"), _told().alias("told"))
    out = _facts(documents, body).join(errs, "doc_key", "left").fillna(0, ["errs", "told"])
    return out.select("doc_key", "declared", F.coalesce("declared", _form(F.col("errs"), F.col("told"), F.col("share"), F.col("polite_lines"))).alias("form"))


def undeclared(forms: DataFrame) -> DataFrame:
    own = forms.where("declared IS NULL AND form IN ('prose', 'notice')")
    return own.select("doc_key", F.lit(None).cast("int").alias("line_no"), F.lit("form_undeclared").alias("kind"), F.lit("warn").alias("severity"), F.col("form").alias("match"), F.lit("").alias("note"))


def _not_asked(form: Column) -> Column:
    """A finding of a kind that this form of document does not ask for."""
    off = F.lit(False)
    for name, kinds in (("prose", FORM_ONLY), ("app", APP_DROPS), ("notice", NOTICE_DROPS)):
        off |= (form == name) & F.col("kind").isin(kinds)
    return F.coalesce(off, F.lit(False))


def drop_by_form(findings: DataFrame, forms: DataFrame) -> DataFrame:
    """Without the kinds that a document's form does not ask for."""
    joined = findings.join(forms.select("doc_key", F.col("form").alias("_form")), "doc_key", "left")
    return joined.where(~_not_asked(F.col("_form"))).select(*findings.columns)


def _outside(form: Column, first: Column, last: Column) -> Column:
    """A finding on speech level in a notice's greeting or closing."""
    out = (form == "notice") & ((F.col("line_no") < first) | (F.col("line_no") > last)) & F.col("kind").isin("plain_speech", "register_mix")
    return F.coalesce(out, F.lit(False))


def drop_notice_frame(findings: DataFrame, forms: DataFrame, body: DataFrame) -> DataFrame:
    """In notices, findings on speech level in the greeting and the closing are dropped."""
    frame = structure.notice_frame(body).withColumnsRenamed({"first": "f_first", "last": "f_last"}).join(forms.select("doc_key", "form"), "doc_key")
    joined = findings.join(frame, "doc_key", "left")
    return joined.where(~_outside(F.col("form"), F.col("f_first"), F.col("f_last"))).select(*findings.columns)


def drop_instruction_files(findings: DataFrame, documents: DataFrame) -> DataFrame:
    files = documents.where(F.col("path").rlike(INSTRUCTION_FILE)).select("doc_key", F.explode(F.lit(INSTRUCTION_DROPS)).alias("kind"))
    return findings.join(files, ["doc_key", "kind"], "left_anti").select(*findings.columns)


@dataclass(frozen=True)
class Selection:
    """Which kinds are off, warnings or errors; applied in the order off, demote, promote."""

    off: list[str] = field(default_factory=list)
    demote: list[str] = field(default_factory=list)
    promote: list[str] = field(default_factory=list)

    @staticmethod
    def parse(toml: str, known: list[str]) -> Selection:
        """From [rules] kind = off, warn, err or on; unknown kinds and values raise."""
        rules = tomllib.loads(toml).get("rules", {})
        for kind, value in rules.items():
            if kind not in known or value not in ("off", "warn", "err", "on"):
                raise ValueError(f"unknown rule or value: {kind} = {value}")
        return Selection(*[[k for k, v in rules.items() if v == name] for name in ("off", "warn", "err")])

    def apply(self, findings: DataFrame) -> DataFrame:
        kept = findings.where(~F.col("kind").isin(self.off)) if self.off else findings
        level = F.when(F.col("kind").isin(self.promote or [""]), "err").when(F.col("kind").isin(self.demote or [""]), "warn").otherwise(F.col("severity"))
        return kept.withColumn("severity", level)


def finalize(findings: DataFrame, documents: DataFrame, selection: Selection | None = None, parsed: DataFrame | None = None) -> DataFrame:
    """The fixed chain: first of a kind, form, notice frame, form drops, instruction files, selection.

    Findings are dealt by document once, each document with one more row of its facts; windows over a document tell its
    form, so nothing is joined with itself.  ``parsed`` are the documents' dealt lines, if at hand.
    """
    if parsed is None:
        parsed = structure.dealt_lines(documents)
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    found = first_of_kind(findings.repartition(n, "doc_key"))
    facts = _facts(documents, parsed.where("NOT fenced").drop("fenced"))
    told = facts.select("doc_key", F.struct(*[c for c in facts.columns if c != "doc_key"]).alias("_facts"))
    every = found.unionByName(told, allowMissingColumns=True)
    own = Window.partitionBy("doc_key")
    every = every.withColumn("_own", F.max("_facts").over(own)).withColumn("_errs", _errs().over(own)).withColumn("_told", _told().over(own))
    every = every.withColumn("_form", F.coalesce("_own.declared", _form(F.col("_errs"), F.col("_told"), F.col("_own.share"), F.col("_own.polite_lines"))))
    is_facts = F.col("_facts").isNotNull()
    every = every.where((is_facts & F.col("_own.declared").isNull() & F.col("_form").isin("prose", "notice")) | (~is_facts & ~_outside(F.col("_form"), F.col("_own.first"), F.col("_own.last")) & ~_not_asked(F.col("_form"))))
    said = {"kind": "form_undeclared", "severity": "warn", "note": ""}
    columns = [F.when(is_facts, F.lit(said[c]) if c in said else F.col("_form")).otherwise(F.col(c)).alias(c) if c in (*said, "match") else F.col(c) for c in findings.columns]
    out = every.select(*columns)
    if "path" in documents.columns:
        out = drop_instruction_files(out, documents)
    return (selection or Selection()).apply(out)


def summary(findings: DataFrame, slots: DataFrame, shown: int = 8) -> DataFrame:
    """(doc_key, errors, warnings, slots, blind, first_warnings, failed) of every document."""
    warned = F.array_sort(F.collect_list(F.when(F.col("severity") == "warn", F.struct("line_no", "kind", "match"))))
    n = findings.groupBy("doc_key").agg(
        F.count_if(F.col("severity") == "err").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"), F.transform(F.slice(warned, 1, shown), lambda w: w["kind"]).alias("first_warnings")
    )
    return slots.join(n, "doc_key", "left").fillna(0, ["errors", "warnings"]).withColumn("failed", F.col("errors") > 0)


def drop_origin_lines(findings: DataFrame, lines: DataFrame, origin: DataFrame) -> DataFrame:
    """Without findings on lines that equal a line of the declared origin document (doc_key, text)."""
    same = lines.withColumn("k", squeeze("text")).join(origin.select("doc_key", squeeze("text").alias("k")).distinct(), ["doc_key", "k"], "left_semi").select("doc_key", "line_no")
    return findings.join(same, ["doc_key", "line_no"], "left_anti").select(*findings.columns)


def condense(findings: DataFrame) -> DataFrame:
    """Equal findings of a document as one row with their number and first line."""
    return findings.groupBy("doc_key", "kind", "severity", "match").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


def gate_status(findings: DataFrame, passes: DataFrame, open_lines: DataFrame, documents: DataFrame, stages: list[str]) -> DataFrame:
    """(doc_key, reason): why a document may not be published; no row if it may.

    passes: (doc_key, stage, verdict) of the current content; open_lines: (doc_key, line_no) not judged yet.
    """
    keys = documents.select("doc_key")
    errors = findings.where("severity = 'err'").select("doc_key", F.lit("errors").alias("reason"))
    unjudged = open_lines.select("doc_key", F.lit("lines not judged").alias("reason"))
    wanted = keys.select("doc_key", F.explode(F.lit(stages)).alias("stage")).join(passes.where("verdict = 'pass'").select("doc_key", "stage"), ["doc_key", "stage"], "left_anti")
    missing = wanted.select("doc_key", F.concat(F.lit("no pass: "), "stage").alias("reason"))
    return errors.union(unjudged).union(missing).distinct()


def line_identities(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line_key", line_key("text"))

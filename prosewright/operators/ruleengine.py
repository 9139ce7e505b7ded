"""Rules as records: literal or regex, allow lists, profiles and scopes; feedback and its promotion to rules and cases.

Units are (doc_key, unit_id, line_number, text).  Literals are found by one automaton, regular expressions by a list compiled once a worker.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright.functions.spans import pandas_function
from prosewright.functions.text import rule_key
from prosewright.operators import intervals, patterns

# Profiles and the scope each stands for.
PROFILE_SCOPES = {
    "general": "general_it_business", "technical-report": "general_it_business", "executive-report": "general_it_business", "presentation": "general_it_business",
    "presenter-notes": "presenter_notes", "short-message": "general_it_business", "ct-project": "ct_project_context",
}
# Marks between the two sides of a comparison, and pairs of marks for its bad and its good side.
COMPARISON = ["→", "=>", "->", "❌", "✅"]
CONTRAST = [("❌", "✅"), ("✗", "✓"), ("×", "○")]
# What stands beside the word for path when it is abstract, a metaphor, or meant literally.
ABSTRACT = r"(?:제품화|도입|성장|개선|상용화|발전|전환|확장|진입|학습|실현|달성|해결|복구|성공|수익화|배포|운영)\s*경로"
METAPHOR = r"에이전트.{0,16}경로(?:를|에서)?\s*(?:이탈|벗어(?:나|났))"
LITERAL = (
    r"(?:파일|폴더|디렉터리|디렉토리|절대|상대|UNC|네임스페이스|메뉴|화면|URL|URI|Windows|윈도우|import|임포트|권한|원격|소스|설정|스캔|호출|실행|보고서|프로젝트|네트워크 공유(?:의\s+특정)?|하위호환|우회|Write)\s*경로"
    r"|경로(?:의|가|는|를|에|로)?\s*(?:문자열|구분자|표기|입력|인자|변수|처리|패턴|포맷|불일치|잔재|전체|단축|조정|포함|삭제|재인덱싱|비어|활성화|허용|한정)"
    r"|(?:아래|해당|특정|네트워크 공유의\s+특정)\s*경로(?:에|로|를)?\s*(?:생성|저장|등록|지정|복사|이동|삭제|접근|확인)|\|\s*경로\s*\|"
    r"|(?:[A-Za-z]:[\\/]|\\\\|(?:^|\s)/[A-Za-z0-9_.-]|[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)"
)
WINDOW = 40

RULE_SCHEMA = "rule_id string, detector string, original string, pattern string, revised string, scope string, status string, allow array<string>, profiles array<string>, requires_context boolean"


def rule_errors(rules: DataFrame) -> DataFrame:
    """(rule_id, error): what makes a rule table unusable; empty if it can be used."""
    keyed = rules.withColumn("key", rule_key("detector", "pattern", "original"))
    bad = lambda where, why: keyed.where(where).select("rule_id", F.lit(why).alias("error"))
    twice = lambda c, why: keyed.join(keyed.groupBy(c).count().where("count > 1").select(c), c).select("rule_id", F.lit(why).alias("error"))
    missing = bad("rule_id IS NULL OR detector IS NULL OR (detector = 'literal' AND coalesce(original, '') = '') OR (detector = 'regex' AND coalesce(pattern, '') = '')", "missing field")
    unknown = bad("detector NOT IN ('literal', 'regex')", "unknown detector")
    return missing.union(unknown).union(twice("rule_id", "duplicate id")).union(twice("key", "duplicate target")).union(_bad_patterns(keyed))


def _bad_patterns(rules: DataFrame) -> DataFrame:
    @F.pandas_udf("boolean")
    def broken(patterns: pd.Series) -> pd.Series:
        def fails(p):
            try:
                re.compile(p or "")
            except re.error:
                return True
            return False

        return patterns.map(fails).astype(bool)

    return rules.where("detector = 'regex'").where(broken("pattern")).select("rule_id", F.lit("bad pattern").alias("error"))


def applies(profile: str):
    """Whether a rule holds for a profile: the profile is in its list, if it has one, and its scope is the profile's or the general one."""
    if profile == "all":
        return F.lit(True)
    scope = PROFILE_SCOPES[profile]
    listed = (F.size(F.coalesce("profiles", F.array().cast("array<string>"))) == 0) | F.array_contains("profiles", profile)
    return listed & (F.col("scope").isNull() | F.col("scope").isin(scope, "general_it_business"))


@pandas_function("boolean")
def is_allowed(text: pd.Series, start: pd.Series, end: pd.Series, allow: pd.Series) -> pd.Series:
    """Whether an allow pattern overlaps the hit, seen within WINDOW characters around it."""

    def one(t, a, b, own):
        lo = max(0, a - WINDOW)
        return any(m.start() + lo < b and a < m.end() + lo for p in own for m in re.finditer(p, t[lo : b + WINDOW]))

    return pd.Series([one(*x) for x in zip(text, start, end, allow, strict=True)], dtype=bool)


def rule_hits(units: DataFrame, rules: DataFrame) -> DataFrame:
    """The units' columns, rule_id, start and end of every hit that no allow pattern of its rule overlaps; hits of one literal keep apart."""
    keep = units.columns
    literal = rules.where("detector = 'literal' AND original != ''").select("rule_id", F.col("original").alias("term"))
    found = patterns.find_terms(units, literal, keep, overlapping=False).join(literal, "term").select(*keep, "rule_id", "start", "end")
    found = found.union(patterns.find_patterns(units, rules.where("detector = 'regex'"), keep).select(*keep, "rule_id", "start", "end"))
    guarded = rules.where("size(allow) > 0").select("rule_id", "allow")
    both = found.join(guarded, "rule_id", "left")
    free = both.where("allow IS NULL").select(*found.columns)
    return free.union(both.where("allow IS NOT NULL").where(~is_allowed("text", "start", "end", "allow")).select(*found.columns))


def compared(text: Column, match: Column, revised: Column) -> Column:
    """Whether a line sets the match against its revision: a mark stands between the two, or they share a table row; without a
    revision, a pair of marks for bad and good."""
    at, other = F.instr(text, match), F.instr(text, revised)
    first = at < other
    from_, to = F.when(first, at + F.length(match)).otherwise(other + F.length(revised)), F.when(first, other).otherwise(at)
    between = F.substring(text, from_, F.greatest(to - from_, F.lit(0)))
    marked = reduce(Column.__or__, [F.contains(between, F.lit(m)) for m in COMPARISON])
    row = text.rlike(r"^\s*\|") & (F.length(text) - F.length(F.replace(text, F.lit("|"))) >= 3)
    paired = reduce(Column.__or__, [F.contains(text, F.lit(bad)) & F.contains(text, F.lit(good)) for bad, good in CONTRAST])
    return F.when(F.coalesce(revised, F.lit("")) == "", paired).otherwise((at > 0) & (other > 0) & (row | marked))


def scan(units: DataFrame, rules: DataFrame, profile: str = "general") -> DataFrame:
    """Findings of all rules in all units, with 1-based columns and the action: replace, review or skip."""
    own = rules.where(applies(profile))
    said = own.select("rule_id", "revised", "requires_context")
    hits = rule_hits(units.select("doc_key", "unit_id", "line_number", "text"), own).join(said, "rule_id")
    match = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    quoted = F.substring(F.col("text"), F.lit(1), F.col("start")).rlike("「[^」]*$") & F.contains(F.substring(F.col("text"), F.col("end") + 1, F.length("text")), F.lit("」"))
    action = F.when(compared(F.col("text"), match, F.col("revised")) | quoted, "skip").when(F.col("requires_context"), "review").otherwise("replace")
    return hits.select(
        "doc_key", "unit_id", "line_number", "rule_id", match.alias("match"), (F.col("start") + 1).alias("start_column"), (F.col("end") + 1).alias("end_column"), "revised", action.alias("action"),
    )


def action_counts(findings: DataFrame) -> DataFrame:
    """(action, n) of a scan's findings."""
    return findings.groupBy("action").agg(F.count("*").alias("n"))


def path_uses(units: DataFrame) -> DataFrame:
    """Each 경로: abstract (metaphors too), literal or review, by the 40 characters around it; numbered in its unit."""
    cut = F.split("text", "경로")
    places = F.transform(F.sequence(F.lit(1), F.size(cut) - 1), lambda i: F.length(F.array_join(F.slice(cut, 1, i), "경로")))
    each = units.where(F.contains("text", F.lit("경로"))).select("doc_key", "unit_id", "line_number", "text", F.posexplode(places).alias("n", "at"))
    near = F.substring(F.col("text"), F.greatest(F.lit(1), F.col("at") - WINDOW + 1), F.lit(2 * WINDOW + 2))
    kind = F.when(near.rlike(ABSTRACT) | near.rlike(METAPHOR), "abstract_candidate").when(near.rlike(LITERAL), "literal_candidate").otherwise("review")
    return each.select("doc_key", "unit_id", "line_number", (F.col("n") + 1).alias("occurrence"), F.col("at").alias("start"), kind.alias("classification"))


def uncovered(uses: DataFrame, findings: DataFrame) -> DataFrame:
    """Uses of 경로 that no rule hit covers, skipped hits included."""
    spans = findings.select("doc_key", "unit_id", (F.col("start_column") - 1).alias("start"), (F.col("end_column") - 1).alias("end"))
    return intervals.without_overlaps(uses, spans, ["doc_key", "unit_id"], end=F.col("start") + 2)


def ordered_report(findings: DataFrame) -> DataFrame:
    return findings.orderBy("doc_key", F.coalesce("line_number", F.lit(-1)), "start_column", "rule_id")


FEEDBACK_ERRORS = [
    ("candidate_id IS NULL OR rule_id IS NULL OR original IS NULL", "missing field"),
    ("user_verdict NOT IN ('accept', 'reject', 'unsure')", "unknown verdict"),
    ("decision_source NOT IN ('human', 'model')", "unknown source"),
    ("context_level NOT IN ('word', 'sentence', 'paragraph', 'document')", "unknown context level"),
    ("user_verdict = 'accept' AND revised = original", "nothing changed"),
]


def feedback_errors(feedback: DataFrame) -> DataFrame:
    found = F.array(*[F.when(F.expr(where), F.lit(why)) for where, why in FEEDBACK_ERRORS])
    return feedback.select("candidate_id", F.explode(F.array_compact(found)).alias("error"))


def candidates(feedback: DataFrame) -> DataFrame:
    """Adds status, replacement mode and whether context is needed."""
    context = F.col("context_level").isin("paragraph", "document")
    status = F.when((F.col("user_verdict") == "accept") & (F.col("decision_source") == "human"), "confirmed").when(F.col("user_verdict") == "reject", "rejected").otherwise("open")
    return feedback.withColumn("status", status).withColumn("requires_context", context).withColumn("replacement_mode", F.when(context, "review").otherwise("replace"))


def promotable(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Confirmed human candidates that no rule has yet."""
    return found.where("status = 'confirmed' AND decision_source = 'human'").join(rules.select("original"), "original", "left_anti").dropDuplicates(["original"])


def regression_cases(rules: DataFrame) -> DataFrame:
    """Generated cases of every rule: the phrase, its revision, both compared, each allowed context, and another scope."""
    case = lambda v, text, expected: F.struct(F.lit(v).alias("variant"), text.alias("text"), F.lit(expected).alias("expected"))
    fixed = F.array(
        case("P", F.concat(F.lit("본문에 "), "original", F.lit(" 있음")), "finding"), case("N", F.concat(F.lit("본문에 "), "revised", F.lit(" 있음")), "no_finding"),
        case("T", F.concat(F.lit("| "), "original", F.lit(" → "), "revised", F.lit(" |")), "skip"), case("X", F.concat("original", F.lit(" 다른 범위")), "other_scope"),
    )
    allowed = F.transform(F.coalesce("allow", F.array().cast("array<string>")), lambda a: F.struct(F.lit("A").alias("variant"), a.alias("text"), F.lit("no_finding").alias("expected")))
    return rules.where("detector = 'literal'").select("rule_id", F.inline(F.concat(fixed, allowed))).withColumn("case_id", F.concat_ws("-", "rule_id", "variant", F.substring(F.sha2("text", 256), 1, 6)))


def mirrors_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two copies has: none if they are equal."""
    return a.exceptAll(b).union(b.exceptAll(a))

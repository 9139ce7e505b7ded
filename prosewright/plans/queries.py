"""Registered queries over the given tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.functions.text import ENTITIES, share
from prosewright.operators import corpus, elements, evaluation, intervals, lexical, patterns, revision, sensitive, structure, usage
from prosewright.plans import planted

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("doc_key"), F.coalesce("text", F.lit("")).alias("raw"), "lang", "source")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


LINES = "l AS (SELECT doc_id AS doc_key, CAST(unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS INT) AS line_no, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents)"

# --- findings -----------------------------------------------------------------------------------------------------------

# The blocking patterns of sensitive content without their exemptions, which the SQL's expressions cannot say.
SENSITIVE = [
    ("account_path", r"(?:[A-Za-z]:[/\\]Users[/\\]|/home/|/Users/)[A-Za-z0-9][A-Za-z0-9._-]{1,}"),
    ("key", r"(?:sk-[A-Za-z0-9_-]{12,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{12,})"),
    ("email", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]{2,}"),
    ("internal_host", r"https?://[a-z0-9.-]*\.(?:local|internal|corp|lan)\b"),
]

NEUTRAL_RULES = [
    ("doubled_stop", "warn", r"[A-Za-z0-9]\.[!?]"),
    ("doubled_mark", "warn", r"[!?]{2,}"),
    ("doubled_word_mark", "warn", r"[#$%&*]{3}"),
    ("invisible", "err", "[​‌‍⁠﻿]"),
    ("key_like", "err", dict(SENSITIVE)["key"]),
    ("email", "err", dict(SENSITIVE)["email"]),
]


def neutral_counts(docs: DataFrame) -> DataFrame:
    """(doc_key, kind, severity, n) by document: no pattern crosses a line end, so whole texts are counted in one narrow pass."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.regexp_count("raw", F.lit(p)).cast("long").alias("n")) for k, s, p in NEUTRAL_RULES])
    return docs.select("doc_key", F.inline(each)).where("n > 0")


def neutral_findings(docs: DataFrame) -> DataFrame:
    """(doc_key, line_no, kind, severity, n) of rules that hold in any language."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.regexp_count("text", F.lit(p)).cast("long").alias("n")) for k, s, p in NEUTRAL_RULES])
    return structure.lines(docs).select("doc_key", "line_no", F.inline(each)).where("n > 0")


_NEUTRAL_SQL = " UNION ALL ".join(
    f"SELECT doc_key, line_no, '{k}' AS kind, '{s}' AS severity, CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS n FROM l" for k, s, p in NEUTRAL_RULES
)


@query(f"WITH {LINES}, f AS (SELECT * FROM ({_NEUTRAL_SQL}) WHERE n > 0) SELECT doc_key, kind, severity, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY ALL")
def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neutral_counts(documents(spark, sf_dir))


@query(
    f"WITH {LINES}, f AS (SELECT * FROM ({_NEUTRAL_SQL}) WHERE n > 0) SELECT doc_key, CAST(sum(CASE WHEN severity = 'err' THEN n ELSE 0 END) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS findings, count(DISTINCT kind) AS kinds FROM f GROUP BY doc_key ORDER BY errors DESC, findings DESC, doc_key LIMIT 100"
)
def most_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the 100 documents with most errors (a top-k report)."""
    n = F.array(*[F.regexp_count("raw", F.lit(p)).cast("long") for _, _, p in NEUTRAL_RULES])
    errs = F.lit([s == "err" for _, s, _ in NEUTRAL_RULES])
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    counted = documents(spark, sf_dir).select("doc_key", n.alias("n")).where(F.exists("n", lambda x: x > 0))
    by_doc = counted.select("doc_key", total(F.zip_with("n", errs, lambda x, e: F.when(e, x).otherwise(0))).alias("errors"), total(F.col("n")).alias("findings"), F.size(F.filter("n", lambda x: x > 0)).cast("long").alias("kinds"))
    return by_doc.orderBy(F.desc("errors"), F.desc("findings"), "doc_key").limit(100)


@query(
    f"WITH {LINES}, f AS (SELECT * FROM ({_NEUTRAL_SQL}) WHERE n > 0), k AS (SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY kind) SELECT kind, n, round(CAST(n AS DOUBLE) / (SELECT CAST(sum(n) AS BIGINT) FROM k), 6) AS share FROM k"
)
def rule_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = neutral_counts(documents(spark, sf_dir)).groupBy("kind").agg(F.sum("n").alias("n"))
    return by.join(F.broadcast(by.agg(F.sum("n").alias("t")))).select("kind", "n", F.round(share("n", "t"), 6).alias("share"))


_SENSITIVE_SQL = " UNION ALL ".join(f"SELECT doc_key, line_no, '{label}' AS label, unnest(regexp_extract_all(text, '({p})', 1)) AS match FROM l" for label, p in SENSITIVE)


@query(f"WITH {LINES}, m AS ({_SENSITIVE_SQL}) SELECT doc_key, line_no, label, substr(match, 1, 44) AS match FROM m")
def sensitive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns without lookaround, so that the SQL can say the same; the full set is ``sensitive_scan_full``."""
    return sensitive.scan_lines(structure.lines(documents(spark, sf_dir)), patterns=SENSITIVE).select("doc_key", "line_no", "label", "match")


# The exemptions that the patterns say by lookahead, as conditions on what a bare pattern finds: (label, bare pattern, what rules a match out).
_EXEMPT = [
    ("account_path", r"(?:[A-Za-z]:[/\\]Users[/\\]|/home/|/Users/)[A-Za-z0-9][A-Za-z0-9._-]+", r"regexp_matches(match, '^(?:[A-Za-z]:[/\\]Users[/\\]|/home/|/Users/)(?:name|user|username|you|me|runner|your[_-]?name|your[_-]?user)\b')"),
    ("email", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]{2,}", r"regexp_matches(match, '^[a-z]@[a-z]\.[a-z]{2,3}\b|@[0-9.]+\b|@example\.(?:com|org|net)\b|@(?:invalid|localhost)\b')"),
    ("key", r"(?:sk-[A-Za-z0-9_-]{12,}|ghp_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{8,}|AKIA[0-9A-Z]{12,})", r"regexp_matches(match, '^xox[baprs]-(?:your|example|test|dummy|xxx)\b')"),
    ("internal_host", r"(?i:https?://[a-z0-9.-]*\.(?:local|internal|corp|lan)\b)", "false"),
    ("chat_id", r"\b[CDGUT]0[A-Z0-9]{8,}\b", "NOT regexp_matches(substr(match, 3), '[A-Z]')"),
]
_FULL_SQL = " UNION ALL ".join(f"SELECT * FROM (SELECT doc_key, line_no, '{label}' AS label, unnest(regexp_extract_all(text, '({p})', 1)) AS match, text FROM l) WHERE NOT ({out})" for label, p, out in _EXEMPT)
_ADVICE_SQL = "CASE label " + " ".join(f"WHEN '{label}' THEN '{sensitive.ADVICE[label]}'" for label, _, _ in _EXEMPT) + " END"


@query(f"WITH {LINES}, m AS ({_FULL_SQL}) SELECT doc_key, line_no, label, substr(match, 1, 44) AS match, substr(text, 1, 96) AS line, {_ADVICE_SQL} AS advice FROM m")
def sensitive_scan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocking patterns with their exemptions."""
    return sensitive.scan_lines(structure.lines(documents(spark, sf_dir)))


# The list: words of eight letters or more of all benchmark items, found in all texts as parts of words too.
_TERMS_SQL = """d AS (SELECT doc_id AS doc_key, coalesce(text, '') AS raw FROM documents),
t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{8,}')) AS term FROM benchmark),
o AS (SELECT doc_key, term, list_transform(string_split(raw, term), lambda x: length(x)) AS sizes FROM d JOIN t ON contains(raw, term)),
i AS (SELECT doc_key, term, sizes, unnest(range(1, len(sizes))) AS i FROM o),
h AS (SELECT doc_key, term, CAST(list_sum(sizes[1:i]) + (i - 1) * length(term) AS BIGINT) AS s FROM i),
p AS (SELECT doc_key, term, s, s + length(term) AS e FROM h)"""


def term_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_key, term, start, end, ...) of the listed words in all texts, each word's places apart."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{8,})"), F.lit(1))).alias("term"))
    return patterns.find_terms(documents(spark, sf_dir), words, ["doc_key"], text="raw", overlapping=False)


@query(f"WITH {_TERMS_SQL} SELECT doc_key, term, count(*) AS n, min(s) AS first_start FROM p GROUP BY doc_key, term")
def term_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_places(spark, sf_dir).groupBy("doc_key", "term").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first_start"))


@query(
    f"""WITH {_TERMS_SQL},
r AS (SELECT doc_key, s, e, coalesce(max(e) OVER (PARTITION BY doc_key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= s, true) AS opens FROM p),
g AS (SELECT doc_key, s, e, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM r),
m AS (SELECT doc_key, run, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY doc_key, run)
SELECT doc_key, CAST(sum(n) AS BIGINT) AS hits, count(*) AS runs, CAST(sum(e - s) AS BIGINT) AS covered FROM m GROUP BY doc_key"""
)
def term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many code points of each text the listed words cover together, overlaps once."""
    runs = intervals.merged(term_places(spark, sf_dir), ["doc_key"])
    return runs.groupBy("doc_key").agg(F.sum("n").alias("hits"), F.count("*").alias("runs"), F.sum(F.col("end") - F.col("start")).alias("covered"))


# --- corpus -------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id AS doc_key, source, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, sha256(coalesce(text, '')) AS sha256, substr(sha256(replace(coalesce(text, ''), chr(13) || chr(10), chr(10))), 1, 16) AS digest,
  CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS line_count, CAST(len(regexp_extract_all(text, '[가-힣]')) AS BIGINT) AS hangul,
  CASE WHEN strlen(coalesce(text, '')) < 4096 THEN 'small' WHEN strlen(coalesce(text, '')) < 20480 THEN 'medium' ELSE 'large' END AS size_bucket FROM documents""")
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.catalog(documents(spark, sf_dir))


@query("""WITH c AS (SELECT doc_id AS doc_key, source, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, '')) AS b FROM documents WHERE strlen(coalesce(text, '')) >= 512),
  s AS (SELECT *, CASE WHEN b < 4096 THEN 'small' WHEN b < 20480 THEN 'medium' ELSE 'large' END AS size_bucket FROM c),
  r AS (SELECT doc_key, source, size_bucket, CAST(row_number() OVER (PARTITION BY source, size_bucket ORDER BY sha256, doc_key) AS INT) AS turn FROM s)
SELECT * FROM r ORDER BY turn, source, size_bucket LIMIT 200""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 200 documents, round robin over source and size."""
    rows = corpus.catalog(documents(spark, sf_dir)).where("bytes >= 512").select("doc_key", "source", "size_bucket", "sha256")
    return corpus.stratified_sample(rows, ["source", "size_bucket"], ["sha256", "doc_key"], 200).select("doc_key", "source", "size_bucket", "turn")


@query("""WITH k AS (SELECT doc_id AS doc_key, source, sha256(coalesce(text, '')) AS sha256 FROM documents), f AS (SELECT sha256, count(*) AS copies, arg_min(doc_key, (source, doc_key)) AS canonical FROM k GROUP BY sha256)
SELECT doc_key, sha256, canonical, copies, doc_key <> canonical AS is_copy FROM k JOIN f USING (sha256)""")
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_key", "source", F.sha2(F.col("raw").cast("binary"), 256).alias("sha256"))
    return corpus.mark_copies(rows, "sha256", ["source", "doc_key"], "doc_key").select("doc_key", "sha256", "canonical", "copies", "is_copy")


@query("""WITH p AS (SELECT doc_id AS doc_key, [x FOR x IN [CASE WHEN regexp_matches(text, 'licen[sc]ed?') THEN 'licence' END, CASE WHEN regexp_matches(text, 'rights reserved') THEN 'rights' END] IF x IS NOT NULL] AS categories,
    list_distinct(list_concat(regexp_extract_all(text, 'licen[sc]ed?'), regexp_extract_all(text, 'rights reserved'))) AS phrases, sha256(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS h FROM (SELECT doc_id, lower(text) AS low, text FROM documents)),
  s AS (SELECT doc_key, h AS passage_hash, CAST(len(phrases) + 2 * len(categories) AS BIGINT) AS score FROM p WHERE len(categories) > 0)
SELECT passage_hash, max(score) AS score, arg_min(doc_key, (-score, doc_key)) AS doc_key, count(*) AS uses FROM s GROUP BY passage_hash""")
def keyword_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.best_passages(_licence_passages(spark, sf_dir), "doc_key")


def _licence_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.keyword_passages(documents(spark, sf_dir).select("doc_key", F.col("raw").alias("text")), {"licence": "licen[sc]ed?", "rights": "rights reserved"})


@query("""SELECT DISTINCT sha256(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS passage_hash, doc_id AS doc_key FROM documents WHERE regexp_matches(text, 'licen[sc]ed?|rights reserved')""")
def keyword_passage_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.passage_aliases(_licence_passages(spark, sf_dir), "doc_key")


@query("""WITH t AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn) = text, false) AS again FROM conversations)
SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, CAST(count_if(trim(coalesce(text, '')) = '') AS BIGINT) AS empty_turns, CAST(count_if(again) AS BIGINT) AS repeats_before, CAST(sum(length(text)) AS BIGINT) AS chars,
  round(count(*) / (SELECT count(*) FROM conversations), 6) AS turn_share FROM t GROUP BY role""")
def transcript_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.transcript_coverage(table(spark, sf_dir, "conversations"))


# --- structure ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {LINES}, n AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_key ORDER BY line_no) AS run FROM l WHERE regexp_replace(text, '\\s', '', 'g') <> '')
SELECT doc_key, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines, sha256(string_agg(text, chr(10) ORDER BY line_no)) AS text_sha FROM n GROUP BY doc_key, run""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.paragraphs(structure.lines(documents(spark, sf_dir))).withColumn("text_sha", F.sha2(F.col("text").cast("binary"), 256)).drop("text")


@query(f"""WITH {LINES} SELECT doc_key, round(avg(CASE WHEN regexp_matches(trim(text), '^([-*+>|#]|\\d+[.)]\\s|```|~~~|<|!\\[|[→⇒])') THEN 0.0 ELSE 1.0 END), 6) AS share, count(*) AS n_lines
FROM l WHERE regexp_replace(text, '\\s', '', 'g') <> '' GROUP BY doc_key""")
def prose_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.prose_share(structure.lines(documents(spark, sf_dir))).withColumn("share", F.round("share", 6))


@query()
def value_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.slot_counts(documents(spark, sf_dir))


@query()
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.sections(structure.body_lines(documents(spark, sf_dir))).select("doc_key", "first_line", "last_line", F.array_join("path", " > ").alias("path"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_key"), F.coalesce("html", F.lit("")).alias("raw"), "url")


_PAGE = r"""r AS (SELECT page_id AS doc_key, coalesce(html, '') AS raw FROM pages),
c AS (SELECT doc_key, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '(?is)<style\b.*?</style\s*>', '', 'g'), '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<pre[^>]*>\s*<code.*?</code>\s*</pre>', '□', 'g'), '(?i)<code[^>]*>\s*</code>', '', 'g') AS raw FROM r)"""


def _unescaped(value: str) -> str:
    """SQL of ``unescape_html`` without numbered references, which no page has."""
    for pattern, by in ENTITIES:
        value = f"regexp_replace({value}, '{pattern}', '{by.replace(chr(39), chr(39) * 2)}', 'g')"
    return value


_HREF = _unescaped(r"""regexp_extract(a, '(?is)\bhref\s*=\s*["'']([^"'']*)["'']', 1)""")
_SHOWN = rf"""regexp_replace(regexp_replace({_unescaped("regexp_replace(a, '<[^>]+>', '', 'g')")}, '\s+', ' ', 'g'), '^ | $', '', 'g')"""


def _stripped(value: str) -> str:
    """SQL of ``strip_tags``."""
    blocks = structure.BLOCK_TAGS
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({value}, '(?i)<br\b[^>]*>', ' ', 'g'), '(?i)</?(?:{blocks})\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g')"


@query("""SELECT page_id AS doc_key, regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\\b')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '(?i)<h[1-6]\\b')) AS BIGINT) AS headings,
  CAST(len(regexp_extract_all(html, '(?i)<p\\b')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, '(?i)<(?:script|style)\\b')) AS BIGINT) AS scripts FROM pages""")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: F.regexp_count("raw", F.lit(p)).cast("long")
    return pages(spark, sf_dir).select("doc_key", F.regexp_extract("raw", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), n(r"(?i)<a\b").alias("links"), n(r"(?i)<h[1-6]\b").alias("headings"), n(r"(?i)<p\b").alias("paragraphs"), n(r"(?i)<(?:script|style)\b").alias("scripts"))


@query(
    rf"""WITH {_PAGE}, a AS (SELECT doc_key, regexp_extract_all(raw, '(?is)(<a\b[^>]*\bhref\s*=\s*["''][^"'']*["''][^>]*>.*?</a>)', 1) AS found FROM c), e AS (SELECT doc_key, unnest(found) AS a, CAST(generate_subscripts(found, 1) - 1 AS INT) AS link_no FROM a)
SELECT doc_key, CAST(row_number() OVER (PARTITION BY doc_key ORDER BY link_no) - 1 AS INT) AS link_no, {_SHOWN} AS text, {_HREF} AS href FROM e WHERE {_SHOWN} <> '' AND {_HREF} <> ''"""
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_key", F.posexplode(structure.html_links("raw")).alias("link_no", "link")).select("doc_key", "link_no", "link.text", "link.href")


@query(
    rf"""WITH {_PAGE}, h AS (SELECT doc_key, regexp_extract_all(raw, '(?is)(<h[1-6]\b[^>]*>.*?</h[1-6]>)', 1) AS found FROM c), e AS (SELECT doc_key, unnest(found) AS h, CAST(generate_subscripts(found, 1) - 1 AS INT) AS heading_no FROM h)
SELECT doc_key, heading_no, CAST(regexp_extract(h, '(?i)^<h([1-6])', 1) AS INT) AS level, {_unescaped(_stripped("h"))} AS title FROM e"""
)
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_key", F.posexplode(structure.html_headings("raw")).alias("heading_no", "h")).select("doc_key", "heading_no", "h.level", "h.title")


@query(
    rf"""WITH {_PAGE}, t AS (SELECT doc_key, regexp_replace(regexp_replace(regexp_replace(raw, '(?is)<head\b.*?</head\s*>|<title\b.*?</title\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)</?(?:{structure.BLOCK_TAGS}|body|html)\b[^>]*>|<br\b[^>]*>', chr(10), 'g') AS t FROM c),
l AS (SELECT doc_key, list_filter(list_transform(string_split(regexp_replace(t, '<[^>]+>', '', 'g'), chr(10)), lambda r: regexp_replace({_unescaped("r")}, '^\s+|\s+$', '', 'g')), lambda r: r <> '') AS found FROM t)
SELECT doc_key, CAST(generate_subscripts(found, 1) AS INT) AS line_no, unnest(found) AS text FROM l"""
)
def page_visible_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.visible_html_lines(pages(spark, sf_dir))


_SLOTS = " UNION ALL ".join(
    [f"SELECT doc_key, '{k}' AS slot_kind, regexp_extract_all(raw, '{p}', 1) AS found FROM c" for k, p in (("dd", r"(?is)<dd\b[^>]*>(.*?)</dd>"), ("td", r"(?is)<td\b[^>]*>(.*?)</td>"), ("v", r'(?is)<[^>]*class="v"[^>]*>(.*?)</'))]
    + [r"SELECT doc_key, 'li', list_transform(string_split_regex(raw, '(?i)<li\b[^>]*>')[2:], lambda x: regexp_replace(x, '(?is)(?:<ul|<ol|</li>).*$', '')) FROM c"]
)


@query(
    f"""WITH {_PAGE}, s AS ({_SLOTS}), e AS (SELECT doc_key, slot_kind, CAST(generate_subscripts(found, 1) - 1 AS INT) AS slot_no, unnest(found) AS text FROM s)
SELECT doc_key, slot_kind, slot_no, {_stripped("text")} AS text FROM e WHERE {_stripped("text")} <> ''"""
)
def page_value_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.html_slots(pages(spark, sf_dir))


@query(
    rf"""WITH {_PAGE}, p AS (SELECT doc_key, regexp_replace(raw, '(?s)<!--.*?-->', '', 'g') AS raw FROM c),
a AS (SELECT doc_key, regexp_extract_all(raw, '(?i)<([a-z][a-z0-9]*)\b', 1) AS tags, regexp_extract_all(regexp_extract(raw, '(?is)<article\b[^>]*>(.*?)</article>', 1), '(?i)<([a-z][a-z0-9]*)\b', 1) AS inner_tags FROM p),
t AS (SELECT doc_key, lower(unnest(tags)) AS tag, 1 AS n, 0 AS inside FROM a UNION ALL SELECT doc_key, lower(unnest(inner_tags)), 0, 1 FROM a)
SELECT doc_key, tag, CAST(sum(n) AS BIGINT) AS n, CAST(sum(inside) AS BIGINT) AS in_article FROM t GROUP BY doc_key, tag"""
)
def page_article_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_key, tag, n, in_article): elements of each kind, and those that lie in an article by their numbers."""
    every = pages(spark, sf_dir).select("doc_key", elements.elements_of("raw").alias("e"))
    articles = F.filter("e", lambda a: a["tag"] == "article")
    inside = F.transform("e", lambda x: F.struct(x["tag"].alias("tag"), F.exists("articles", lambda a: (a["pre"] < x["pre"]) & (x["pre"] <= a["post"])).alias("inside")))
    flat = every.withColumn("articles", articles).select("doc_key", F.inline(inside))
    return flat.groupBy("doc_key", "tag").agg(F.count("*").alias("n"), F.count_if("inside").alias("in_article"))


# --- vocabulary ---------------------------------------------------------------------------------------------------------

_TERMS = "t AS (SELECT doc_id AS doc_key, unnest(regexp_extract_all(lower(text), '\\pL+')) AS lexeme FROM documents), c AS (SELECT doc_key, lexeme, count(*) AS n FROM t WHERE length(lexeme) >= 2 GROUP BY ALL), b AS (SELECT lexeme, CAST(sum(n) AS BIGINT) AS base, count(*) AS docs FROM c GROUP BY lexeme)"


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_counts(documents(spark, sf_dir).select("doc_key", "raw"), lexical.words("raw"))


def term_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.uses(documents(spark, sf_dir), lexical.words("raw"))


@query(f"WITH {_TERMS} SELECT lexeme, base, docs FROM b")
def frequency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.frequencies(documents(spark, sf_dir), lexical.words("raw"))


@query(f"WITH {_TERMS} SELECT doc_key, lexeme, n, base - n AS others FROM c JOIN b USING (lexeme) WHERE base - n <= 40 AND n >= 2")
def rare_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rare_terms(term_counts(spark, sf_dir), term_uses(spark, sf_dir), least_mine=2)


@query(f"""WITH {_TERMS}, s AS (SELECT doc_id AS doc_key, length(coalesce(text, '')) AS chars FROM documents), a AS (SELECT CAST(sum(chars) AS BIGINT) AS all_chars FROM s),
r AS (SELECT doc_key, lexeme, n, base, round((CAST(n AS DOUBLE) / chars) / (CAST(base AS DOUBLE) / all_chars), 6) AS ratio FROM c JOIN b USING (lexeme) JOIN s USING (doc_key), a WHERE n >= 3 AND base > 40 AND base <= 300)
SELECT * FROM r WHERE ratio >= 20""")
def overused_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = documents(spark, sf_dir).select("doc_key", F.length("raw").alias("chars"))
    return lexical.overused_terms(term_counts(spark, sf_dir), term_uses(spark, sf_dir), sizes, ratio=20)


@query(f"""WITH {_TERMS}, g AS (SELECT doc_id AS doc_key, CAST(quality AS VARCHAR) AS class FROM labels WHERE quality IS NOT NULL),
z AS (SELECT count_if(class = '1') AS n1, count_if(class = '0') AS n2 FROM g), d AS (SELECT lexeme, CAST(count_if(class = '1') AS BIGINT) AS df1, CAST(count_if(class = '0') AS BIGINT) AS df2 FROM c JOIN g USING (doc_key) GROUP BY lexeme)
SELECT lexeme, df1, df2, round(((df1 + 0.5::DOUBLE) / (n1 + 1)) / ((df2 + 0.5::DOUBLE) / (n2 + 1)), 6) AS skew FROM d, z WHERE df1 + df2 >= 5""")
def quality_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select(F.col("doc_id").alias("doc_key"), F.col("quality").cast("string").alias("class"))
    return lexical.class_skew(term_counts(spark, sf_dir), classes, "1", "0")


@query(f"""WITH {_TERMS}, g AS (SELECT doc_id AS doc_key, lang FROM documents WHERE lang IS NOT NULL), v AS (SELECT lang, lexeme, CAST(sum(n) AS BIGINT) AS n FROM c JOIN g USING (doc_key) GROUP BY ALL), w AS (SELECT lang, CAST(sum(n) AS BIGINT) AS total FROM v GROUP BY lang)
SELECT lang, lexeme, n, round(n * 10000::DOUBLE / total, 6) AS per_10k FROM v JOIN w USING (lang)""")
def vocabulary_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = documents(spark, sf_dir).where("lang IS NOT NULL").select("doc_key", "lang")
    return lexical.vocabulary_rates(term_counts(spark, sf_dir), groups, "lang")


# --- evaluation ---------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT d.doc_id, l.quality, strlen(coalesce(d.text, '')) >= 1000 AS hit FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT CAST(count_if(quality = 1 AND hit) AS BIGINT) AS tp, CAST(count_if(quality = 0 AND hit) AS BIGINT) AS fp, CAST(count_if(quality = 1 AND NOT hit) AS BIGINT) AS fn, CAST(count_if(quality = 0 AND NOT hit) AS BIGINT) AS tn, CAST(count_if(quality IS NULL AND hit) AS BIGINT) AS unlabelled_hits FROM s)
SELECT *, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision FROM c""")
def length_as_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = documents(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "doc_key"), "doc_key", "left")
    return evaluation.confusion(scored, "quality", F.octet_length("raw") >= 1000)


@query("""WITH s AS (SELECT l.quality AS y, length(coalesce(d.text, '')) AS x FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL), p AS (SELECT x FROM s WHERE y = 1), n AS (SELECT x FROM s WHERE y = 0)
SELECT (SELECT count(*) FROM p) AS positives, (SELECT count(*) FROM n) AS negatives, round((SELECT sum(CASE WHEN p.x > n.x THEN 1.0::DOUBLE WHEN p.x = n.x THEN 0.5::DOUBLE ELSE 0 END) FROM p, n) / ((SELECT count(*) FROM p) * (SELECT count(*) FROM n)), 6) AS auc""")
def length_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = documents(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "doc_key"), "doc_key").select(F.length("raw").alias("chars"), "quality")
    return evaluation.auc(scored, "chars", "quality")


@query("""SELECT d.source, count(*) AS unlabelled FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY d.source""")
def unlabelled_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "doc_key"), "doc_key", "left_anti").groupBy("source").agg(F.count("*").alias("unlabelled"))


@query("""WITH a AS (SELECT doc_id AS item, 'quality' AS judge, quality = 1 AS correct FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic', toxic = 0 FROM labels WHERE toxic IS NOT NULL),
p AS (SELECT item, min(correct::INT) AS lo, max(correct::INT) AS hi FROM a GROUP BY item)
SELECT count(*) AS items, round(avg(lo), 6) AS all_correct, round(avg(hi), 6) AS any_correct, round(avg((lo = hi)::INT), 6) AS agreement FROM p""")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "item")
    one = labels.where("quality IS NOT NULL").select("item", F.lit("quality").alias("judge"), (F.col("quality") == 1).alias("correct"))
    two = labels.where("toxic IS NOT NULL").select("item", F.lit("toxic").alias("judge"), (F.col("toxic") == 0).alias("correct"))
    return evaluation.agreement(one.union(two))


@query("""WITH s AS (SELECT DISTINCT lang AS run, lexeme AS item FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '\\pL+')) AS lexeme FROM documents WHERE lang IS NOT NULL) WHERE length(lexeme) >= 2),
n AS (SELECT run, count(*) AS k FROM s GROUP BY run), b AS (SELECT x.run AS a, y.run AS b, count(*) AS n_both FROM s x JOIN s y ON x.item = y.item AND x.run < y.run GROUP BY ALL)
SELECT x.run AS a, y.run AS b, coalesce(n_both, 0) AS "both", x.k + y.k - coalesce(n_both, 0) AS either, round(coalesce(n_both, 0) / CAST(x.k + y.k - coalesce(n_both, 0) AS DOUBLE), 6) AS jaccard FROM n x JOIN n y ON x.run < y.run LEFT JOIN b ON b.a = x.run AND b.b = y.run""")
def language_vocabulary_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = documents(spark, sf_dir).where("lang IS NOT NULL").select(F.col("lang").alias("run"), F.explode(lexical.words("raw")).alias("item"))
    return evaluation.jaccard_stability(own)


_RUN_WORDS = 8


@query(f"""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f\\v]+') AS w FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f\\v]+') AS w FROM documents),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + {_RUN_WORDS - 1}], ' ') AS run FROM b, unnest(range(1, greatest(len(w) - {_RUN_WORDS - 2}, 1))) AS r(i)),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {_RUN_WORDS - 1}], ' ') AS run FROM d, unnest(range(1, greatest(len(w) - {_RUN_WORDS - 2}, 1))) AS r(i))
SELECT doc_id AS doc_key, item_id, count(*) AS shared_runs FROM ds JOIN bs USING (run) GROUP BY ALL""")
def shared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items that share eight words in a row: an equi join on hashes of runs, confirmed on the words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0)).alias("w")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), words)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), words)
    return evaluation.shared_word_runs(docs, items, _RUN_WORDS).withColumnRenamed("item", "item_id")


# --- revisions ----------------------------------------------------------------------------------------------------------


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive turns of one role as versions of a text."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "conv_id", "role")  # so many tasks, as alignments take long
    before = F.lag("text").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("pair_id"), before.alias("original"), F.col("text").alias("revised")).where("original IS NOT NULL AND revised IS NOT NULL")


_PAIRS = "p AS (SELECT concat_ws('-', conv_id, turn) AS pair_id, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS original, text AS revised FROM conversations), q AS (SELECT * FROM p WHERE original IS NOT NULL AND revised IS NOT NULL)"


@query(f"""WITH {_PAIRS}, t AS (SELECT pair_id, unnest(regexp_extract_all(original, '[0-9]+|[A-Z]{{2,}}')) AS token, 1 AS a, 0 AS b FROM q UNION ALL SELECT pair_id, unnest(regexp_extract_all(revised, '[0-9]+|[A-Z]{{2,}}')), 0, 1 FROM q),
c AS (SELECT pair_id, token, sum(a) AS a, sum(b) AS b FROM t GROUP BY ALL) SELECT pair_id, token, CAST(greatest(a - b, 0) AS BIGINT) AS removed, CAST(greatest(b - a, 0) AS BIGINT) AS added FROM c WHERE a <> b""")
def turn_token_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = turn_pairs(spark, sf_dir)
    return revision.token_changes(pairs, revision.tokens("original", r"[0-9]+|[A-Z]{2,}"), revision.tokens("revised", r"[0-9]+|[A-Z]{2,}"))


@query()
def turn_edit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revision.edit_rate(turn_pairs(spark, sf_dir))


@query()
def turn_protected_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revision.protected_status(turn_pairs(spark, sf_dir))


@query()
def turn_change_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revision.change_rate(turn_pairs(spark, sf_dir))


# --- events -------------------------------------------------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_GAP = "g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events)"


@query(f"""WITH {_GAP} SELECT CASE WHEN gap IS NULL THEN 'none' WHEN gap <= 300 THEN 'up to 5 min' WHEN gap <= 3600 THEN '5 to 60 min' ELSE 'over 60 min' END AS bucket, count(*) AS events, count(DISTINCT user_id) AS keys FROM g GROUP BY ALL""")
def gap_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.gap_histogram(events(spark, sf_dir), "user_id", "ts", "event_id")


@query("""WITH m AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 10800000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM m)
SELECT user_id, session, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS events, round(sum(value), 2) AS spent FROM s GROUP BY user_id, session""")
def spend_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = usage.sessions(events(spark, sf_dir), "user_id", "ts", "event_id", "value")
    return found.select("user_id", "session", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events", F.round("spent", 2).alias("spent"))


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS period, event_type, count(*) AS n, round(sum(value), 2) AS cost FROM events GROUP BY ROLLUP (strftime(date_trunc('day', ts), '%Y-%m-%d'), event_type)""")
def daily_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.cost_by_period(events(spark, sf_dir), "ts", "value", "day", "event_type").withColumn("cost", F.round("cost", 2))


@query("""SELECT user_id, event_type, epoch_us(ts) AS ts_us, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id", "value")
    return usage.latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", F.unix_micros("ts").alias("ts_us"), "event_id", "value")


@query("""SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def once_for_each_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id")
    return usage.first_of_key(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""WITH c AS (SELECT *, lag(event_type) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), d AS (SELECT * FROM c WHERE last IS NULL OR event_type <> last),
b AS (SELECT *, lag(event_type, 1) OVER w AS b1, lag(event_type, 2) OVER w AS b2 FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, CAST(count_if(b1 IS NOT NULL) AS BIGINT) AS changes, CAST(count_if(b2 = event_type) AS BIGINT) AS reversals FROM b GROUP BY user_id""")
def stage_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.reversals(events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")


_STATE = "(SELECT user_id, ts, event_id, value FROM events WHERE event_type = (SELECT min(event_type) FROM events))"


@query(f"""SELECT e.event_id, (SELECT s.event_id FROM {_STATE} s WHERE s.user_id = e.user_id AND s.ts <= e.ts ORDER BY s.ts DESC, s.event_id DESC LIMIT 1) AS state_id FROM events e WHERE e.event_type <> (SELECT min(event_type) FROM events)""")
def state_as_of_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    first = rows.agg(F.min("event_type").alias("stage"))
    marked = rows.join(F.broadcast(first))
    points = marked.where("event_type != stage").select("user_id", "ts", "event_id")
    states = usage.latest(marked.where("event_type = stage").select("user_id", "ts", F.col("event_id").alias("state_id")), ["user_id", "ts"], ["state_id"])
    return usage.as_of(points, states, "user_id", "ts").select("event_id", "state_id")


@query("""WITH h AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) AS fresh_events, count(DISTINCT user_id) AS users FROM events, h WHERE ts >= now - INTERVAL 14 DAY GROUP BY event_type""")
def fresh_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    recent = usage.fresh(rows.join(F.broadcast(rows.agg(F.max("ts").alias("now")))), "ts", F.col("now"))
    return recent.groupBy("event_type").agg(F.count("*").alias("fresh_events"), F.countDistinct("user_id").alias("users"))


@query("""SELECT event_type, count(*) AS n, CAST(count_if(props IS NOT NULL AND props <> '') AS BIGINT) AS with_props, count(DISTINCT props) AS distinct_props FROM events GROUP BY event_type""")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("props").isNotNull() & (F.col("props") != "")).alias("with_props"), F.countDistinct("props").alias("distinct_props"))


# --- whole-document checks ----------------------------------------------------------------------------------------------


@query()
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full wording check over all documents: errors, warnings, value slots and blind documents."""
    from prosewright.operators import findings, rules

    docs = documents(spark, sf_dir).select("doc_key", "raw")
    parsed = structure.dealt_lines(docs).persist()  # read by every family of rules
    final = findings.finalize(rules.markdown_findings(docs, parsed=parsed).persist(), docs, parsed=parsed)
    return findings.summary(final, structure.slot_counts(docs, parsed)).select("doc_key", "errors", "warnings", "slots", "blind", "failed")


@query(f"WITH {planted.PLANTS_SQL} SELECT *, TRUE AS found, TRUE AS net FROM p")
def planted_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a defect of each family planted: whether the wording check finds each, and tells it from its clean twin."""
    return planted.hits(documents(spark, sf_dir).select("doc_key", "raw"))


@query()
def document_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared or guessed form of every document."""
    from prosewright.operators import findings

    docs = documents(spark, sf_dir).select("doc_key", "raw")
    none = docs.limit(0).select("doc_key", F.lit(1).alias("line_no"), F.lit("").alias("kind"), F.lit("").alias("severity"))
    return findings.guess_form(docs, none)


@query(f"""WITH {LINES}, w AS (SELECT doc_key, line_no, text, lead(text) OVER (PARTITION BY doc_key ORDER BY line_no) AS nxt FROM l)
SELECT doc_key, CAST(count_if(regexp_replace(text, '\\s', '', 'g') <> '' AND regexp_replace(coalesce(nxt, ''), '\\s', '', 'g') <> '' AND NOT regexp_matches(nxt, '^\\s*([-*+>|#]|\\d+[.)]|```|~~~|<|!\\[)')) AS BIGINT) AS wrapped_lines, count(*) AS n_lines FROM w GROUP BY doc_key""")
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.wrapped(structure.lines(documents(spark, sf_dir)))
    return found.groupBy("doc_key").agg(F.count_if("wrapped").alias("wrapped_lines"), F.count("*").alias("n_lines"))


# No text of the given tables has a heading, a list or a table, which the SQL of chunks and windows leaves out.
@query(f"WITH {LINES} SELECT doc_key, min(line_no) AS first, max(line_no) AS last, CAST(length(string_agg(text, chr(10) ORDER BY line_no)) AS INT) AS chars FROM l GROUP BY doc_key, (line_no - 1) // 180")
def review_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 180 lines for a judge, as line ranges."""
    from prosewright.operators import context

    return context.chunks(structure.lines(documents(spark, sf_dir))).select("doc_key", "first", "last", F.length("text").alias("chars"))


_LICENCE = "licen[sc]ed?|rights reserved"


@query(f"""WITH {LINES}, o AS (SELECT DISTINCT doc_key, line_no FROM (SELECT doc_key, unnest(range(line_no - 2, line_no + 3)) AS line_no FROM l WHERE regexp_matches(lower(text), '{_LICENCE}'))),
d AS (SELECT * FROM l WHERE doc_key IN (SELECT doc_key FROM o)), t AS (SELECT doc_key, line_no, unnest(regexp_extract_all(lower(text), '[가-힣]+|[a-z]+|[0-9]+')) AS w FROM d),
g AS (SELECT doc_key, line_no, '#' || w AS gram, 2 AS one FROM t WHERE regexp_matches(w, '^[0-9]') UNION ALL SELECT doc_key, line_no, substr(w, i, 2), 1 FROM (SELECT *, unnest(range(1, length(w))) AS i FROM t WHERE NOT regexp_matches(w, '^[0-9]'))),
f AS (SELECT doc_key, line_no, gram, sum(one) AS tf FROM g GROUP BY ALL), n AS (SELECT doc_key, count(*) AS n FROM d GROUP BY ALL), df AS (SELECT doc_key, gram, count(*) AS df FROM f GROUP BY ALL),
w AS (SELECT f.doc_key, f.line_no, f.gram, f.tf * ln(n / df) AS w, o.line_no IS NOT NULL AS shown FROM f JOIN df USING (doc_key, gram) JOIN n USING (doc_key) LEFT JOIN o ON f.doc_key = o.doc_key AND f.line_no = o.line_no),
q AS (SELECT doc_key, gram, sum(w) AS q FROM w WHERE shown GROUP BY ALL), qn AS (SELECT doc_key, sqrt(sum(q * q)) AS qn FROM q GROUP BY ALL), m AS (SELECT doc_key, line_no, sqrt(sum(w * w)) AS m FROM w WHERE NOT shown GROUP BY ALL),
p AS (SELECT doc_key, line_no, sum(w * q) AS dot FROM w JOIN q USING (doc_key, gram) WHERE NOT shown GROUP BY ALL), r AS (SELECT doc_key, line_no, round(dot / nullif(m * qn, 0), 6) AS s FROM p JOIN m USING (doc_key, line_no) JOIN qn USING (doc_key))
SELECT doc_key, line_no, round(s, 4) AS similarity FROM r WHERE s >= 0.18 QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY s DESC, line_no) <= 6""")
def licence_support_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For passages that speak of a licence (its line and two on either side): the likest other lines of their documents."""
    from prosewright.operators import context

    lines = structure.lines(documents(spark, sf_dir))
    named = lines.where(F.lower("text").rlike(_LICENCE))
    shown = named.select("doc_key", F.explode(F.sequence(F.col("line_no") - 2, F.col("line_no") + 2)).alias("line_no"))
    own = lines.join(named.select("doc_key").distinct(), "doc_key", "left_semi")
    return context.support_lines(own, shown).select("doc_key", "line_no", F.round("similarity", 4).alias("similarity"))


_BLOCKS = rf"""{LINES}, r AS (SELECT doc_key, line_no, line_no - row_number() OVER (PARTITION BY doc_key ORDER BY line_no) AS run FROM l WHERE regexp_matches(text, '\S')),
k AS (SELECT doc_key, min(line_no) AS f, max(line_no) AS e, row_number() OVER (PARTITION BY doc_key ORDER BY min(line_no)) AS place FROM r GROUP BY doc_key, run),
t AS (SELECT doc_key, line_no, greatest(1, line_no - 20) AS a, least(n, line_no + 20) AS z FROM l JOIN (SELECT doc_key, max(line_no) AS n FROM l GROUP BY doc_key) USING (doc_key) WHERE regexp_matches(lower(text), '{_LICENCE}'))"""


@query(f"""WITH {_BLOCKS}, x AS (SELECT t.doc_key, t.line_no, coalesce(min(f) FILTER (f <= a AND e >= a AND a - f <= 10), a) AS first, coalesce(max(e) FILTER (f <= z AND e >= z AND e - z <= 10), z) AS last FROM t JOIN k USING (doc_key) GROUP BY t.doc_key, t.line_no, a, z)
SELECT doc_key, line_no, CAST(first AS INT) AS first, CAST(last AS INT) AS last, last - first + 1 > 180 AS fallback FROM x""")
def licence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosewright.operators import context

    lines = structure.lines(documents(spark, sf_dir))
    return context.windows(lines.where(F.lower("text").rlike(_LICENCE)), lines)


@query(f"""WITH {_BLOCKS}, s AS (SELECT *, e - f + 1 AS n, lag(f) OVER w AS pf, lag(e) OVER w AS pe, lead(f) OVER w AS nf, lead(e) OVER w AS ne FROM k WINDOW w AS (PARTITION BY doc_key ORDER BY place)),
x AS (SELECT t.doc_key, t.line_no, s.*, coalesce(n + pe - pf + 1 <= 120, false) AS p FROM t JOIN s ON t.doc_key = s.doc_key AND t.line_no BETWEEN f AND e),
y AS (SELECT *, coalesce(n + CASE WHEN p THEN pe - pf + 1 ELSE 0 END + ne - nf + 1 <= 120, false) AS q FROM x)
SELECT doc_key, line_no, CASE WHEN n <= 120 THEN array_to_string(list_concat(CASE WHEN p THEN range(pf, pe + 1) ELSE [] END, range(f, e + 1), CASE WHEN q THEN range(nf, ne + 1) ELSE [] END), ',') END AS shown, n > 120 AS fallback FROM y""")
def licence_block_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to show a judge with each line that speaks of a licence: its block and the blocks next to it, within 120 lines."""
    from prosewright.operators import context

    lines = structure.lines(documents(spark, sf_dir))
    shown = context.block_windows(lines.where(F.lower("text").rlike(_LICENCE)), lines)
    return shown.select("doc_key", "line_no", F.array_join("shown", ",").alias("shown"), "fallback")


@query("""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS doc_key, event_type AS key, epoch_us(ts) / 1e6 AS t, event_id AS seq, value FROM events)
SELECT doc_key, key, max(t) AS last_when, max(seq) AS last_seq, arg_max(CAST(value AS VARCHAR), seq) AS body, key = 'error' AS closed FROM s GROUP BY doc_key, key""")
def event_state_by_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each user's kinds of events, met from two batches that each hold some days of every week; errors were closed by a person."""
    from prosewright.operators import judgements

    rows = events(spark, sf_dir)
    items = F.array(F.struct(F.col("event_type").alias("line_key"), F.lit(0).alias("line"), F.lit("").alias("phrase"), F.col("value").cast("string").alias("text")))
    empty = F.array().cast("array<string>")
    book = rows.select(F.col("event_id").alias("seq"), (F.unix_micros("ts") / 1e6).alias("when"), F.col("user_id").cast("string").alias("doc_key"), F.lit(True).alias("ok"), empty.alias("seen"), empty.alias("seen_form"), items.alias("asks"), F.lit(None).cast(judgements.ITEMS).alias("fixes"), F.dayofweek("ts").alias("day"))
    closed = rows.where("event_type = 'error'").select(F.col("user_id").cast("string").alias("doc_key"), F.lit("ask").alias("kind"), F.col("event_type").alias("line_key"), F.lit("").alias("phrase")).distinct()
    early, late = judgements.changes(book.where("day <= 3"), closed), judgements.changes(book.where("day > 3"))
    return judgements.merged(late.unionByName(early)).select("doc_key", "key", "last_when", "last_seq", F.col("body.text").alias("body"), "closed")


@query("""WITH t AS (SELECT conv_id, turn, role, CAST(length(text) AS INT) AS chars FROM conversations) SELECT conv_id, turn, role, chars FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY chars DESC NULLS LAST, turn) <= 3""")
def longest_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the three longest turns of each conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("chars"))
    return corpus.quota_sample(turns, "conv_id", [F.col("chars").desc_nulls_last(), F.col("turn")], 3)


@query(f"""WITH {LINES}, s AS (SELECT doc_key, sha256(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS h FROM l WHERE regexp_replace(text, '\\s', '', 'g') <> ''), o AS (SELECT h, count(*) AS uses, count(DISTINCT doc_key) AS docs FROM s GROUP BY h) SELECT h AS line_hash, uses, docs FROM o WHERE docs > 1""")
def shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that several documents have."""
    from prosewright.functions.text import squeeze, strip

    lines = structure.lines(documents(spark, sf_dir)).where(strip("text") != "")
    return lines.groupBy(F.sha2(squeeze("text").cast("binary"), 256).alias("line_hash")).agg(F.count("*").alias("uses"), F.countDistinct("doc_key").alias("docs")).where("docs > 1")


@query("""WITH s AS (SELECT d.source, l.quality, l.toxic = 0 AS hit FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT source, CAST(count_if(quality = 1 AND hit) AS BIGINT) AS tp, CAST(count_if(quality = 0 AND hit) AS BIGINT) AS fp, CAST(count_if(quality = 1 AND NOT hit) AS BIGINT) AS fn, CAST(count_if(quality = 0 AND NOT hit) AS BIGINT) AS tn, CAST(count_if(quality IS NULL AND hit) AS BIGINT) AS unlabelled_hits FROM s GROUP BY source)
SELECT *, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision FROM c""")
def clean_as_quality_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = documents(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "doc_key"), "doc_key")
    return evaluation.confusion(scored, "quality", F.col("toxic") == 0, by=["source"])


@query()
def quality_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of good documents with its bootstrap interval over sources."""
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL").withColumnRenamed("doc_id", "doc_key")
    per = documents(spark, sf_dir).join(labels, "doc_key").groupBy("source").agg(F.sum("quality").alias("good"), F.count("*").alias("all"))
    found = evaluation.cluster_bootstrap(per, "good", "all", key="source").withColumnRenamed("point", "share")
    return found.withColumn("against_half", evaluation.interval_verdict(F.col("low") - 0.5, F.col("high") - 0.5))


@query("""WITH d AS (SELECT sum(CASE WHEN event_type IS NOT NULL THEN 1 ELSE 0 END) AS n FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS round FROM events)
SELECT event_type, CAST(max(round) AS BIGINT) AS most_rounds, CAST(count_if(round > 3) AS BIGINT) AS asks FROM r GROUP BY event_type""")
def judgement_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    counted = usage.round_numbers(rows, "key", ["ts", "event_id"])
    return counted.groupBy("event_type").agg(F.max("round").cast("long").alias("most_rounds"), F.count_if("ask").alias("asks"))


@query("""WITH s AS (SELECT user_id, event_type, value, ts, event_id FROM events) SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_stage, count(DISTINCT event_type) AS stages FROM s GROUP BY user_id""")
def stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_stage"), F.countDistinct("event_type").alias("stages"))


# The given turns hold no digits, so no number is new; the SQL says names and words.
_BARE = "lower(regexp_replace({}, '[\\s*_`]', '', 'g'))"


@query(f"""WITH {_PAIRS}, t AS (SELECT DISTINCT pair_id, original, 'name' AS kind, unnest(regexp_extract_all(revised, '[「『“"]([^」』”"]+)[」』”"]', 1)) AS token FROM q UNION SELECT DISTINCT pair_id, original, 'word', unnest(regexp_extract_all(revised, '([A-Za-z][A-Za-z0-9+.-]{{1,}})', 1)) FROM q)
SELECT pair_id, kind, token FROM t WHERE {_BARE.format("token")} <> '' AND NOT contains({_BARE.format("original")}, {_BARE.format("token")})""")
def turn_new_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revision.new_information(turn_pairs(spark, sf_dir))


@query("""SELECT label, count(*) AS n FROM embeddings GROUP BY label""")
def embedding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS c FROM e GROUP BY label, i),
n AS (SELECT label, sqrt(sum(c * c)) AS cn FROM m GROUP BY label), v AS (SELECT vec_id, sqrt(sum(x * x)) AS vn FROM e GROUP BY vec_id), d AS (SELECT e.vec_id, e.label, sum(x * c) AS dot FROM e JOIN m ON e.label = m.label AND e.i = m.i GROUP BY ALL)
SELECT vec_id, label, round(dot / (vn * cn), 4) AS similarity FROM d JOIN n USING (label) JOIN v USING (vec_id)""")
def similarity_to_label_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector with the mean vector of its label: one aggregation and an equi join."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    centre = vectors.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("c")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda p: p["c"]).alias("centre"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = vectors.join(centre, "label")
    return both.select("vec_id", "label", F.round(dot("v", "centre") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("centre", "centre"))), 4).alias("similarity"))


@query("""WITH s AS (SELECT doc_id AS doc_key, unnest(regexp_split_to_array(coalesce(text, ''), '[.!?]+')) AS s FROM documents), n AS (SELECT doc_key, len(regexp_extract_all(s, '[^ \\t\\n\\r\\f\\v]+')) AS n, len(regexp_extract_all(s, ',')) AS commas FROM s),
b AS (SELECT doc_key, count(*) AS sentences, avg(n) AS mean, stddev_pop(n) AS sd, sum(commas) AS commas FROM n WHERE n > 0 GROUP BY doc_key),
t AS (SELECT doc_id AS doc_key, unnest(regexp_extract_all(lower(text), '\\pL+')) AS w FROM documents), k AS (SELECT doc_key, count(DISTINCT w) AS kinds, count(*) AS tokens FROM t WHERE length(w) >= 2 GROUP BY doc_key)
SELECT doc_key, sentences, round(mean, 4) AS mean_words, round(sd / mean, 4) AS cv_words, round(CAST(commas AS DOUBLE) / sentences, 4) AS commas_a_sentence, round(CAST(kinds AS DOUBLE) / tokens, 4) AS diversity FROM b JOIN k USING (doc_key)""")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.text_features(documents(spark, sf_dir))


_PROBES = [("shout", "[A-Z]{4,}", "[A-Z]{2,}"), ("marks", "[!?]{2,}", "[!?]"), ("figures", "[0-9]{4,}", "[0-9]+"), ("licence", "licen[sc]ed under", "licen[sc]e")]


@query(
    f"WITH {LINES}, g AS (SELECT l.*, lang FROM l JOIN documents d ON d.doc_id = l.doc_key), p AS ("
    + " UNION ALL ".join(f"SELECT lang, '{n}' AS name, len(regexp_extract_all(text, '{a}')) AS narrow, len(regexp_extract_all(text, '{b}')) AS wide FROM g" for n, a, b in _PROBES)
    + ") SELECT lang, name, CAST(sum(narrow) AS BIGINT) AS narrow, CAST(sum(wide) AS BIGINT) AS wide, CAST(count_if(wide > 0) AS BIGINT) AS lines FROM p GROUP BY lang, name"
)
def pattern_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rules, narrow and wide, by language."""
    docs = documents(spark, sf_dir)
    rows = docs.select("lang", F.explode(F.split("raw", "\n")).alias("text"))
    return evaluation.probe_patterns(rows, _PROBES, "lang")


# --- finding algebra, gates and ledgers over neutral rules and events -----------------------------------------------------

_FOUND = f"{LINES}, f AS (SELECT * FROM ({_NEUTRAL_SQL}) WHERE n > 0)"
_RULE_HITS = " UNION ALL ".join(f"SELECT doc_key, line_no, '{k}' AS kind, '{s}' AS severity, unnest(regexp_extract_all(text, '{p}')) AS match FROM l" for k, s, p in NEUTRAL_RULES)


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule engine of the wording rules over all lines, with rules that hold in any language."""
    from prosewright.operators import rules

    own = [rules.Rule(k, s, p) for k, s, p in NEUTRAL_RULES]
    return rules.apply_rules(structure.lines(documents(spark, sf_dir)), own)


@query(f"WITH {LINES} {_RULE_HITS}")
def wording_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_hits(spark, sf_dir).select("doc_key", "line_no", "kind", "severity", "match")


@query(f"WITH {LINES}, h AS ({_RULE_HITS}) SELECT doc_key, line_no, kind, severity, min(match) AS match FROM h GROUP BY ALL")
def first_hits_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding for each line and kind."""
    from prosewright.operators import findings

    return findings.first_of_kind(rule_hits(spark, sf_dir)).select("doc_key", "line_no", "kind", "severity", "match")


@query(f"WITH {LINES}, h AS ({_RULE_HITS}) SELECT doc_key, kind, severity, match, count(*) AS n, min(line_no) AS first_line FROM h GROUP BY ALL")
def condensed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosewright.operators import findings

    return findings.condense(rule_hits(spark, sf_dir))


@query(f"""WITH {LINES}, h AS ({_RULE_HITS}) SELECT kind, CASE WHEN kind = 'doubled_stop' THEN 'err' WHEN kind = 'invisible' THEN 'warn' ELSE severity END AS severity, count(*) AS n
FROM h WHERE kind <> 'doubled_word_mark' GROUP BY ALL""")
def selected_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection of rules: one off, one promoted, one demoted."""
    from prosewright.operators import findings

    chosen = findings.Selection.parse('[rules]\ndoubled_word_mark = "off"\ninvisible = "warn"\ndoubled_stop = "err"', [k for k, _, _ in NEUTRAL_RULES])
    return chosen.apply(rule_hits(spark, sf_dir)).groupBy("kind", "severity").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, h AS ({_RULE_HITS}), n AS (SELECT doc_key, CAST(count_if(severity = 'err') AS BIGINT) AS errors, CAST(count_if(severity = 'warn') AS BIGINT) AS warnings FROM h GROUP BY doc_key),
w AS (SELECT doc_key, string_agg(kind, ',' ORDER BY line_no, kind, match) AS first_warnings FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY line_no, kind, match) AS i FROM h WHERE severity = 'warn') WHERE i <= 8 GROUP BY doc_key)
SELECT d.doc_id AS doc_key, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(first_warnings, '') AS first_warnings, coalesce(errors, 0) > 0 AS failed
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_key LEFT JOIN w ON d.doc_id = w.doc_key""")
def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-document summary, over the neutral rules."""
    from prosewright.operators import findings

    slots = documents(spark, sf_dir).select("doc_key", F.lit(1).alias("slots"), F.lit(False).alias("blind"))
    found = findings.summary(rule_hits(spark, sf_dir), slots)
    return found.select("doc_key", "errors", "warnings", F.coalesce(F.array_join("first_warnings", ","), F.lit("")).alias("first_warnings"), "failed")


@query(f"""WITH {LINES}, h AS ({_RULE_HITS}), p AS (SELECT doc_id AS doc_key, 'quality' AS stage FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxicity' FROM labels WHERE toxic = 0)
SELECT DISTINCT doc_key, 'errors' AS reason FROM h WHERE severity = 'err' UNION ALL
SELECT DISTINCT d.doc_id, 'no pass: ' || s FROM documents d, (VALUES ('quality'), ('toxicity')) AS v(s) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_key = d.doc_id AND p.stage = s)""")
def publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why documents may not be published: errors, or no pass at a stage."""
    from prosewright.operators import findings

    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "doc_key")
    passes = labels.where("quality = 1").select("doc_key", F.lit("quality").alias("stage"), F.lit("pass").alias("verdict")).union(labels.where("toxic = 0").select("doc_key", F.lit("toxicity"), F.lit("pass")))
    nothing = structure.lines(documents(spark, sf_dir)).where("false").select("doc_key", "line_no")
    return findings.gate_status(rule_hits(spark, sf_dir), passes, nothing, documents(spark, sf_dir), ["quality", "toxicity"])


@query(f"""WITH {_TERMS}, k AS (SELECT unnest(['the', 'and', 'der', 'de']) AS lexeme), r AS (SELECT doc_key, CAST(count(*) AS BIGINT) AS blocked FROM c JOIN b USING (lexeme) WHERE base <= 60 AND lexeme NOT IN (SELECT lexeme FROM k) GROUP BY doc_key)
SELECT DISTINCT c.doc_key, coalesce(blocked, 0) AS blocked, coalesce(blocked, 0) = 0 AS passes FROM c LEFT JOIN r USING (doc_key)""")
def vocabulary_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    approved = spark.range(1).select(F.explode(F.lit(["the", "and", "der", "de"])).alias("lexeme"))
    worded = documents(spark, sf_dir).where(lexical.has_words("raw"))
    return lexical.gate(term_counts(spark, sf_dir), term_uses(spark, sf_dir), approved, keys=worded).select("doc_key", "blocked", "passes")


@query("""WITH t AS (SELECT doc_id AS doc_key, regexp_extract_all(lower(text), '\\pL+') AS w FROM documents), e AS (SELECT doc_key, generate_subscripts(w, 1) AS pos, length(unnest(w)) >= 6 AS bare FROM t),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_key ORDER BY pos) AS run FROM e WHERE bare), n AS (SELECT doc_key, run, count(*) AS length FROM r GROUP BY ALL)
SELECT threshold, count(*) AS runs, max(length) AS longest FROM n, (VALUES (2), (3), (5)) AS v(threshold) WHERE length >= threshold GROUP BY threshold""")
def long_word_pileups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of long words, by least length of a run."""
    words = F.regexp_extract_all(F.lower("raw"), F.lit(r"\p{L}+"), F.lit(0))
    return lexical.row_pileups(documents(spark, sf_dir), F.transform(words, lambda w: F.length(w) >= 6), [2, 3, 5])


TURN_RULES = [*NEUTRAL_RULES, ("long_word", "warn", r"[^ \n,.!?]{18,}"), ("one_word_sentence", "warn", r"(?:^|[.] )[^ \n,.]+[.]")]
_COUNTS = ", ".join(f"len(regexp_extract_all(original, '{p}')) AS a{i}, len(regexp_extract_all(revised, '{p}')) AS b{i}" for i, (_, _, p) in enumerate(TURN_RULES))
_NEW = " UNION ALL ".join(f"SELECT pair_id, '{k}' AS kind, CAST(b{i} - a{i} AS BIGINT) AS new FROM x WHERE b{i} > a{i}" for i, (k, _, _) in enumerate(TURN_RULES))


@query(f"WITH {_PAIRS}, x AS (SELECT pair_id, {_COUNTS} FROM q) {_NEW}")
def turn_fix_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a later turn beyond those of the earlier one."""
    from prosewright.operators import rules

    own = [rules.Rule(k, s, p) for k, s, p in TURN_RULES]
    pairs = turn_pairs(spark, sf_dir)
    hits = lambda c: rules.apply_rules(pairs.select(F.col("pair_id").alias("doc_key"), F.lit(1).alias("line_no"), F.col(c).alias("text")), own).withColumnRenamed("doc_key", "pair_id")
    return revision.fix_cascade(hits("original"), hits("revised"))


@query(f"""WITH {LINES}, s AS (SELECT *, line_no - coalesce(lag(line_no) OVER (PARTITION BY doc_key ORDER BY line_no), 0) - 1 AS gap FROM l WHERE regexp_matches(lower(text), 'licen[sc]ed?|rights reserved'))
SELECT doc_key, sha256(string_agg(CASE WHEN gap > 0 THEN '… ' || gap || ' lines omitted' || chr(10) ELSE '' END || line_no || ': ' || text, chr(10) ORDER BY line_no)) AS text_sha FROM s GROUP BY doc_key""")
def licence_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines that speak of a licence, gaps told."""
    from prosewright.operators import context

    lines = structure.lines(documents(spark, sf_dir))
    shown = lines.where(F.lower("text").rlike("licen[sc]ed?|rights reserved"))
    return context.excerpts(lines, shown).select("doc_key", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha"))


@query("""WITH m AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, value, event_id FROM events), g AS (SELECT *, CASE WHEN lag(s) OVER w - s > 10800 THEN 1 ELSE 0 END AS apart FROM m WINDOW w AS (PARTITION BY user_id ORDER BY s DESC)),
b AS (SELECT *, sum(apart) OVER (PARTITION BY user_id ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS back FROM g) SELECT user_id, round(sum(value), 2) AS spent FROM b WHERE back = 0 GROUP BY user_id HAVING sum(value) >= 50""")
def open_sessions_over_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosewright.operators import ledger

    rows = events(spark, sf_dir).select(F.col("user_id").alias("doc_key"), (F.unix_micros("ts") / 1e6).alias("when"), F.col("value").alias("cost_usd"))
    return ledger.over_budget(rows, 50.0).select(F.col("doc_key").alias("user_id"), F.round("spent", 2).alias("spent"))


@query("""WITH h AS (SELECT max(epoch_us(ts)) / 1e6 AS now FROM events), f AS (SELECT user_id, event_type, event_id, CASE WHEN value > 10 THEN 'pass' ELSE 'fail' END AS verdict FROM events, h WHERE epoch_us(ts) / 1e6 >= now - 1209600)
SELECT user_id, event_type AS stage, arg_max(verdict, event_id) AS verdict FROM f GROUP BY ALL""")
def latest_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fresh verdict of each key at each stage, in append order."""
    from prosewright.operators import ledger

    rows = events(spark, sf_dir).select(F.col("user_id").alias("path"), F.lit("").alias("hash"), F.col("event_type").alias("stage"), F.when(F.col("value") > 10, "pass").otherwise("fail").alias("verdict"), F.lit("r").alias("rules"), (F.unix_micros("ts") / 1e6).alias("when"), F.col("event_id").alias("seq"))
    rows = rows.join(F.broadcast(rows.agg(F.max("when").alias("now"))))
    return ledger.pass_status(rows, F.col("now"), "r").select(F.col("path").alias("user_id"), "stage", "verdict")


@query("""WITH c AS (SELECT *, lag(event_type) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), d AS (SELECT * FROM c WHERE last IS NULL OR event_type <> last),
b AS (SELECT *, lag(event_type, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS b2 FROM d) SELECT user_id, count(*) AS versions, CAST(count_if(b2 = event_type) AS BIGINT) AS reverts FROM b GROUP BY user_id""")
def stage_flip_flops(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosewright.operators import ledger

    rows = events(spark, sf_dir).select(F.col("user_id").alias("doc_key"), F.lit("r").alias("root"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"))
    return ledger.flip_flops(rows).select(F.col("doc_key").alias("user_id"), "versions", "reverts")


@query("""WITH c AS (SELECT *, lag(event_type) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), d AS (SELECT user_id, event_id, last, event_type AS fix FROM c WHERE event_type <> last),
e AS (SELECT *, list(fix) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM d),
f AS (SELECT user_id, length(last) >= 4 AND len(list_filter(coalesce(earlier, []), lambda p: length(p) >= 4 AND contains(last, p) AND length(last) <= length(p) + 8)) > 0 AS again FROM e)
SELECT user_id, count(*) AS fixes, CAST(count_if(again) AS BIGINT) AS contradicting FROM f GROUP BY user_id""")
def stage_self_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a user's kind of event that leave a kind an earlier change had come to."""
    from pyspark.sql import Window

    from prosewright.operators import ledger

    last = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    changed = events(spark, sf_dir).withColumn("phrase", last).where("event_type != phrase")
    fixes = changed.select(F.col("user_id").alias("doc_key"), F.lit("r").alias("root"), F.col("event_id").alias("seq"), F.col("phrase").alias("text"), "phrase", F.col("event_type").alias("fix"))
    return ledger.self_contradictions(fixes).select(F.col("doc_key").alias("user_id"), "fixes", "contradicting")


@query("""WITH m AS (SELECT to_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) / 2e6) AS half, (epoch_us(min(ts)) + epoch_us(max(ts))) / 2 AS us FROM events)
SELECT CASE WHEN epoch_us(ts) < us THEN 'before' ELSE 'after' END AS period, count(*) AS n, count(DISTINCT user_id) AS sessions, CAST(count_if(value > 10) AS BIGINT) AS used, round(avg(CASE WHEN value > 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM events, m GROUP BY ALL""")
def uptake_by_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before and after the middle of the time span."""
    rows = events(spark, sf_dir).withColumn("us", F.unix_micros("ts"))
    half = rows.agg(((F.min("us") + F.max("us")) / 2).alias("half"))
    return corpus.uptake(rows.join(F.broadcast(half)), "us", F.col("half"), "user_id", F.col("value") > 10)


@query("""SELECT arg_min(event_id, (-value, event_id)) AS event_id, user_id, event_type, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type""")
def dearest_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert by priority: of each key the row that costs most."""
    rows = events(spark, sf_dir).where("value IS NOT NULL").select(F.concat_ws("|", "user_id", "event_type").alias("key"), (-F.col("value")).alias("priority"), "event_id", "user_id", "event_type", "value")
    return corpus.upsert(rows, "key", "priority").select("event_id", "user_id", "event_type", "value")


@query()
def page_text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text units of all pages, by the HTML parser of the eight-format extractor."""
    from prosewright.sources import formats

    raw = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("format"), F.coalesce("html", F.lit("")).alias("raw"))
    return formats.text_units(raw).select("path", "unit_id", "kind", "line_number", "text")


@query()
def document_text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text units of all documents read as Markdown."""
    from prosewright.sources import formats

    return formats.text_units(documents(spark, sf_dir).select(F.col("doc_key").cast("string").alias("path"), F.lit("md").alias("format"), "raw")).select("path", "unit_id", "line_number", "text")


@query("""WITH q AS (SELECT doc_id // 20 AS sheet_id, CAST(doc_id % 20 + 1 AS INT) AS number, doc_id FROM documents),
r AS (SELECT doc_id // 20 AS sheet_id, CAST(doc_id % 20 + 1 AS INT) AS number, doc_id, CASE WHEN toxic = 1 THEN '보류' WHEN quality = 1 THEN '그대로 — ' || doc_id WHEN quality IS NOT NULL THEN '글 ' || doc_id || ' 완료.' END AS answer FROM labels),
a AS (SELECT sheet_id, number, answer FROM r WHERE answer IS NOT NULL UNION ALL SELECT sheet_id, number, '고침 (의견대로)' FROM q WHERE sheet_id % 2 = 1 AND doc_id NOT IN (SELECT doc_id FROM r WHERE answer IS NOT NULL))
SELECT *, CASE WHEN answer = '보류' THEN 'hold' WHEN answer LIKE '그대로%' THEN 'keep' WHEN answer LIKE '고침%' THEN 'edit' ELSE 'free' END AS kind, answer LIKE '%(의견대로)' AS by_opinion FROM a""")
def label_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels told as replies to sheets of twenty documents, some leaving the rest to the opinions, and read back as answers."""
    from prosewright.operators import answers

    sheet, number = F.expr("doc_id div 20").alias("sheet_id"), (F.col("doc_id") % 20 + 1).cast("int").alias("number")
    n = number.cast("string")
    said = F.when(F.col("toxic") == 1, F.concat(F.lit("보류 "), n, F.lit("번."))).when(F.col("quality").isNull(), F.concat(F.lit("아직 안 고름 "), n))
    said = said.when(F.col("quality") == 1, F.concat(F.lit("Q"), n, F.lit(" 그대로 — "), "doc_id")).otherwise(F.concat(n, F.lit(". 글 "), "doc_id", F.lit(" 완료.")))
    asked = table(spark, sf_dir, "documents").select(sheet, number, F.lit("고침").alias("opinion"))
    left = asked.where("sheet_id % 2 = 1").select("sheet_id", F.lit(-1).cast("long").alias("seq"), F.lit("전부 의견대로.").alias("text")).distinct()
    replies = table(spark, sf_dir, "labels").select(sheet, F.col("doc_id").alias("seq"), said.alias("text")).union(left)
    return answers.answers(answers.read_replies(replies, asked))


# --- documents as Markdown ----------------------------------------------------------------------------------------------
# The given texts hold no Markdown, so their lines are laid out as it: of each eight lines a heading (levels 1, 2, 3 in turn),
# two list items, a quotation, a fenced line between its marks and a plain line; every second document has front matter.


def outlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    def line(text, at):
        i = at + 1
        numbered = F.concat(i.cast("string"), F.lit(" "), text)
        part = F.concat(F.repeat(F.lit("#"), 1 + F.floor(i / 8).cast("int") % 3), F.lit(" Part "), i.cast("string"))
        turn = i % 8
        return F.when(turn == 1, part).when(turn.isin(2, 3), F.concat(F.lit("- "), numbered)).when(turn == 4, F.concat(F.lit("> "), numbered)).when(turn.isin(5, 7), "```").otherwise(text)

    matter = F.when(F.col("doc_key") % 2 == 0, F.lit("---\nform: structured\ntitle: outline\n---\n")).otherwise("")
    return documents(spark, sf_dir).select("doc_key", F.concat(matter, F.array_join(F.transform(F.split("raw", "\n"), line), "\n")).alias("raw"))


_OUTLINE = f"""{LINES}, o AS (SELECT doc_key, line_no AS i, line_no % 8 AS turn, line_no // 8 AS part, CAST(line_no + CASE WHEN doc_key % 2 = 0 THEN 4 ELSE 0 END AS INT) AS line_no, text FROM l),
b AS (SELECT * FROM o WHERE turn NOT IN (5, 6, 7))"""


@query(f"""WITH {_OUTLINE}, h AS (SELECT doc_key, i, part, line_no FROM b WHERE turn = 1), e AS (SELECT h.doc_key, h.i, h.part, h.line_no, max(b.line_no) AS last_line FROM h JOIN b ON h.doc_key = b.doc_key AND b.i BETWEEN h.i AND h.i + 7 GROUP BY ALL)
SELECT doc_key, line_no AS first_line, last_line, array_to_string(list_transform(range(part - part % 3, part + 1), lambda p: 'Part ' || (8 * p + 1)), ' > ') AS path FROM e""")
def outline_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of outlined documents with the chain of headings they stand under."""
    return structure.sections(structure.body_lines(outlined(spark, sf_dir))).select("doc_key", "first_line", "last_line", F.array_join("path", " > ").alias("path"))


@query(f"WITH {_OUTLINE} SELECT doc_key, line_no, '- ' || i || ' ' || text AS text, CAST(line_no - turn + 2 AS INT) AS block FROM b WHERE turn IN (2, 3)")
def outline_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items of outlined documents and the line their list begins at."""
    return structure.list_blocks(structure.body_lines(outlined(spark, sf_dir))).select("doc_key", "line_no", "text", "block")


@query(f"WITH {_OUTLINE} SELECT doc_key, line_no, '> ' || i || ' ' || text AS text, line_no AS block FROM b WHERE turn = 4 AND line_no > 6")
def outline_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block quotes of outlined documents behind their head."""
    return structure.quote_blocks(structure.body_lines(outlined(spark, sf_dir))).select("doc_key", "line_no", "text", "block")


@query(f"WITH {_OUTLINE} SELECT doc_key, line_no, turn IN (5, 6, 7) AS fenced FROM o")
def outline_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of outlined documents behind the front matter, and which of them stand in a code fence."""
    return structure.parsed_lines(outlined(spark, sf_dir)).select("doc_key", "line_no", "fenced")


@query(f"""WITH {_OUTLINE}, s AS (SELECT doc_key, avg(CASE WHEN turn = 0 AND NOT regexp_matches(trim(text), '^(?:[-*+>|#<]|[0-9]+[.)]\\s)') THEN 1.0::DOUBLE ELSE 0 END) AS share FROM b WHERE turn <> 0 OR regexp_replace(text, '\\s', '', 'g') <> '' GROUP BY doc_key)
SELECT doc_key, CASE WHEN doc_key % 2 = 0 THEN 'structured' END AS declared, CASE WHEN doc_key % 2 <> 0 AND share >= 0.3 THEN 'prose' ELSE 'structured' END AS form FROM s""")
def outline_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form of outlined documents: declared in the front matter, or told by the share of running text."""
    from prosewright.operators import findings

    docs = outlined(spark, sf_dir)
    none = docs.limit(0).select("doc_key", F.lit(1).alias("line_no"), F.lit("").alias("kind"), F.lit("").alias("severity"))
    return findings.guess_form(docs, none)


# --- evaluation over the tables' own rows ---------------------------------------------------------------------------------


@query("""SELECT event_type AS tool, count(*) AS documents, CAST(count_if(value > 1) AS BIGINT) AS scanned, CAST(count(*) - count_if(value > 1) AS BIGINT) AS unsupported, CAST(count_if(value > 1 AND event_id % 4 > 0) AS BIGINT) AS with_errors,
CAST(count_if(value > 1 AND event_id % 3 > 0) AS BIGINT) AS with_warnings, CAST(coalesce(sum(CASE WHEN value > 1 THEN event_id % 4 END), 0) AS BIGINT) AS errors, CAST(coalesce(sum(CASE WHEN value > 1 THEN event_id % 3 END), 0) AS BIGINT) AS warnings,
CAST(coalesce(sum(CASE WHEN value > 1 THEN event_id % 2 END), 0) AS BIGINT) AS blind FROM events GROUP BY event_type""")
def event_tool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of tools over their users' documents; those of a value up to 1 were not supported."""
    n = F.col("event_id")
    runs = events(spark, sf_dir).select(F.col("event_type").alias("tool"), F.col("user_id").alias("doc_key"), F.when(F.col("value") > 1, "scanned").otherwise("unsupported").alias("status"), (n % 4).alias("errors"), (n % 3).alias("warnings"), (n % 2).alias("blind"))
    return evaluation.tool_summary(runs)


@query("""WITH k AS (SELECT DISTINCT 'u' || user_id || CASE WHEN user_id % 3 > 0 THEN '::repo' ELSE '' END AS own, 'u' || user_id AS path FROM events), r AS (SELECT event_id, 'u' || user_id || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '::repo' ELSE '::other' END AS row_key FROM events)
SELECT event_id, own AS doc_key FROM r JOIN k ON row_key = own OR (row_key = path AND own <> path)""")
def event_rows_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows of documents whose keys name a repository, written under these keys, under old ones of the path alone, or under another repository's."""
    from prosewright.operators import ledger

    rows = events(spark, sf_dir)
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    turn = F.col("event_id") % 3
    book = rows.select("event_id", F.concat(path, F.when(turn == 0, "").when(turn == 1, "::repo").otherwise("::other")).alias("doc_key"))
    docs = rows.select(F.concat(path, F.when(F.col("user_id") % 3 > 0, "::repo").otherwise("")).alias("doc_key"))
    return ledger.rows_of(book, docs).select("event_id", "doc_key")


@query(f"""WITH {_PAIRS}, s AS (SELECT pair_id, substr(original, 1, 30) AS a, revised AS b FROM q)
SELECT pair_id, length(a) > 0 AND length(b) > 0 AND len(list_filter(range(1, greatest(1, length(a) - least(6, length(a)) + 1) + 1), lambda i: contains(b, substr(a, i, least(6, length(a)))))) > 0 AS covered FROM s""")
def turn_covered_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn covers the phrase that the turn before of the same role starts with."""
    pairs = turn_pairs(spark, sf_dir).withColumn("phrase", F.substring("original", 1, 30))
    return pairs.select("pair_id", evaluation.covers("phrase", "revised").alias("covered"))


@query("""WITH f AS (SELECT doc_id, CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 'agreed' WHEN quality = 0 THEN 'rejected' ELSE 'open' END ELSE 'agreed' END AS verdict, doc_id % 3 AS src FROM labels),
t AS (SELECT count_if(verdict = 'agreed') AS agreed, count_if(verdict = 'rejected') AS rejected, count_if(verdict = 'open') AS held, (SELECT count(*) FROM labels WHERE quality = 0) AS unseen FROM f),
c AS (SELECT layer, (SELECT count(*) FROM f WHERE verdict = 'agreed' AND (src = y OR (y = 3 AND src < 2))) AS caught FROM (VALUES ('rules', 0), ('judge', 1), ('any', 3)) AS v(layer, y))
SELECT layer, caught, CAST(agreed + unseen AS BIGINT) AS problems, round(caught / (agreed + unseen), 3) AS recall, CAST(rejected AS BIGINT) AS rejected, CAST(held AS BIGINT) AS held FROM c, t""")
def label_sheet_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as review sheets: findings of two layers and of an unnamed one, a reader's notes on toxic ones with verdicts by quality, and what nobody found."""
    rows = table(spark, sf_dir, "labels").withColumn("line_number", F.lit(1)).withColumn("phrase", F.lit("p")).withColumnRenamed("doc_id", "document_id")
    source = F.when(F.col("document_id") % 3 == 0, "regex").when(F.col("document_id") % 3 == 1, "model").otherwise("reader")
    at = ["document_id", "line_number", "phrase"]
    found = rows.select(*at, F.array(source).alias("sources"), F.when(F.col("toxic") == 1, "noted").otherwise("").alias("note"), F.lit(False).alias("allowed"))
    verdict = F.when(F.col("quality") == 1, "agreed").when(F.col("quality") == 0, "rejected")
    said = rows.where("toxic = 1 AND quality IS NOT NULL").select(*at, F.lit("finding").alias("slot"), verdict.alias("verdict"))
    missed = rows.where("quality = 0").select("document_id", "line_number", F.lit("overlooked").alias("note"))
    return evaluation.sheet_recall(found, missed, said, {"regex": "rules", "model": "judge"})


@query("""SELECT event_type AS system, count(*) AS n, round(avg(CASE WHEN value > 10 THEN 1.0::DOUBLE WHEN value > 5 THEN 0.5 ELSE 0 END), 6) AS win_rate FROM events GROUP BY event_type""")
def event_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as comparisons of systems: a value over 10 wins, one over 5 ties."""
    verdict = F.when(F.col("value") > 10, "win").when(F.col("value") > 5, "tie").otherwise("loss")
    return evaluation.win_rate(events(spark, sf_dir).select(F.col("event_type").alias("system"), F.col("user_id").alias("doc_key"), verdict.alias("verdict")))

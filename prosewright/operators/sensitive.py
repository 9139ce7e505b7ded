"""Sensitive content: account paths, e-mail, keys, internal hosts, chat ids, issue keys, deny-listed terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewright.operators import patterns

# Labels and patterns (Java syntax).
PLACEHOLDER = r"(?:name|user|username|you|me|runner|your[_-]?name|your[_-]?user|<[^/\\>]+>|%[^%]+%|\$\w+)"
BLOCKING = [
    ("account_path", rf"(?:[A-Za-z]:[/\\]Users[/\\]|/home/|/Users/)(?!{PLACEHOLDER}\b)[A-Za-z0-9][A-Za-z0-9._-]{{1,}}"),
    ("email", r"(?![a-z]@[a-z]\.[a-z]{2,3}\b)[\w.+-]+@(?![\d.]+\b)(?!example\.(?:com|org|net)\b|invalid\b|localhost\b)[\w-]+\.[\w.]{2,}"),
    ("key", r"(?:sk-[A-Za-z0-9_-]{12,}|ghp_[A-Za-z0-9]{20,}|xox[baprs]-(?!(?:your|example|test|dummy|xxx)\b)[A-Za-z0-9-]{8,}|AKIA[0-9A-Z]{12,})"),
    ("internal_host", r"(?i)https?://[a-z0-9.-]*\.(?:local|internal|corp|lan)\b"),
    ("chat_id", r"\b[CDGUT]0(?=[A-Z0-9]{8,}\b)[0-9]*[A-Z][A-Z0-9]*\b"),
]
ADVICE = {
    "account_path": "use a home-directory variable", "email": "remove it or name the role", "key": "revoke it and clean the history",
    "internal_host": "not reachable from outside", "chat_id": "names people and rooms", "issue_key": "internal issue number", "term": "on the deny list", "author_path": "a path of the author's machine", "company": "name the role instead", "advisory_term": "on the deny list for data files",
}
def advisory_patterns(folders: list[str], companies: list[str]) -> list[tuple[str, str]]:
    """Patterns that advise only: folders at a drive's root of the author's machine, and names of companies."""
    out = [("author_path", rf"[A-Za-z]:[/\\](?:{'|'.join(folders)})")] if folders else []
    return out + ([("company", rf"(?i)(?:{'|'.join(companies)})")] if companies else [])


DATA_FILE = r"(?i)\.(?:json|jsonl|csv|tsv|parquet|txt)$"


def scan_lines(lines: DataFrame, issue_projects: list[str] | None = None, patterns: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_key, line_no, label, match, line, advice): every match; one narrow pass, patterns as data."""
    own = list(BLOCKING if patterns is None else patterns)
    if issue_projects:
        own.append(("issue_key", rf"\b(?:{'|'.join(issue_projects)})-\d+\b"))
    hits = F.array(*[F.struct(F.lit(label).alias("label"), F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)).alias("matches")) for label, pattern in own])
    scoped = [f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for _, p in own]  # a flag at a pattern's start holds for that pattern only
    prefilter = lines.where(F.col("text").rlike("|".join(scoped)))
    found = prefilter.select("doc_key", "line_no", "text", F.inline(hits)).select("doc_key", "line_no", "text", "label", F.explode("matches").alias("match"))
    advice = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    return found.select("doc_key", "line_no", "label", F.substring("match", 1, 44).alias("match"), F.substring("text", 1, 96).alias("line"), advice[F.col("label")].alias("advice"))


def deny_terms(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """Deny-listed terms (term, section) not preceded by Hangul; company terms count in data files, elsewhere they advise; a term once a line."""
    keep = ["doc_key", "line_no", "text", "path"]
    found = patterns.find_terms(lines.select(*keep), terms, keep).where(~F.col("before").rlike("[가-힣]"))
    hit = found.dropDuplicates(["doc_key", "line_no", "path", "term"]).join(terms.select("term", "section"), "term")
    label = F.when((F.col("section") == "company") & ~F.col("path").rlike(DATA_FILE), "advisory_term").otherwise("term")
    return hit.select("doc_key", "line_no", label.alias("label"), F.substring("term", 1, 44).alias("match"), F.substring("text", 1, 96).alias("line"))

"""Documents in eight text formats to visible text units, and the small tables that rules are made of."""

from __future__ import annotations

import html.parser
import json
import re
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosewright.functions.spans import pandas_function
from prosewright.functions.text import json_pointer, terminal_text
from prosewright.operators.structure import fenced

SUFFIXES = ["md", "html", "json", "jsonl", "yaml", "yml", "properties", "txt"]
UNIT = "array<struct<logical_path:string,line_number:int,kind:string,text:string>>"
BLOCKS = set("p div section article main header footer nav aside li dt dd td th caption h1 h2 h3 h4 h5 h6 blockquote figcaption label button option title".split())
SKIPPED = {"script", "style", "pre", "code", "noscript", "template", "svg"}


def configured(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """A setting that overrides a default, such as the place of a word list: the session's ``prosewright.<name>``."""
    return spark.conf.get(f"prosewright.{name}", default)


def read_documents(spark: SparkSession, path: str, suffixes: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """(path, format, raw) of all files below a path, folders named in ``without`` left out before they are read; none is an error."""
    globs = "{" + ",".join(f"*.{s}" for s in suffixes or SUFFIXES) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", globs).load(path)
    if without:
        files = files.where(~F.col("_metadata.file_path").rlike("/(?:" + "|".join(re.escape(w) for w in without) + ")/"))
    out = files.select("path", F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("format"), F.decode("content", "UTF-8").alias("raw"))
    if out.select("path").isEmpty():
        raise ValueError(f"no document under {path}")
    return out


def markdown_units(raw: str) -> list[tuple]:
    """Lines behind the front matter (closed within 100 lines) and outside fences; inline code as blanks of its length."""
    rows = raw.split("\n")
    skip = next((i + 1 for i, r in enumerate(rows[1:100], 1) if r.strip() == "---"), 0) if rows[0].strip() == "---" else 0
    inside = fenced(rows[skip:])
    out = []
    for i, (row, code) in enumerate(zip(rows[skip:], inside, strict=True), skip + 1):
        text = re.sub(r"`[^`]*`", lambda m: " " * len(m.group()), row).rstrip()
        if not code and text.strip():
            out.append((f"line/{i}", i, "line", text))
    return out


class _Visible(html.parser.HTMLParser):
    """Text joins the innermost open block; loose text is a unit of its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []
        self.skip = 0
        self.found: list[tuple] = []

    def _close(self):
        tag, line, parts = self.open.pop()
        if text := re.sub(r"\s+", " ", "".join(parts)).strip():
            self.found.append((line, tag, text))

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag in BLOCKS:
            self.open.append([tag, self.getpos()[0], []])

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCKS and any(o[0] == tag for o in self.open):
            while self.open[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if self.skip or not data.strip() and not self.open:
            return
        if self.open:
            self.open[-1][2].append(data)
        else:
            self.found.append((self.getpos()[0], "text", re.sub(r"\s+", " ", data).strip()))

    def units(self, raw: str) -> list[tuple]:
        self.feed(raw)
        self.close()
        while self.open:
            self._close()
        return [(f"{tag}/{i}", line, tag, text) for i, (line, tag, text) in enumerate(sorted(self.found, key=lambda f: f[0]), 1)]


def json_leaves(value, path: str = "") -> list[tuple[str, str]]:
    """(JSON pointer, text) of all string values."""
    if isinstance(value, str):
        return [(path or "/", value)] if value.strip() else []
    pairs = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    return [leaf for k, v in pairs for leaf in json_leaves(v, f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}")]


def yaml_units(raw: str) -> list[tuple]:
    import yaml

    out = []

    def walk(node, path):
        if isinstance(node, yaml.ScalarNode):
            if node.tag == "tag:yaml.org,2002:str" and node.value.strip():
                out.append((path or "/", node.start_mark.line + 1, "string", node.value))
        elif isinstance(node, yaml.MappingNode):
            for k, v in node.value:
                walk(v, f"{path}/{getattr(k, 'value', '')}")
        elif isinstance(node, yaml.SequenceNode):
            for i, v in enumerate(node.value):
                walk(v, f"{path}/{i}")

    try:
        for document in yaml.compose_all(raw, yaml.SafeLoader):
            walk(document, "")
    except yaml.YAMLError as error:
        raise ValueError(str(error)) from error
    return out


def unescaped(text: str) -> str:
    r"""Java properties escapes: \uXXXX, \t, \n, \r, \f, and a backslash before any other character."""
    known = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}
    return re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m.group(1), 16)) if m.group(1) else known.get(m.group(2), m.group(2)), text)


def properties_units(raw: str) -> list[tuple]:
    out, logical, start = [], "", 0
    for i, row in enumerate(raw.split("\n"), 1):
        row = row.rstrip("\r")
        text = row.lstrip()
        if not logical:
            if not text or text[0] in "#!":
                continue
            start = i
        if len(text) - len(text.rstrip("\\")) & 1:
            logical += text[:-1]
            continue
        logical += text
        m = re.match(r"((?:\\.|[^\\=:\s])*)\s*[=:]?\s*(.*)", logical, re.S)
        if m and (value := unescaped(m.group(2))).strip():
            out.append((unescaped(m.group(1)), start, "value", value))
        logical = ""
    return out


def units_of(kind: str, raw: str | None) -> list[tuple]:
    """The units of one document; one that cannot be parsed, or is of no known format, is a single unit that says so."""
    if raw is None:
        return []
    try:
        return _parsed(kind, raw)
    except (ValueError, RecursionError) as error:
        return [("/", None, "invalid", f"{type(error).__name__}: {error}"[:200])]


def _parsed(kind: str, raw: str) -> list[tuple]:
    if kind == "md":
        return markdown_units(raw)
    if kind == "html":
        return _Visible().units(raw)
    if kind == "json":
        return [(p, None, "string", t) for p, t in json_leaves(json.loads(raw))]
    if kind == "jsonl":
        out = []
        for i, row in enumerate(raw.split("\n"), 1):
            if row.strip():
                try:
                    out += [(p, i, "string", t) for p, t in json_leaves(json.loads(row))]
                except ValueError:
                    out.append(("/", i, "invalid_jsonl", row))
        return out
    if kind in ("yaml", "yml"):
        return yaml_units(raw)
    if kind == "properties":
        return properties_units(raw)
    if kind == "txt":
        return [(f"line/{i}", i, "line", r.rstrip()) for i, r in enumerate(raw.split("\n"), 1) if r.strip()]
    raise ValueError(f"unsupported format: {kind}")


def text_units(documents: DataFrame) -> DataFrame:
    """(path, unit_id, format, logical_path, line_number, kind, text): the visible text units of (path, format, raw)."""

    @pandas_function(UNIT)
    def parsed(kind: pd.Series, raw: pd.Series) -> pd.Series:
        return pd.Series([units_of(k, r) for k, r in zip(kind, raw, strict=True)])

    clean = F.when(F.col("format") == "txt", terminal_text("raw")).otherwise(F.col("raw"))
    each = documents.select("path", "format", F.posexplode(parsed("format", clean)).alias("at", "u"))
    return each.select("path", F.format_string("unit-%06d", F.col("at") + 1).alias("unit_id"), "format", "u.logical_path", "u.line_number", "u.kind", "u.text")


def json_units(rows: DataFrame, column: str) -> DataFrame:
    """String values of a JSON column natively, two levels deep: (…, pointer, text)."""
    first = rows.select("*", F.explode_outer(F.from_json(column, "map<string,string>")).alias("k1", "v1"))
    second = first.select("*", F.explode_outer(F.when(F.col("v1").rlike(r"^\s*\{"), F.from_json("v1", "map<string,string>"))).alias("k2", "v2"))
    pointer = F.concat(F.lit("/"), json_pointer("k1"), F.coalesce(F.concat(F.lit("/"), json_pointer("k2")), F.lit("")))
    return second.select(*rows.columns, pointer.alias("pointer"), F.coalesce("v2", "v1").alias("text")).where("k1 IS NOT NULL")


def spelling_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated wrong, right, scope, level, excepts, why; missing cells get their defaults."""
    rows = spark.read.text(path).where("NOT trim(value) RLIKE '^(#.*)?$'").select(F.split("value", "\t").alias("c"))
    cell = lambda i: F.trim(F.coalesce(F.try_element_at("c", F.lit(i)), F.lit("")))
    scope = F.when(cell(3).isin("any", "어디나"), "any").when(cell(3).isin("word", "낱말"), "word").otherwise("head")
    level = F.when(cell(4).isin("warn", "주의"), "warn").otherwise("err")
    excepts = F.filter(F.transform(F.split(cell(5), ","), lambda e: F.trim(e)), lambda e: e != "")
    return rows.select(cell(1).alias("wrong"), cell(2).alias("right"), scope.alias("scope"), level.alias("level"), excepts.alias("excepts"), cell(6).alias("why")).where("wrong != '' AND right != ''")


def inverted_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``canonical = wrong, wrong`` as (wrong, canonical)."""
    rows = spark.read.text(path).where("NOT trim(value) RLIKE '^#' AND value LIKE '%=%'")
    pairs = rows.select(F.trim(F.substring_index("value", "=", 1)).alias("canonical"), F.explode(F.split(F.regexp_replace("value", "^[^=]*=", ""), ",")).alias("wrong"))
    return pairs.select(F.trim("wrong").alias("wrong"), "canonical").where("wrong != '' AND canonical != ''")


def deny_list(spark: SparkSession, path: str) -> DataFrame:
    """Terms under [section] lines as (term, section); the file is a small one."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("i", "row")).withColumn("row", F.trim("row"))
    named = text.withColumn("section", F.last(F.nullif(F.regexp_extract("row", r"^\[(.+)\]$", 1), F.lit("")), ignorenulls=True).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    return named.where("row != '' AND NOT row RLIKE '^[#\\\\[]'").select(F.col("row").alias("term"), "section")


def find_config(spark: SparkSession, folder: str, name: str) -> dict | None:
    """The nearest TOML file of this name in the folder or above it, parsed."""
    parts = folder.rstrip("/").split("/")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for i in range(len(parts), 0, -1):
        path = "/".join(parts[:i]) + "/" + name
        if hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(path)):
            return tomllib.loads(spark.read.text(path, wholetext=True).first()[0])
    return None


def pipe_table(lines: DataFrame) -> DataFrame:
    """(doc_key, section, line_no, cells) of pipe-table rows, under the last heading above them."""
    above = Window.partitionBy("doc_key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("section", F.last(F.nullif(F.regexp_extract("text", r"^#{1,6}\s+(.+?)\s*$", 1), F.lit("")), ignorenulls=True).over(above))
    rows = named.where(F.trim("text").rlike(r"^\|.*\|$") & ~F.col("text").rlike(r"^[-:|\s]*$"))
    inner = F.replace(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), F.lit("\\|"), F.lit("\u0000"))
    return rows.select("doc_key", "section", "line_no", F.transform(F.split(inner, r"\|"), lambda c: F.trim(F.replace(c, F.lit("\u0000"), F.lit("|")))).alias("cells"))


def recent_rows(spark: SparkSession, path: str, schema: str, ts: str, since: str) -> DataFrame:
    """JSON-lines logs: files changed since, then rows by their own time; broken lines are left out."""
    rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").option("modifiedAfter", since).json(path)
    return rows.where(F.col("_broken").isNull() & (F.col(ts) >= F.lit(since).cast("timestamp"))).drop("_broken")

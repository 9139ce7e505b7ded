"""Raw text to relations: lines, body lines, paragraphs, tables, headings, HTML values.

``documents`` here is (doc_key, raw); ``lines`` is (doc_key, line_no, text), line_no from 1.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosewright.functions.spans import pandas_function
from prosewright.functions.text import BLOCK_TAGS, CODE_SPAN, QUOTE_SPAN, is_narrative, shown, squeeze, strip, strip_tags, unescape_html

LIST_ITEM = r"^(?:[-*]\s+|\d+[.)]\s+)"
HEADING = r"^(#{1,6})\s+(.+?)\s*#*$"


def lines(documents: DataFrame) -> DataFrame:
    """Every line of every document; narrow."""
    return documents.select("doc_key", F.posexplode(F.split("raw", "\n")).alias("at", "text")).select("doc_key", (F.col("at") + 1).alias("line_no"), "text")


def by_line(*more: str) -> Window:
    return Window.partitionBy("doc_key", *more).orderBy("line_no")


def front_matter_end(raw: str) -> int:
    """Number of lines of the front matter: first line ---, then something like a key, up to the next ---."""
    rows = raw.split("\n")
    if rows[0].rstrip() != "---":
        return 0
    first = next((r for r in rows[1:] if r.strip()), "")
    if not re.match(r"\s*[\w가-힣-]+\s*:", first):
        return 0
    return next((i + 1 for i, r in enumerate(rows[1:], 1) if r.rstrip() == "---"), 0)


def fenced(rows: list[str]) -> list[bool]:
    """Lines in code fences, marks included; a fence is closed by the same mark at least as long."""
    out, mark = [], ""
    for row in rows:
        m = re.match(r"\s{0,3}(`{3,}|~{3,})\s*(.*)$", row) if "```" in row or "~~~" in row else None
        if mark:
            out.append(True)
            if m and m.group(1)[0] == mark[0] and len(m.group(1)) >= len(mark) and not m.group(2).strip():
                mark = ""
        else:
            out.append(bool(m))
            mark = m.group(1) if m else ""
    return out


@pandas_function("array<struct<line_no:int,text:string,fenced:boolean>>")
def _parsed(raws: pd.Series) -> pd.Series:
    def parsed(raw):
        if raw is None:
            return []
        rows, skip = raw.split("\n"), front_matter_end(raw)
        inside = fenced(rows[skip:])
        return [(skip + i + 1, r, f) for i, (r, f) in enumerate(zip(rows[skip:], inside, strict=True))]

    return raws.map(parsed)


def parsed_lines(documents: DataFrame) -> DataFrame:
    """Lines behind the front matter, with whether they are in a code fence."""
    return documents.select("doc_key", F.inline(_parsed("raw"))).select("doc_key", "line_no", "text", "fenced")


# The same as the expressions of ``merge_wrapped``, ``without_contrast`` and ``paragraphs``, whose classes are Java's: \s and \d are ASCII,
# a dot stops at any line end, blank lines are told by Unicode's white space.
_ITEM, _MORE = re.compile(r"(?:[-*]\s+|\d+[.)]\s+)", re.A), re.compile(r"\s{2,}\S", re.A)
_ROW = re.compile("\\|[^\n\r\x85\u2028\u2029]*\\|")
_SHOWN = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# What a paragraph must hold for a pattern of repetition: Hangul, or quotation marks around blanks alone once code and quotations are masked.
_HANGUL, _BLANK_QUOTE = re.compile("[가-힣]"), re.compile("['‘] {1,12}['’]")
_CODE_SPAN, _QUOTE_SPAN = re.compile(CODE_SPAN), re.compile(QUOTE_SPAN)


def _may_repeat(text: str) -> bool:
    if _HANGUL.search(text):
        return True
    return ("'" in text or "‘" in text) and bool(_BLANK_QUOTE.search(_QUOTE_SPAN.sub(" ", _CODE_SPAN.sub(" ", text))))


def laid_out(raw: str | None) -> list[tuple]:
    """(line_no, text, fenced, taken, joined, contrast, para) of the lines behind the front matter.

    ``taken`` lines went into the item above (``merge_wrapped``), whose text with theirs is ``joined``; ``contrast`` marks rows of
    contrast tables; ``para`` is, at its first line, a paragraph in which patterns may repeat.  Null where there is nothing to tell.
    """
    if raw is None:
        return []
    rows, skip = raw.split("\n"), front_matter_end(raw)
    rows = rows[skip:]
    inside = fenced(rows)
    joined: list[str | None] = [None] * len(rows)
    taken, contrast, para = [False] * len(rows), [False] * len(rows), [None] * len(rows)
    head = None  # the last line that goes on with no other, if it is an item
    tails: dict[int, list[str]] = {}
    begin = None
    for i, row in enumerate(rows):
        if inside[i] or not _SHOWN.search(row):
            if begin is not None and _may_repeat(text := "\n".join(rows[begin:i])):
                para[begin] = text
            begin = None
        elif begin is None:
            begin = i
        if inside[i]:
            continue
        item = bool(_ITEM.match(row.strip(" ")))
        if not item and _MORE.match(row):
            if head is not None:
                tails.setdefault(head, []).append(row.strip(" "))
                taken[i] = True
        else:
            head = i if item else None
    if begin is not None and _may_repeat(text := "\n".join(rows[begin:])):
        para[begin] = text
    for i, more in tails.items():
        joined[i] = " ".join([rows[i], *more])
    before = marked = False  # the line before is a row of a table, of a contrast table
    for i, text in enumerate(rows):  # what is joined is an item, no row
        row = not inside[i] and not taken[i] and bool(_ROW.match(text.strip(" ")))
        marked = row and (marked if before else "❌" in text and "✅" in text)
        contrast[i], before = marked, row
    return [(skip + i + 1, *x) for i, x in enumerate(zip(rows, inside, taken, joined, contrast, para, strict=True))]


LAID_OUT = "line_no:int,text:string,fenced:boolean,taken:boolean,joined:string,contrast:boolean,para:string"


@pandas_function(f"array<struct<{LAID_OUT}>>")
def _laid_out(raws: pd.Series) -> pd.Series:
    return raws.map(laid_out)


# What a line must hold for a rule of wording or spelling, for a section named by a bare number, and how one with a label begins.
_LETTER, _NUMBER, _LABEL = re.compile("[가-힣ㄱ-ㅣ]"), re.compile(r"\(\d{1,2}[-.]\d", re.A), re.compile(r"\s*(?:[-*]\s+|\d+[.)]\s+)?\*\*", re.A)


def bearing(rows: list[tuple]) -> list[tuple]:
    """Of a document's ``laid_out`` rows those that ``rules.markdown_findings`` can find something by, if all words of its lists hold Hangul.

    A line bears by Hangul or a jamo, as a heading, by a label (emphasis at its start), by a section's sign or number, or by its
    paragraph.  What tables, lists, quotations and wrapped lines are told from are runs of lines, so a run of non-blank lines
    stays whole; a fence that holds Hangul stays with the line before it, and an H1 with the line that may be its lede.
    """
    kept = [row[6] is not None for row in rows]
    begin = fence = None  # where a run of lines, of fenced lines began
    bears = told = False  # whether the run bears, the fence holds Hangul
    for i in range(len(rows) + 1):
        _, text, fenced_, taken, joined, _, _ = rows[i] if i < len(rows) else (0, "", False, False, None, False, None)
        if fenced_:
            fence = i if fence is None else fence
            told = told or bool(_LETTER.search(text))
        elif fence is not None:
            if told:
                kept[max(0, fence - 1) : i] = [True] * (i - max(0, fence - 1))
            fence, told = None, False
        if fenced_ or taken or not _SHOWN.search(text):
            if bears:
                kept[begin:i] = [True] * (i - begin)
            begin, bears = None, False
            continue
        begin = i if begin is None else begin
        text = joined or text
        bears = bears or text.startswith("#") or "**" in text and bool(_LABEL.match(text)) or "§" in text or not text.isascii() and bool(_LETTER.search(text)) or "(" in text and bool(_NUMBER.search(text))
        if text.startswith("#") and not text.startswith("##"):
            near = (j for j in range(i + 1, min(i + 8, len(rows))) if not rows[j][2] and not rows[j][3] and _SHOWN.search(rows[j][1]) and not rows[j][1].startswith("#"))
            if (lede := next(near, None)) is not None:
                kept[lede] = True
    return [row for row, keep in zip(rows, kept, strict=True) if keep]


def dealt_lines(documents: DataFrame) -> DataFrame:
    """``parsed_lines`` with what ``laid_out`` tells of them, dealt by document and in its order, so that whatever groups, joins
    or looks at the next line within a document needs no further shuffle or sort."""
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    each = documents.select("doc_key", F.inline(_laid_out("raw")))
    return each.repartition(n, "doc_key").sortWithinPartitions("doc_key", "line_no")


def _residues(text_pairs: Iterator[tuple[str | None, str | None]]) -> Iterator[tuple[int, str]]:
    for pair in text_pairs:
        sides = [bearing(laid_out(raw)) for raw in pair]
        first = min((rows[0][0] for rows in sides if rows), default=1)
        # Places count for quotations only, which a document's first six lines are no place for.
        ahead = max(0, first - 7) if any(row[1].lstrip().startswith(">") for rows in sides for row in rows) else first - 1
        yield ahead, json.dumps([[(row[0] - ahead, *row[1:]) for row in rows] for rows in sides], ensure_ascii=False, separators=(",", ":"))


@pandas_function("struct<ahead:int,residue:string>")
def residue(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """What two texts hold for the rules: their ``bearing`` lines as JSON, numbered from behind ``ahead`` lines.

    Findings of texts with the same residue are the same but for line numbers, which differ as ``ahead`` does.
    """
    return pd.DataFrame(_residues(zip(a, b, strict=True)), columns=["ahead", "residue"]).astype({"ahead": "int32"})


@pandas_function("struct<ahead:int,residue:string>")
def planted_residue(raw: pd.Series, at: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """``residue`` of a text with ``a`` and with ``b`` put behind line ``at``, so that a worker is sent the text once."""

    def both():
        for text, n, *blocks in zip(raw, at, a, b, strict=True):
            rows = text.split("\n")
            yield tuple("\n".join([*rows[:n], block, *rows[n:]]) for block in blocks)

    return pd.DataFrame(_residues(both()), columns=["ahead", "residue"]).astype({"ahead": "int32"})


@pandas_function(f"array<array<struct<{LAID_OUT}>>>")
def _of_residue(residues: pd.Series) -> pd.Series:
    return residues.map(json.loads)


def residue_lines(residues: DataFrame, sides: tuple[str, str], n: int) -> DataFrame:
    """``dealt_lines`` of texts told by (key, residue), in n partitions: doc_key is the side, a colon and the key."""
    both = residues.select("key", F.posexplode(_of_residue("residue")).alias("side", "rows"))
    name = F.when(F.col("side") == 0, sides[0]).otherwise(sides[1])
    each = both.select(F.concat_ws(":", name, "key").alias("doc_key"), F.inline("rows"))
    return each.repartition(n, "doc_key").sortWithinPartitions("doc_key", "line_no")


def merged_body(parsed: DataFrame) -> DataFrame:
    """The merged body (doc_key, line_no, text, contrast) of dealt lines; of others without ``contrast``."""
    if "joined" not in parsed.columns:
        return merge_wrapped(parsed.where("NOT fenced").drop("fenced"))
    return parsed.where("NOT fenced AND NOT taken").select("doc_key", "line_no", F.coalesce("joined", "text").alias("text"), "contrast")


def body_lines(documents: DataFrame) -> DataFrame:
    return parsed_lines(documents).where("NOT fenced").drop("fenced")


def declared_form(raw: Column | str) -> Column:
    """Value of a form: line or meta tag in the first 4,096 characters, if it is a legal one."""
    head = F.regexp_replace(F.substring(raw, 1, 4096), r"`[^`]*`", "")
    found = F.lower(F.coalesce(F.nullif(F.regexp_extract(head, r"(?m)^form:\s*(\w+)\s*$", 1), F.lit("")), F.regexp_extract(head, r'(?i)<meta\s+name="form"\s+content="(\w+)"', 1)))
    return F.when(found.isin("structured", "prose", "app", "notice"), found)


def wrapped(body: DataFrame) -> DataFrame:
    """Adds ``wrapped``: the next line goes on with this one."""
    nxt = F.lead("text").over(by_line())
    goes_on = shown(nxt) & ~nxt.rlike(r"^\s*(?:[-*+>|#]|\d+[.)]|```|~~~|<|!\[)")
    follows = F.lead("line_no").over(by_line()) == F.col("line_no") + 1
    return body.withColumn("wrapped", F.coalesce(goes_on & follows & shown("text"), F.lit(False)))


def merge_wrapped(body: DataFrame) -> DataFrame:
    """Indented lines below a list item join the item's first line."""
    item = F.trim("text").rlike(LIST_ITEM)
    more = F.col("text").rlike(r"^\s{2,}\S") & ~item
    marked = body.withColumn("item", item).withColumn("more", more)
    head = F.last(F.when(~F.col("more"), F.struct("line_no", "item")), ignorenulls=True).over(by_line().rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("head", head).withColumn("head_no", F.when(F.col("more") & F.col("head.item"), F.col("head.line_no")).otherwise(F.col("line_no")))
    return marked.groupBy("doc_key", "head_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("rows")).select(
        "doc_key", F.col("head_no").alias("line_no"), F.concat(F.element_at("rows.text", 1), F.array_join(F.transform(F.slice("rows.text", F.lit(2), F.size("rows")), lambda t: F.concat(F.lit(" "), F.trim(t))), "")).alias("text")
    )


def _runs(rows: DataFrame, member: Column, name: str) -> DataFrame:
    """Rows of consecutive line numbers that satisfy ``member``, with the first line of their run."""
    kept = rows.where(member)
    run = F.col("line_no") - F.row_number().over(by_line())
    return kept.withColumn("run", run).withColumn(name, F.min("line_no").over(Window.partitionBy("doc_key", "run"))).drop("run")


def paragraphs(body: DataFrame) -> DataFrame:
    """(doc_key, first_line, last_line, n_lines, text) of runs of non-blank lines."""
    runs = _runs(body, strip("text") != "", "first_line")
    return runs.groupBy("doc_key", "first_line").agg(
        F.max("line_no").alias("last_line"), F.count("*").alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "\n").alias("text"),
    )


def list_blocks(body: DataFrame) -> DataFrame:
    return _runs(body, F.trim("text").rlike(LIST_ITEM), "block")


def quote_blocks(body: DataFrame) -> DataFrame:
    """Block quotes that start after the document's head."""
    return _runs(body, F.col("text").rlike(r"^\s*>"), "block").where("block > 6")


def table_cells(body: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cells of pipe tables with their row's part: header or value; separator rows left out; ``contrast`` tables marked."""
    runs = _runs(body, F.trim("text").rlike(r"^\|.*\|"), "block")
    rows = runs.withColumn("header", F.col("line_no") == F.col("block")).where(~F.col("text").rlike(r"^[-:|\s]*$"))
    contrast = F.max(F.col("header") & F.col("text").contains("❌") & F.col("text").contains("✅")).over(Window.partitionBy("doc_key", "block"))
    inner = F.regexp_replace(F.regexp_replace(F.trim("text"), r"^\|+|\|+$", ""), r"\\\|", "\u0000")
    cells = rows.withColumn("contrast", contrast).select("doc_key", "line_no", "block", "header", "contrast", *keep, F.posexplode(F.split(inner, r"\|")).alias("cell_no", "text"))
    return cells.withColumn("text", F.trim(F.replace("text", F.lit("\u0000"), F.lit("|"))))


def without_contrast(body: DataFrame) -> DataFrame:
    """The lines that are not rows of contrast tables: as ``laid_out`` told, or by windows within a document."""
    if "contrast" in body.columns:
        return body.where("NOT contrast").drop("contrast")
    row = F.trim("text").rlike(r"^\|.*\|")
    marked = body.withColumn("_row", row).withColumn("_run", F.col("line_no") - F.row_number().over(Window.partitionBy("doc_key", "_row").orderBy("line_no")))
    block = Window.partitionBy("doc_key", "_row", "_run")
    head = F.col("line_no") == F.min("line_no").over(block)
    marked = marked.withColumn("_head", head & F.col("text").contains("❌") & F.col("text").contains("✅"))
    return marked.withColumn("_contrast", F.max("_head").over(block)).where("NOT (_row AND _contrast)").select(*body.columns)


def headings(body: DataFrame) -> DataFrame:
    marked = body.where(F.col("text").rlike(HEADING))
    return marked.select("doc_key", "line_no", F.length(F.regexp_extract("text", HEADING, 1)).alias("level"), F.regexp_extract("text", HEADING, 2).alias("title"))


def heading_chain(body: DataFrame) -> DataFrame:
    """Adds ``chain``: titles of the headings a line stands under, outermost first."""
    out = body.withColumn("level", F.length(F.regexp_extract("text", HEADING, 1))).withColumn("title", F.regexp_extract("text", HEADING, 2))
    above = by_line().rowsBetween(Window.unboundedPreceding, 0)
    for n in range(1, 7):
        out = out.withColumn(f"h{n}", F.last(F.when(F.col("level") == n, F.struct("line_no", "title")), ignorenulls=True).over(above))
    shown = []
    for n in range(1, 7):
        newer = F.greatest(*[F.coalesce(F.col(f"h{m}.line_no"), F.lit(0)) for m in range(1, n)], F.lit(0), F.lit(0))
        shown.append(F.when(F.col(f"h{n}.line_no") > newer, F.col(f"h{n}.title")))
    return out.withColumn("chain", F.array_compact(F.array(*shown))).select("doc_key", "line_no", "text", "chain")


def sections(body: DataFrame) -> DataFrame:
    """(doc_key, first_line, last_line, path, text) from each heading to before the next."""
    chained = heading_chain(body)
    starts = F.sum(F.col("text").rlike(HEADING).cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0))
    return chained.withColumn("section", starts).groupBy("doc_key", "section").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.min_by("chain", "line_no").alias("path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "\n").alias("text"),
    )


def heading_numbers(body: DataFrame) -> DataFrame:
    """(doc_key, number, title): the first heading with each number."""
    return numbered_titles(headings(body))


def numbered_titles(heads: DataFrame) -> DataFrame:
    """(doc_key, line_no, title) to (doc_key, number, title).  Numbers have up to two digits a level, after an optional word for appendix."""
    numbered = r"^\s*(?:부록\s+)?(\d{1,2}(?:[-.]\d{1,2})*)[.)]?\s+(.+)$"
    found = heads.withColumn("title", F.replace("title", F.lit("**"), F.lit(""))).where(F.col("title").rlike(numbered))
    return found.groupBy("doc_key", F.regexp_extract("title", numbered, 1).alias("number")).agg(F.min_by(F.trim(F.regexp_extract("title", numbered, 2)), "line_no").alias("title"))


def ledes(body: DataFrame) -> DataFrame:
    """(doc_key, h1_line, lede_line, lede): the first other line within seven behind the first H1; nulls without one."""
    first = headings(body).where("level = 1").groupBy("doc_key").agg(F.min("line_no").alias("h1_line"))
    near = body.join(first, "doc_key").where((F.col("line_no") > F.col("h1_line")) & (F.col("line_no") <= F.col("h1_line") + 7))
    told = shown("text") & ~F.col("text").rlike("^#")  # judged of the lines near an H1 only
    lede = near.groupBy("doc_key").agg(F.min(F.when(told, F.struct("line_no", "text"))).alias("l"))
    return first.join(lede, "doc_key", "left").select("doc_key", "h1_line", F.col("l.line_no").alias("lede_line"), F.col("l.text").alias("lede"))


def label_values(text: Column) -> Column:
    """Parts of a value that are judged: a bold conclusion without its evidence sentence, or label and value."""
    t = F.regexp_replace(F.trim(text), r"^(?:[←-⯿☀-➿\x{1F000}-\x{1FAFF}]+\s*)+", "")
    # Label and value, and a bold conclusion with what follows it.
    label = r"^\*\*(.+?)\*\*\s*(?:\([^)]*\))?\s*[:：]\s*(.*)$"
    bold = r"(?s)^\*\*(.+?)\*\*\s*(?:\([^)]*\))?\s*(?:[—–\-:·：.。]\s*|\s+|$)(.*)$"
    bare = lambda c: F.replace(c, F.lit("**"), F.lit(""))
    head, rest = F.regexp_extract(t, bold, 1), F.trim(F.regexp_extract(t, bold, 2))
    evidence = F.regexp_replace(rest, "[*_`~\"”’'」』 ]+$", "").rlike(r"[.。]$")
    both = lambda p: F.filter(F.array(bare(F.regexp_extract(t, p, 1)), bare(F.regexp_extract(t, p, 2))), lambda x: F.trim(x) != "")
    return F.when(t.rlike(label), both(label)).when(~t.rlike(bold), F.array(bare(t))).when(evidence, F.array(bare(head))).otherwise(both(bold))


def value_slots(body: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_key, line_no, slot_kind, slot_no, text, and columns of the line to keep): table cells, list items and conclusion lines."""
    cells = table_cells(body, keep).where("NOT header AND NOT contrast AND text != ''").select("doc_key", "line_no", F.lit("cell").alias("slot_kind"), F.col("cell_no").alias("slot_no"), "text", *keep)
    trimmed = F.trim("text")
    kind = F.when(trimmed.rlike(LIST_ITEM), "item").when(trimmed.rlike(r"^[→⇒]\s*"), "conclusion")
    items = body.withColumn("slot_kind", kind).where("slot_kind IS NOT NULL").withColumn("text", F.regexp_replace(trimmed, LIST_ITEM + r"|^[→⇒]\s*", ""))
    items = items.select("doc_key", "line_no", "slot_kind", *keep, F.posexplode(label_values(F.col("text"))).alias("slot_no", "text"))
    return cells.union(items.select(*cells.columns))


def slot_counts(documents: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Slots of every document; ``blind`` where there is nothing to inspect, which is not a pass.  ``lines`` are parsed ones, if at hand."""
    body = body_lines(documents) if lines is None else lines.where("NOT fenced").drop("fenced")
    counted = value_slots(body).groupBy("doc_key").agg(F.count("*").alias("slots"))
    return documents.select("doc_key").join(counted, "doc_key", "left").select("doc_key", F.coalesce("slots", F.lit(0)).alias("slots")).withColumn("blind", F.col("slots") == 0)


def flowing() -> Column:
    """A line of running text: no list item, quotation, table row, heading, fence or element."""
    return ~F.trim("text").rlike(r"^(?:[-*+>|#]|\d+[.)]\s|```|~~~|<|!\[|[→⇒])")


def prose_share(lines_: DataFrame) -> DataFrame:
    """(doc_key, share): flowing lines among the non-blank ones."""
    return lines_.where(strip("text") != "").groupBy("doc_key").agg(F.avg(flowing().cast("double")).alias("share"), F.count("*").alias("n_lines"))


def of_matter() -> Column:
    return F.trim("text").rlike(LIST_ITEM) | F.col("text").rlike(r"^\s*[|#]") | is_narrative(F.col("text"))


def notice_frame(body: DataFrame) -> DataFrame:
    """(doc_key, first, last): first and last line that belong to the matter of a notice, not to its greeting or closing."""
    return body.where(of_matter()).groupBy("doc_key").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"))


def clean_html(raw: Column | str, longest: int | None = None) -> Column:
    """Without styles and scripts; code blocks as one mark.  With ``longest``, lines that still are as long or longer go as data."""
    text = F.regexp_replace(raw, r"(?is)<(style|script)\b.*?</\1\s*>", "")
    if longest is not None:
        text = F.array_join(F.filter(F.split(text, "\n"), lambda r: F.length(r) < longest), "\n")
    return F.regexp_replace(F.regexp_replace(text, r"(?is)<pre[^>]*>\s*<code.*?</code>\s*</pre>", "□"), r"(?i)<code[^>]*>\s*</code>", "")


def html_slots(pages: DataFrame, longest: int | None = None) -> DataFrame:
    """(doc_key, slot_kind, slot_no, text) of dd, li and td elements and class v values; an item ends at a nested list."""
    kinds = [("dd", r"(?is)<dd\b[^>]*>(.*?)</dd>"), ("li", r"(?is)<li\b[^>]*>((?:(?!<ul|<ol|</li>).)*)"), ("td", r"(?is)<td\b[^>]*>(.*?)</td>"), ("v", r'(?is)<[^>]*class="v"[^>]*>(.*?)</')]
    clean = pages.select("doc_key", clean_html("raw", longest).alias("raw"))
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("raw", F.lit(p), F.lit(1)).alias("values")) for k, p in kinds])
    each = clean.select("doc_key", F.inline(found)).select("doc_key", F.col("kind").alias("slot_kind"), F.posexplode("values").alias("slot_no", "text"))
    return each.withColumn("text", strip_tags("text")).where("text != ''")


def html_headings(raw: Column | str) -> Column:
    """Array of (level, title)."""
    found = F.regexp_extract_all(clean_html(raw), F.lit(r"(?is)(<h[1-6]\b[^>]*>.*?</h[1-6]>)"), F.lit(1))
    return F.transform(found, lambda h: F.struct(F.regexp_extract(h, "(?i)^<h([1-6])", 1).cast("int").alias("level"), unescape_html(strip_tags(h)).alias("title")))


def html_links(raw: Column | str) -> Column:
    """Array of (text, href); links that show no text are left out."""
    pattern = r"""(?is)(<a\b[^>]*\bhref\s*=\s*["'][^"']*["'][^>]*>.*?</a>)"""
    found = F.regexp_extract_all(clean_html(raw), F.lit(pattern), F.lit(1))
    named = lambda a: F.struct(squeeze(unescape_html(F.regexp_replace(a, r"<[^>]+>", ""))).alias("text"), unescape_html(F.regexp_extract(a, r"""(?is)\bhref\s*=\s*["']([^"']*)["']""", 1)).alias("href"))
    return F.filter(F.transform(found, named), lambda a: (a["text"] != "") & (a["href"] != ""))


def visible_html_lines(pages: DataFrame) -> DataFrame:
    """(doc_key, line_no, text) of what a page shows, block by block."""
    text = F.regexp_replace(F.regexp_replace(clean_html("raw"), r"(?is)<(?:head|title)\b.*?</(?:head|title)\s*>", ""), r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCK_TAGS}|body|html)\b[^>]*>|<br\b[^>]*>", "\n")
    rows = F.filter(F.transform(F.split(F.regexp_replace(text, r"<[^>]+>", ""), "\n"), lambda r: strip(unescape_html(r))), lambda r: r != "")
    return pages.select("doc_key", F.posexplode(rows).alias("at", "text")).select("doc_key", (F.col("at") + 1).alias("line_no"), "text")

"""Pieces of documents for a judge: chunks, windows around target lines, supporting lines, links."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosewright.functions.spans import pandas_function
from prosewright.functions.text import bigrams

CHUNK_LINES, WINDOW_LINES, SNAP, BLOCK_BUDGET = 180, 20, 10, 120
SUPPORT, SUPPORT_LEAST, LINKS = 6, 0.18, 40


@pandas_function("array<struct<first:int,last:int>>")
def chunk_bounds(rows: pd.Series) -> pd.Series:
    """For an array of lines: chunks of at most CHUNK_LINES, cut at the nearest heading in the second half."""

    def cut(lines):
        lines, out, at = list(lines), [], 0
        while at < len(lines):
            end = min(len(lines), at + CHUNK_LINES)
            if end < len(lines):
                end = next((i for i in range(end, at + CHUNK_LINES // 2, -1) if re.match(r"#{1,6}\s", lines[i])), end)
            out.append((at + 1, end))
            at = end
        return out

    return rows.map(cut)


def chunks(lines: DataFrame) -> DataFrame:
    """(doc_key, first, last, text)."""
    whole = lines.groupBy("doc_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]).alias("rows"))
    each = whole.select("doc_key", "rows", F.explode(chunk_bounds("rows")).alias("c"))
    return each.select("doc_key", "c.first", "c.last", F.array_join(F.slice("rows", F.col("c.first"), F.col("c.last") - F.col("c.first") + 1), "\n").alias("text"))


def heading_chunks(lines: DataFrame) -> DataFrame:
    """Pieces that begin at second-level headings."""
    part = F.sum(F.col("text").rlike(r"^##\s").cast("int")).over(Window.partitionBy("doc_key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("part", part).groupBy("doc_key", "part").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"))


def blocks(lines: DataFrame) -> DataFrame:
    """Adds ``block``: the first line of the run of non-blank lines a line is in."""
    kept = lines.where(F.trim("text") != "")
    run = F.col("line_no") - F.row_number().over(Window.partitionBy("doc_key").orderBy("line_no"))
    return kept.withColumn("run", run).withColumn("block", F.min("line_no").over(Window.partitionBy("doc_key", "run"))).drop("run")


# Fixed value: how a list item begins.
LIST_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s")


class Outline:
    """A document's lines as a tree, told in one pass: blocks, items within items, headings within headings.

    Lines are numbered from 1.  ``block`` is a line's (first, last); ``item`` the list item it belongs to, ``over`` an item's parent and
    ``ends`` where an item's own lines end; ``under`` is the heading above a line, ``higher`` the heading above a heading.
    A fence keeps its blank lines in its block.
    """

    def __init__(self, lines: list[str], levels: dict[int, int] | None = None):
        self.lines, self.blocks = lines, []
        self.block: dict[int, int] = {}
        self.item: dict[int, int] = {}
        self.over: dict[int, int | None] = {}
        self.ends: dict[int, int] = {}
        self.under: dict[int, int | None] = {}
        self.higher: dict[int, int | None] = {}
        heads: list[tuple[int, int]] = []  # open headings, (level, line)
        items: list[tuple[int, int]] = []  # open items of this block, (indentation, line)
        code, first = False, None

        def close(last: int) -> None:
            nonlocal first
            if first is not None:
                self.blocks.append((first, last))
                for n in range(first, last + 1):
                    self.block[n] = len(self.blocks) - 1
                self.ends.update((at, last) for _, at in items)
                items.clear()
                first = None

        for n, line in enumerate(lines, 1):
            bare = line.lstrip()
            code ^= bare.startswith(("```", "~~~"))
            if not bare and not code:
                close(n - 1)
            elif first is None:
                first = n
            if first is not None:
                if LIST_ITEM.match(line):
                    indent = len(line) - len(bare)
                    while items and items[-1][0] >= indent:
                        self.ends[items.pop()[1]] = n - 1
                    self.over[n] = items[-1][1] if items else None
                    items.append((indent, n))
                if items:
                    self.item[n] = items[-1][1]
            self.under[n] = heads[-1][1] if heads else None
            hashes = re.match(r"(#{1,6})\s", line)
            level = levels.get(n) if levels is not None else hashes and len(hashes[1])
            if level:
                while heads and heads[-1][0] >= level:
                    heads.pop()
                self.higher[n] = heads[-1][1] if heads else None
                heads.append((level, n))
        close(len(lines))

    def chain(self, n: int) -> set[int]:
        """The headings over a line.  A heading's own chain begins with the last heading above it, whatever its level."""
        out, at = set(), self.under[n]
        while at is not None:
            out.add(at)
            at = self.higher[at]
        return out

    def _indent(self, n: int) -> int:
        return len(self.lines[n - 1]) - len(self.lines[n - 1].lstrip())

    def is_table(self, first: int, last: int) -> bool:
        return all(row.lstrip().startswith("|") for row in self.lines[first - 1 : last])

    def unit(self, n: int) -> set[int] | None:
        """What must not be cut around a line of a long block: its item with the items over it and the list's lead, or a row with its neighbours and the table's head."""
        first, last = self.blocks[self.block[n]]
        rows = range(first, last + 1)
        if 2 * sum(k in self.over for k in rows) >= len(rows):
            own = self.item.get(n)
            if own is None:  # above the first item: the lead, with the items that are indented below it
                edge = self._indent(first)
                return set(range(first, next((k for k in rows if k in self.over and self._indent(k) <= edge), last + 1)))
            out = set(range(own, self.ends[own] + 1))
            while (own := self.over[own]) is not None:
                out.add(own)
            return out | ({first} - self.over.keys())
        if self.is_table(first, last):
            return {k for k in (first, first + 1, *range(n - 2, n + 3)) if first <= k <= last}
        return None

    def window(self, n: int, budget: int) -> set[int] | None:
        """The lines to show with a line, within the budget; none if its block is neither short nor a list nor a table."""
        heads = self.chain(n)
        at = self.block.get(n)
        if at is None:
            return heads | {k for k in (n - 1, n, n + 1) if 1 <= k <= len(self.lines)}
        out = set(range(self.blocks[at][0], self.blocks[at][1] + 1)) | heads
        if len(out) > budget:
            own = self.unit(n)
            if own is None or len(out := own | heads) > budget:
                return None
        for near in (at - 1, at + 1):
            if 0 <= near < len(self.blocks):
                more = out | set(range(self.blocks[near][0], self.blocks[near][1] + 1))
                out = more if len(more) <= budget else out
        return out

    def around(self, n: int, reach: int, snap: int) -> range:
        """Lines around a line, moved out to ends of blocks that are near."""
        first, last = max(1, n - reach), min(len(self.lines), n + reach)
        lead, tail = self.block.get(first), self.block.get(last)
        if lead is not None and first - self.blocks[lead][0] <= snap:
            first = self.blocks[lead][0]
        if tail is not None and self.blocks[tail][1] - last <= snap:
            last = self.blocks[tail][1]
        return range(first, last + 1)

    def fixed(self, n: int, reach: int, snap: int) -> set[int]:
        """The lines around, the head of a table that they cut, and the headings."""
        rows = self.around(n, reach, snap)
        lead = self.block.get(rows[0])
        head = set()
        if lead is not None and self.blocks[lead][0] < rows[0] and self.is_table(*self.blocks[lead]):
            head = {self.blocks[lead][0], self.blocks[lead][0] + 1}
        return {*rows} | head | self.chain(n)


def _told(choose):
    """Arrow function over (lines, targets, headings of HTML): each target's lines, null where the chunk has to be taken."""

    @F.pandas_udf("array<struct<line_no:int,shown:array<int>>>")
    def told(rows: pd.Series, targets: pd.Series, heads: pd.Series) -> pd.Series:
        def one(lines, wanted, levels):
            tree = Outline([r or "" for r in lines], None if levels is None else {h["line_no"]: h["level"] for h in levels})
            out = []
            for n in sorted({int(t) for t in wanted if t is not None and 1 <= t <= len(tree.lines)}):
                shown = choose(tree, n)
                out.append((n, None if shown is None else sorted(shown)))
            return out

        return pd.Series([one(*args) for args in zip(rows, targets, heads, strict=True)])

    return told


def _windows(targets: DataFrame, lines: DataFrame, heads: DataFrame | None, choose) -> DataFrame:
    rows = lines.groupBy("doc_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]).alias("rows"))
    wanted = targets.groupBy("doc_key").agg(F.collect_set("line_no").alias("wanted"))
    met = rows.join(wanted, "doc_key")
    if heads is not None:
        html = heads.groupBy("doc_key").agg(F.collect_list(F.struct(F.col("line_no").cast("int").alias("line_no"), F.col("level").cast("int").alias("level"))).alias("heads"))
        met = met.join(html, "doc_key", "left")
    else:
        met = met.withColumn("heads", F.lit(None).cast("array<struct<line_no:int,level:int>>"))
    out = met.select("doc_key", F.inline(_told(choose)("rows", "wanted", "heads")))
    return out.withColumn("fallback", F.col("shown").isNull() | (F.size("shown") > CHUNK_LINES))


def block_windows(targets: DataFrame, lines: DataFrame, budget: int = BLOCK_BUDGET, heads: DataFrame | None = None) -> DataFrame:
    """(doc_key, line_no, shown, fallback): the target's block and headings, and the blocks next to it if they fit the budget of lines.

    Of a block over the budget, a list gives the target's item with what it stands under, a table the neighbouring rows and the
    head; anything else is not cut, ``shown`` is null and ``fallback`` says to take the chunk.  ``lines`` hold every line of a
    document, ``heads`` (doc_key, line_no, level) the headings of visible HTML lines.  Documents are read once, whatever the number of targets.
    Targets that are null or not a line of their document give no row.
    """
    return _windows(targets, lines, heads, lambda tree, n: tree.window(n, budget))


def windows(targets: DataFrame, lines: DataFrame, reach: int = WINDOW_LINES, snap: int = SNAP) -> DataFrame:
    """(doc_key, line_no, first, last): ``reach`` lines around each target, moved out by up to ``snap`` to ends of blocks.

    Where the window would be longer than a chunk, ``fallback`` says to take the chunk.
    """
    own = _windows(targets, lines, None, lambda tree, n: tree.around(n, reach, snap))
    return own.select("doc_key", "line_no", F.array_min("shown").alias("first"), F.array_max("shown").alias("last"), "fallback")


def fixed_windows(targets: DataFrame, lines: DataFrame, reach: int = WINDOW_LINES, snap: int = SNAP, heads: DataFrame | None = None) -> DataFrame:
    """(doc_key, line_no, shown, fallback) as ``block_windows``: lines around the target as ``windows`` takes them, a cut table's head, the headings."""
    return _windows(targets, lines, heads, lambda tree, n: tree.fixed(n, reach, snap))


def excerpts(lines: DataFrame, shown: DataFrame) -> DataFrame:
    """(doc_key, text): numbered lines that are shown (doc_key, line_no), gaps told by their number of lines."""
    own = lines.join(shown.select("doc_key", "line_no").distinct(), ["doc_key", "line_no"])
    gap = F.col("line_no") - F.coalesce(F.lag("line_no").over(Window.partitionBy("doc_key").orderBy("line_no")), F.lit(0)) - 1
    told = F.concat(F.when(F.col("gap") > 0, F.concat(F.lit("… "), F.col("gap").cast("string"), F.lit(" lines omitted\n"))).otherwise(""), F.col("line_no").cast("string"), F.lit(": "), "text")
    rows = own.withColumn("gap", gap).withColumn("told", told)
    return rows.groupBy("doc_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "told"))), lambda r: r["told"]), "\n").alias("text"))


def support_lines(lines: DataFrame, shown: DataFrame, n: int = SUPPORT, least: float = SUPPORT_LEAST) -> DataFrame:
    """(doc_key, line_no, similarity): lines not shown that are likest to what is shown, by cosine of bigram counts with in-document idf."""
    grams = lines.select("doc_key", "line_no", F.explode(bigrams("text")).alias("gram"))
    tf = grams.groupBy("doc_key", "line_no", "gram").agg(F.sum(F.when(F.col("gram").startswith("#"), 2).otherwise(1)).alias("tf"))
    n_lines = lines.groupBy("doc_key").agg(F.count("*").alias("n_lines"))
    df = tf.groupBy("doc_key", "gram").agg(F.count("*").alias("df"))
    w = tf.join(df, ["doc_key", "gram"]).join(n_lines, "doc_key").withColumn("w", F.col("tf") * F.ln(F.col("n_lines") / F.col("df")))
    mark = shown.select("doc_key", "line_no", F.lit(True).alias("shown")).distinct()
    w = w.join(mark, ["doc_key", "line_no"], "left")
    query = w.where("shown").groupBy("doc_key", "gram").agg(F.sum("w").alias("q"))
    q_norm = query.groupBy("doc_key").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    rest = w.where("shown IS NULL")
    norm = rest.groupBy("doc_key", "line_no").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    dot = rest.join(query, ["doc_key", "gram"]).groupBy("doc_key", "line_no").agg(F.sum(F.col("w") * F.col("q")).alias("dot"))
    like = dot.join(norm, ["doc_key", "line_no"]).join(q_norm, "doc_key").withColumn("similarity", F.round(F.try_divide("dot", F.col("n") * F.col("qn")), 6)).where(F.col("similarity") >= least)
    turn = F.row_number().over(Window.partitionBy("doc_key").orderBy(F.desc("similarity"), "line_no"))
    return like.withColumn("turn", turn).where(F.col("turn") <= n).select("doc_key", "line_no", "similarity")


def link_notes(chunk_rows: DataFrame, links: DataFrame, most: int = LINKS) -> DataFrame:
    """(doc_key, first, text, href): links whose text is in the chunk, each once, at most ``most``."""
    near = chunk_rows.join(links.withColumnRenamed("text", "shown"), "doc_key").where(F.contains("text", F.col("shown"))).select("doc_key", "first", F.col("shown").alias("text"), "href").distinct()
    return near.withColumn("turn", F.row_number().over(Window.partitionBy("doc_key", "first").orderBy("text", "href"))).where(F.col("turn") <= most).drop("turn")


def consistency_findings(answers: DataFrame, lines: DataFrame, wanted: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(doc_key, line_no, phrase, fix, why, check, decide): contradictions within a document that a judge answered with.

    answers: (doc_key, line, phrase, other, other_phrase, why, fix).  Kept are those whose phrase stands in the line; of a
    second pass those that touch a ``wanted`` line (doc_key, line_no); not those that were ``found`` (doc_key, line_no,
    phrase) before.  Which of the two places is right is the author's to check; without a fix the finding is a question.
    """
    own = answers.withColumn("phrase", F.trim(F.coalesce("phrase", F.lit("")))).where("phrase != ''").withColumnRenamed("line", "line_no")
    kept = own.join(lines.select("doc_key", "line_no", "text"), ["doc_key", "line_no"]).where(F.contains("text", F.col("phrase")))
    if wanted is not None:
        mark = wanted.select("doc_key", "line_no").distinct()
        one, two = mark.withColumn("here", F.lit(True)), mark.withColumnRenamed("line_no", "other").withColumn("there", F.lit(True))
        kept = kept.join(one, ["doc_key", "line_no"], "left").join(two, ["doc_key", "other"], "left").where("here OR there").drop("here", "there")
    if found is not None:
        kept = kept.join(found.select("doc_key", "line_no", "phrase").distinct(), ["doc_key", "line_no", "phrase"], "left_anti")
    place = F.when(F.col("other").isNotNull(), F.concat(F.lit("line "), F.col("other").cast("string"), F.lit(": "), F.substring(F.coalesce("other_phrase", F.lit("")), 1, 40))).otherwise("elsewhere")
    fix = F.trim(F.coalesce("fix", F.lit("")))
    out = kept.select(
        "doc_key", "line_no", "phrase", fix.alias("fix"), F.concat(F.trim(F.coalesce("why", F.lit(""))), F.lit(" / "), place).alias("why"), F.concat(F.lit("which is right: "), place).alias("check"),
        F.when(fix == "", "ask").otherwise("fix").alias("decide"),
    )
    keys = ["doc_key", "line_no", "phrase"]  # of several answers on one phrase, one with a fix
    best = out.groupBy(*keys).agg(F.max_by(F.struct("fix", "why", "check", "decide"), F.struct((F.col("fix") != "").alias("has"), F.col("fix"), F.col("why"))).alias("b"))
    return best.select(*keys, "b.*")


def relocate(hints: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_key, phrase, hint) to the nearest line that has the phrase."""
    near = hints.join(lines, "doc_key").where(F.contains("text", F.col("phrase")))
    return near.groupBy("doc_key", "phrase", "hint").agg(F.min_by("line_no", F.struct(F.abs(F.col("line_no") - F.col("hint")), F.col("line_no"))).alias("line_no"))


def halves(pieces: DataFrame, failed: Column, least: int = 20) -> DataFrame:
    """Pieces (doc_key, first, last): those that failed and have ``least`` lines or more as two halves."""
    middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
    two = F.array(F.struct(F.col("first").alias("first"), middle.alias("last")), F.struct((middle + 1).alias("first"), F.col("last").alias("last")))
    one = F.array(F.struct(F.col("first").alias("first"), F.col("last").alias("last")))
    return pieces.select("doc_key", F.inline(F.when(failed & (F.col("last") - F.col("first") + 1 >= least), two).otherwise(one)))

"""Answers of review sheets: short replies in a conversation and the answer column of a sheet, by question number.

Nothing is guessed.  A line that cannot be read, or a question left to an opinion that is empty, is a problem, and a sheet
with a problem gives no answers at all.  Everything is built-in expressions over one row a sheet; questions and replies of a
sheet are what one person answers at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words of answers, of leaving it to the opinion, and of a question not answered yet.
EDIT, KEEP, HOLD, DIRECT, FREE = "고침", "그대로", "보류", "직접", "글"
AS_OPINION, NOT_YET = "의견대로", "아직 안 고름"
KINDS = (EDIT, KEEP, HOLD, DIRECT)
# Marks that end a short answer; a number with text behind it; columns of a sheet with and without opinions.
TAIL = r"[ \t.。!！]+$"
NUMBERED = r"(?s)^(\d+)\s*(?:번(?:\s*[:.)]\s*|\s+)|[:.)]\s+)(\S.*)$"
WIDTH, WIDTH_WITHOUT_OPINION = 6, 7

_ANSWERS = "array<struct<number:int,answer:string>>"


def _bare(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")), r"^[「」]+|[「」]+$", ""))


def _untailed(text: Column) -> Column:
    return F.regexp_replace(text, TAIL, "")


def answer_kind(answer: Column | str) -> Column:
    """keep, hold or edit by how the answer starts, blank without one, free for any other text."""
    c = F.col(answer) if isinstance(answer, str) else answer
    a = F.trim(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^`+|`+$", ""))
    return F.when(a == "", "blank").when(a.startswith(KEEP), "keep").when(a.startswith(HOLD), "hold").when(a.startswith(EDIT) | a.startswith(DIRECT), "edit").otherwise("free")


def _read(line: Column, kinds: tuple[str, ...]) -> Column:
    """struct(answers, delegated, problem) of one line of a reply."""
    names = "|".join(kinds)
    grouped = rf"^({'|'.join(k for k in kinds if k != DIRECT)})\s+((?:[Qq]?\d+번?[\s,]*)+)$"
    item = rf"(?:^|,\s*|\s+)([Qq]?\d+)번?\s*[:.]?\s*(?={names})"
    marked = r"(?s)^[Qq](\d+)번?\s*[:.]?\s*(.*)$"
    delegates = rf"^(?:전부\s+)?{AS_OPINION}\s*,?\s*(?:단\s*)?"
    number = lambda c: F.regexp_extract(c, r"\d+", 0).cast("int")
    one = lambda n, a: F.array(F.struct(number(n).alias("number"), a.alias("answer"))).cast(_ANSWERS)
    none = F.array().cast(_ANSWERS)
    says = lambda answers, delegated, problem=None: F.struct(answers.alias("answers"), delegated.alias("delegated"), F.lit(problem).cast("string").alias("problem"))
    no = F.lit(False)

    left = line.startswith(AS_OPINION) | line.startswith(f"전부 {AS_OPINION}")
    rest = F.when(left, F.regexp_replace(line, delegates, "")).otherwise(line)
    short = _untailed(rest)
    many = F.transform(F.regexp_extract_all(F.regexp_extract(short, grouped, 2), F.lit(r"(\d+)"), F.lit(1)), lambda n: F.struct(n.cast("int").alias("number"), F.regexp_extract(short, grouped, 1).alias("answer"))).cast(_ANSWERS)
    # each item starts at a mark, its number ends at another; what stands before the first mark belongs to none
    parts = F.split(F.regexp_replace(rest, item, "\u0001$1\u0002"), "\u0001")
    items = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(number(F.substring_index(p, "\u0002", 1)).alias("number"), F.trim(F.regexp_replace(F.trim(F.substring_index(p, "\u0002", -1)), ",+$", "")).alias("answer"))).cast(_ANSWERS)
    ahead, some = F.get(parts, 0), F.size(parts) > 1
    written = rest.rlike(NUMBERED) & (~some | (ahead != ""))
    return (
        F.when((line == "") | line.startswith(NOT_YET), says(none, no))
        .when(line.rlike(marked), says(one(F.regexp_extract(line, marked, 1), F.trim(F.regexp_extract(line, marked, 2))), no))
        .when(left & (short == ""), says(none, left))
        .when(short.rlike(grouped), says(many, left))
        .when(written & some, says(none, left, "another answer behind a written one"))
        .when(written, says(one(F.regexp_extract(rest, NUMBERED, 1), F.trim(F.regexp_extract(rest, NUMBERED, 2))), left))
        .when(~some | (F.regexp_replace(ahead, "[ ,]", "") != ""), says(none, left, "not understood"))
        .otherwise(says(items, left))
    )


def read_replies(replies: DataFrame, questions: DataFrame | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(sheet_id, answers, problems): one row for each sheet that was replied to.

    Replies are (sheet_id, seq, text), texts of one or more lines; questions are (sheet_id, number, opinion).  Of several
    answers to a question the last one counts, whatever its line; questions nobody named take the opinion once the reply leaves
    it to the opinions.  A sheet of one question may be answered without its number.  Null texts are empty.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))), lambda r: r["text"]), "\n")
    said = replies.groupBy("sheet_id").agg(F.translate(joined, "\u0001\u0002", "").alias("reply"))
    if questions is None:
        said = said.withColumn("asked", F.array().cast("array<struct<number:int,opinion:string>>"))
    else:
        asked = questions.groupBy(F.col("sheet_id").alias("_sheet")).agg(F.array_sort(F.collect_list(F.struct(F.col("number").cast("int").alias("number"), F.trim(F.coalesce("opinion", F.lit(""))).alias("opinion")))).alias("asked"))
        said = said.join(asked, F.col("sheet_id").eqNullSafe(F.col("_sheet")), "left").drop("_sheet").withColumn("asked", F.coalesce("asked", F.array().cast("array<struct<number:int,opinion:string>>")))
    whole = _untailed(_bare(F.col("reply")))
    alone = (F.size("asked") == 1) & whole.rlike("^(?:" + "|".join(kinds) + ")") & ~whole.rlike(r"\d")
    read = F.transform(F.transform(F.split("reply", r"\r?\n"), _bare), lambda line: _read(line, kinds))
    out = said.withColumn("whole", whole).withColumn("alone", alone).withColumn("read", read)
    out = out.withColumn("named", F.flatten("read.answers")).withColumn("delegated", F.exists("read", lambda r: r["delegated"]))
    # a later answer to the same question takes the place of an earlier one
    last = F.transform(F.array_distinct("named.number"), lambda n: F.element_at(F.filter("named", lambda a: a["number"] == n), -1))
    open_ = F.filter("asked", lambda q: ~F.array_contains("named.number", q["number"]))
    taken = F.transform(F.filter(open_, lambda q: q["opinion"] != ""), lambda q: F.struct(q["number"].alias("number"), F.concat(q["opinion"], F.lit(f" ({AS_OPINION})")).alias("answer")))
    empty = F.filter(open_, lambda q: q["opinion"] == "")
    both = F.when(F.col("delegated"), F.concat(last, taken)).otherwise(last)
    lines = F.array_compact("read.problem")
    opinions = F.when(F.col("delegated") & (F.size("asked") == 0), F.array(F.lit("no opinions"))).when(F.col("delegated"), F.transform(empty, lambda q: F.concat(F.lit("no opinion: "), q["number"].cast("string")))).otherwise(F.array().cast("array<string>"))
    problems = F.when(F.col("alone"), F.array().cast("array<string>")).otherwise(F.concat(lines, opinions))
    only = F.array(F.struct(F.get("asked.number", 0).alias("number"), F.col("whole").alias("answer")))
    out = out.select("sheet_id", F.when(F.col("alone"), only).otherwise(both).cast(_ANSWERS).alias("answers"), problems.alias("problems"))
    return out.withColumn("answers", F.when(F.size("problems") > 0, F.array().cast(_ANSWERS)).otherwise(F.col("answers")))


def answers(read: DataFrame) -> DataFrame:
    """(sheet_id, number, answer, kind, by_opinion) of sheets that were read without a problem."""
    each = read.where(F.size("problems") == 0).select("sheet_id", F.inline("answers"))
    return each.select("sheet_id", "number", "answer", answer_kind("answer").alias("kind"), F.endswith("answer", F.lit(f"({AS_OPINION})")).alias("by_opinion"))


def sheet_rows(sheets: DataFrame, mark: str) -> DataFrame:
    """(sheet_id, number, opinion, answer, key, problem) of the rows of sheets (sheet_id, raw), Markdown tables with numbers in front.

    ``mark`` starts the comment behind the table that holds each row's key as JSON by number (Q1, Q2, …); a sheet without it
    is one row with a problem, and so is a row with another number of cells.  An answer that only says to take the opinion takes
    it, if there is one.
    """
    comment = rf"(?s)<!--\s*{mark}\s*(.*?)-->"
    held = sheets.where("raw IS NOT NULL").withColumn("keys", F.from_json(F.regexp_extract("raw", comment, 1), "map<string,string>")).withColumn("has", F.col("raw").rlike(comment))
    lost = held.where(~F.col("has")).select("sheet_id", F.lit(None).cast("int").alias("number"), F.lit(None).cast("string").alias("opinion"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("key"), F.lit("no keys").alias("problem"))
    lines = held.where("has").select("sheet_id", "keys", F.explode(F.split(F.regexp_extract("raw", rf"(?s)^(.*?)<!--\s*{mark}", 1), r"\r?\n")).alias("line")).where(F.col("line").rlike(r"^\s*\|\s*Q?\d+\s*\|"))
    inner = F.regexp_replace(F.regexp_replace(F.trim("line"), r"^\|", ""), r"(?<!\\)\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(F.replace(F.trim(c), F.lit("\\|"), F.lit("|"))))
    row = lines.select("sheet_id", "keys", cells.alias("c"))
    opinion = F.when(F.size("c") == WIDTH, F.element_at("c", -2))
    own = F.element_at("c", -1)
    fits = F.size("c").isin(WIDTH, WIDTH_WITHOUT_OPINION)
    number = F.regexp_extract(F.element_at("c", 1), r"\d+", 0)
    answer = F.when((own == AS_OPINION) & (F.coalesce(opinion, F.lit("")) != ""), F.concat(opinion, F.lit(f" ({AS_OPINION})"))).otherwise(own)
    told = row.select("sheet_id", number.cast("int").alias("number"), F.when(fits, opinion).alias("opinion"), F.when(fits, answer).alias("answer"), F.try_element_at("keys", F.concat(F.lit("Q"), number)).alias("key"), F.when(~fits, "wrong number of cells").alias("problem"))
    return told.union(lost)

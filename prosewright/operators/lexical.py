"""Vocabulary against a baseline: rare and over-used terms, skew between classes, rates per corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosewright.functions.text import let

RARE_MOST, GATE_MOST = 40, 60
OVER_BASE, OVER_COUNT, OVER_RATIO = (40, 300), 3, 350.0


def words(text: Column | str, least: int = 2) -> Column:
    """Tokens of letters, lower-cased: the tokenizer where no analyser is installed."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{{max(least, 1)},}}"), F.lit(0))


def has_words(text: Column | str, least: int = 2) -> Column:
    """Whether ``words`` finds any.

    Letters are letters in lower case too, but for \u0130, which becomes two characters: only texts without a run free of it are lower-cased.
    """
    n = max(least, 1)
    return F.rlike(text, F.lit(rf"[\p{{L}}&&[^\x{{130}}]]{{{n}}}")) | F.rlike(F.lower(text), F.lit(rf"\p{{L}}{{{n}}}"))


def counted(tokens: Column) -> Column:
    """(lexeme, n) of an array of tokens: lengths of the runs of equal ones in order, so that a row is all that is held."""

    def runs(w):
        first = F.filter(F.transform(w, lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get(w, i - 1)), i)), lambda i: i.isNotNull())
        return let(first, lambda at: F.transform(at, lambda s, j: F.struct(F.get(w, s).alias("lexeme"), (F.coalesce(F.get(at, j + 1), F.size(w)) - s).cast("long").alias("n"))))

    return let(F.sort_array(tokens), runs)


def term_counts(documents: DataFrame, tokens: Column, key: str = "doc_key") -> DataFrame:
    """(doc_key, lexeme, n).

    Terms are counted within a document's row.  Only rows that share their key with another, or have none, are dealt by it and counted
    together.  Texts are shuffled once to tell them, and no token is; both parts lie by key, so that what joins the counts by document
    shuffles none either.
    """
    repeated = documents.groupBy(F.col(key).alias("again")).count().where("count > 1").select("again")
    same, keyless = F.col(key) == F.col("again"), F.col(key).isNull()
    each = lambda rows: rows.select(key, F.inline(counted(tokens)))
    again = documents.join(repeated, same, "left_semi").unionByName(documents.where(keyless))
    shared = each(again.repartition(F.col(key))).groupBy(key, "lexeme").agg(F.sum("n").alias("n"))
    return each(documents.where(~keyless).join(repeated, same, "left_anti")).unionByName(shared)


def baseline(counts: DataFrame) -> DataFrame:
    """(lexeme, base, docs): the corpus frequency table."""
    return counts.groupBy("lexeme").agg(F.sum("n").alias("base"), F.count("*").alias("docs"))


def uses(documents: DataFrame, tokens: Column) -> DataFrame:
    """(lexeme, base): what ``baseline`` sums up, straight from texts, which neither deals them nor counts by document."""
    return documents.select(F.explode(tokens).alias("lexeme")).groupBy("lexeme").agg(F.count("*").alias("base"))


def frequencies(documents: DataFrame, tokens: Column) -> DataFrame:
    """(lexeme, base, docs): the corpus frequency table straight from texts; one aggregation, combined before the shuffle."""
    words_of = documents.select(tokens.alias("w"))
    uses = words_of.select(F.explode("w").alias("lexeme"), F.lit(1).alias("use"), F.lit(0).alias("doc"))
    docs = words_of.select(F.explode(F.array_distinct("w")).alias("lexeme"), F.lit(0).alias("use"), F.lit(1).alias("doc"))
    return uses.union(docs).groupBy("lexeme").agg(F.sum("use").alias("base"), F.sum("doc").alias("docs"))


def seldom(mine: DataFrame, base: DataFrame, most: int) -> DataFrame:
    """``mine`` without terms that the baseline has over ``most`` times besides, as far as a broadcast tells.

    Terms with over a 500,000th of all uses are told by it, less than 500,000 whatever the corpus; they are most of the uses.
    """
    limit = base.agg(F.greatest(F.lit(most), F.sum("base") / 500_000).alias("limit"))
    common = base.join(F.broadcast(limit)).where(F.col("base") > F.col("limit")).select("lexeme", F.col("base").alias("often"))
    return mine.join(F.broadcast(common), "lexeme", "left").where(F.col("often").isNull() | (F.col("often") - F.col("n") <= most)).drop("often")


def rare_terms(mine: DataFrame, base: DataFrame, most: int = RARE_MOST, least_mine: int = 1) -> DataFrame:
    """Terms of each document that the baseline (without the document itself) has at most ``most`` times."""
    base = base.where("lexeme IS NOT NULL")  # said once, so that its uses are one and the same plan
    joined = seldom(mine.where(F.col("n") >= least_mine), base, most).join(base, "lexeme", "left").withColumn("others", F.coalesce("base", F.lit(0)) - F.col("n"))
    return joined.where(F.col("others") <= most).select("doc_key", "lexeme", "n", "others")


def gate(mine: DataFrame, base: DataFrame, approved: DataFrame, most: int = GATE_MOST, keys: DataFrame | None = None) -> DataFrame:
    """(doc_key, blocked, passes, terms): documents with terms that the corpus has at most ``most`` times and nobody approved (lexeme).

    The limit of the gate is higher than that of the list of rare terms, as it also stops terms a reader would wonder at.  ``keys``
    (doc_key) lists the documents of ``mine`` where that is known without counting.
    """
    base = base.where("lexeme IS NOT NULL")  # said once, so that its uses are one and the same plan
    joined = seldom(mine, base, most).join(base, "lexeme", "left").where(F.coalesce("base", F.lit(0)) <= most).join(approved.select("lexeme").distinct(), "lexeme", "left_anti")
    term = F.struct(F.coalesce("base", F.lit(0)).alias("base"), (-F.col("n")).alias("less"), "lexeme")
    found = joined.select("doc_key", F.when(F.col("doc_key").isNotNull(), term).alias("term"))  # a document without a key has no terms of its own
    listed = (mine if keys is None else keys).select("doc_key").distinct().withColumn("term", F.lit(None).cast(found.schema["term"].dataType))
    out = listed.unionByName(found).groupBy("doc_key").agg(F.count("term").alias("blocked"), F.array_sort(F.collect_list("term")).alias("t"))
    return out.select("doc_key", "blocked", (F.col("blocked") == 0).alias("passes"), F.transform("t", lambda x: x["lexeme"]).alias("terms"))


def overused_terms(mine: DataFrame, base: DataFrame, sizes: DataFrame, base_span=OVER_BASE, least=OVER_COUNT, ratio=OVER_RATIO) -> DataFrame:
    """Terms of middling baseline frequency that a document has far more densely than the corpus."""
    total = sizes.agg(F.sum("chars").alias("all_chars"))
    joined = mine.where(F.col("n") >= least).join(base, "lexeme").where((F.col("base") > base_span[0]) & (F.col("base") <= base_span[1]))
    density = (F.col("n") / F.col("chars")) / (F.col("base") / F.col("all_chars"))
    return joined.join(sizes, "doc_key").join(F.broadcast(total)).withColumn("ratio", F.round(density, 6)).where(F.col("ratio") >= ratio).select("doc_key", "lexeme", "n", "base", "ratio")


def not_whitelisted(uses: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Uses (lexeme, line, path) of which no whitelist entry (word, context or *, path glob or *) covers the occurrence."""
    pattern = F.concat(F.lit("^"), F.replace(F.regexp_replace("scope", r"([.+^$()\[\]{}|\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("$"))
    entries = whitelist.withColumn("scope_pattern", pattern)
    covers = (uses["lexeme"] == entries["word"]) & ((entries["context"] == "*") | F.contains(uses["line"], entries["context"])) & F.rlike(uses["path"], entries["scope_pattern"])
    return uses.join(entries, covers, "left_anti")


def class_skew(counts: DataFrame, classes: DataFrame, first: str, second: str, least_docs: int = 5) -> DataFrame:
    """(lexeme, df1, df2, skew): smoothed document-frequency ratio between two classes."""
    sizes = classes.groupBy().agg(F.count_if(F.col("class") == first).alias("n1"), F.count_if(F.col("class") == second).alias("n2"))
    df = counts.join(classes, "doc_key").groupBy("lexeme").agg(F.count_if(F.col("class") == first).alias("df1"), F.count_if(F.col("class") == second).alias("df2"))
    rate = lambda k, n: (F.col(k) + 0.5) / (F.col(n) + 1)
    return df.where(F.col("df1") + F.col("df2") >= least_docs).join(F.broadcast(sizes)).select("lexeme", "df1", "df2", F.round(rate("df1", "n1") / rate("df2", "n2"), 6).alias("skew"))


def vocabulary_rates(counts: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """(group, lexeme, n, per_10k): uses for each 10,000 tokens of the group."""
    by = counts.join(groups, "doc_key").groupBy(group, "lexeme").agg(F.sum("n").alias("n"))
    totals = by.groupBy(group).agg(F.sum("n").alias("total"))
    return by.join(F.broadcast(totals), group).select(group, "lexeme", "n", F.round(F.col("n") * 10000 / F.col("total"), 6).alias("per_10k"))


def scrub(counts: DataFrame, deny: DataFrame, name_like: str = r"(?:님|씨|㈜|주식회사)$") -> DataFrame:
    """Without lexemes that look like names or are on the deny list."""
    return counts.where(~F.col("lexeme").rlike(name_like)).join(F.broadcast(deny.select("lexeme")), "lexeme", "left_anti")


def noun_pileups(tokens: DataFrame, thresholds: list[int]) -> DataFrame:
    """(threshold, runs, longest): runs of tokens without a particle at least so long; tokens are (doc_key, pos, bare)."""
    run = F.col("pos") - F.row_number().over(Window.partitionBy("doc_key").orderBy("pos"))
    runs = tokens.where("bare").withColumn("run", run).groupBy("doc_key", "run").agg(F.count("*").alias("length"))
    swept = runs.select("length", F.explode(F.lit(thresholds)).alias("threshold"))
    return swept.where("length >= threshold").groupBy("threshold").agg(F.count("*").alias("runs"), F.max("length").alias("longest"))


def row_pileups(documents: DataFrame, bare: Column, thresholds: list[int]) -> DataFrame:
    """``noun_pileups`` of whole documents, ``bare`` being an array with a flag for each token: runs are told within the row."""
    marks = F.array_join(F.transform(bare, lambda b: F.when(b, "1").otherwise("0")), "")
    lengths = F.transform(F.regexp_extract_all(marks, F.lit("1+"), F.lit(0)), lambda r: F.length(r).cast("long"))
    swept = documents.select(F.explode(lengths).alias("length")).select("length", F.explode(F.lit(thresholds)).alias("threshold"))
    return swept.where("length >= threshold").groupBy("threshold").agg(F.count("*").alias("runs"), F.max("length").alias("longest"))


def context_counts(lines: DataFrame, word: str) -> DataFrame:
    """How often each context has a word right behind a Hangul letter."""
    return lines.select(F.explode(F.regexp_extract_all("text", F.lit(rf"([가-힣]+{word})"), F.lit(1))).alias("context")).groupBy("context").count()


def text_features(documents: DataFrame) -> DataFrame:
    """(doc_key, sentences, mean_words, cv_words, commas_a_sentence, diversity): features that tell styles apart."""
    said = documents.select("doc_key", F.explode(F.split("raw", r"[.!?]+")).alias("s"))
    said = said.withColumn("n", F.regexp_count("s", F.lit(r"[^ \t\n\r\f\x0B]+"))).where("n > 0").withColumn("commas", F.regexp_count("s", F.lit(",")))
    by = said.groupBy("doc_key").agg(F.count("*").alias("sentences"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.sum("commas").alias("commas"))
    kinds = term_counts(documents, words("raw")).groupBy("doc_key").agg(F.count("*").alias("kinds"), F.sum("n").alias("tokens"))
    return by.join(kinds, "doc_key").select(
        "doc_key", "sentences", F.round("mean", 4).alias("mean_words"), F.round(F.try_divide("sd", "mean"), 4).alias("cv_words"),
        F.round(F.col("commas") / F.col("sentences"), 4).alias("commas_a_sentence"), F.round(F.col("kinds") / F.col("tokens"), 4).alias("diversity"),
    )

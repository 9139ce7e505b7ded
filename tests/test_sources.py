import pytest
from prosewright.sources import formats, sinks

FILES = {
    "a.md": "---\ntitle: t\n---\n# 제목\n글 `code` 끝\n\n```\nx\n```\n",
    "b.html": "<title>이름</title><style>p{}</style><p>첫 <strong>문단</strong></p><script>no</script><pre>no</pre>",
    "c.json": '{"a": {"b/c": ["하나", 2, "둘"]}, "n": 1}',
    "d.jsonl": '{"x": "가"}\nnot json\n{"y": "나"}\n',
    "e.yaml": "k: 값\nn: 3\nl:\n  - 하나\n  - 2\n",
    "f.properties": "# c\n! d\nname = 값\\\n  이어짐\nkey:\\uAC00\nempty=\n",
    "g.txt": "\u001b]0;t\u0007첫 줄  \n\n둘째\n",
}


@pytest.fixture(scope="module")
def units(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "sub").mkdir()
    for i, (name, text) in enumerate(FILES.items()):
        (root / ("sub" if i % 2 else ".") / name).write_text(text, encoding="utf-8")
    (root / "skip.bin").write_bytes(b"\0")
    found = {}
    for r in formats.text_units(formats.read_documents(spark, str(root))).orderBy("path", "unit_id").collect():
        found.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    return found


def test_every_format(units):
    assert set(units) == set(FILES)
    assert [(u["line_number"], u["text"]) for u in units["a.md"]] == [(4, "# 제목"), (5, "글        끝")]
    assert [u["text"] for u in units["b.html"]] == ["이름", "첫 문단"]
    assert [(u["logical_path"], u["text"]) for u in units["c.json"]] == [("/a/b~1c/0", "하나"), ("/a/b~1c/2", "둘")]
    assert [(u["line_number"], u["kind"], u["text"]) for u in units["d.jsonl"]] == [(1, "string", "가"), (2, "invalid_jsonl", "not json"), (3, "string", "나")]
    assert [(u["logical_path"], u["line_number"], u["text"]) for u in units["e.yaml"]] == [("/k", 1, "값"), ("/l/0", 4, "하나")]
    assert [(u["logical_path"], u["line_number"], u["text"]) for u in units["f.properties"]] == [("name", 3, "값이어짐"), ("key", 5, "가")]
    assert [(u["line_number"], u["text"]) for u in units["g.txt"]] == [(1, "첫 줄"), (3, "둘째")]
    assert units["g.txt"][0]["unit_id"] == "unit-000001"


def test_no_readable_file_is_an_error(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"1")
    with pytest.raises(ValueError):
        formats.read_documents(spark, str(tmp_path))


def test_small_tables(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("# c\n몇일\t며칠\n되요\t돼요\tany\twarn\t가되요, 나되요\t까닭\n\n", encoding="utf-8")
    got = {r["wrong"]: (r["right"], r["scope"], r["level"], r["excepts"]) for r in formats.spelling_dictionary(spark, str(tmp_path / "s.tsv")).collect()}
    assert got == {"몇일": ("며칠", "head", "err", []), "되요": ("돼요", "any", "warn", ["가되요", "나되요"])}
    (tmp_path / "b.txt").write_text("# c\nAcme = 에크미, 아크메\nnone\n", encoding="utf-8")
    assert {(r["wrong"], r["canonical"]) for r in formats.inverted_list(spark, str(tmp_path / "b.txt")).collect()} == {("에크미", "Acme"), ("아크메", "Acme")}
    (tmp_path / "d.txt").write_text("[people]\n홍길동\n# c\n[company]\nacme\n", encoding="utf-8")
    assert {(r["term"], r["section"]) for r in formats.deny_list(spark, str(tmp_path / "d.txt")).collect()} == {("홍길동", "people"), ("acme", "company")}
    (tmp_path / "q.toml").write_text('[rules]\na = "off"\n')
    (tmp_path / "x" / "y").mkdir(parents=True)
    assert formats.find_config(spark, str(tmp_path / "x" / "y"), "q.toml") == {"rules": {"a": "off"}}
    lines = spark.createDataFrame([("d", 1, "# 절"), ("d", 2, "| a | b\\|c |"), ("d", 3, "|--|--|")], "doc_key string, line_no int, text string")
    assert [(r["section"], r["cells"]) for r in formats.pipe_table(lines).collect()] == [("절", ["a", "b|c"])]
    rows = spark.createDataFrame([(1, '{"a": "x", "b": {"c/d": "y"}}')], "i int, j string")
    assert {(r["pointer"], r["text"]) for r in formats.json_units(rows, "j").collect()} == {("/a", "x"), ("/b/c~1d", "y")}


def test_sinks(spark, tmp_path):
    found = spark.createDataFrame([("d", 1, "k", "err", "m")], "doc_key string, line_no int, kind string, severity string, match string")
    sinks.write_report(found, str(tmp_path / "t"), "text")
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "d:1:err:k:m"
    assert sinks.exit_status(found) == 1 and sinks.exit_status(found, strict=False) == 0
    assert sinks.append_rows(found, str(tmp_path / "l"), str(tmp_path / "f")) and sinks.append_rows(found, str(tmp_path / "l"), str(tmp_path / "f"))
    assert sinks.read_ledger(spark, "doc_key string, line_no int", str(tmp_path / "l")).count() == 1
    made = []
    make = lambda: (made.append(1), found)[1]
    sinks.cached(spark, str(tmp_path / "c"), make)
    assert sinks.cached(spark, str(tmp_path / "c"), make).count() == 1 and len(made) == 1


def test_what_cannot_be_parsed_is_one_unit_that_says_so(spark):
    own = [("a", "json", "{broken"), ("b", "yaml", "a: [1"), ("c", "xls", "?"), ("d", "json", '{"k": "v"}'), ("e", "json", None), ("f", "json", "[" * 100_000)]
    got = {r["path"]: (r["kind"], r["text"][:5]) for r in formats.text_units(spark.createDataFrame(own, "path string, format string, raw string")).collect()}
    assert {p: k for p, (k, _) in got.items()} == {"a": "invalid", "b": "invalid", "c": "invalid", "d": "string", "f": "invalid"} and got["d"][1] == "v"

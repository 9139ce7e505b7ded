import html.parser
import random
import re

import pytest
from prosewright.operators import elements as E
from prosewright.operators import rules as R
from pyspark.sql import functions as F


class Tree(html.parser.HTMLParser):
    """Elements by another parser: its events, with the ends that HTML lets one leave out."""

    def __init__(self):
        super().__init__()
        self.open, self.found = [], []

    def end(self, i):
        for e in self.open[i:]:
            e["post"] = len(self.found) - 1
        del self.open[i:]

    def within(self, tags, upto):
        for i in reversed(range(len(self.open))):
            if self.open[i]["tag"] in tags:
                return i
            if self.open[i]["tag"] in upto:
                break
        return None

    def handle_starttag(self, tag, attrs):
        if tag in E.ENDS_P and (i := self.within({"p"}, E.HIDES_P)) is not None:
            self.end(i)
        if tag in E.ENDS and (i := self.within(*E.ENDS[tag])) is not None:
            self.end(i)
        e = {"tag": tag, "pre": len(self.found), "post": len(self.found), "depth": len(self.open), "text": ""}
        self.found.append(e)
        if tag not in E.VOID:
            self.open.append(e)

    def handle_endtag(self, tag):
        if (i := self.within({tag}, set())) is not None:
            self.end(i)

    def handle_data(self, data):
        if self.open:
            self.open[-1]["text"] += data


def other(raw):
    tree = Tree()
    tree.feed(re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", raw))
    tree.close()
    tree.end(0)
    return [(e["pre"], e["post"], e["tag"], e["depth"]) for e in tree.found], [re.sub(r"\s+", "", e["text"]) for e in tree.found]


def same_text(own):
    return re.sub(r"[\s\u0001]+", "", html.unescape(own))


def test_all_pages_equal_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("page_id AS doc_key", "html AS raw")
    got = {}
    for r in E.elements(pages).collect():
        got.setdefault(r["doc_key"], []).append(r)
    for r in pages.collect():
        tree, texts = other(r["raw"] or "")
        own = sorted(got.get(r["doc_key"], []), key=lambda e: e["pre"])
        assert [(e["pre"], e["post"], e["tag"], e["depth"]) for e in own] == tree
        if "<!--" not in (r["raw"] or ""):
            assert [same_text(e["own"]) for e in own] == texts


def test_random_nesting_equals_another_parser():
    rng = random.Random(4)
    tags = ["section", "article", "blockquote", "p", "ul", "li", "b", "dl", "dt", "dd", "table", "tr", "td", "br", "div"]
    for _ in range(400):
        raw = "".join(rng.choice([f"<{t}>", f'<{t} a="x>y">', f"</{t}>", "w ", "<!-- <p> -->"]) for t in rng.choices(tags, k=rng.randint(0, 40)))
        tree, texts = other(raw)
        got = E.parse(raw)
        assert [e[:4] for e in got] == tree, raw
        assert [same_text(e[6]) for e in got] == texts, raw


def test_owners_and_own_text():
    raw = "<section><h2>a</h2><section><dl><dt>x</dt></dl></section><dl><dt>y<b>z</b></dt></dl></section><dt>w</dt>"
    got = E.parse(raw, {"section", "dt"})
    assert [(e[2], e[4], e[6]) for e in got] == [("section", None, "<h2>a</h2>\u0001<dl>\u0001</dl>"), ("section", 0, "<dl>\u0001</dl>"), ("dt", 2, "x"), ("dt", 0, "y<b>z</b>"), ("dt", None, "w")]
    outer, inner = got[0], got[1]
    assert outer[0] < inner[0] <= outer[1] and not inner[0] < got[3][0] <= inner[1]
    assert E.parse("", None) == [] and E.parse("no tags <", None) == []


def test_very_deep_and_long_pages(spark):
    raw = "<div>" * 20_000 + "x" + "</div>" * 20_000
    got = E.parse(raw)
    assert len(got) == 20_000 and got[0][:2] == (0, 19_999) and got[-1][6] == "x"
    pages = spark.createDataFrame([("a", "<p>long " * 20_000), ("b", None), ("c", "")], "doc_key string, raw string")
    assert E.elements(pages, ("p",)).groupBy("doc_key").agg(F.count("*")).collect() == [("a", 20_000)]


def quoted(spark, raw):
    pages = spark.createDataFrame([("d", f"<h1>이름</h1><p>한 줄</p>{raw}")], "doc_key string, raw string")
    return sorted(r["match"] for r in R.html_findings(pages).where("kind = 'commentary_as_quote'").collect())


def test_nested_quotations_are_judged_each(spark):
    assert quoted(spark, "<blockquote>값이 올랐다.<blockquote>값이 내렸다. (출처: 근거)</blockquote>값이 남았다.</blockquote>") == ["값이 남았다.", "값이 올랐다."]
    assert quoted(spark, "<blockquote>앞<blockquote>값이 내렸다.</blockquote>뒤 (9/4)</blockquote>") == ["값이 내렸다."]


@pytest.mark.parametrize("nested", [False, True])
def test_labels_belong_to_the_nearest_block(spark, nested):
    blocks = "".join(f"<section><dl><dt>이름</dt><dd>a</dd><dt>항목{i}</dt><dd>b</dd></dl></section>" for i in range(4))
    raw = f"<article><h2>모음</h2>{blocks}</article>" if nested else blocks
    pages = spark.createDataFrame([("d", raw)], "doc_key string, raw string")
    assert "block_label_mismatch" in {r["kind"] for r in R.html_findings(pages).collect()}

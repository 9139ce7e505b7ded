"""HTML as a table of elements: one pass over a page's tags numbers elements in document order.

``pre`` is an element's number and ``post`` that of the last element inside it, so one element contains another exactly if
pre < other.pre <= post; ``owner`` is the pre of the nearest element around it that was asked for.  ``own`` is the markup inside an element that
lies in no nested element that was asked for, with U+0001 where one was left out, so that every text belongs to one element.

Elements that never have an end tag are empty; ends that HTML lets one leave out are supplied; end tags without a start are
ignored; what is open at the end of a page ends there.  Tags in comments and in scripts and styles do not count.  A null
page has no elements.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright.functions.spans import pandas_function
from prosewright.functions.text import strip_tags
from prosewright.operators.structure import clean_html

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
# Fixed values of HTML: elements without an end tag; elements whose start ends an open paragraph, and what hides the paragraph from
# them; elements whose start ends others (which, and up to where).
VOID = set("area base br col embed hr img input link meta source track wbr".split())
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
HIDES_P = set("applet button caption html marquee object table td template th".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
CUT = "\u0001"
ELEMENT = "array<struct<pre:int,post:int,tag:string,depth:int,owner:int,head:string,own:string>>"


def parse(raw: str, kinds: set[str] | None = None) -> list[tuple]:
    """(pre, post, tag, depth, owner, head, own) of the elements of these kinds (all, if None), in document order."""
    found: list[list] = []
    stack: list[tuple[str, int, list | None]] = []  # tag, pre, row
    asked: list[list] = []  # rows of the open elements that were asked for
    opened: Counter = Counter()  # open elements of each kind, so that none is looked for in vain
    count = 0

    def close(at: int) -> None:
        for tag, _, row in reversed(stack[at:]):
            opened[tag] -= 1
            if row:
                row[1] = count - 1
                asked.pop()
        del stack[at:]

    def last(tags: set[str], upto: set[str]) -> int | None:
        if not any(opened[t] for t in tags):
            return None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in upto:
                return None
        return None

    def put(text: str) -> None:
        if asked and text:
            asked[-1][6].append(text)

    at = 0
    for m in TOKEN.finditer(raw):
        put(raw[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, wanted = m[2].lower(), kinds is None or m[2].lower() in kinds
        if m[1]:
            if (i := last({tag}, set())) is not None:
                own = stack[i][2] is not None
                close(i)
                if not own:
                    put(m[0])
            continue
        if tag in ENDS_P and (i := last({"p"}, HIDES_P)) is not None:
            close(i)
        if tag in ENDS and (i := last(*ENDS[tag])) is not None:
            close(i)
        row = None
        if wanted:
            put(CUT)
            row = [count, count, tag, len(stack), asked[-1][0] if asked else None, m[0], []]
            found.append(row)
        else:
            put(m[0])
        count += 1
        if tag not in VOID:
            stack.append((tag, count - 1, row))
            opened[tag] += 1
            if row:
                asked.append(row)
    put(raw[at:])
    close(0)
    return [(*row[:6], "".join(row[6])) for row in found]


def elements_of(raw: Column | str, kinds: tuple[str, ...] | None = None) -> Column:
    """Array of a page's elements, without scripts, styles and code."""
    asked = set(kinds) if kinds else None

    @pandas_function(ELEMENT)
    def parsed(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: parse(p, asked) if p else [])

    return parsed(clean_html(raw))


def elements(pages: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_key, pre, post, tag, depth, owner, head, own) of all elements of these kinds."""
    return pages.select("doc_key", F.inline(elements_of("raw", kinds)))


def paragraphs(pages: DataFrame) -> DataFrame:
    """(doc_key, text) of p elements, whether ended or not; one that begins with a bold conclusion explains it and is left out."""
    each = elements(pages, ("p",)).select("doc_key", F.col("own").alias("text"))
    return each.where(~F.col("text").rlike(r"(?i)^\s*<(?:b|strong)\b")).withColumn("text", strip_tags("text")).where("text != ''")

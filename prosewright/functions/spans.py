"""What needs offsets or alignments: small pandas functions, each over one text or one pair of texts."""

from __future__ import annotations

import difflib
import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

SLICE_CHARS = 1 << 20  # of text that is worked on at once; what it becomes takes many times as much


def slices(batch: tuple[pd.Series, ...]) -> Iterator[tuple[pd.Series, ...]]:
    """A batch in parts of some ``SLICE_CHARS`` characters, so that a worker holds the results of a few texts and not of all."""
    begin = chars = 0
    for at, values in enumerate(zip(*batch, strict=True)):
        chars += sum(len(v) for v in values if isinstance(v, str))
        if chars >= SLICE_CHARS:
            yield tuple(s.iloc[begin : at + 1].reset_index(drop=True) for s in batch)
            begin, chars = at + 1, 0
    if begin < len(batch[0]) or not begin:
        yield tuple(s.iloc[begin:].reset_index(drop=True) for s in batch)


def pandas_function(returns: str):
    """Decorator: a Column function over columns, made when it is called (a type as text needs a session); each row for itself."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns):
            def sliced(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
                for batch in batches:
                    for part in slices(batch if isinstance(batch, tuple) else (batch,)):
                        yield f(*part)

            return F.pandas_udf(sliced, returns)(*columns)

        return call

    return wrap


SPAN = "array<struct<start:int,end:int,text:string>>"


def regex_spans(pattern: str, group: int = 0):
    """Column function: non-overlapping, non-empty matches with 0-based offsets."""
    compiled = re.compile(pattern)

    @F.pandas_udf(SPAN)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(m.start(group), m.end(group), m.group(group)) for m in compiled.finditer(t) if m.end(group) > m.start(group)] if t else [])

    return found


def literal_spans(word: str, overlapping: bool = False):
    """Column function: places of a word; the next search starts one after a hit, or behind it."""
    step = 1 if overlapping else len(word)

    def places(text):
        out, at = [], text.find(word)
        while at >= 0:
            out.append((at, at + len(word), word))
            at = text.find(word, at + step)
        return out

    @F.pandas_udf(SPAN)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: places(t) if t else [])

    return found


def matching(a: str, b: str) -> int:
    """Characters that ``difflib.SequenceMatcher`` without junk matches: the longest shared run, leftmost in ``a`` and then in ``b``, and so on beside it.

    The run's length is searched for by halves over sets of equally long pieces, as a shared run holds shared runs of all
    smaller lengths; parts beside it share nothing longer.  So time grows with the texts' lengths and not with their product.
    """
    total, todo = 0, [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while todo:
        i, j, k, m, most = todo.pop()
        most = min(most, j - i, m - k)
        least, at, n = 0, -1, min(most, 6)
        while least < most:
            if n <= 64:
                pieces = {b[y : y + n] for y in range(k, m - n + 1)}
                found = (x for x in range(i, j - n + 1) if a[x : x + n] in pieces)
            else:  # long pieces are not kept
                prints = {hash(b[y : y + n]) for y in range(k, m - n + 1)}
                found = (x for x in range(i, j - n + 1) if hash(a[x : x + n]) in prints and b.find(a[x : x + n], k, m) >= 0)  # noqa: B023
            at, least, most = next(((x, n, most) for x in found), (at, least, n - 1))
            n = min(2 * least, (least + most + 1) // 2) or (most + 1) // 2
        if not least:
            continue
        total += least
        y = b.find(a[at : at + least], k, m)
        if at > i and y > k:
            todo.append((i, at, k, y, least))
        if at + least < j and y + least < m:
            todo.append((at + least, j, y + least, m, least))
    return total


def similarity(a: str, b: str, least: float = 0.0) -> float:
    """Ratcliff-Obershelp ratio, 0 as soon as an upper bound lies under ``least``."""
    if a == b:
        return 1.0
    if 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return 0.0
    if least and difflib.SequenceMatcher(None, a, b, autojunk=False).quick_ratio() < least:
        return 0.0
    return 2.0 * matching(a, b) / (len(a) + len(b))


@pandas_function("double")
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b, strict=True)])


@pandas_function("array<struct<tag:string,a_from:int,a_to:int,b_from:int,b_to:int>>")
def token_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits between the words and line ends of two texts."""

    def edits(x, y):
        p, q = re.findall(r"\S+|\n", x or ""), re.findall(r"\S+|\n", y or "")
        return [op for op in difflib.SequenceMatcher(None, p, q, autojunk=False).get_opcodes() if op[0] != "equal"]

    return pd.Series([edits(x, y) for x, y in zip(a, b, strict=True)])


@pandas_function("struct<start:int,end:int>")
def quote_range(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """Where a quote stands in a text, white space ignored if need be; nulls if nowhere."""

    def place(t, q):
        if not t or not q:
            return None, None
        if (at := t.find(q)) >= 0:
            return at, at + len(q)
        kept = [i for i, c in enumerate(t) if not c.isspace()]
        squeezed, wanted = "".join(t[i] for i in kept), "".join(q.split())
        at = squeezed.find(wanted) if wanted else -1
        return (kept[at], kept[at + len(wanted) - 1] + 1) if at >= 0 else (None, None)

    return pd.DataFrame([place(t, q) for t, q in zip(text, quote, strict=True)], columns=["start", "end"]).astype("Int32")


@pandas_function("string")
def apply_fixes(text: pd.Series, fixes: pd.Series) -> pd.Series:
    """Replaces [start, end) spans from right to left; a span that overlaps a later one is left out."""

    def fixed(t, spans):
        edge = len(t)
        for f in sorted(spans if spans is not None else [], key=lambda f: (f["start"], f["end"]), reverse=True):
            if f["end"] <= edge:
                t, edge = t[: f["start"]] + f["fix"] + t[f["end"] :], f["start"]
        return t

    return pd.Series([fixed(t or "", f) for t, f in zip(text, fixes, strict=True)])


@pandas_function("struct<start:int,end:int>")
def changed_span(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """From the first to the last place of ``b`` that differs from ``a``."""

    def span(x, y):
        ops = [o for o in difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).get_opcodes() if o[0] != "equal"]
        return (ops[0][3], ops[-1][4]) if ops else (None, None)

    return pd.DataFrame([span(x, y) for x, y in zip(a, b, strict=True)], columns=["start", "end"]).astype("Int32")


# Korean numerals, multipliers and units.
DIGITS = {"영": 0, "일": 1, "이": 2, "삼": 3, "사": 4, "오": 5, "육": 6, "칠": 7, "팔": 8, "구": 9, "한": 1, "두": 2, "세": 3, "네": 4}
SMALL_STEPS, BIG_STEPS = {"십": 10, "백": 100, "천": 1000}, {"만": 10**4, "억": 10**8, "조": 10**12}
UNITS = "퍼센트|개월|시간|%p|%|배|명|건|개|곳|점|위|년|월|일|분|초|원|달러|회|차|번|쪽|줄|자|글자|문장|가지|단계|종|대|장|권|편|호|층|살|세|주"


def number_value(text: str) -> float | None:
    """Value of a numeral in digits, Korean words or both (3만 5천)."""
    total = part = 0.0
    number: float | None = None
    for token in re.findall(r"\d[\d,]*(?:\.\d+)?|[가-힣]", text):
        if token[0].isdigit():
            number = float(token.replace(",", ""))
        elif token in DIGITS:
            number = (number or 0) * 10 + DIGITS[token]
        elif token in SMALL_STEPS:
            part, number = part + (1 if number is None else number) * SMALL_STEPS[token], None
        elif token in BIG_STEPS:
            total, part, number = total + ((part + (number or 0)) or 1) * BIG_STEPS[token], 0.0, None
        else:
            return None
    return round(total + part + (number or 0), 6)


@pandas_function("array<struct<shown:string,value:double,unit:string>>")
def numbers(texts: pd.Series) -> pd.Series:
    """Numbers with their units as values, so that 3만 명 and 30,000명 are equal."""
    pattern = re.compile(rf"((?:\d[\d,]*(?:\.\d+)?\s?[십백천만억조]*\s?)+|[일이삼사오육칠팔구십백천만억조]+)\s?({UNITS})?")

    def found(t):
        out = []
        for m in pattern.finditer(t or ""):
            if (m.group(2) or m.group(1)[0].isdigit()) and (value := number_value(m.group(1))) is not None:
                out.append((m.group(0).strip(), value, m.group(2)))
        return out

    return texts.map(found)

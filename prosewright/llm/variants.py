"""Spelling variant grouping: a bit-sliced position index finds all words one edit apart.

Words are counted over whole texts, and a vocabulary is made of the frequent ones.  Two words one edit apart agree outside one third of the
shorter one, so each word goes to a group for each third it can differ in (as the shorter and as the longer of two).
Within a group the index holds, for each position of that third and each letter, a bitset of the words that have it there.  For one word
the recurrence walks the letters of its third over all words of the group at once: the zero-error set keeps the words that
agree so far, the one-error sets those with one letter replaced or, with positions shifted by one, one letter more.  A pair is
taken in the group of the third that holds its first difference, so each is found once.

Groups over GROUP_WORDS are never gathered: their words are dealt again by each single position of the third, after which a
group holds at most 90 words of the shorter length and 8,100 of the longer, as there are 90 letters.  Nothing is dropped.

Null texts have no runs; a null doc_id counts as the empty string in the hash.  Repeated rows count each.  Ties of counts go to the word that
is smaller in code-point order.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewright.llm.common import Scratch, shuffle_partitions

MIN_CHARS, MIN_COUNT = 5, 3
THIRDS = 3
GROUP_WORDS = 8_192
CHUNK = 1 << 20
HELD_WORDS = 1 << 18  # distinct words a task counts before it hands them on

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RUN, _BREAK = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")


def runs(text: str) -> Iterator[Counter]:
    """How often each run of letters occurs, A-Z lower-cased, in each bounded part of a text."""
    text = text.encode().translate(_LOWER).decode()
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + CHUNK) if len(text) - at > CHUNK else None
        end = cut.start() if cut else len(text)
        yield Counter(_RUN.findall(text, at, end))
        at = end


def with_typing_errors(run: str, start: int, one_in: int) -> str:
    """The run, without one letter if its hash says so; ``start``: the crc32 of what precedes it."""
    h = zlib.crc32(run.encode(), start)
    return run if h % one_in else run[: h % len(run)] + run[h % len(run) + 1 :]


def count_words(docs: DataFrame, one_in: int = 97, min_chars: int = MIN_CHARS) -> DataFrame:
    """word and n over all texts; runs are deleted from where the hash of doc_id and run is divisible by ``one_in``."""

    def counted(batches):
        import pyarrow as pa

        total: Counter = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(f"{key.as_py() or ''}:".encode())
                for part in runs(value.as_py() or ""):
                    for run, n in part.items():
                        word = with_typing_errors(run, start, one_in)
                        if len(word) >= min_chars:
                            total[word] += n
                if len(total) >= HELD_WORDS:
                    yield rows()
                    total.clear()
        yield rows()

    named = docs.select(docs["doc_id"].cast("string").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return named.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class PositionIndex:
    """Bitsets over a list of strings of one length: which of them have a letter at a position."""

    def __init__(self, strings: list[str], length: int):
        self.every = (1 << len(strings)) - 1
        self.at: list[dict[str, int]] = [defaultdict(int) for _ in range(length)]
        for i, string in enumerate(strings):
            for own, letter in zip(self.at, string, strict=True):
                own[letter] |= 1 << i


def one_error(query: str, same: PositionIndex, longer: PositionIndex, at_end: bool) -> tuple[int, int]:
    """Which strings of ``same`` differ by one replaced letter, and which of ``longer`` by one letter more whose first
    difference lies before the end of the query, or at it if ``at_end``."""
    zero, replaced = same.every, 0
    zero_longer, more = longer.every, 0
    for i, letter in enumerate(query):
        has = same.at[i].get(letter, 0)
        replaced = replaced & has | zero & ~has
        zero &= has
        more = (more | zero_longer) & longer.at[i + 1].get(letter, 0)
        zero_longer &= longer.at[i].get(letter, 0)
    return replaced, more | zero_longer if at_end else more & ~zero_longer


def _members(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def near_in_group(words: list[tuple[str, int]], s: int, x: int, y: int) -> Iterator[tuple[str, str, int]]:
    """(word, near word, its n) of words that agree but for positions x to y of the shorter length s; both ways."""
    short = [w for w in words if len(w[0]) == s]
    long = [w for w in words if len(w[0]) == s + 1]
    if not short or len(words) < 2:
        return
    rest = lambda own: [w[x : len(w) - (s - y)] for w, _ in own]
    queries = rest(short)
    same, longer = PositionIndex(queries, y - x), PositionIndex(rest(long), y - x + 1)
    for (word, n), query in zip(short, queries, strict=True):
        replaced, more = one_error(query, same, longer, at_end=y == s)
        for i in _members(replaced):
            yield word, *short[i]
        for i in _members(more):
            yield word, *long[i]
            yield long[i][0], word, n


def _dealt(words: DataFrame, slots: str) -> DataFrame:
    """A row for each word and slot (shorter length s, from x to y), with the hash of what pairs of the slot agree on."""
    spread = words.select("word", "n", F.expr(f"inline({slots})")).where("x < y")
    outside = [F.substring("word", F.lit(1), F.col("x")), F.substring("word", F.length("word") - F.col("s") + F.col("y") + 1, F.col("s") - F.col("y"))]
    return spread.select(F.xxhash64("s", "x", "y", *outside).alias("k"), "s", "x", "y", "word", "n")


def near_pairs(words: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, near, near_n) for every two distinct words of the table that are one edit apart, both ways."""
    slots = f"""flatten(transform(filter(array(length(word), length(word) - 1), s -> s >= {max(min_chars, 1)}), s ->
        transform(sequence(0, {THIRDS - 1}), j -> named_struct('s', s, 'x', int(s * j div {THIRDS}), 'y', int(s * (j + 1) div {THIRDS})))))"""
    members = _dealt(words, slots)
    large = scratch.write(members.groupBy("k").count().where(F.col("count") > group_words).select("k"), "large")
    if not large.isEmpty():
        single = F.expr("transform(sequence(x, y - 1), p -> named_struct('s', s, 'x', p, 'y', p + 1))")
        again = members.join(large, "k", "left_semi").select("word", "n", single.alias("slots"))
        members = members.join(large, "k", "left_anti").union(_dealt(again, "slots"))

    def linked(batches):
        import pyarrow as pa

        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "near_n"])
        for _, group in groupby(rows, key=itemgetter(0)):
            if len(own := list(group)) < 2:
                continue
            exact = defaultdict(list)  # words of one hash, by what they agree on
            for _, s, x, y, word, n in own:
                exact[s, x, y, word[:x], word[len(word) - s + y :]].append((word, n))
            for (s, x, y, *_), words_here in exact.items():
                out.extend(near_in_group(words_here, s, x, y))
            if len(out) >= 50_000:
                yield made()
                out.clear()
        if out:
            yield made()

    grouped = members.repartition(shuffle_partitions(words.sparkSession), "k").sortWithinPartitions("k")
    return grouped.mapInArrow(linked, "word string, near string, near_n long")


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) from (word, form): pointers are doubled until none moves; forms have larger counts, so there are no rings."""
    now, step, moved = scratch.write(forms.select("word", F.col("form").alias("root")), "roots-0"), 0, True
    while moved:
        a, b = now.select("word", "root"), now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = a.join(b, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step += 1
        now = scratch.write(joined, f"roots-{step}")
        scratch.drop(f"roots-{step - 1}")
        moved = not now.where("moved").isEmpty()
    return now.select("word", "root")


def group_variants(docs: DataFrame, one_in: int = 97, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, n, n_near, form (its commonest near word, if at least twice as common), form_n, and root (the end of its forms)."""
    scratch = Scratch(docs.sparkSession, "variants")
    words = scratch.write(count_words(docs, one_in, min_chars).where(F.col("n") >= min_count), "words")
    best = near_pairs(words, scratch, min_chars, group_words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    common = -F.col("best.less") >= 2 * F.col("n")
    near = words.join(best, "word", "left").select(
        "word", F.when(common, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(common, -F.col("best.less")).alias("form_n")
    )
    near = scratch.write(near, "near")
    scratch.drop("words", "large")
    roots = _roots(near.where(F.col("form").isNotNull()), scratch)
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

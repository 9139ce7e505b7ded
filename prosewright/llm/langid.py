"""Language ID by language-bitmask n-gram filters.

Learning counts byte 4-grams of lower-cased letters per language over all learning rows; a language keeps each 4-gram
that makes up at least ``MIN_SHARE`` of its text, so at most 1 / MIN_SHARE of them, whatever the corpus size.  They
go into bit-sliced Bloom filters: a slot holds one bit per language, and the AND over a gram's slots is the set of all
languages that have it.  A text's share of grams in each language, corrected for that filter's false-positive rate,
decides; ties go to the language with more learning text.

Null text and text without a letter: ``und``, score 0.  Text with letters but no 4-gram, and text of which no gram is
known, goes to the language with most learning text, score 0.  Nothing learned (empty table, no labels): all ``und``.
A letter is a character of the Unicode categories L*; digits, fractions and numerals are none.  Repeated rows are learned and
judged each.  N-grams of a text of any length are made and looked up BLOCK at a time, so besides the text itself a few of its
byte copies are held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_SHARE = 2e-5
MIN_SCORE = 0.2
SLOTS = 1 << 20
HASHES = 3
CHUNK_BYTES = 4 << 20
BLOCK = 1 << 20
MIN_GRAMS = 16  # a text with fewer is not rejected for its language

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], "u8")
_WORD_CHARACTER = re.compile(r"[^\W\d_]")  # letters, and numerals such as fractions
_TO_SPACE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _WORD_CHARACTER.finditer(text))


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of 4-grams of the texts as 32-bit numbers, and the text each comes from; none crosses texts."""
    parts = [b" " + t.lower().encode("utf-8", "replace").translate(_TO_SPACE) + b" " for t in texts]
    flat = np.frombuffer(b"\0".join(parts) + b"\0", "u1")
    owner = np.repeat(np.arange(len(parts), dtype="i4"), [len(p) + 1 for p in parts]) if len(parts) > 1 else None
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != 32) | (flat[:-1] != 32)
    flat = flat[keep]
    if owner is not None:
        owner = owner[keep]
    for lo in range(0, len(flat) - 3, BLOCK):
        part = flat[lo : lo + BLOCK + 3]
        wide = part.astype("u4")
        gram = wide[:-3] | (wide[1:-2] << 8) | (wide[2:-1] << 16) | (wide[3:] << 24)
        end = part == 0
        whole = ~(end[:-3] | end[1:-2] | end[2:-1] | end[3:])
        yield gram[whole], np.zeros(int(whole.sum()), "i4") if owner is None else owner[lo : lo + len(gram)][whole]


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES):
    """Positions of the non-empty texts, in groups of about ``limit`` characters."""
    group, held = [], 0
    for i, text in enumerate(texts):
        if text:
            group.append(i)
            held += len(text)
            if held >= limit:
                yield group
                group, held = [], 0
    if group:
        yield group


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, text) rows to (lang, gram, n) over all of them; Arrow batches are summed before the shuffle."""

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(langs, texts, strict=True):
                if lang is not None and text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                found = [np.unique(gram, return_counts=True) for group in chunks(own) for gram, _ in grams([own[i] for i in group])]
                if not found:
                    continue
                gram, n = (np.concatenate(x) for x in zip(*found, strict=True))
                gram, at = np.unique(gram, return_inverse=True)
                n = np.bincount(at, weights=n).astype("i8")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype("i8")), pa.array(n)], names=["lang", "gram", "n"])

    return labelled.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Bit-sliced filters: ``masks[w, slot]`` has bit b set if language 64 w + b has a gram that hashes there."""

    def __init__(self, langs: list[str], grams_of: list[np.ndarray], slots: int = SLOTS, hashes: int = HASHES):
        self.langs, self.hashes = langs, hashes
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        kind = "u1" if len(langs) <= 8 else "u8"
        width = 8 if kind == "u1" else 64
        self.width = width
        self.masks = np.zeros((max(1, -(-len(langs) // width)), slots), kind)
        for i, gram in enumerate(grams_of):
            for slot in self._slots(gram):
                self.masks[i // width, slot] |= np.array(1 << (i % width), "u8").astype(kind)
        fill = [np.count_nonzero(self.masks[i // width] & np.array(1 << (i % width), "u8").astype(kind)) / slots for i in range(len(langs))]
        self.false_rate = np.array(fill, "f8") ** hashes

    def _slots(self, gram: np.ndarray):
        wide = gram.astype("u8") + np.uint64(1)
        for j in range(self.hashes):
            yield (wide * _MULTIPLIERS[j]) >> self.shift

    def coverage(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Share of each text's grams that each language has, corrected for false positives (a row for each text), and the number of grams."""
        total, out = np.zeros(len(texts)), np.zeros((len(texts), len(self.langs)))
        for gram, owner in grams(texts):
            total += np.bincount(owner, minlength=len(texts))
            slots = list(self._slots(gram))
            for w in range(len(self.masks)):
                hit = self.masks[w][slots[0]]
                for slot in slots[1:]:
                    hit &= self.masks[w][slot]
                for i in range(w * self.width, min(len(self.langs), (w + 1) * self.width)):
                    bit = (hit >> np.array(i % self.width, hit.dtype)) & np.array(1, hit.dtype)
                    out[:, i] += np.bincount(owner, weights=bit, minlength=len(texts))
        share = out / np.maximum(total, 1)[:, None]
        return np.where(total[:, None] > 0, np.clip((share - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1), 0), total


def learn(labelled: DataFrame, min_share: float = MIN_SHARE) -> Model:
    """The model of (lang, text) rows.  What reaches the driver is bounded by 1 / min_share grams a language."""
    from prosewright.llm.common import Scratch

    scratch = Scratch(labelled.sparkSession, "langid")
    counts = scratch.write(gram_counts(labelled), "counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    size = {r["lang"]: r["total"] for r in totals.collect()}
    kept = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= F.col("total") * F.lit(min_share)).select("lang", "gram").toPandas()
    scratch.drop("counts")
    langs = sorted(size, key=lambda x: (-size[x], x))
    own = dict(tuple(kept.groupby("lang")["gram"]))
    return Model(langs, [own[x].to_numpy("u4") if x in own else np.empty(0, "u4") for x in langs])


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score of every row's whole text; one scan, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def judged(batches):
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            for group in chunks(texts):
                cover, _ = own.coverage([texts[i] for i in group])
                for i, row in zip(group, cover, strict=True):
                    if len(row) and has_letter(texts[i]):
                        best = int(np.argmax(row))
                        lang[i], score[i] = own.langs[best], row[best]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, docs["text"].cast("string").alias("_text")).mapInArrow(judged, schema)


def in_known_language(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose text has a letter and whose language's corrected share of grams is at least ``min_score``.

    With no language learned, or fewer than MIN_GRAMS grams, there is no share to judge by, and a text with a letter stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches):
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keep = np.array([bool(t) and has_letter(t) for t in texts], bool)
            if own.langs:
                for group in chunks(texts):
                    cover, total = own.coverage([texts[i] for i in group])
                    keep[group] &= (cover.max(axis=1) >= min_score) | (total < MIN_GRAMS)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep))], names=["doc"])

    rows = docs.select(F.struct(*docs.columns).alias("doc"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(kept, T.StructType([rows.schema["doc"]])).select("doc.*")


def learn_from(docs: DataFrame) -> Model:
    """The model of the documents with a language that are not held out."""
    return learn(docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("lang", "text"))


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows that are not held out, then judge every row."""
    return predict(docs, learn_from(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

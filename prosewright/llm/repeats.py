"""Suffix-array dedup with a run-length index: removes what starts earlier in the corpus as a 100-byte string.

1. Anchors.  Every 100-byte window of a text has an anchor, its 40-byte string of least hash (leftmost of equals); equal
   windows have equal anchors.  A run of windows with the same anchor is a segment, about 28 windows long.
2. Only segments whose anchor occurs again anywhere in the corpus can hold a repetition; the others end here.
3. Segments of the same bytes are copies: all windows of each but the first are repetitions.  Equal means an equal
   128-bit BLAKE2b digest of the bytes and an equal 64-bit anchor hash.
4. The first copies of segments that differ but share an anchor go to shards of about SHARD_BYTES that hold whole
   anchors.  A shard builds a run-length index (run-compressed Burrows-Wheeler transform, sampled run ends), streams its
   segments through it for matching statistics of 100 bytes and more, and marks the windows that match an earlier one,
   all from the samples.  An anchor with more than MOST_SEGMENTS different segments, such as the border of a passage in
   very many documents, is cut into its single windows, copies of which are merged by Spark's aggregation on their bytes.
5. Marks meet their documents, which lose the bytes that marked windows cover.

The order of documents is that of doc_id.  Null text: no bytes.  A null doc_id comes before all others.  Rows that share a
doc_id, or have none, but differ in text are documents of their own, in the order of ``row``, a hash of doc_id and text.  Marks meet
their rows by doc_id and ``row`` together.  Rows equal in doc_id and text count as the same document: none is earlier.  Texts under 100
bytes stay as they are.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewright.llm.common import Scratch, shuffle_partitions
from prosewright.llm.rlindex import earlier_matches
from prosewright.llm.shingles import mixed

DEPTH = 100
ANCHOR = 40
CHUNK = 1 << 19
SHARD_BYTES = 1 << 20
MOST_SEGMENTS = 512
ANCHOR_PARTS = 8
NO_ID = -(2**63)

_SPAN = DEPTH - ANCHOR + 1  # anchors a window chooses from
_RNG = np.random.default_rng(100)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype="u8") | np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _window_hash(flat: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of the ``width`` bytes from each place on, by doubling."""
    part, known = _BYTE[flat], 1
    whole, done = None, 0
    left = width
    while left:
        if left & 1:
            if whole is None:
                whole, done = part, known
            else:
                n = min(len(whole), len(part) - done)
                whole, done = whole[:n] * _power(known) + part[done : done + n], done + known
        left >>= 1
        if left:
            part = part[:-known] * _power(known) + part[known:]
            known *= 2
    return whole


def segments(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after another in ``flat``: (anchor, first window, windows) of each segment.

    ``flat`` has at most 2 ** 20 bytes; windows do not cross texts.
    """
    n = len(flat)
    none = np.empty(0, "i8")
    if n < DEPTH:
        return none.view("u8"), none, none
    h = mixed(_window_hash(flat, ANCHOR))
    least = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype="u8")
    known = 1
    while known * 2 <= _SPAN:
        least = np.minimum(least[:-known], least[known:])
        known *= 2
    least = np.minimum(least[: n - DEPTH + 1], least[_SPAN - known : _SPAN - known + n - DEPTH + 1])
    anchor = (least & np.uint64(0xFFFFF)).astype("i8")
    inside = np.zeros(n - DEPTH + 1, bool)
    start = np.concatenate(([0], ends[:-1]))
    for s, e in zip(start, ends, strict=True):
        if e - s >= DEPTH:
            inside[s : e - DEPTH + 1] = True
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~inside[:-1])) & inside
    first = np.flatnonzero(new)
    stop = np.concatenate((anchor[1:] != anchor[:-1], [True])) | np.concatenate((~inside[1:], [True]))
    last = np.flatnonzero(stop & inside)
    return h[anchor[first]], first, last - first + 1


def contents(blob: bytes, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A 128-bit digest of the bytes of each segment, as two numbers."""
    view, digest = memoryview(blob), hashlib.blake2b
    made = [digest(view[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (first + windows + DEPTH - 1).tolist(), strict=True)]
    return np.frombuffer(b"".join(made), "i8").reshape(-1, 2)


def _chunked(ids: list[int], texts: list[bytes]):
    """(flat, ends, ids, offsets) groups of about CHUNK bytes; long texts in pieces that overlap by DEPTH - 1."""
    group: list[tuple[int, int, bytes]] = []
    held = 0
    for doc, text in zip(ids, texts, strict=True):
        for at in range(0, max(1, len(text) - DEPTH + 1), CHUNK):
            piece = text[at : at + CHUNK + DEPTH - 1]
            if held + len(piece) > CHUNK + DEPTH and group:
                yield group
                group, held = [], 0
            if len(piece) >= DEPTH:
                group.append((doc, at, piece))
                held += len(piece)
    if group:
        yield group


def _cut(with_contents: bool):
    """(row, doc_id, text) to anchor, content, doc_id, row, start and windows of every segment, or to the anchors alone."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(2).to_pylist()]
            keys, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for group in _chunked(range(len(texts)), texts):
                blob = b"".join(p for *_, p in group)
                ends = np.cumsum([len(p) for *_, p in group])
                anchor, first, windows = segments(np.frombuffer(blob, "u1"), ends)
                if not with_contents:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view("i8"))], names=["anchor"])
                    continue
                own = np.searchsorted(ends, first, side="right")
                at = np.array([i for i, *_ in group], "i8")[own]
                start = first - (ends - np.array([len(p) for *_, p in group]))[own] + np.array([a for _, a, _ in group], "i8")[own]
                content = contents(blob, first, windows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view("i8")), pa.array(content[:, 0]), pa.array(content[:, 1]), pa.array(ids[at]), pa.array(keys[at]), pa.array(start), pa.array(windows.astype("i4"))],
                    names=["anchor", "content", "content2", "doc_id", "row", "start", "windows"],
                )

    return cut


_SEGMENT = "anchor long, content long, content2 long, doc_id long, row long, start long, windows int"


def _fetched(batches):
    """(row, doc_id, text, array of (anchor, start, windows, cut)) to the bytes of the segments, or of their single windows if ``cut``."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for key, doc, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = (text or "").encode("utf-8", "replace")
            for w in wanted:
                lo, n = w["start"], w["windows"]
                if not w["cut"]:
                    rows.append((w["anchor"], doc, key, lo, raw[lo : lo + n + DEPTH - 1], False))
                else:
                    rows.extend((w["anchor"], doc, key, i, raw[i : i + DEPTH], True) for i in range(lo, lo + n))
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary()), pa.array(columns[5], pa.bool_())],
                names=["anchor", "doc_id", "row", "start", "bytes", "cut"],
            )


def _runs(offsets: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of each run of consecutive numbers among ascending ones."""
    new = np.flatnonzero(np.diff(offsets, prepend=-2) != 1)
    return list(zip(offsets[new].tolist(), (offsets[np.append(new[1:], len(offsets)) - 1] + 1).tolist(), strict=True)) if len(offsets) else []


def _marked(batches):
    """Segments sorted by shard and anchor to the windows (doc_id, row, start, windows) that start earlier too."""
    import pyarrow as pa

    held: list[tuple] = []
    size = 0

    def result():
        docs, keys, starts = (np.array([r[i] for r in held], "i8") for i in (1, 2, 3))
        # places: documents in order, each as wide as its last segment needs
        order = np.lexsort((starts, keys, docs))
        width = starts + np.array([len(r[4]) for r in held])
        new = (np.diff(docs[order]) != 0) | (np.diff(keys[order]) != 0)
        at = np.empty(len(held), "i8")
        at[order] = np.cumsum(np.concatenate(([0], new)))
        reach = np.zeros(int(at.max()) + 1, "i8")
        np.maximum.at(reach, at, width)
        where = (np.cumsum(reach) - reach)[at] + starts
        again = earlier_matches([held[i][4] for i in order], where[order], DEPTH)
        rows = [(held[i][1], held[i][2], held[i][3] + a, b - a) for i, x in zip(order, again, strict=True) for a, b in _runs(x)]
        held.clear()
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [pa.int64()] * 3 + [pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "row", "start", "windows"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= SHARD_BYTES and row[0] != held[-1][0]:
                yield result()
                size = 0
            held.append(row)
            size += len(row[4])
    if held:
        yield result()


# What a mark says of the windows from its start on.
COPY, FIRST_COPY, AGAIN, CUT, FIRST_WINDOW = range(5)


def _packed(df: DataFrame, kind: int) -> DataFrame:
    """Marks as one number each: start, windows (fewer than 4,096) and kind."""
    return df.select("doc_id", "row", (F.col("start") * 32768 + F.col("windows").cast("long") * 8 + kind).alias("mark"))


def marks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, row, mark) rows; a document is told by both, 128 bits, so that no text is cut by another's marks.

    To go are the windows AGAIN, those of a COPY (a segment whose anchor is repeated) unless it is also a FIRST_COPY, and those
    of a CUT segment but for its FIRST_WINDOWs.  Firsts are marked rather than joined with, so common contents multiply nothing.
    """
    n = shuffle_partitions(docs.sparkSession)
    texts = docs.select("row", "doc_id", "text")
    repeated = texts.mapInArrow(_cut(False), "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    repeated = scratch.write(repeated, "repeated")  # so that the next join has plain exchanges and common anchors can be split
    shared = scratch.write(texts.mapInArrow(_cut(True), _SEGMENT).join(repeated.hint("merge"), "anchor"), "shared")
    scratch.drop("repeated")

    copies = shared.groupBy("anchor", "content", "content2").agg(F.min(F.struct("doc_id", "row", "start", "windows")).alias("first"))
    copies = scratch.write(copies.select("anchor", "first.*"), "firsts")
    several = copies.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = several.select("anchor", "kinds", F.explode(F.sequence(F.lit(0), F.lit(ANCHOR_PARTS - 1))).alias("part"))  # so that a common anchor is met in parts
    parted = copies.withColumn("part", F.pmod(F.xxhash64("row", "start"), F.lit(ANCHOR_PARTS)).cast("int"))
    differing = scratch.write(parted.join(several, ["anchor", "part"]).withColumn("cut", F.col("kinds") > MOST_SEGMENTS).drop("kinds", "part"), "differing")
    wanted = differing.groupBy("doc_id", "row").agg(F.collect_list(F.struct("anchor", "start", "windows", "cut")).alias("wanted"))
    fetched = docs.select("row", "doc_id", "text").join(wanted.hint("merge"), ["doc_id", "row"]).select("row", "doc_id", "text", "wanted").mapInArrow(_fetched, "anchor long, doc_id long, row long, start long, bytes binary, cut boolean")
    fetched = scratch.write(fetched, "fetched")

    whole = fetched.where("NOT cut").select("anchor", "doc_id", "row", "start", "bytes")
    indexed = whole.repartition(n, "anchor").sortWithinPartitions("anchor", "doc_id", "row", "start").mapInArrow(_marked, "doc_id long, row long, start long, windows int")
    windows = fetched.where("cut").groupBy("bytes").agg(F.min(F.struct("doc_id", "row", "start")).alias("first")).select("first.*", F.lit(1).alias("windows"))
    parts = [_packed(shared, COPY), _packed(copies, FIRST_COPY), _packed(indexed, AGAIN), _packed(differing.where("cut"), CUT), _packed(windows, FIRST_WINDOW)]
    return reduce(DataFrame.union, parts)


def _spans(found: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes to remove from a text of ``size`` bytes."""
    if not len(found):
        return []
    start, n, kind = found >> 15, (found >> 3) & 4095, found & 7
    go = (kind == AGAIN) | ((kind == COPY) & ~np.isin(start, start[kind == FIRST_COPY]))
    lo, hi = start[go], start[go] + n[go]
    if (kind == CUT).any():
        single = np.concatenate([np.arange(a, a + b) for a, b in zip(start[kind == CUT], n[kind == CUT], strict=True)])
        single = single[~np.isin(single, start[kind == FIRST_WINDOW])]
        lo, hi = np.concatenate((lo, single)), np.concatenate((hi, single + 1))
    hi = np.minimum(hi + DEPTH - 1, size)
    lo, hi = lo[hi > lo], hi[hi > lo]
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > reach[:-1]))
    return list(zip(lo[new].tolist(), reach[np.concatenate((new[1:], [True]))].tolist(), strict=True))


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for lo, hi in spans:
        parts.append(raw[at:lo])
        at = hi
    return b"".join([*parts, raw[at:]])


def _with_marks(docs: DataFrame, *more) -> DataFrame:
    """doc_id, text, further columns and the list of marks of every row."""
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    rows = rows.withColumn("row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    found = marks(rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), scratch).groupBy("doc_id", "row").agg(F.collect_set("mark").alias("found"))
    found = scratch.write(found, "found").withColumnRenamed("doc_id", "own")
    scratch.drop("shared", "firsts", "differing", "fetched")
    return rows.withColumn("own", F.coalesce("doc_id", F.lit(NO_ID))).join(found.hint("merge"), ["own", "row"], "left")


def _lists(column) -> list[np.ndarray]:
    """The marks of each row of an Arrow column of lists."""
    import pyarrow.compute as pc

    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    return [flat[e - n : e] for e, n in zip(ends, sizes, strict=True)]


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def judged(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lists(batch.column(2)), strict=True):
                raw = (text or "").encode("utf-8", "replace")
                spans = _spans(found, len(raw))
                rows.append((doc, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(raw, spans)).hexdigest()))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_marks(docs).select("doc_id", "text", "found").mapInArrow(judged, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated passages; characters that are cut in part go as well, n_chars follows the text."""
    from pyspark.sql import types as T

    others = [c for c in docs.columns if c != "text"]

    def cleaned(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, found in zip(batch.column(0).to_pylist(), _lists(batch.column(1)), strict=True):
                if text and len(found):
                    raw = text.encode("utf-8", "replace")
                    text = _kept(raw, _spans(found, len(raw))).decode("utf-8", "ignore")
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(2)], names=["text", "others"])

    rows = _with_marks(docs, F.struct(*others).alias("others")).select("text", "found", "others")
    done = rows.mapInArrow(cleaned, T.StructType([T.StructField("text", T.StringType()), rows.schema["others"]]))
    renewed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*[renewed.get(c, F.col("others").getField(c)).alias(c) for c in docs.columns])

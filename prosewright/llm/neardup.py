"""MinHash near-dedup by fast similarity sketching.

A document's set of distinct 5-word shingles is sketched into COORDINATES coordinates.  In round i < t every element
falls into a hashed bin with value i plus a hashed fraction, in round i >= t all fall into bin i - t; a bin keeps its
least value, and no round is needed after all are filled, which is certain after 2 t rounds.  Coordinates of two sketches
agree with the probability of the sets' Jaccard similarity, and their sum is concentrated as that of independent
draws.  The coordinates are hashed in bands, as wide as keeps the probability that two documents at the threshold share
no band under MISS: 36 bands of 6 at 0.85 (4e-8), 43 bands of 5 at 0.80 (4e-8).

Documents of the same words in the same order (told by a 256-bit digest of them) form a class, and only its smallest doc_id goes on.  Classes
whose sets seem equal by two 64-bit sums are compared with the first of them on their full sets; equal ones are linked and leave it at
that first one, others go on by themselves.  Documents that share a band are compared
on their full sets: all pairs of buckets of up to SMALL documents, and each document of a larger bucket with the bucket's
smallest.  Larger buckets that then still hold more than one component are compared in full, block by block.  Nothing is
capped or sampled, and no link between documents of different components is left out.

No join or group takes a common key whole: pairs and members of large buckets are dealt in parts by the bucket's size.

Null text, text without words: empty set, a component of its own.  A null doc_id is never linked: component_id null, kept.
Rows that share a doc_id share their links; the filter keeps one of rows that repeat doc_id and text.  Empty tables give no
rows.  Ties cannot arise: the smallest doc_id is kept.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewright.llm.common import Scratch, shuffle_partitions
from prosewright.llm.graph import components
from prosewright.llm.shingles import _LOWER, mixed, shingle_sets

COORDINATES = 216
PERCENT = 85
MISS = 1e-7  # most probable miss of a pair at the threshold
SMALL = 16
BLOCK, BLOCK_SHINGLES = 512, 400_000
PAIRS_A_GROUP, MEMBERS_A_PART = 64, 256
BATCH_BYTES = 2 << 20

_ROUND = np.random.default_rng(85).integers(1, 1 << 63, (2 * COORDINATES, 2), dtype="u8") | np.uint64(1)
_VALUE = np.uint64((1 << 53) - 1)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _thrown(element: np.ndarray, i: int) -> np.ndarray:
    """The hash of each element in round i."""
    return mixed(element * _ROUND[i, 0] + _ROUND[i, 1])


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """(n, t) sketches of sets of 64-bit hashes: the round in the high 11 bits, the fraction below.  Empty sets: all ones."""
    out = np.full(len(sets) * t, np.iinfo("u8").max, "u8")
    size = np.array([len(s) for s in sets], "i8")
    element = np.concatenate(sets) if len(sets) else np.empty(0, "u8")
    owner = np.repeat(np.arange(len(sets)), size)
    open_bins = np.where(size > 0, t, 0)
    for i in range(t):
        live = open_bins[owner] > 0
        if not live.all():
            element, owner = element[live], owner[live]
        if not len(element):
            return out.reshape(len(sets), t)
        h = _thrown(element, i)
        at = owner * t + ((h >> np.uint64(53)) * np.uint64(t) >> np.uint64(11)).astype("i8")
        np.minimum.at(out, at, (np.uint64(i) << np.uint64(53)) | (h & _VALUE))
        if i % 4 == 3:
            open_bins = np.where(size > 0, (out.reshape(len(sets), t) >> np.uint64(53) == 2047).sum(axis=1), 0)
    table = out.reshape(len(sets), t)
    unfilled = table >> np.uint64(53) == 2047
    unfilled[size == 0] = False
    for b in np.flatnonzero(unfilled.any(axis=0)):
        mine = unfilled[owner, b]
        h = (np.uint64(t + b) << np.uint64(53)) | (_thrown(element[mine], t + b) & _VALUE)
        np.minimum.at(out, owner[mine] * t + b, h)
    return table


def band_width(percent: int) -> int:
    """Most coordinates in a band at which a pair of this similarity is missed with a probability under MISS."""
    fits = [r for r in range(1, 17) if (1 - (percent / 100) ** r) ** (COORDINATES // r) < MISS]
    return max(fits, default=1)


def band_keys(table: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each sketch, bands told apart."""
    bands = table.shape[1] // rows
    parts = table[:, : bands * rows].reshape(len(table), bands, rows)
    h = np.arange(1, bands + 1, dtype="u8")[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(table), 1), "u8")
    for j in range(rows):
        h = mixed(h ^ parts[:, :, j])
    return h


def _groups(texts: list[bytes]):
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= BATCH_BYTES:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _sketched(rows: int):
    """doc_id, n_shingles, two hashes of the set, the band keys, and a digest of the words of each document."""

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            for lo, hi in _groups(texts):
                sets = shingle_sets(texts[lo:hi])
                keys = band_keys(sketches(sets), rows).view("i8")
                sums = np.array([(s.sum(), mixed(s ^ np.uint64(0x5555555555555555)).sum()) for s in sets], "u8").view("i8").reshape(-1, 2)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype="i4"), keys.ravel())
                columns = [batch.column(0)[lo:hi], pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), lists, pa.array([words_digest(t) for t in texts[lo:hi]], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "s1", "s2", "keys", "words"])

    return made


def words_digest(text: bytes) -> bytes:
    """Of the lower-cased words in their order; equal words have equal shingles."""
    return hashlib.blake2b(b" ".join(_WORD.findall(text.translate(_LOWER))), digest_size=32).digest()


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def linked(n_a: int, n_b: int, common: int, percent: int = PERCENT) -> bool:
    return common > 0 and 100 * common >= percent * (n_a + n_b - common)


def _with_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds the text to rows that name a doc_id; a merge join at every size."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return wanted.hint("merge").join(texts, "doc_id")


def _parts(rows, limit: int):
    """Number of parts, a power of two, into which so many rows are dealt."""
    return F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(rows / limit)))).cast("int")


def _part(key: str, parts):
    return F.pmod(F.xxhash64(key), parts).cast("int")


def confirm(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the distinct (a, b, near) pairs that are linked on full sets.

    ``near`` bounds the pairs of ``a`` that one bucket gave; by it they are dealt in groups of about PAIRS_A_GROUP, so each
    group needs the text of ``a`` once and none is large; a group streams through its task in the order: a, then the b's.
    """
    n = shuffle_partitions(docs.sparkSession)
    dealt = pairs.select("a", F.col("b").alias("doc_id"), _part("b", _parts(F.col("near"), PAIRS_A_GROUP)).alias("part"), F.lit(1).alias("turn"))
    heads = dealt.select("a", "part").distinct().select("a", F.col("a").alias("doc_id"), "part", F.lit(0).alias("turn"))
    rows = _with_texts(dealt.union(heads), docs).repartition(n, "a", "part").sortWithinPartitions("a", "part", "turn")

    def compared(batches):
        import pyarrow as pa

        head, own = None, []
        for batch in batches:
            a, part, turn, b = (batch.column(i).to_pylist() for i in range(4))
            texts = [t.encode("utf-8", "replace") for t in batch.column(4).to_pylist()]
            left, right = [], []
            for lo, hi in _groups(texts):
                for i, s in zip(range(lo, hi), shingle_sets(texts[lo:hi]), strict=True):
                    if turn[i] == 0:
                        if head != (a[i], part[i]):
                            head, own = (a[i], part[i]), []
                        own.append(s)  # a doc_id may have several texts
                    elif any(linked(len(x), len(s), shared(x, s), percent) for x in own if min(len(x), len(s)) * 100 >= percent * max(len(x), len(s))):
                        left.append(a[i])
                        right.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["u", "v"])

    return rows.select("a", "part", "turn", "doc_id", "text").mapInArrow(compared, "u long, v long")


def _find(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _block_links(ids: list[int], comps: list[int], sets: list[np.ndarray], side: list[int], percent: int) -> list[tuple[int, int]]:
    """A forest of the links among a block's documents (side 0 with side 1, or all if there is one side)."""
    if len(ids) < 2 or len(set(comps)) < 2:
        return []
    size = np.array([len(s) for s in sets])
    values, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    several = uses > 1  # shingles of one document add to no intersection
    keep = several[column]
    column, row, values = (np.cumsum(several) - 1)[column[keep]], row[keep], values[several]
    common = np.zeros((len(sets), len(sets)), "f4")
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for lo in range(0, len(values), 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((len(sets), min(4096, len(values) - lo)), "f4")
        part[row[i:j], column[i:j] - lo] = 1
        common += part @ part.T
    common = np.rint(common).astype("i8")
    ok = np.triu((common > 0) & (100 * common >= percent * (size[:, None] + size[None, :] - common)), 1)
    parent = {c: c for c in comps}
    out = []
    for i, j in zip(*np.nonzero(ok), strict=True):
        if (len(set(side)) == 1 or side[i] != side[j]) and (a := _find(parent, comps[i])) != (b := _find(parent, comps[j])):
            parent[a] = b
            out.append((ids[i], ids[j]))
    return out


def compare_buckets(members: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between documents of different components in each bucket: (key, cnt, part, doc_id, n_shingles, component) rows to (u, v).

    A bucket is cut by hash into blocks of about BLOCK documents or BLOCK_SHINGLES shingles, whichever is less, and every pair of its
    blocks is a group of its own.
    """
    sizes = members.groupBy("key", "cnt").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sizes = sizes.select("key", "blocks", F.explode(F.sequence(F.lit(0), _parts(F.col("cnt"), MEMBERS_A_PART) - 1)).alias("part"))
    cut = members.join(sizes, ["key", "part"]).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("blocks")).cast("int"))
    pairs = cut.select(
        "key", "doc_id", "component", "block",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("lo"), F.greatest("block", o).alias("hi")))).alias("at"),
    )
    rows = _with_texts(pairs.select("key", "at.lo", "at.hi", "block", "component", "doc_id"), docs)

    def compared(frame):
        import pandas as pd

        found = _block_links(frame["doc_id"].tolist(), frame["component"].tolist(), shingle_sets([t.encode("utf-8", "replace") for t in frame["text"]]), frame["block"].tolist(), percent)
        return pd.DataFrame(found, columns=["u", "v"], dtype="i8")

    return rows.groupBy("key", "lo", "hi").applyInPandas(compared, "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    made = scratch.write(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_sketched(band_width(percent)), "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>, words binary"), "sketches"
    )
    linkable = made.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    first = F.min(F.struct("doc_id", "n_shingles", "s1", "s2", "keys")).alias("first")
    classes = scratch.write(linkable.groupBy("words").agg(first).select("words", F.col("first.doc_id").alias("class_id"), "first.n_shingles", "first.s1", "first.s2", "first.keys"), "classes")
    heads = classes.groupBy("s1", "s2").agg(F.min("class_id").alias("a"), F.count("*").alias("near")).where("near > 1")
    alike = classes.select("s1", "s2", F.col("class_id").alias("b")).join(heads, ["s1", "s2"]).where("a != b").select("a", "b", "near")
    equal = scratch.write(confirm(scratch.write(alike.groupBy("a", "b").agg(F.max("near").alias("near")), "alike"), docs, 100), "equal")
    compared = classes.join(equal.select(F.col("v").alias("class_id")), "class_id", "left_anti")

    members = compared.select(F.col("class_id").alias("doc_id"), F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("cnt"), F.min("doc_id").alias("leader")).where("cnt > 1")
    buckets = scratch.write(buckets, "buckets")  # so that the next join has plain exchanges and common keys can be split
    members = scratch.write(members.join(buckets.hint("merge"), "key"), "members")
    few = members.where(F.col("cnt") <= SMALL).select("key", "doc_id")
    inside = few.withColumnRenamed("doc_id", "a").join(few.withColumnRenamed("doc_id", "b"), "key").where("a < b").select("a", "b", F.lit(SMALL).cast("long").alias("near"))
    stars = members.where((F.col("cnt") > SMALL) & (F.col("doc_id") != F.col("leader"))).select(F.col("leader").alias("a"), F.col("doc_id").alias("b"), F.col("cnt").alias("near"))
    pairs = scratch.write(inside.union(stars).groupBy("a", "b").agg(F.max("near").alias("near")), "pairs")
    links = scratch.write(confirm(pairs, docs, percent).union(equal), "links")
    found = scratch.write(components(links, scratch, "first"), "found")

    large = members.where(F.col("cnt") > SMALL).join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    parts = _parts(F.col("cnt"), MEMBERS_A_PART)
    large = large.select("key", "cnt", "doc_id", F.coalesce("component", "doc_id").alias("component"), _part("doc_id", parts).alias("part"))
    mixed_keys = large.groupBy("key", "cnt").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    mixed_keys = mixed_keys.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    sizes = classes.select(F.col("class_id").alias("doc_id"), "n_shingles")
    unsettled = scratch.write(large.join(mixed_keys, ["key", "part"]).join(sizes, "doc_id").select("key", "cnt", "part", "doc_id", "n_shingles", "component"), "unsettled")
    if not unsettled.isEmpty():
        more = scratch.write(compare_buckets(unsettled, docs, percent), "more")
        found = scratch.write(components(links.union(more), scratch, "second"), "all-found")
    scratch.drop("members", "buckets", "pairs", "unsettled", "alike", "equal")

    named = classes.select("words", "class_id").join(found.withColumnRenamed("node", "class_id"), "class_id", "left").select("words", F.coalesce("component", "class_id").alias("component_id"))
    own = made.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("words")).otherwise(F.coalesce("doc_id", F.lit(0)).cast("string").cast("binary")).alias("words"))
    out = own.join(named, "words", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    out = scratch.write(out, "result")
    scratch.drop("sketches", "classes", "links", "found", "all-found", "more")
    return out


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that are kept: of each component the one of smallest doc_id, of rows that repeat doc_id and text one."""
    judged = near_duplicates(docs, percent).where("doc_id IS NOT NULL")
    flags = judged.groupBy(F.col("doc_id").alias("_id")).agg(F.bool_or(~F.col("kept")).alias("_gone"), (F.count("*") > 1).alias("_again")).where("_gone OR _again")
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").cast("long").alias("_id")).join(flags, "_id", "left").where("coalesce(NOT _gone, true)")
    once = rows.where("coalesce(NOT _again, true)").select("_doc.*")
    again = rows.where("_again").select("_id", F.col("_doc.text").alias("_text"), "_doc").groupBy("_id", "_text").agg(F.first("_doc").alias("_doc")).select("_doc.*")
    return once.union(again)

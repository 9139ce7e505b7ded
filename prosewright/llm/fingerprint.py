"""Document fingerprints: improbable-feature digests.

Every 64-byte window of a text is a feature.  Its Shannon entropy gives its rarity: the rank table is the bell curve
of entropies of running text, so windows far from the usual entropy rank first and nearly constant ones last.  In each
run of 64 neighbouring features the leftmost of lowest rank gains a point, and features of at least 16 points are
selected.  Each sets five bits of a 2,048-bit Bloom filter; after 160 features the next filter of the chain begins.
Two digests are compared filter by filter: shared bits less those expected by chance, over the most possible.

Few 64-byte windows of a short text can be selected, so texts under SHORT bytes are told by their 8-byte windows (or
themselves, if shorter), all selected.  Texts from SHORT to BOTH bytes carry both kinds, the 8-byte ones in filters of their own,
so that they meet shorter and longer texts.  A text of which no window gains 16 points keeps its first lowest-ranked one.

Null text is the empty text.  Empty text: fingerprint '' (like another empty one 1, any other 0).  A text of any length is
worked on in blocks of BLOCK bytes; besides it only its selected features' hashes and its filters are held.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewright.llm.common import shuffle_partitions

WINDOW = 64
SMALL = 8
RUN = 64
POINTS = 16
BITS = 2048
PER_FILTER = 160
BATCH_BYTES = 2 << 20

ENTROPY_MEAN, ENTROPY_SD = 0.66, 0.05  # of 64-byte windows of running text, as a share of the most possible
LEVELS = 1000


def rarity_table(mean: float = ENTROPY_MEAN, sd: float = ENTROPY_SD) -> np.ndarray:
    """Rank of each entropy level, low for rare ones: the bell curve's height; under a tenth of the most, last."""
    level = np.arange(LEVELS + 1) / LEVELS
    rank = np.round(1000 * np.exp(-(((level - mean) / sd) ** 2) / 8)).astype("i4")
    rank[: LEVELS // 10] = 1001
    return rank


_C = np.arange(WINDOW + 2, dtype="f8")
_C_LOG_C = np.round(65536 * _C * np.log2(np.maximum(_C, 1))).astype("i8")
_STEP = np.diff(_C_LOG_C)  # what the (c + 1)-th copy of a byte adds
_MOST = int(_C_LOG_C[WINDOW])
_RANK = rarity_table()
_CHUNK = 1 << 16
SHORT, BOTH = 256, 512
BLOCK = 1 << 20


def _neighbours(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, how often it occurs among the 63 before it and among the 63 after it."""
    n = len(flat)
    before, after = np.zeros(n, "u1"), np.zeros(n, "u1")
    for lo in range(0, n, _CHUNK):
        at = max(0, lo - WINDOW)
        part = flat[at : lo + _CHUNK + WINDOW]
        b, a = np.zeros(len(part), "u1"), np.zeros(len(part), "u1")
        same = np.empty(len(part), bool)
        for k in range(1, min(WINDOW, len(part))):
            eq = same[: len(part) - k]
            np.equal(part[k:], part[:-k], out=eq)
            step = eq.view("u1")
            np.add(b[k:], step, out=b[k:])
            np.add(a[:-k], step, out=a[:-k])
        hi = min(n, lo + _CHUNK)
        before[lo:hi], after[lo:hi] = b[lo - at : hi - at], a[lo - at : hi - at]
    return before, after


def _first_sums(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of c log c over the first window of each text."""
    first = flat[starts[:, None] + np.arange(WINDOW)]
    seen = np.zeros(first.shape, "u1")
    for k in range(1, WINDOW):
        seen[:, k:] += first[:, k:] == first[:, :-k]
    return _STEP[seen].sum(axis=1)


def _mixed(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 64 bytes from each position on."""
    words = np.ascontiguousarray(flat[at[:, None] + np.arange(WINDOW)]).view("<u8")
    h = np.full(len(at), 0x9E3779B97F4A7C15, "u8")
    for j in range(words.shape[1]):
        h = (h ^ words[:, j]) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    return h


def _points(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all features of texts of 64 bytes or more that lie in ``flat``: rank, points, and the number of features of each text."""
    before, after = _neighbours(flat)
    change = np.zeros(len(flat) + 1, "i8")
    change[1 : len(flat) - WINDOW + 1] = _STEP[before[WINDOW:]] - _STEP[after[: len(flat) - WINDOW]]
    run = np.cumsum(change)
    features = sizes - WINDOW + 1
    owner = np.repeat(np.arange(len(starts)), features)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(features) - features, features)
    total = (_first_sums(flat, starts) - run[starts])[owner] + run[starts[owner] + offset]
    rank = _RANK[LEVELS - (LEVELS * total) // _MOST]
    # leftmost lowest rank in each run of features, by doubling
    points = np.zeros(len(rank), "i4")
    ends = np.cumsum(features)
    part = (rank.astype("i8") << 22) | np.arange(len(rank))
    width = 1
    while width < RUN and len(part) > width:
        part = np.minimum(part[:-width], part[width:])
        width *= 2
    if width == RUN:
        inside = np.arange(len(part)) + RUN <= ends[owner[: len(part)]]
        won = np.bincount(part[inside] & ((1 << 22) - 1))
        points[: len(won)] = won
    return rank, points, features


def _selected(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the selected features of texts of 64 bytes or more that lie in ``flat`` (under 2 ** 22 bytes), and their texts."""
    rank, points, features = _points(flat, starts, sizes)
    ends = np.cumsum(features)
    owner = np.repeat(np.arange(len(starts)), features)
    at = starts[owner] + np.arange(len(owner)) - (ends - features)[owner]
    take = points >= POINTS
    none = np.bincount(owner[take], minlength=len(starts)) == 0
    if none.any():
        key = (rank.astype("i8") << 40) | np.arange(len(rank))
        best = np.minimum.reduceat(key, ends - features) & ((1 << 40) - 1)
        take[best[none]] = True
    return at[take], owner[take]


def _hashes_of_long(text: bytes) -> np.ndarray:
    """Hashes of the selected features of one text, block by block: a feature's points come from the runs within 63 features of it."""
    features, found, lowest = len(text) - WINDOW + 1, [], None
    for lo in range(0, features, BLOCK):
        hi = min(features, lo + BLOCK)
        first = max(0, lo - RUN + 1)
        flat = np.frombuffer(text, "u1")[first : min(features, hi + RUN - 1) + WINDOW - 1]
        rank, points, _ = _points(flat, np.zeros(1, "i8"), np.array([len(flat)]))
        own = slice(lo - first, hi - first)
        at = np.flatnonzero(points[own] >= POINTS) + lo - first
        found.append(_mixed(flat, at))
        best = int(np.argmin(rank[own])) + lo - first
        if lowest is None or rank[best] < lowest[0]:
            lowest = (rank[best], _mixed(flat, np.array([best])))
    chosen = np.concatenate(found)
    return chosen if len(chosen) else lowest[1]


def _filters(owner: np.ndarray, h: np.ndarray, n: int) -> list[np.ndarray]:
    """The chain of filters of each of ``n`` texts from the hashes of its features in order; a feature counts once."""
    order = np.lexsort((np.arange(len(owner)), h, owner))
    first = np.ones(len(order), bool)
    first[1:] = (owner[order][1:] != owner[order][:-1]) | (h[order][1:] != h[order][:-1])
    kept = np.sort(order[first])
    kept = kept[np.argsort(owner[kept], kind="stable")]
    owner, h = owner[kept], h[kept]
    count = np.bincount(owner, minlength=n)
    filters = -(-count // PER_FILTER)
    base = np.cumsum(filters) - filters
    nth = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    row = base[owner] + nth // PER_FILTER
    bits = np.zeros((int(filters.sum()), BITS), "u1")
    for j in range(5):
        bits[row, ((h >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype("i8")] = 1
    packed = np.packbits(bits, axis=1)
    return [packed[b : b + m] for b, m in zip(base, filters, strict=True)]


def digests(texts: list[bytes]) -> list[np.ndarray]:
    """The chain of filters of each text, 256 bytes a row: those of 8-byte features, then those of 64-byte ones."""
    owners, hashes = [np.empty(0, "i8")], [np.empty(0, "u8")]
    middle = [i for i, t in enumerate(texts) if SHORT <= len(t) <= BLOCK]
    for lo, hi in _spans([len(texts[i]) for i in middle], BLOCK):
        ranked = middle[lo:hi]
        flat = np.frombuffer(b"".join(texts[i] for i in ranked), "u1")
        sizes = np.array([len(texts[i]) for i in ranked], "i8")
        at, own = _selected(flat, np.cumsum(sizes) - sizes, sizes)
        owners.append(np.array(ranked)[own])
        hashes.append(_mixed(flat, at))
    for i in (i for i, t in enumerate(texts) if len(t) > BLOCK):
        hashes.append(_hashes_of_long(texts[i]))
        owners.append(np.full(len(hashes[-1]), i))
    large = _filters(np.concatenate(owners), np.concatenate(hashes), len(texts))
    short = [i for i, t in enumerate(texts) if 0 < len(t) < BOTH]
    small = [[texts[i][j : j + SMALL] for j in range(max(1, len(texts[i]) - SMALL + 1))] for i in short]
    owner = np.repeat(np.array(short, "i8"), [len(x) for x in small])
    h = np.array([int.from_bytes(hashlib.sha1(x).digest()[:8], "little") for own in small for x in own], "u8")
    tiny = _filters(owner, h, len(texts))
    return [np.concatenate((a, b)) for a, b in zip(tiny, large, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the mean over the shorter chain's filters of the best normalised bit overlap with the other chain."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    x, y = np.ascontiguousarray(a).view("u8"), np.ascontiguousarray(b).view("u8")
    nx, ny = np.bitwise_count(x).sum(axis=1).astype("f8"), np.bitwise_count(y).sum(axis=1).astype("f8")
    best = np.empty(len(x))
    for i, own in enumerate(x):
        shared = np.bitwise_count(own & y).sum(axis=1)
        chance, most = nx[i] * ny / BITS, np.minimum(nx[i], ny)
        best[i] = np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1).max()
    return float((best * nx).sum() / nx.sum())


def as_text(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the fingerprint of every row's whole text; one scan, no shuffle."""
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fingerprint", T.StringType())])

    def printed(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(len(keep)).to_pylist()]
            made = [as_text(d) for lo, hi in _spans([len(t) for t in texts]) for d in digests(texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(made, pa.string())], names=[*keep, "fingerprint"])

    return docs.select(*keep, docs[text].cast("string").alias("text")).mapInArrow(printed, schema)


def _spans(sizes: list[int], limit: int = BATCH_BYTES):
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= limit:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def _below(key, bounds: list[int]):
    """How many of the sorted bounds are less than ``key``, in about 2 sqrt(n) comparisons."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = F.size(F.filter(F.lit([g[0] for g in groups]).cast("array<bigint>"), lambda b: b < key))
    fine = F.element_at(F.array(*[F.lit(g).cast("array<bigint>") for g in groups]), F.greatest(coarse, F.lit(1)))
    inside = F.size(F.filter(fine, lambda b: b < key))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + inside)


def _bucket(key, h, bounds: list[int]):
    """The bucket of a row in the order of ``key`` and then ``h``: the number of bounds at or below it.

    A bound that occurs m times is a key so common that it fills m buckets; its rows are dealt to them by ranges of ``h``.
    """
    if not bounds:
        return F.lit(0)
    below = _below(key, bounds)
    equal = _below(F.coalesce(F.try_add(key, F.lit(1).cast("long")), key), bounds) - below
    share = h.cast("double") / 2.0**64 + 0.5
    return (below + F.when(equal == 0, 0).otherwise(F.least(equal, F.floor(share * equal).cast("int") + 1))).cast("int")


def edited(text: str, following: str) -> str:
    """The last half of the text's code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; and likeness to the next document's.

    Documents are ordered by doc_id (null first, equal ids by a hash of the text).  Buckets between quantiles of doc_id go
    to the partitions, an id that fills several quantiles to several, each with a copy of the next bucket's first
    row, so texts are shuffled once and no task holds more than its bucket's stream.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shares = [i / n for i in range(1, n)]
    bounds = sorted(rows.select(F.percentile_approx("key", shares, max(10_000, 20 * n)).alias("q")).first()["q"] or []) if shares else []
    placed = rows.withColumn("h", F.xxhash64("text")).withColumn("bucket", _bucket(F.col("key"), F.col("h"), bounds))
    firsts = sorted((r["bucket"], r["first"]["key"], r["first"]["h"]) for r in placed.groupBy("bucket").agg(F.min(F.struct("key", "h")).alias("first")).collect())
    before = [firsts[i - 1][0] for i in range(len(firsts))]
    ahead = spark.createDataFrame([(k, h, b) for (_, k, h), b in zip(firsts, before, strict=True)], "key long, h long, before int")  # a row for each partition
    ahead = ahead.groupBy("key", "h").agg(F.collect_list("before").alias("before"))
    dealt = (
        placed.join(F.broadcast(ahead), ["key", "h"], "left")
        .select("key", "h", "doc_id", "text", F.posexplode(F.concat(F.array("bucket"), F.coalesce("before", F.array().cast("array<int>")))).alias("copy", "bucket"))
        .repartitionById(n, F.col("bucket"))
        .sortWithinPartitions("bucket", F.col("copy") > 0, "key", "h", "text")
        .select("bucket", F.least("copy", F.lit(1)).alias("copy"), "doc_id", "text")
    )

    def compared(batches):
        import pyarrow as pa

        def results(held: list[tuple]):
            """Rows for all but the last of the rows held, which are in order."""
            raw = [t.encode("utf-8", "replace") for *_, t in held]
            prints = digests(raw)
            own = [i for i in range(len(held) - 1) if held[i][1] == 0 and held[i][0] == held[i + 1][0]]
            changed = [edited(held[i][3], held[i + 1][3]).encode("utf-8", "replace") for i in own]
            marks = digests(changed)
            out = [
                (held[i][2], len(held[i][3]), hashlib.sha256(c).hexdigest(), as_text(prints[i]), as_text(m), likeness(prints[i], m), likeness(prints[i], prints[i + 1]))
                for i, c, m in zip(own, changed, marks, strict=True)
            ]
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=arrow) if out else None

        names = [f.split()[0] for f in SCHEMA.split(", ")]
        arrow = pa.schema([(x, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]]) for x, f in zip(names, SCHEMA.split(", "), strict=True)])
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= BATCH_BYTES and len(held) > 1:
                    if (made := results(held)) is not None:
                        yield made
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1 and (made := results(held)) is not None:
            yield made

    return dealt.mapInArrow(compared, SCHEMA)

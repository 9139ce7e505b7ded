"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one full-dimensional codeword from each of 40 codebooks; the books are trained one
after the other on what the earlier ones leave over, on a bounded sample, and a beam search over the books picks
the codewords.  The squared norm of the sum is stored.  A query's distance to a coded vector is then, but for a constant,
that norm less twice the sum of 40 entries of the query's lookup tables.  What the code leaves over of a vector (its
residual norm) is stored too: the distance to the vector differs from that to its code by this much at most.  Queries are
broadcast in super-blocks of at most about QUERY_BYTES, one after the other, and each passes once over the codes where they lie; what
it finds is written before the next one is collected.  A task scores
block after block; the exact distances of the best scores, and what it found before, bound a query's ``k`` nearest, and
every row that this bound and its own residual norm do not rule out is reranked by exact distance on original vectors.
Nothing else is cut, so the neighbours are the true ones, also in large groups of near copies, whose codes hardly differ.
Only the ``k`` nearest of each query and task are shuffled.

Vectors that are null, empty, zero, hold a null or non-finite component, or are not of the commonest dimension take no
part.  Equal rows are merged before they are coded.  Repeated vec_ids count once, with the nearest of their vectors; a query never finds its own vec_id.  Ties go
to the smaller vec_id.  Fewer neighbours than asked for: all of them.  An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosewright.llm.common import Scratch, shuffle_partitions

BOOKS, WORDS = 40, 256  # five bits a dimension of 64: what is left over is then far below the spread of distances
BEAM = 4
SAMPLE = 16_384
ROUNDS = 2
QUERY_BYTES = 1 << 24  # of query vectors in a super-block
DATA_BYTES = 1 << 25  # of vectors scored at once
SLACK = 1e-5  # of the squared norms: what single precision may add to a score


def usable(vector: Column) -> Column:
    """Holds finite numbers only, not all of them zero."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def train(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Codebooks (books, words, dimension), each fitted by k-means to the residuals of those before it."""
    rng = np.random.default_rng(seed)
    rest = sample.astype("f4").copy()
    out = np.zeros((books, words, rest.shape[1]), "f4")
    for m in range(books):
        centre = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            near = _nearest(rest, centre)
            count = np.bincount(near, minlength=words)
            total = np.zeros_like(centre)
            np.add.at(total, near, rest)
            centre[count > 0] = total[count > 0] / count[count > 0, None]
        out[m] = centre
        rest -= centre[_nearest(rest, centre)]
    return out


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = 0.5 * (centre**2).sum(axis=1)
    return np.concatenate([np.argmin(half - x[i : i + 4096] @ centre.T, axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, "i8")])


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) and squared norms of the sums, by beam search."""
    n, (m, words, dim) = len(x), books.shape
    rest = x.astype("f4")[:, None, :]  # what each kept sum leaves over
    codes = np.zeros((n, 1, 0), "u1")
    for book in books:
        # the squares of what would be left over, for every kept sum and word, by one product
        wide = np.concatenate([rest, (rest**2).sum(axis=2, keepdims=True), np.ones((n, rest.shape[1], 1), "f4")], axis=2)
        flat = (wide.reshape(-1, dim + 2) @ np.concatenate([-2 * book.T, np.ones((1, words), "f4"), (book**2).sum(axis=1)[None, :]])).reshape(n, -1)
        best, row = np.empty((n, min(beam, flat.shape[1])), "i8"), np.arange(n)
        for j in range(best.shape[1]):
            best[:, j] = flat.argmin(axis=1)
            flat[row, best[:, j]] = np.inf
        parent, word = best // words, best % words
        row = row[:, None]
        rest = rest[row, parent] - book[word]
        codes = np.concatenate([codes[row, parent], word[:, :, None].astype("u1")], axis=2)
    top = np.argmin((rest**2).sum(axis=2), axis=1)
    made = x - rest[np.arange(n), top]
    return codes[np.arange(n), top], (made**2).sum(axis=1).astype("f4")


def tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Lookup tables: minus twice each query's product with each codeword, (queries, books, words)."""
    return np.einsum("qd,mwd->qmw", -2 * queries.astype("f4"), books, optimize=True)


def left_over(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Norms of what the codes leave over of the vectors."""
    rest = x.astype("f8")
    for m in range(len(books)):
        rest -= books[m][codes[:, m]]
    return np.sqrt((rest**2).sum(axis=1))


def _distances(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, squares added one after the other, so equal vectors are equally far in every block."""
    return np.sqrt(np.cumsum((x - query) ** 2, axis=1)[:, -1])


class Nearest:
    """The ``k`` nearest ids found so far for each of some queries, and their distances."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, books: np.ndarray, k: int):
        self.query_ids, self.queries, self.books, self.k = query_ids, queries, books, k
        self.found = [(np.empty(0, "i8"), np.empty(0))] * len(queries)
        self.scored = self.reranked = 0

    def add(self, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, rests: np.ndarray, x: np.ndarray) -> None:
        """Looks through one block of coded rows; ids are sorted."""
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
        largest = float(norms.max(initial=0))
        for lo in range(0, len(self.queries), 128):
            for i, lut in enumerate(tables(self.queries[lo : lo + 128], self.books), lo):
                score = norms.copy()
                for m in range(len(lut)):
                    score += lut[m][codes[:, m]]
                self._rerank(i, score, ids, first, group, largest, rests, x)

    def _rerank(self, i: int, score: np.ndarray, ids: np.ndarray, first: np.ndarray, group: np.ndarray, largest: float, rests: np.ndarray, x: np.ndarray) -> None:
        k, y, (known, known_far) = self.k, self.queries[i], self.found[i]
        own = ids == self.query_ids[i]
        score[own] = np.inf
        # an upper bound of the k-th nearest id's distance: what is known, or exact distances of the best-scored row of some ids
        bound = known_far[k - 1] if len(known) == k else np.inf
        best = np.minimum.reduceat(score, first)
        if len(best) > 4 * k:
            some = np.argpartition(best, 4 * k - 1)[: 4 * k]
            row = first[some] if len(first) == len(ids) else np.array([first[g] + np.argmin(score[group == g]) for g in some])
            row = row[~own[row]]
            if len(row) >= k:
                bound = min(bound, np.partition(_distances(x[row], y), k - 1)[k - 1])
        square = float((y**2).sum())
        at = np.flatnonzero(~(score + square > (bound + rests) ** 2 + SLACK * (square + largest)) & ~own)
        self.scored, self.reranked = self.scored + len(ids), self.reranked + len(at)
        if not len(at):
            return
        rest = x[at] - y
        rough = np.einsum("ij,ij->i", rest, rest)
        near = np.minimum.reduceat(rough, np.flatnonzero(np.concatenate(([True], group[at][1:] != group[at][:-1]))))
        if len(near) > k:
            at = at[~(rough > np.partition(near, k - 1)[k - 1] * (1 + 1e-9))]
        every, distance = np.concatenate((known, ids[at])), np.concatenate((known_far, _distances(x[at], y)))
        order = np.lexsort((every, distance))
        every, distance = every[order], distance[order]
        nearest = np.sort(np.unique(every, return_index=True)[1])[:k]
        self.found[i] = (every[nearest], distance[nearest])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_ids, ids, distances) of all that was found."""
        return (
            np.repeat(self.query_ids, [len(ids) for ids, _ in self.found]), np.concatenate([ids for ids, _ in self.found] or [np.empty(0, "i8")]),
            np.concatenate([far for _, far in self.found] or [np.empty(0)]),
        )


def _blocks(batches, row_bytes: int):
    """Arrow batches joined to tables of about DATA_BYTES of vectors."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n * row_bytes >= DATA_BYTES:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def search(vectors: DataFrame, is_query: Column, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the ``k`` nearest for each query row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, n = (sizes["dim"], sizes["count"]) if sizes else (1, 0)
    parts = max(shuffle_partitions(spark), -(-n * dim * 8 // DATA_BYTES))
    rows = rows.where(F.size("v") == dim).repartition(parts, "vec_id", "v").groupBy("vec_id", "v").agg(F.max("asks").alias("asks"))
    rows = scratch.write(rows, "rows")
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(SAMPLE).select("v").toPandas()["v"]
    books = train(np.stack(sample.to_numpy())) if len(sample) else np.zeros((1, 1, dim), "f4")
    shared = spark.sparkContext.broadcast(books)

    def coded(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            for lo in range(0, len(x), 1024):
                part = x[lo : lo + 1024]
                codes, norms = encode(part, shared.value)
                rests = left_over(part, codes, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo : lo + 1024], batch.column(2)[lo : lo + 1024], pa.array([v.tobytes() for v in part], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(rests)],
                    names=["vec_id", "asks", "x", "code", "norm", "rest"],
                )

    codes = scratch.write(rows.select("vec_id", "v", "asks").mapInArrow(coded, "vec_id long, asks boolean, x binary, code binary, norm float, rest double"), "codes")
    scratch.drop("rows")
    asked = codes.where("asks").select("vec_id", "x")
    blocks = max(1, -(-asked.count() * dim * 8 // query_bytes))

    def nearest_of(block: int) -> DataFrame:
        """Writes the nearest of the queries of one super-block, by task; what is collected and broadcast is about ``query_bytes``."""
        frame = asked.where(F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)) == block).toPandas()
        queries = spark.sparkContext.broadcast((frame["vec_id"].to_numpy("i8"), np.frombuffer(b"".join(frame["x"]), "f8").reshape(len(frame), dim)))

        def scored(batches):
            import pyarrow as pa

            best = Nearest(*queries.value, shared.value, k)
            for part in _blocks(batches, dim * 8):
                part = part.sort_by("vec_id")
                raw = lambda name, kind, part=part: np.frombuffer(b"".join(part.column(name).to_pylist()), kind).reshape(part.num_rows, -1)
                best.add(part.column("vec_id").to_numpy(), raw("code", "u1"), part.column("norm").to_numpy(), part.column("rest").to_numpy(), raw("x", "f8"))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows()], names=["query_id", "vec_id", "score"])

        found = scratch.write(codes.select("vec_id", "x", "code", "norm", "rest").mapInArrow(scored, "query_id long, vec_id long, score double"), f"found-{block}")
        queries.destroy()
        return found

    found = reduce(DataFrame.union, [nearest_of(b) for b in range(blocks)])
    exact = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    out = scratch.write(out, "result")
    scratch.drop("codes", *(f"found-{b}" for b in range(blocks)))
    return out

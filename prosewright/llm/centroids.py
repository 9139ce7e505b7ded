"""Centroid clustering of integer vectors with JVM-native expressions.

Vectors become arrays of integers, so sums and distances are exact and every run agrees.  A round is one scan: ``zip_with``
and ``aggregate`` give the squared distance to each centroid, which is an array literal of the plan; ``array_min`` over
structs (distance, number) chooses the cluster; and a column sum for each component, combined before the shuffle, gives what
the centroids are updated from.  Only those sums, one row a cluster, come to the driver.

Vectors that are null, of another length, or hold a null or non-finite component take no part.  Components beyond 2^27 either
way (of the scaled integers) are held there: squared distances would not fit a long.  Starting vectors are ordered by the
hash of their vec_id, a null vec_id last, then by the vector itself; fewer vectors than clusters make fewer clusters.  Repeated rows are
vectors of their own; equal centroids leave their ties to the smaller number.  A sum of distances beyond a long is null.  An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright.llm.common import Scratch

BOUND = 1 << 27


def integers(vector: Column, dim: int, scale: int) -> Column:
    """floor(scale * x) of each component as longs; null for vectors that take no part."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(float(BOUND))), F.lit(float(-BOUND))))
    x = vector.cast("array<double>")
    return F.when(F.coalesce((F.size(x) == dim) & F.forall(x, number), F.lit(False)), F.transform(x, whole))


def nearest(vector: str, centroids: list[list[int]]) -> Column:
    """(distance, cluster) of the nearest literal centroid; ties to the smaller number."""
    each = [
        f"struct(aggregate(zip_with({vector}, array({', '.join(f'{c}L' for c in centroid)}), (a, b) -> (a - b) * (a - b)), 0L, (s, d) -> s + d) AS distance, {k} AS cluster)"
        for k, centroid in enumerate(centroids)
    ]
    return F.expr(f"array_min(array({', '.join(each)}))")


def updated(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Componentwise floor(sum / count) of each cluster's vectors; an empty cluster's centroid stays."""
    dim = len(centroids[0])
    chosen = rows.select(nearest("v", centroids)["cluster"].alias("cluster"), *[F.col("v")[i].alias(f"x{i}") for i in range(dim)])
    sums = chosen.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"x{i}") for i in range(dim)]).collect()
    out = list(centroids)
    for row in sums:
        out[row["cluster"]] = [row[f"x{i}"] // row["n"] for i in range(dim)]
    return out


def cluster(vectors: DataFrame, clusters: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    rows = scratch.write(vectors.select("vec_id", integers(F.col("embedding"), dim, scale).alias("v")).where(F.col("v").isNotNull()), "rows")
    by_hash = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    centroids = [list(r["v"]) for r in rows.orderBy(by_hash.asc_nulls_last(), "v").limit(clusters).collect()]
    for _ in range(rounds if centroids else 0):
        centroids = updated(rows, centroids)
    best = nearest("v", centroids) if centroids else F.lit(None).cast("struct<distance: bigint, cluster: int>")
    assigned = scratch.write(rows.select("vec_id", best.alias("best")).select("vec_id", F.col("best.cluster").alias("cluster"), F.col("best.distance").alias("distance")), "assigned")
    scratch.drop("rows")

    # one entry a cluster: sums and digests are literals of the last projection, so that nothing is joined
    sums = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    within = lambda x: "CAST(NULL AS BIGINT)" if x >= 1 << 63 else f"{x}L"
    inertia = [within(sums.get(k, 0)) for k in range(len(centroids))]
    digests = [f"'{hashlib.sha256(','.join(map(str, c)).encode()).hexdigest()}'" for c in centroids]
    pick = lambda values, kind: f"element_at(array({', '.join(values) or f'CAST(NULL AS {kind})'}), cluster + 1)"
    return assigned.select(
        "vec_id", "cluster", "distance", F.expr(pick(inertia, "BIGINT")).alias("cluster_inertia"),
        F.expr(within(sum(sums.values()))).alias("inertia"), F.expr(pick(digests, "STRING")).alias("centroid_sha256"),
    )


def cluster_sql(clusters: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2:") -> str:
    """The same by joins of components, one common table expression after the other."""
    steps = [
        f"""v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"x AS (SELECT vec_id, i, v[i] AS x FROM v, range(1, {dim + 1}) AS r(i))",
        f"""s AS (
  SELECT v, row_number() OVER (ORDER BY sha256('{seed}' || vec_id)) - 1 AS k FROM v QUALIFY k < {clusters})""",
        f"c0 AS (SELECT k, i, v[i] AS c FROM s, range(1, {dim + 1}) AS r(i))",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS (SELECT vec_id, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance FROM x JOIN c{n} USING (i) GROUP BY vec_id, k)")
        steps.append(f"a{n} AS (SELECT * FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, k) = 1)")
        if n < rounds:
            steps.append(
                f"""m{n} AS (
  SELECT k, i, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM a{n} JOIN x USING (vec_id) GROUP BY k, i)"""
            )
            steps.append(f"c{n + 1} AS (SELECT k, i, CASE WHEN n IS NULL THEN c ELSE (t - (t % n + n) % n) // n END AS c FROM c{n} LEFT JOIN m{n} USING (k, i))")
    return f"""WITH {", ".join(steps)},
h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN h USING (k)"""

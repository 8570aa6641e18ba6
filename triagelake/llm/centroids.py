"""Plain Lloyd clustering of embedding vectors in whole numbers.

Vectors are quantised once to integers, so every distance and every mean is
exact and the result is the same on any number of executors. The centroids are
broadcast (``k`` vectors: a parameter, not data); ``mapInPandas`` works out the
squared differences to one centroid after another in NumPy and takes the
smallest, the lowest number among equals. A task hands over its sums for each
centroid and component, ``groupBy`` merges them, and the driver sees ``k`` times
``dims`` sums. Vectors are never shuffled, so no vector that is repeated
everywhere and no crowded cluster can be hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.shared import Scratch, table

#: Integers beyond this count as this, so that 64 squared differences still fit in a long.
FARTHEST = 1 << 27


def quantised(vectors: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """``vec_id`` and the integers floor(scale * x) of the vectors that have ``dims`` components, none null or non-finite."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    fit = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    far = float(FARTHEST)
    whole = F.transform("x", lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(far)), F.lit(-far))).cast("int"))
    return rows.where((F.size("x") == dims) & fit).select("vec_id", whole.alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids come first by the sha256 of ``seed:id`` (a null id comes last; equal ids by their vectors)."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = rows.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centroid and the squared distance to it; of equally near ones, the lowest number."""
    best, at = np.full(len(v), np.iinfo(np.int64).max), np.zeros(len(v), np.int32)
    for number, c in enumerate(centroids):
        apart = v - c
        d = np.einsum("ij,ij->i", apart, apart)
        nearer = d < best
        best[nearer], at[nearer] = d[nearer], number
    return at, best


def _stack(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["v"].to_numpy()).astype(np.int64)


def _sums(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids = shared.value
        total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if len(batch):
                v = _stack(batch)
                at, _ = nearest(v, centroids)
                for number in np.unique(at):
                    total[number] += v[at == number].sum(axis=0)
                n += np.bincount(at, minlength=len(n))
        met = np.flatnonzero(n)
        dims = total.shape[1]
        yield pd.DataFrame({"cluster": np.repeat(met, dims).astype(np.int32), "dim": np.tile(np.arange(dims, dtype=np.int32), len(met)), "total": total[met].ravel(), "n": np.repeat(n[met], dims)})

    return run


def _assign(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at, best = nearest(_stack(batch), shared.value)
                yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "cluster": at, "distance": best})

    return run


def lloyd(spark: SparkSession, vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 16, dims: int = 64, rounds: int = 3, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Each kept vector with its cluster and squared distance, and the final centroids.

    Vectors with another number of components, or with a null or non-finite one,
    are left out. With fewer than ``k`` kept vectors each is a centroid; with none
    the result is empty. Repeated rows count each time; two equal starting vectors
    are two centroids, of which the lower number gets all members. A null id is
    kept and clustered. Other columns play no part, whatever their names.
    A centroid without members stays where it is.
    """
    scratch = Scratch(spark)
    rows = scratch.save(quantised(vectors, vec_id, vector, dims, scale))
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids.reshape(0, dims)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centroids)
        sums = rows.mapInPandas(_sums(shared), "cluster int, dim int, total long, n long").groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        centroids = centroids.copy()
        for r in sums.collect():  # k * dims rows
            centroids[r["cluster"], r["dim"]] = r["total"] // r["n"]
        shared.unpersist()
    done = scratch.save(rows.mapInPandas(_assign(spark.sparkContext.broadcast(centroids)), "vec_id long, cluster int, distance long"))
    scratch.drop(rows)
    return done, centroids


def clustered(spark: SparkSession, vectors: DataFrame, **how) -> DataFrame:
    """``lloyd`` with the inertia of each cluster and of all, and the digest of the final centroid.

    An inertia beyond a long is null.
    """
    done, centroids = lloyd(spark, vectors, **how)
    named = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    found = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()  # k rows
    inertia = {r["cluster"]: int(r["d"]) for r in found}
    fits = lambda d: d if d < 1 << 63 else None
    facts = spark.createDataFrame([(i, fits(inertia.get(i, 0)), fits(sum(inertia.values())), h) for i, h in named], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fitting row of ``embeddings``: 16 centroids, 64 components, three rounds."""
    return clustered(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _round(given: str, number: int) -> str:
    """SQL of one assignment of ``kept`` to the centroids of ``given``, and of the centroids that it moves."""
    return f"""near{number} AS (SELECT vec_id, row, v, min(struct_pack(d := d, c := cluster)) AS best FROM (SELECT vec_id, row, v, cluster,
 list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, {given}) GROUP BY ALL),
moved{number} AS (SELECT cluster, list(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END ORDER BY dim) AS c FROM (SELECT best.c AS cluster, dim, sum(x)::BIGINT AS s, count(*) AS n
 FROM (SELECT best, unnest(v) AS x, unnest(range(1, 65)) AS dim FROM near{number}) GROUP BY ALL) GROUP BY cluster),
cent{number + 1} AS (SELECT {given}.cluster, coalesce(m.c, {given}.c) AS c FROM {given} LEFT JOIN moved{number} m ON m.cluster = {given}.cluster)"""


OP11_SQL = f"""WITH kept AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cent0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1)::INTEGER AS cluster, v AS c FROM kept QUALIFY cluster < 16),
{", ".join(_round(f"cent{n}", n) for n in range(4))}
SELECT vec_id, best.c AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(cent3.c, ',')) AS centroid_sha256
FROM near3 JOIN cent3 ON cent3.cluster = best.c"""

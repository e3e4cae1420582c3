"""Centroid clustering with annulus search.

Centroids are sorted by norm. A vector's distance to one centroid, the one it
had last, bounds its distance to the nearest; by the triangle inequality that
one's norm lies within this bound of the vector's own norm. Binary search finds
the centroids of this annulus, and only they are compared, exactly, in whole
numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, discard, small_batches, stored

#: Components of a vector; centroids; rounds; what components are multiplied by; what the order of first centroids goes by.
DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Largest whole component: squared distances of 64 such fit into 64 bits.
LARGEST = 1 << 27
_TABLE = "vec_id long, q binary, cluster int, distance long"
_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _whole(dimensions: int, scale: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            right = pc.equal(pc.list_value_length(batch["x"]), dimensions).fill_null(False)
            batch = batch.filter(right)
            values = batch["x"].cast(pa.list_(pa.float64())).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(values * scale)
                good = (np.abs(whole) <= LARGEST).all(axis=1)  # nulls are NaN here, and neither they nor infinities pass
            q = whole[good].astype(np.int32)
            ends = np.arange(1, len(q) + 1) * (4 * dimensions)
            yield pa.RecordBatch.from_arrays([batch["vec_id"].filter(pa.array(good)), binary_column(q.view(np.uint8).ravel(), ends)], ["vec_id", "q"])

    return run


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and q: floor(scale * x) of the vectors with ``dimensions`` finite components, as 32-bit numbers."""
    small_batches(vectors.sparkSession)
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("x"))
    return named.mapInArrow(_whole(dimensions, scale), "vec_id long, q binary")


class Annuli:
    """Centroids sorted by norm."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        norms = np.sqrt((centroids * centroids).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def nearest(self, q: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Cluster and squared distance of each vector (of equally near ones the smaller number), and how many distances were worked out.

        ``start`` names a centroid of each vector that bounds its distance; by
        default it is the one next in norm.
        """
        norm = np.sqrt((q * q).sum(axis=1))
        if start is None:
            start = self.order[np.minimum(np.searchsorted(self.norms, norm), len(self.norms) - 1)]
        best = self.squared(q, start)
        which = start.astype(np.int64)
        bound = np.sqrt(best)
        bound += 1e-9 * (1 + norm + bound)  # more than rounding can take away: ties at the border are inside
        low, high = np.searchsorted(self.norms, norm - bound, "left"), np.searchsorted(self.norms, norm + bound, "right")
        compared = len(q)
        for place, c in enumerate(self.order.tolist()):
            rows = np.flatnonzero((low <= place) & (place < high) & (start != c))
            d = self.squared(q[rows], np.full(len(rows), c))
            nearer = (d < best[rows]) | ((d == best[rows]) & (c < which[rows]))
            best[rows[nearer]], which[rows[nearer]] = d[nearer], c
            compared += len(rows)
        return which, best, compared

    def squared(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        apart = q - self.centroids[c]
        return np.einsum("ij,ij->i", apart, apart)


def _vectors(column, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dimensions).astype(np.int64)


def _assigned(centroids: np.ndarray, first: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        annuli = Annuli(centroids)
        for batch in batches:
            q = _vectors(batch["q"], centroids.shape[1])
            which, best, _ = annuli.nearest(q, None if first else batch["cluster"].to_numpy())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["q"], pa.array(which, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "q", "cluster", "distance"])

    return run


def _sums(dimensions: int, clusters: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums, counts = np.zeros((clusters, dimensions), np.int64), np.zeros(clusters, np.int64)
        for batch in batches:
            which = batch["cluster"].to_numpy()
            np.add.at(sums, which, _vectors(batch["q"], dimensions))
            counts += np.bincount(which, minlength=clusters)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means, component by component; empty clusters stay. Each task gives one row a cluster."""
    k, dimensions = centroids.shape
    parts = assigned.select("q", "cluster").mapInArrow(_sums(dimensions, k), "cluster int, n long, sums array<long>")
    exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(dimensions)]
    out = centroids.copy()
    for cluster, n, *sums in parts.groupBy("cluster").agg(F.sum("n"), *exact).collect():  # one row a centroid
        out[cluster] = [int(s) // n for s in sums]
    return out


def first_centroids(table: DataFrame, clusters: int, seed: int, dimensions: int) -> np.ndarray:
    """The vectors whose ``seed:vec_id`` has the smallest SHA-256, in that order; of repeated ids the one with smaller bytes first, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = table.select(key.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(clusters).collect()
    return np.array([np.frombuffer(r.q, np.int32) for r in found], np.int64).reshape(-1, dimensions)


def clustered(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector with ``dimensions`` finite components.

    Components are floor(scale * x); distances are squared, exact and whole.
    Each round assigns every vector to its nearest centroid (of equally near
    ones the smaller number) and moves every centroid that has vectors to the
    floor of their mean; at the end vectors are assigned once more.

    Null vectors, those of another length, and those with a null or infinite
    component, NaN, or one beyond LARGEST (whose distances 64 bits don't hold)
    are left out. A null id stays; repeated rows count each time. With fewer
    vectors than clusters every vector begins as a centroid. An empty table
    gives no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    table = stored(whole_vectors(vectors, vec_id, embedding, dimensions, scale), "vectors")
    centroids = first_centroids(table, clusters, seed, dimensions)
    if not len(centroids):
        return spark.createDataFrame([], _RESULT)
    current = table.withColumn("cluster", F.lit(0))
    for turn in range(rounds + 1):
        following = stored(current.select("vec_id", "q", "cluster").mapInArrow(_assigned(centroids, turn == 0), _TABLE), "clusters")
        discard(current)
        current = following
        if turn < rounds:
            centroids = moved(current, centroids)
    inertia = {r[0]: int(r[1]) for r in current.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # one row a centroid
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    told = spark.createDataFrame([(c, x, sum(inertia.values()), digest(c)) for c, x in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return current.select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

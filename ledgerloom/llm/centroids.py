"""Centroid clustering with the equal-average equal-variance search for the nearest centroid."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import cut_lineage

#: Components below this are squared and summed in 64 bits; beyond, in Python integers.
SMALL = 2**27
#: Bounds are compared with this share of the squared lengths as room for rounding; distances themselves are whole numbers.
SLACK = 1e-6


def whole(column: pa.Array, dims: int) -> np.ndarray:
    """floor(256 x) of lists of equal lengths as whole numbers."""
    x = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), dims)
    return x.astype(np.int64) if np.abs(x).max(initial=0) < SMALL else np.array([[int(v) for v in r] for r in x], object).reshape(len(x), dims)


def shape(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the sum, the length of what is left without the mean (deviation), the squared length."""
    f = x.astype(np.float64)
    total, square = f.sum(axis=1), (f * f).sum(axis=1)
    return total, np.sqrt(((f - total[:, None] / f.shape[1]) ** 2).sum(axis=1)), square


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each row, ties to the smaller number, and how many distances were computed.

    Centroids lie in the order of their means. Each row goes outward from its own mean, always to the nearer of the two next ones. As
    dims (m - m')^2 + (s - s')^2 bounds the squared distance from below (m the mean, s the deviation), a mean too far ends the row's scan, and
    a mean and deviation too far together skip the centroid; what is left is measured in whole numbers.
    """
    if SMALL <= np.abs(centroids).max(initial=0):
        x = x.astype(object)
    if x.dtype == object:
        centroids = centroids.astype(object)
    total, spread, square = shape(centroids)
    order = np.lexsort((np.arange(len(total)), total))
    total, spread, square, line = total[order], spread[order], square[order], centroids[order]
    own, own_spread, own_square = shape(x)
    dims, computed = x.shape[1], 0
    hi = np.searchsorted(total, own)
    lo = hi - 1
    best, rough = np.full(len(x), len(order)), np.full(len(x), np.inf)
    exact = np.zeros(len(x), x.dtype)
    rows = np.arange(len(x))
    while len(rows):
        left, right = lo[rows], hi[rows]
        down = np.where(left >= 0, own[rows] - total[np.maximum(left, 0)], np.inf)
        up = np.where(right < len(order), total[np.minimum(right, len(order) - 1)] - own[rows], np.inf)
        j, gap = np.where(down <= up, left, np.minimum(right, len(order) - 1)), np.minimum(down, up)
        lo[rows], hi[rows] = np.where(down <= up, left - 1, left), np.where(down <= up, right, right + 1)
        room = rough[rows] + SLACK * (own_square[rows] + square[j])
        alive = np.isfinite(gap) & (gap * gap / dims <= rough[rows] + SLACK * (own_square[rows] + square.max()))
        rows, j, gap, room = rows[alive], j[alive], gap[alive], room[alive]
        near = gap * gap / dims + (own_spread[rows] - spread[j]) ** 2 <= room
        r, c = rows[near], j[near]
        d = ((x[r] - line[c]) ** 2).sum(axis=1)
        computed += len(r)
        better = (best[r] == len(order)) | (d < exact[r]) | ((d == exact[r]) & (order[c] < best[r]))
        r, c, d = r[better], c[better], d[better]
        best[r], exact[r], rough[r] = order[c], d, d.astype(np.float64)
    return best, exact, computed


def sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's rows -> for each centroid: rows, sum of distances, sums of components (decimal text, as they may pass 64 bits)."""
    k, dims = centroids.shape
    count, far, total = np.zeros(k, np.int64), np.zeros(k, object), np.zeros((k, dims), object)
    for t in batches:
        x = whole(t.column(1), dims)
        to, d, _ = nearest(x, centroids)
        for c in np.unique(to):
            count[c] += (to == c).sum()
            far[c] += sum(int(v) for v in d[to == c])
            total[c] += x[to == c].sum(axis=0).astype(object)
    held = np.flatnonzero(count)
    yield pa.record_batch([pa.array(held, pa.int32()), pa.array(count[held]), pa.array([str(far[c]) for c in held], pa.string()), pa.array([[str(v) for v in total[c]] for c in held], pa.list_(pa.string()))], ["cluster", "n", "far", "total"])


def labelled(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, inertia: dict[int, int], names: list[str]) -> Iterator[pa.RecordBatch]:
    everything = sum(inertia.values())
    for t in batches:
        to, d, _ = nearest(whole(t.column(1), centroids.shape[1]), centroids)
        columns = [pa.array(to, pa.int32()), pa.array([int(v) for v in d], pa.int64()), pa.array([inertia[c] for c in to.tolist()], pa.int64()), pa.array([everything] * len(to), pa.int64()), pa.array([names[c] for c in to], pa.string())]
        yield pa.record_batch([t.column(0), *columns], ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])


def fits(e: F.Column, dims: int) -> F.Column:
    return F.coalesce((F.size(e) == dims) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2) -> DataFrame:
    """Rounds of nearest centroid and componentwise floor of the mean, in whole numbers, over all vectors of `dims` finite components.

    A round is one pass in Arrow batches: each task finds the nearest centroid of its rows and returns k rows of sums, which Spark adds up; the
    driver holds the k centroids. No vector is shuffled, so equal vectors and a centroid with most rows cost nothing more.

    Defined cases: other vectors (null, another length, null or non-finite components) have no row; centroids start as the k vectors of least
    hash, a null vec_id last, equal hashes by vector; fewer than k vectors: all start one; centroids without rows stay; repeated rows are rows of
    their own; no rows give no rows; a distance or sum of distances beyond 64 bits is an error; other columns are ignored.
    Returns vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.
    """
    spark, sc = vectors.sparkSession, vectors.sparkSession.sparkContext
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = cut_lineage(vectors.where(fits(F.col("embedding"), dims)).select("vec_id", "embedding"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    start = rows.orderBy(key.asc_nulls_last(), "embedding").limit(k).collect()
    if not start:
        return spark.createDataFrame([], schema)
    centroids = whole(pa.array([list(r["embedding"]) for r in start], pa.list_(pa.float64())), dims)

    def summed(centroids: np.ndarray) -> list:
        sent = sc.broadcast(centroids)
        each = rows.mapInArrow(lambda b: sums(b, sent.value), "cluster int, n long, far string, total array<string>")
        whole_sum = lambda c: F.sum(c.cast("decimal(38,0)"))
        return each.groupBy("cluster").agg(F.sum("n").alias("n"), whole_sum(F.col("far")).alias("far"), F.array(*[whole_sum(F.col("total")[i]) for i in range(dims)]).alias("total")).collect()

    for _ in range(rounds):
        moved = [list(map(int, c)) for c in centroids]
        for r in summed(centroids):
            moved[r["cluster"]] = [int(t) // r["n"] for t in r["total"]]
        largest = max((abs(v) for c in moved for v in c), default=0)
        centroids = np.array(moved, np.int64 if largest < SMALL else object)
    inertia = {r["cluster"]: int(r["far"]) for r in summed(centroids)}
    names = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    sent = sc.broadcast((centroids, inertia, names))
    return rows.mapInArrow(lambda b: labelled(b, *sent.value), schema)


def cluster_sql(k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2) -> str:
    nearest_ = lambda i: f"""a{i} AS MATERIALIZED (SELECT rid, unnest(min(struct_pack(d := d, k := k))) FROM (SELECT rid, k, list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i} c) GROUP BY rid)"""
    moved = lambda i: f"""c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN (SELECT k, list(floor_mean ORDER BY j) AS e FROM (SELECT k, j, ((s - ((s % n) + n) % n) // n)::BIGINT AS floor_mean
 FROM (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM a{i} JOIN v USING (rid)) GROUP BY k, j)) GROUP BY k) m USING (k))"""  # noqa: E731
    steps = ",\n".join(f"{nearest_(i)},\n{moved(i)}" for i in range(rounds))
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
 WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, e FROM (SELECT sha256('{seed}:' || vec_id) AS h, e FROM v ORDER BY h LIMIT {k})),
{steps},
{nearest_(rounds)}
SELECT vec_id, a.k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c ON a.k = c.k"""

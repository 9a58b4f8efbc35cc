"""Nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from .kit import cut_lineage, spread

#: A code has 64 substrings of 16 bits.
SUBSTRINGS, SUB = 64, 16
BITS = SUBSTRINGS * SUB


@lru_cache
def masks(radius: int) -> np.ndarray:
    """All 16-bit numbers with at most `radius` bits."""
    every = np.arange(1 << SUB)
    return every[np.bitwise_count(every) <= radius]


def learn_rotation(sample: np.ndarray, rounds: int = 6, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of iterative quantisation: principal axes, then rotations that bring the data near their signs.

    Rotations from different starts are laid side by side until a code has BITS bits.
    """
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    x = sample - mean
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :BITS]
    y, out = x @ axes, []
    for _ in range(-(-BITS // axes.shape[1])):
        r = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
            r = (u @ w).T
        out.append(axes @ r)
    return mean, np.concatenate(out, axis=1)[:, :BITS]


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, rows: int = 4096) -> np.ndarray:
    """Codes as rows of substrings; a direction's code does not depend on its length."""
    out = np.empty((len(x), SUBSTRINGS), np.uint16)
    for i in range(0, len(x), rows):
        part = x[i : i + rows]
        part = (part / np.linalg.norm(part, axis=1, keepdims=True) - mean).astype(np.float32)
        out[i : i + rows] = np.packbits(part @ projection.astype(np.float32) >= 0, axis=1).view(np.uint16)
    return out


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows with one more coordinate that makes all as long as the longest: the angle to a query, which has 0 there, then ranks them as the
    inner product does. 0: rows are equally long as they are."""
    return np.column_stack([x, np.sqrt(np.maximum(0, longest**2 - (x * x).sum(axis=1)))]) if longest else x


def lift_query(q: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([q, np.zeros(len(q))]) if longest else q


def needed_radius(codes: np.ndarray, query_codes: np.ndarray) -> np.ndarray:
    """The least probing radius at which each code is met by its query: a substring j that differs in d bits is probed from m d + j on."""
    apart = np.bitwise_count(codes ^ query_codes).astype(np.int64)
    return (apart * SUBSTRINGS + np.arange(SUBSTRINGS)).min(axis=1)


class MultiIndex:
    """One inverted list for each value of each substring of the codes."""

    def __init__(self, codes: np.ndarray):
        self.rows = len(codes)
        columns = np.ascontiguousarray(codes.T)
        self.order = np.argsort(columns, axis=1, kind="stable").astype(np.int32)
        self.first = np.zeros((SUBSTRINGS, (1 << SUB) + 1), np.int32)
        for j, c in enumerate(columns):
            np.cumsum(np.bincount(c, minlength=1 << SUB), out=self.first[j, 1:])

    def probe(self, codes: np.ndarray, radius: int) -> np.ndarray:
        """(query x row): which rows each query meets. With m substrings and radius = m r + a, the first a + 1 substrings are probed at up to r
        differing bits and the others at up to r - 1; by the pigeonhole principle every code within the radius is met."""
        hit = np.zeros((len(codes), self.rows), bool)
        r, a = divmod(radius, SUBSTRINGS)
        for j in range(SUBSTRINGS):
            near = r if j <= a else r - 1
            if near < 0:
                break
            first = self.first[j]
            if len(masks(near)) <= self.rows:
                values = codes[:, j, None] ^ masks(near)
            else:  # fewer values are in the list than would be probed
                held = np.flatnonzero(np.diff(first))
                values = np.where(np.bitwise_count(held ^ codes[:, j, None].astype(np.int64)) <= near, held, -1)
            lo = first[values]
            many = np.where(values >= 0, first[values + 1] - lo, 0)
            q, p = np.nonzero(many)
            lo, many = lo[q, p], many[q, p]
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else np.zeros(0, int)
            hit[np.repeat(q, many), self.order[j, at]] = True
        return hit


class Block:
    """Some rows with their index; `model` is (mean, projection, radius, longest)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, model: tuple):
        self.ids, self.x, self.slim, self.model = ids, x, x.astype(np.float32), model
        self.index = MultiIndex(encode(lift(x, model[3]), *model[:2]))

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, queries: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k best rows that each query meets; a query that meets fewer than k probes further, to the end if need be."""
        mean, projection, radius, longest = self.model
        out: tuple[list, list, list] = ([], [], [])
        enough = min(k, len(self.ids) - 1)
        for i in range(0, len(q), queries):
            coded = encode(lift_query(q[i : i + queries], longest), mean, projection)
            hit, r = self.index.probe(coded, radius), radius
            few = np.flatnonzero(hit.sum(axis=1) <= enough)
            while len(few) and r < BITS:
                r = min(BITS, r + SUBSTRINGS)
                hit[few] = self.index.probe(coded[few], r)
                few = few[hit[few].sum(axis=1) <= enough]
            for n, met in enumerate(hit, i):
                rows = np.flatnonzero(met)
                rows = rows[self.ids[rows] != qids[n]]
                if len(rows) > 4 * k:  # floats in single precision first, with a margin; the exact measure decides
                    rough = self.slim[rows] @ q[n].astype(np.float32)
                    least = np.partition(rough, len(rough) - k)[len(rough) - k]
                    rows = rows[rough >= least - 1e-4 * max(1.0, float(np.abs(rough).max()))]
                exact = (self.x[rows] * q[n]).sum(axis=1)
                best = np.lexsort((self.ids[rows], -exact))[:k]
                out[0].append(np.full(len(best), qids[n]))
                out[1].append(self.ids[rows][best])
                out[2].append(exact[best])
        return tuple(np.concatenate(x) for x in out)


def dense(column: pa.Array) -> np.ndarray:
    """Lists of equal lengths as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search_blocks(batches: Iterator[pa.RecordBatch], model: tuple, k: int) -> Iterator[pa.RecordBatch]:
    """A partition sorted by block, rows before queries: the index of a block is built once, and its queries stream past it."""
    current, held, ready = None, [], None
    for t in batches:
        block, query, ids, x = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy(), dense(t.column(3))
        edge = np.flatnonzero((block[1:] != block[:-1]) | (query[1:] != query[:-1])) + 1
        for a, z in zip([0, *edge], [*edge, len(block)], strict=True):
            if a == z:
                continue
            if block[a] != current:
                current, held, ready = block[a], [], None
            if not query[a]:
                held.append((ids[a:z], x[a:z]))
            elif held:
                ready = ready or Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), model)
                found = ready.search(ids[a:z], x[a:z], k)
                yield pa.record_batch([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query_id", "vec_id", "score"])


def true_nearest(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> list:
    """The exact k nearest of a few queries among all rows: (query, vec_id, embedding)."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            own, x = t.column(0).to_numpy(), dense(t.column(1))
            s = x @ q.T
            s[own[:, None] == ids] = -np.inf
            at = np.argpartition(-s, min(k, len(s)) - 1, axis=0)[:k] if len(s) else np.zeros((0, len(q)), int)
            n = np.broadcast_to(np.arange(len(q)), at.shape).ravel()
            yield pa.record_batch([pa.array(n, pa.int32()), pa.array(own[at.ravel()], pa.int64()), pa.array(s[at.ravel(), n], pa.float64()), t.column(1).take(pa.array(at.ravel()))], ["n", "vec_id", "s", "embedding"])

    kind = rows.schema["embedding"].dataType.simpleString()
    found = rows.mapInArrow(best, f"n int, vec_id long, s double, embedding {kind}").where(F.col("s") > F.lit(float("-inf")))
    order = Window.partitionBy("n").orderBy(F.desc("s"), "vec_id")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("n", "embedding").collect()


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = 0.97, block: int = 16_384, sample: int = 4_096, probes: int = 200) -> DataFrame:
    """The k nearest by inner product of each row whose vec_id is divisible by `every`, among all other rows.

    Rotations and the codes' centre are learnt on the `sample` rows of least hash (a bound, as for a classifier); every row is indexed. The
    probing radius is the least at which the codes of the true k nearest of `probes` sample rows, found exactly among all rows, are met with
    the share `recall`; it shrinks as a table grows and its nearest rows are nearer. Rows of unequal lengths get a coordinate that makes them
    equally long before they are coded.

    Rows are dealt by hash into blocks of about `block` (more, up to eight times, where the session has fewer shuffle partitions than blocks).
    A task builds the inverted lists of a block once, streams the queries past it, and reranks the rows they meet by the original vectors in
    double precision. Every row is in one block; only queries are sent to each block. A task returns k rows a query, which are merged by rank;
    found pairs are never rows.

    Defined cases: vectors that are null, zero, of another length than most, or hold nulls or non-finite numbers take no
    part; rows that repeat a vec_id are one (the least vector); ties go to the smaller vec_id; fewer than k candidates:
    all; no rows give no rows; other columns are ignored. Returns query_id, rank, vec_id, score.
    """
    spark, sc = vectors.sparkSession, vectors.sparkSession.sparkContext
    kind = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "double"
    e = F.col("embedding").cast(f"array<{kind}>")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), e.alias("embedding")).where(F.coalesce(fine, F.lit(False)))
    rows = cut_lineage(rows.groupBy("vec_id", F.size("embedding").alias("_d")).agg(F.min("embedding").alias("embedding")))
    square = F.aggregate("embedding", F.lit(0.0), lambda n, v: n + v.cast("double") * v.cast("double"))
    sizes = {r["_d"]: r for r in rows.groupBy("_d").agg(F.count(F.lit(1)).alias("n"), F.min(square).alias("least"), F.max(square).alias("most")).collect()}
    dims = max(sizes, key=lambda d: (sizes[d]["n"], -d), default=0)
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, total = rows.where(F.col("_d") == dims).select("vec_id", "embedding"), sizes[dims]["n"]
    longest = float(np.sqrt(sizes[dims]["most"])) if sizes[dims]["least"] < sizes[dims]["most"] * (1 - 1e-4) else 0.0
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    ids, s = np.array([r["vec_id"] for r in got]), np.array([r["embedding"] for r in got], np.float64)
    lifted = lift(s, longest)
    mean, projection = learn_rotation(lifted / np.linalg.norm(lifted, axis=1, keepdims=True))
    if longest:  # queries lie elsewhere than lifted rows: only angles at the origin keep the order
        mean = np.zeros_like(mean)
    known = true_nearest(rows, ids[:probes], s[:probes], k)
    radius = 0
    if known:
        asked = encode(lift_query(s[[r["n"] for r in known]], longest), mean, projection)
        need = np.sort(needed_radius(encode(lift(np.array([r["embedding"] for r in known], np.float64), longest), mean, projection), asked))
        radius = int(need[min(len(need) - 1, int(recall * len(need)))])
    model = sc.broadcast((mean, projection, radius, longest))
    blocks = max(1, -(-total // min(8 * block, max(block, total // spread(vectors)))))
    own = rows.select(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("query"), "vec_id", "embedding")
    asking = rows.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("query"), "vec_id", "embedding")
    dealt = own.union(asking).repartition(8 * blocks, "block").sortWithinPartitions("block", "query")
    found = dealt.mapInArrow(lambda b: search_blocks(b, model.value, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

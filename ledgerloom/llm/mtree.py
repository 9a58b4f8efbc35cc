"""Exact best inner products by best-first search of M-trees."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kit import cut_lineage

#: Entries of a node.
PAGE = 128
#: Distances are compared with this share of the lengths as room for rounding; scores themselves are exact.
SLACK = 1e-6


def whole(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of every component, as doubles; shorter lists are filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(256 * flat)
    return out


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly: in doubles while every sum stays under 2**53, else in Python integers."""
    if len(x) == 0 or np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * len(q) < 2.0**53:
        return (x @ q).astype(np.int64)
    exact = [int(v) for v in q]
    return np.array([sum(int(a) * b for a, b in zip(row, exact, strict=True)) for row in x], object)


def least_copies(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Rows without copies of a vector that have `most` copies of smaller number beside them: those can be in no result."""
    same = np.unique(x, axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    same = same[order]
    return order[np.arange(len(order)) - np.searchsorted(same, same) < most]


class Tree:
    """M-tree of one block. An entry of a node has a routing row (in a leaf: the row itself), a covering radius (in a leaf: 0) and its distance to the
    routing row of the node above. Rows get one more coordinate that makes all equally long, so that the greatest inner product with a query, which has
    0 there, is the least distance."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        keep = least_copies(ids, x, k + 1)
        self.ids, self.x = ids[keep], x[keep]
        square = (self.x * self.x).sum(axis=1)
        self.most = float(square.max(initial=0))
        self.lifted = np.column_stack([self.x, np.sqrt(self.most - square)])
        self.nodes: list[tuple] = []
        self.computed = 0
        self.load(np.random.default_rng(3).permutation(len(self.x)), None)

    def apart(self, rows: np.ndarray, head: int | None) -> np.ndarray:
        return np.zeros(len(rows)) if head is None else np.sqrt(((self.lifted[rows] - self.lifted[head]) ** 2).sum(axis=1))

    def load(self, rows: np.ndarray, head: int | None) -> int:
        """Bulk loading: rows go to the nearest of some of them, and so on below each; equal rows are dealt evenly."""
        at = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= PAGE:
            self.nodes[at] = (rows, self.apart(rows, head), np.zeros(len(rows)), None)
            return at
        fan = min(PAGE, -(-2 * len(rows) // PAGE))
        heads = rows[np.linspace(0, len(rows) - 1, fan).astype(int)]
        near = np.argmax(self.lifted[rows] @ self.lifted[heads].T, axis=1)
        groups = [(h, rows[near == j]) for j, h in enumerate(heads) if (near == j).any()]
        if len(groups) == 1:
            groups = [(g[0], g) for g in np.array_split(rows, fan)]
        heads = np.array([h for h, _ in groups])
        radius = np.array([self.apart(g, h).max() for h, g in groups])
        self.nodes[at] = (heads, self.apart(heads, head), radius, [self.load(g, h) for h, g in groups])
        return at

    def search(self, own: int, q: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(vec_id, score) of the k best rows but the query's own, ties to the smaller number; rows that score under `floor` may be left out.

        The node with the least possible distance is taken first. The distance of a node's routing row to the query and the stored distances of its
        entries to that row bound each entry's distance from below, so entries beyond the k-th best are passed by without a product.
        """
        length = float(q @ q)
        slack = SLACK * (np.sqrt(length) + np.sqrt(self.most))
        distance = lambda s: np.sqrt(np.maximum(length + self.most - 2 * np.asarray(s, np.float64), 0))
        limit = float(distance(floor)) + slack if floor > -np.inf else np.inf
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        heap = [(0.0, 0, -1.0)]
        while heap:
            low, node, head = heappop(heap)
            if low > limit:
                break
            rows, stored, radius, below = self.nodes[node]
            near = np.flatnonzero(np.abs(head - stored) - radius <= limit) if head >= 0 else np.arange(len(rows))
            s = products(self.x[rows[near]], q)
            self.computed += len(s)
            if below is None:
                new = self.ids[rows[near]]
                ids, scores = np.concatenate([ids, new[new != own]]), np.concatenate([scores, s[new != own]])
                top = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[top], scores[top]
                if len(ids) == k:
                    limit = min(limit, float(distance(scores[-1])) + slack)
            else:
                d = distance(s)
                for i, far in zip(near, d, strict=True):
                    if far - radius[i] <= limit:
                        heappush(heap, (max(0.0, far - radius[i]), below[i], far))
        return ids, scores


def search_blocks(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """A partition sorted by block, rows before queries: a block's tree is built once, and its queries stream past it."""
    current, held, tree = None, [], None
    for t in batches:
        block, query, ids, floor = (t.column(i).to_numpy() for i in (0, 1, 2, 4))
        x = whole(t.column(3), width)
        edge = np.flatnonzero((block[1:] != block[:-1]) | (query[1:] != query[:-1])) + 1
        for a, z in zip([0, *edge], [*edge, len(block)], strict=True):
            if a == z:
                continue
            if block[a] != current:
                current, held, tree = block[a], [], None
            if not query[a]:
                held.append((ids[a:z], x[a:z]))
            elif held:
                tree = tree or Tree(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), k)
                found = [tree.search(ids[i], x[i], k, floor[i]) for i in range(a, z)]
                asked = np.repeat(ids[a:z], [len(f[0]) for f in found])
                yield pa.record_batch([pa.array(asked, pa.int64()), pa.array([i for f in found for i in f[0]], pa.int64()), pa.array([int(s) for f in found for s in f[1]], pa.int64())], ["query_id", "vec_id", "score"])


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))])


def to_head(batches: Iterator[pa.RecordBatch], heads: np.ndarray, most: float, width: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) -> with the nearest head and the distance to it."""
    for t in batches:
        x = lifted(whole(t.column(1), width), most)
        near = np.argmax(x @ heads.T, axis=1)
        apart = np.sqrt(((x - heads[near]) ** 2).sum(axis=1))
        yield pa.record_batch([pa.array(near, pa.int32()), pa.array(apart), *t.columns], ["head", "apart", "vec_id", "embedding"])


def route(batches: Iterator[pa.RecordBatch], model: tuple, k: int, width: int) -> Iterator[pa.RecordBatch]:
    """Queries -> a row for each head under which a row may be that is as good as the k-th best of the sample."""
    ids, sample, heads, radius, most = model
    for t in batches:
        own, x = t.column(0).to_numpy(), whole(t.column(1), width)
        s = x @ sample.T
        s[own[:, None] == ids] = -np.inf
        floor = np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(x), -np.inf)
        length = (x * x).sum(axis=1)
        # doubles round products beyond 2**53: a floor a little lower is a floor still
        floor -= np.where(np.isfinite(floor), 1e-9 * (length + most), 0)
        slack = SLACK * (np.sqrt(length) + np.sqrt(most))
        limit = np.where(np.isfinite(floor), np.sqrt(np.maximum(0, length + most - 2 * np.where(np.isfinite(floor), floor, 0))), np.inf)
        low = np.sqrt(np.maximum(0, length[:, None] + most - 2 * x @ heads[:, :-1].T)) - radius
        q, h = np.nonzero(low <= (limit + slack)[:, None])
        at = pa.array(q)
        yield pa.record_batch([pa.array(h, pa.int32()), t.column(0).take(at), t.column(1).take(at), pa.array(floor[q])], ["head", "vec_id", "embedding", "floor"])


def best_products(vectors: DataFrame, k: int = 5, every: int = 50, block: int = 16_384, heads: int = 1_024) -> DataFrame:
    """The k greatest integer inner products of each row whose vec_id is divisible by `every`, among all other rows, exactly.

    The root of the tree is on the driver: at most `heads` rows of least hash (a bound) are routing objects, one for about `block` rows; every row lies
    under the nearest, whose covering radius is the farthest of its rows. A head with more than `block` rows has them dealt by hash over several
    subtrees, so copies of one vector never meet in one task. A task builds the subtree of a block and streams its queries past it; a query goes
    only to heads whose radius reaches the k-th best score of the sampled rows. A task returns k rows a query, which are merged by rank.

    Defined cases: vectors that are null or hold null or non-finite components take no part, nor does a null vec_id; a shorter vector counts as filled with
    zeros, an empty one as zero; rows that repeat a vec_id are one (the least vector); ties go to the smaller vec_id; fewer than k candidates: all;
    no rows give no rows; a score beyond 64 bits is an error; other columns are ignored. Returns query_id, rank, vec_id, score.
    """
    spark, sc = vectors.sparkSession, vectors.sparkSession.sparkContext
    e = F.col("embedding")
    fine = e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.col("vec_id").isNotNull()
    rows = cut_lineage(vectors.where(F.coalesce(fine, F.lit(False))).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding")))
    step = lambda v: F.floor(v.cast("double") * 256).cast("double")
    square = F.aggregate("embedding", F.lit(0.0), lambda n, v: n + step(v) * step(v))
    total, width, most = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding")), F.max(square)).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kind, most = rows.schema["embedding"].dataType.simpleString(), most * (1 + 1e-9)
    got = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(heads).collect()
    ids, sample = np.array([r["vec_id"] for r in got]), whole(pa.array([list(r["embedding"]) for r in got], pa.list_(pa.float64())), width)
    tops = lifted(np.unique(sample[: -(-total // block)], axis=0), most)
    sent = sc.broadcast((tops, most))
    under = rows.mapInArrow(lambda b: to_head(b, *sent.value, width), f"head int, apart double, vec_id long, embedding {kind}")
    radius, pieces = np.full(len(tops), -np.inf), np.zeros(len(tops), int)
    for r in under.groupBy("head").agg(F.max("apart").alias("r"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["head"]], pieces[r["head"]] = r["r"], -(-r["n"] // block)
    first = np.concatenate([[0], np.cumsum(pieces)])
    at = lambda values: F.element_at(F.lit([int(v) for v in values]), F.col("head") + 1)  # noqa: E731  at most `heads` numbers
    own = under.select((at(first[:-1]) + F.pmod(F.xxhash64("vec_id", F.lit(5)), at(pieces))).cast("int").alias("block"), F.lit(0).alias("query"), "vec_id", "embedding", F.lit(0.0).alias("floor"))
    model = sc.broadcast((ids, sample, tops, radius, most))
    asking = rows.where(F.col("vec_id") % every == 0).mapInArrow(lambda b: route(b, model.value, k, width), f"head int, vec_id long, embedding {kind}, floor double").where(at(pieces) > 0)
    asking = asking.select(F.explode(F.sequence(at(first[:-1]), at(first[1:]) - 1).cast("array<int>")).alias("block"), F.lit(1).alias("query"), "vec_id", "embedding", "floor")
    dealt = own.union(asking).repartition(8 * int(first[-1]), "block").sortWithinPartitions("block", "query")
    found = dealt.mapInArrow(lambda b: search_blocks(b, k, width), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def products_sql(k: int = 5, every: int = 50) -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id % {every} = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""

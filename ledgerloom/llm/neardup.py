"""N-gram Jaccard join with Bayesian pruning of MinHash candidates."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import chunks, fmix, word_hashes, words
from .kit import cut_lineage, small_batches, spread

HASHES, ROWS = 96, 4
BANDS = HASHES // ROWS
BLOCK = 256
_seeds = np.random.default_rng(20240229)
MULTIPLY = _seeds.integers(1 << 20, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
ADD = _seeds.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
MIX = _seeds.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(text: pa.Array, size: int = 5) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, one sorted array of distinct shingle hashes a row). A text of fewer than `size` words is one shingle."""
    for first, raw, ends in chunks(pc.utf8_lower(text)):
        start, end, row = words(raw, ends)
        h = word_hashes(raw, start, end)
        at = np.searchsorted(row, np.arange(len(ends)))
        many = np.zeros(0, np.uint64)
        if len(h) >= size:
            many = sum((h[k : len(h) - size + 1 + k] * MIX[k] for k in range(size)), np.uint64(0))
            many = fmix(many)
        sets = []
        for i in range(len(ends) - 1):
            a, z = int(at[i]), int(at[i + 1])
            if z - a >= size:
                sets.append(np.unique(many[a : z - size + 1]))
            elif z > a:
                sets.append(fmix(np.array([np.sum(h[a:z] * MIX[8 : 8 + z - a], dtype=np.uint64) + np.uint64(z - a)], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield first, sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Sixteen bits of the least value of each hash function, a row a set; sets must not be empty."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), HASHES), np.uint16)
    for k in range(HASHES):
        least = np.minimum.reduceat(x * MULTIPLY[k] + ADD[k], starts)
        out[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of ROWS values."""
    whole = np.ascontiguousarray(sig).view(np.uint64)
    return fmix(whole + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def least_matches(threshold: float, tolerance: float, step: int = 16) -> list[tuple[int, int]]:
    """(values compared, least matches to go on). With a uniform prior the similarity given m matches of n is Beta(m + 1,
    n - m + 1), so it reaches the threshold with the probability that a binomial of n + 1 trials is at most m."""
    out = []
    for n in range(step, HASHES + 1, step):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray, rule: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs (a, b) of signature rows are left when values are compared step by step."""
    alive, same, seen = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in rule:
        same = same + (sig[a[alive], seen:n] == sig[b[alive], seen:n]).sum(axis=1, dtype=np.int32)
        keep = same >= least
        alive, same, seen = alive[keep], same[keep], n
    return alive


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component, for links (a, b) among n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted partition, whole, several at once; only the last run is carried over."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        last = 0
        k = [t[c].to_numpy() for c in keys]
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0))
        last = int(change[-1]) + 1 if len(change) else 0
        if last:
            yield t.slice(0, last)
        rest = t.slice(last).combine_chunks()
    if rest is not None and len(rest):
        yield rest


def fixed(column, dtype, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def describe(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, sets in shingle_sets(batch.column(1), size):
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = dict(zip(full, signatures([sets[i] for i in full]), strict=True)) if full else {}
            keys = [digest(s) for s in sets]
            yield pa.record_batch([
                ids.slice(first, len(sets)).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                pa.array([sig[i].tobytes() if i in sig else None for i in range(len(sets))], pa.binary()),
            ], ["doc_id", "n", "k1", "k2", "sig"])


def to_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            keys = band_keys(fixed(batch.column(1), np.uint16, HASHES))
            yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["band", "rep"])


def prune(batches: Iterator[pa.RecordBatch], rule: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """For each block (pair) of a bucket: a forest that joins what the surviving pairs join; at most a row a member."""
    for t in grouped(batches, ["band", "i", "j"]):
        band, i, j = (t[c].to_numpy() for c in ("band", "i", "j"))
        rep, side, sig = t["rep"].to_numpy(), t["side"].to_numpy(), fixed(t["sig"], np.uint16, HASHES)
        edge = np.flatnonzero((band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        starts = np.concatenate([[0], edge])
        sizes = np.diff(np.concatenate([starts, [len(rep)]]))
        out_a, out_b = [], []
        for n in np.unique(sizes[sizes > 1]):
            x, y = np.triu_indices(int(n), 1)
            at = starts[sizes == n]
            for part in np.array_split(at, max(1, len(at) * len(x) // 200_000)):
                a, b = (part[:, None] + x).ravel(), (part[:, None] + y).ravel()
                cross = (i[a] == j[a]) | (side[a] != side[b])  # pairs inside a block have a task of their own
                a, b = a[cross], b[cross]
                alive = survivors(sig, a, b, rule)
                out_a.append(a[alive])
                out_b.append(b[alive])
        if out_a:
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            root = roots(len(rep), a, b)
            node = np.flatnonzero(root != np.arange(len(rep)))
            u, v = rep[node], rep[root[node]]
            yield pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, free of order."""
    return tuple(int(np.asarray(x.sum(dtype=np.uint64)).view(np.int64)) for x in (s, fmix(s)))


def ship(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Texts to shingle sets, if they have the representative's digest (a repeated doc_id may have another text)."""
    names = ["comp", "members", "rep", "copies", "n"]
    for batch in batches:
        k1, k2 = (batch.column(c).to_pylist() for c in ("k1", "k2"))
        for first, sets in shingle_sets(batch.column("text"), size):
            own = [x for x, s in enumerate(sets) if digest(s) == (k1[first + x], k2[first + x])]
            at = pa.array([first + x for x in own], pa.int64())
            yield pa.record_batch([*(batch.column(c).take(at) for c in names), pa.array([sets[x].tobytes() for x in own], pa.binary())], [*names, "set"])


def verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Exact similarities inside each block (pair) of a component, by products of incidence matrices: for each member its
    links, weighted by copies, and its root among the linked."""
    for t in grouped(batches, ["comp", "i", "j"]):
        comp, i, j = (t[c].to_numpy() for c in ("comp", "i", "j"))
        rep, side, copies, n_sets = (t[c].to_numpy() for c in ("rep", "side", "copies", "n"))
        sets = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()]
        edge = np.flatnonzero((comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for first, last in zip([0, *edge], [*edge, len(rep)], strict=True):
            at = first + np.unique(rep[first:last], return_index=True)[1]  # a repeated row is one member
            if len(at) < 2:
                continue
            n = n_sets[at].astype(np.int64)
            both = intersections([sets[x] for x in at])
            linked = den * both >= num * (n[:, None] + n[None, :] - both)
            np.fill_diagonal(linked, False)
            if i[first] != j[first]:
                linked &= side[at, None] != side[None, at]
            links[at] = linked.astype(np.int64) @ copies[at]
            root[at] = at[roots(len(at), *np.nonzero(np.triu(linked)))]
        yield pa.record_batch([pa.array(comp), pa.array(rep), pa.array(links), pa.array(rep[root])], ["comp", "rep", "links", "root"])


def intersections(sets: list[np.ndarray], columns: int = 1 << 12) -> np.ndarray:
    """Sizes of all intersections of a block of sets."""
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[code] > 1  # the others meet nothing
    row, code = row[shared], np.cumsum(seen > 1)[code[shared]] - 1
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, columns):
        a, z = np.searchsorted(code, [lo, lo + columns])
        has = np.zeros((len(sets), min(columns, int(code[-1]) + 1 - lo)), np.float32)
        has[row[a:z], code[a:z] - lo] = 1
        out += has @ has.T
    return np.rint(out).astype(np.int64)


def blocks(df: DataFrame, key: str, size: str, member: str) -> DataFrame:
    """Deal a group of more than BLOCK members into blocks and send each member to every pair of blocks with its own, so
    that a task holds two blocks and never a group. Adds i, j (the pair) and side (the member's block)."""
    n = F.ceil(F.col(size) / BLOCK).cast("int")
    own = df.withColumn("side", F.pmod(F.xxhash64(member, F.lit(3)), n).cast("int"))
    other = F.explode(F.sequence(F.lit(0), n - 1))
    return own.withColumn("_o", other).withColumn("i", F.least("side", "_o")).withColumn("j", F.greatest("side", "_o")).drop("_o", size)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of (u, v), by alternating large-star and small-star steps, each a sum by
    node and a join (Spark parts a hot node's links where a partition gets large); state is checkpointed and lies in as many partitions as its
    rows need, nothing is gathered by node, and the driver sees one sum a round."""

    def settled(rows: DataFrame):
        rows = cut_lineage(rows)
        state = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return rows.coalesce(max(1, -(-state[0] // 20_000))), state

    edges, state = settled(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u != v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a != b")
        edges, now = settled(small.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        if now == state:
            break
        state = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def jaccard_join(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (4, 5), tolerance: float = 1e-6, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Link documents whose sets of `size`-word shingles (lower case) have a Jaccard similarity of at least num/den.

    1. A document becomes its set's 128-bit digest and a MinHash signature; equal sets are one class, whose
       representative is its least doc_id. 2. Classes that share one of 24 bands of 4 values are candidates (a pair at 0.8
       shares none with probability 3e-6). 3. Candidate pairs compare their values sixteen at a time and are dropped when
       the posterior probability of reaching the threshold falls under `tolerance`. 4. What survives is joined into
       components and every pair inside a component is verified exactly on whole shingle sets.
    A bucket or component of any size is cut into blocks of 256; a task sees two blocks, pairs are bits of a matrix in
    it and never rows; what leaves a task is at most a row a member. Representatives of components are broadcast to the
    second read of the texts if they are fewer than `broadcast_rows`, and joined by shuffle otherwise.

    Links between different sets are all counted, which takes work in the square of the number of *different* sets in one
    component; copies cost nothing more.
    Defined cases: null, empty and blank texts have no shingles, are classes of their own and have no links; texts of
    fewer than `size` words are one shingle; repeated rows count as copies; other columns are ignored; null doc_id rows
    form no links. Returns doc_id, class_id (least doc_id of the class), n_links (other documents that it links with).
    """
    small_batches(docs.sparkSession)
    num, den = threshold
    rule = least_matches(num / den, tolerance)
    known = cut_lineage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b: describe(b, size), "doc_id long, n int, k1 long, k2 long, sig binary"))
    full = known.where("n > 0 and doc_id is not null")
    reps = cut_lineage(full.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")))
    bands = reps.select("rep", "sig").mapInArrow(to_bands, "band long, rep long")
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    placed = bands.join(shared, "band").join(reps.select("rep", "sig"), "rep")
    tasks = spread(docs)
    keys = ["band", "i", "j"]
    dealt = blocks(placed, "band", "members", "rep").repartition(tasks, *keys).sortWithinPartitions(*keys)
    forest = dealt.select(*keys, "side", "rep", "sig").mapInArrow(lambda b: prune(b, rule), "u long, v long")
    comps = cut_lineage(components(forest).select(F.col("node").alias("rep"), F.col("root").alias("comp")))
    members = comps.join(comps.groupBy("comp").agg(F.count(F.lit(1)).alias("members")), "comp").join(reps.select("rep", "copies", "n", "k1", "k2"), "rep")
    members = cut_lineage(members)
    chosen = F.broadcast(members) if members.count() <= broadcast_rows else members
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(chosen, "rep")
    sets = texts.select("comp", "members", "rep", "copies", "n", "k1", "k2", "text").mapInArrow(lambda b: ship(b, size), "comp long, members long, rep long, copies long, n int, set binary")
    keys = ["comp", "i", "j"]
    dealt = blocks(sets, "comp", "members", "rep").repartition(tasks, *keys).sortWithinPartitions(*keys)
    checked = cut_lineage(dealt.select(*keys, "side", "rep", "copies", "n", "set").mapInArrow(lambda b: verify(b, num, den), "comp long, rep long, links long, root long"))
    linked = components(checked.select(F.col("root").alias("u"), F.col("rep").alias("v"))).select(F.col("node").alias("rep"), F.col("root").alias("class_id"))
    links = checked.groupBy("rep").agg(F.sum("links").alias("links")).join(linked, "rep", "left")
    classes = reps.select("n", "k1", "k2", "rep", "copies").join(links, "rep", "left")
    shingled = F.coalesce((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    out = known.where(shingled).join(classes, ["n", "k1", "k2"]).select(
        "doc_id", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    return out.unionByName(known.where(~shingled).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def join_sql(size: int = 5) -> str:
    """The same for DuckDB, from all pairs that share a shingle."""
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {size - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    e AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT u, v FROM e JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 5 * k >= 4 * (a.n + b.n - k)),
    c(u, v) AS (SELECT u, v FROM l UNION SELECT c.u, l.v FROM c JOIN l ON c.v = l.u)
    SELECT d.doc_id, coalesce(least(d.doc_id, (SELECT min(v) FROM c WHERE c.u = d.doc_id)), d.doc_id) AS class_id,
        (SELECT count(*) FROM l WHERE l.u = d.doc_id)::BIGINT AS n_links FROM documents d"""

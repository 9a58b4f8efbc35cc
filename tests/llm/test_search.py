"""Lexical search, M-trees and centroids against brute force, with nulls, ties, repeats, empties and long texts."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import centroids, lexical, mtree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def term_list(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    """Every document scored for every item."""
    held = [(i, Counter(term_list(t))) for i, t in docs if term_list(t)]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(term_list(text))
    out = []
    for item, own in asked.items():
        scores = []
        for i, c in held:
            m = 50 + 50 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def library():
    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(60)])
    share = 1 / np.arange(1, 61)
    text = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [(i, text(rng.integers(1, 60))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(90)] + [(7, docs[7][1]), (7, "other W1 w2"), (None, "w3 w59"), (None, None), (2000, None), (2001, ""), (2002, " ,.-"), (2003, "Ünï w5 ÉÉ été"), (2004, text(40_000))]
    items = [(i, text(12)) for i in range(8)] + [(20, None), (21, ""), (22, "none of these"), (23, "w0"), (24, docs[3][1] + " Ünï"), (5, "w58 W57"), (None, "w59 w9"), (25, "ÉÉ")]
    return docs, items


@pytest.mark.parametrize("block", [{}, {"block_rows": 16, "first": 40}, {"block_postings": 50, "most_terms": 20}])
def test_lexical_search(spark, library, block):
    docs, items = library
    given = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, n int").repartition(3)
    got = lexical.rank_documents(given, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string"), k=10, **block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(docs, items, 10)


def test_lexical_search_of_nothing(spark):
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = some.where("doc_id = 0")
    ask = lambda df: df.withColumnRenamed("doc_id", "item_id")
    assert lexical.rank_documents(none, ask(some)).count() == lexical.rank_documents(some, ask(none)).count() == 0
    assert lexical.rank_documents(spark.createDataFrame([(1, None), (2, ".")], "doc_id long, text string"), ask(some)).count() == 0


def test_best_positions_stop_early():
    """Impacts that fall quickly: the search ends long before the lists do, with the same best rows."""
    rng = np.random.default_rng(0)
    n, v = 20_000, 4
    tf = np.ones((n, v), np.int64)
    tf[rng.permutation(n)[:100]] = 50
    lists = lexical.Lists(np.full(n, 100), np.full(n, v), np.tile(np.arange(v), n), tf.ravel(), np.full(v, 900), n, 100 * n)
    docs, scores = lists.search(np.arange(v), 10, 0)
    assert lists.accessed < n * v / 10
    assert sorted(scores)[-10:] == sorted((900 * (10**9 * tf // (1000 * tf + 2000))).sum(axis=1))[-10:]
    assert set(docs[np.argsort(-scores)[:10]]) <= set(np.flatnonzero(tf[:, 0] == 50))


def products(rows, k, every):
    held = {}
    for i, e in rows:
        if i is not None and e is not None and all(v is not None and math.isfinite(v) for v in e):
            held[i] = min(held.get(i, e), e)
    whole = {i: [math.floor(256 * v) for v in e] for i, e in held.items()}
    out = []
    for q in whole:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=False)), i) for i in whole if i != q)
            out += [(q, r, i, -x) for r, (x, i) in enumerate(s[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    e = rng.normal(size=(700, 6)) * rng.uniform(0.1, 3, (700, 1))
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(e)]
    rows += [(800 + i, rows[10][1]) for i in range(200)]  # copies of one vector
    rows += [(1000, None), (1010, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1020, [math.nan] * 6), (1030, [math.inf] + [0.0] * 5), (1040, [0.0] * 6), (1050, [2.0, 1.0]), (1060, []), (None, [1.0] * 6), (20, rows[20][1]), (30, [-9.0] * 6)]
    return rows


@pytest.mark.parametrize(("block", "heads"), [(16_384, 1024), (64, 1024), (64, 3)])
def test_best_products(spark, vectors, block, heads):
    given = spark.createDataFrame([(i, e, 1, 0) for i, e in vectors], "vec_id long, embedding array<double>, score int, block int").repartition(3)
    got = mtree.best_products(given, k=5, every=10, block=block, heads=heads)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == products(vectors, 5, 10)


def test_best_products_of_little(spark):
    kind = "vec_id long, embedding array<float>"
    assert mtree.best_products(spark.createDataFrame([], kind)).count() == 0
    assert mtree.best_products(spark.createDataFrame([(50, [1.0])], kind)).count() == 0
    far = spark.createDataFrame([(50, [3e6, 1.0]), (1, [3e6, -1.0]), (2, [3e6, 1.0])], kind)  # products beyond 2**53
    want = [(50, 1, 2, (256 * 3_000_000) ** 2 + 256**2), (50, 2, 1, (256 * 3_000_000) ** 2 - 256**2)]
    assert sorted(tuple(r) for r in mtree.best_products(far).select("query_id", "rank", "vec_id", "score").collect()) == want


def test_tree_avoids_products():
    """On clustered rows most are never measured, and those found are the same."""
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(50, 16)) * 4000
    x = np.floor(middle[rng.integers(0, 50, 8000)] + rng.normal(size=(8000, 16)) * 60)
    tree = mtree.Tree(np.arange(8000), x, 5)
    for q in range(0, 8000, 400):
        ids, scores = tree.search(q, x[q], 5, -np.inf)
        s = x @ x[q]
        s[q] = -np.inf
        assert list(ids) == list(np.lexsort((np.arange(8000), -s))[:5]) and (scores == s[ids]).all()
    assert tree.computed < 0.25 * 20 * 8000


def clustered(rows, k, rounds, dims, seed):
    held = [(i, [math.floor(256 * v) for v in e]) for i, e in rows if e is not None and len(e) == dims and all(v is not None and math.isfinite(v) for v in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    c = [e for _, e in sorted(held, key=key)[:k]]
    assign = lambda e: min((sum((a - b) ** 2 for a, b in zip(e, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, e in held:
            groups.setdefault(assign(e)[1], []).append(e)
        c = [[sum(v) // len(groups[j]) for v in zip(*groups[j], strict=True)] if j in groups else x for j, x in enumerate(c)]
    out = [(i, *assign(e)[::-1]) for i, e in held]
    each = Counter()
    for _, j, d in out:
        each[j] += d
    return sorted(((i, j, d, each[j], each.total(), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out), key=str)


def test_clusters(spark, vectors):
    given = spark.createDataFrame([(i, e, 9, "x") for i, e in vectors], "vec_id long, embedding array<double>, cluster int, distance string").repartition(3)
    for k, rounds in ((12, 3), (2000, 1)):
        got = centroids.cluster_vectors(given, k=k, rounds=rounds, dims=6, seed=2)
        assert sorted((tuple(r) for r in got.collect()), key=str) == clustered(vectors, k, rounds, 6, 2)
    assert centroids.cluster_vectors(given.where("vec_id < 0"), dims=6).count() == 0
    assert centroids.cluster_vectors(given).count() == 0  # none has 64 components


def test_nearest_centroid():
    """Ties go to the smaller number, large components are exact, and means and deviations spare most distances."""
    rng = np.random.default_rng(1)
    c = rng.integers(-9, 9, (30, 5))
    c[20] = c[4]
    x = np.concatenate([rng.integers(-9, 9, (500, 5)), c])
    want = ((x[:, None] - c) ** 2).sum(axis=2)
    to, d, _ = centroids.nearest(x, c)
    assert (to == want.argmin(axis=1)).all() and (d == want.min(axis=1)).all()
    big = np.array([[2**31, 0], [2**31 + 1, 0]], object)
    assert centroids.nearest(big, np.array([[2**31 + 1, 1], [0, 0]], object))[1].tolist() == [2, 1]
    level = np.arange(40)[:, None] * 1000 + rng.integers(-50, 50, (40, 64))
    near = level[rng.integers(0, 40, 2000)] + rng.integers(-50, 50, (2000, 64))
    to, d, computed = centroids.nearest(near, level)
    want = ((near[:, None] - level) ** 2).sum(axis=2)
    assert (d == want.min(axis=1)).all() and computed < 0.1 * want.size


def test_whole_numbers():
    got = mtree.whole(pa.array([[0.5, -0.001], [], [1.0]], pa.list_(pa.float32())), 2)
    assert got.tolist() == [[128, -1], [0, 0], [256, 0]]

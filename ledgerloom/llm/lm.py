"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import chunks, fmix, word_hashes, words
from .kit import cut_lineage

#: Output classes: the most frequent tokens have one each, the others share classes by their last two bytes.
OWN, SUFFIX = 768, 256
#: Tokens whose counts every task has at hand (16 bytes each); counts of all the others come by a join.
TABLE = 131_072
END = np.uint64(0x5851F42D4C957F2D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2


def tokens(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, hash, suffix class and row of every token): a row's words in lower case and one end."""
    for first, raw, ends in chunks(text):
        raw = _LOWER[raw]
        start, end, row = words(raw, ends)
        rows = len(ends) - 1
        tail = raw[end - 1].astype(np.uint64) << np.uint64(8)
        tail[end - start > 1] |= raw[end[end - start > 1] - 2]
        h = np.concatenate([word_hashes(raw, start, end), np.full(rows, END)])
        suffix = np.concatenate([(fmix(tail + np.uint64(1)) % np.uint64(SUFFIX)).astype(np.int32), np.zeros(rows, np.int32)])
        row = np.concatenate([row, np.arange(rows)])
        order = np.argsort(row, kind="stable")
        yield first, rows, h[order], suffix[order], row[order]


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, class, count) of training texts, summed over the task."""
    kept: list[tuple] = []

    def merged():
        h, at = np.concatenate([x[0] for x in kept]), np.concatenate([x[1] for x in kept])
        h, first, inv = np.unique(h, return_index=True, return_inverse=True)
        return h, at[first], np.bincount(inv, np.concatenate([x[2] for x in kept])).astype(np.int64)

    for b in batches:
        for _, _, h, suffix, _ in tokens(b.column(0)):
            h, first, n = np.unique(h, return_index=True, return_counts=True)
            kept.append((h, suffix[first], n))
            if len(kept) == 8:
                kept = [merged()]
    if kept:
        h, suffix, n = merged()
        yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(suffix, pa.int32()), pa.array(n)], ["h", "suffix", "c"])


class Vocabulary:
    """The frequent tokens: sorted hashes, their counts, and their own class (-1: none)."""

    def __init__(self, h: np.ndarray, c: np.ndarray, own: np.ndarray):
        order = np.argsort(h)
        self.h, self.c, self.own = h[order], c[order], own[order]

    def find(self, h: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or 0, class) of tokens."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), suffix + OWN
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        known = self.h[at] == h
        return np.where(known, self.c[at], 0), np.where(known & (self.own[at] >= 0), self.own[at], suffix + OWN)


def pairs_of(cls: np.ndarray, row: np.ndarray, start: int) -> np.ndarray:
    """The class before each token; `start` at the start of a text."""
    before = np.empty_like(cls)
    before[1:] = cls[:-1]
    fresh = np.ones(len(row), bool)
    fresh[1:] = row[1:] != row[:-1]
    before[fresh] = start
    return before


def count_pairs(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, start: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((OWN + SUFFIX) ** 2, np.int64)
    for b in batches:
        for _, _, h, suffix, row in tokens(b.column(0)):
            cls = vocabulary.find(h, suffix)[1]
            total += np.bincount(pairs_of(cls, row, start) * np.int64(OWN + SUFFIX) + cls, minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at), pa.array(total[at])], ["pair", "c"])


def train(pairs: np.ndarray, size: int = 48, noise: float = 20.0, steps: int = 250, rate: float = 0.03, seed: int = 7) -> np.ndarray:
    """Log10 probabilities (context class x class) of a log-bilinear model: s(c, w) = (C r_c) . q_w + b_w.

    Noise-contrastive estimation against the unigram distribution with `noise` noise tokens a token. The objective needs
    a corpus only through its class pair counts, so every step (Adam) uses all of it and the expectation over noise is
    taken exactly. In the end each context's scores are normalised over all classes by one matrix product.
    """
    n = len(pairs)
    rng = np.random.default_rng(seed)
    unigram = (pairs.sum(axis=0) + 0.1) / (pairs.sum() + 0.1 * n)
    context = pairs.sum(axis=1, keepdims=True)
    scale = 1 / max(1.0, pairs.sum())
    theta = {"r": rng.normal(0, 0.1, (n, size)), "C": np.eye(size) + rng.normal(0, 0.02, (size, size)), "q": rng.normal(0, 0.1, (n, size)), "b": np.log(unigram)}
    first, second = ({k: np.zeros_like(v) for k, v in theta.items()} for _ in range(2))
    shift = np.log(noise * unigram)
    # A context's weight is damped, or rare contexts would hardly learn.
    damp = scale * (1 + context.mean() / (1 + context)) ** 0.5
    for t in range(1, steps + 1 if pairs.sum() else 1):
        rc = theta["r"] @ theta["C"]
        p = 1 / (1 + np.exp(-np.clip(rc @ theta["q"].T + theta["b"] - shift, -30, 30)))
        g = damp * (pairs * (1 - p) - context * noise * unigram * p)
        grad = {"q": g.T @ rc, "b": g.sum(axis=0), "C": theta["r"].T @ (g @ theta["q"]), "r": (g @ theta["q"]) @ theta["C"].T}
        for k, v in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            theta[k] = theta[k] + rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-9)
    s = (theta["r"] @ theta["C"]) @ theta["q"].T + theta["b"]
    s -= s.max(axis=1, keepdims=True)
    return (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.log(10)


class Inside:
    """Probabilities of tokens inside shared classes: absolute discounting, what is discounted goes to the unseen token."""

    def __init__(self, discount: float, count: np.ndarray, distinct: np.ndarray):
        self.discount = discount
        self.total = np.log10(np.maximum(count, 1))
        self.unseen = np.where(count > 0, np.log10(np.maximum(discount * distinct, 1e-300)), 0.0)


def score_rows(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, table: np.ndarray, start: int, inside: Inside) -> Iterator[pa.RecordBatch]:
    """A head row for each text with what the task knows of it, and a row for each of its rarer tokens (h, tf)."""
    for b in batches:
        for first, rows, h, suffix, row in tokens(b.column(1)):
            c, cls = vocabulary.find(h, suffix)
            here = c > 0
            gain = np.where(here, np.log10(c + 1.0), 0.0)
            share = np.where(here, np.log10(np.maximum(c, 1) - inside.discount), 0.0) - inside.total[cls]
            part = table[pairs_of(cls, row, start), cls] + np.where(cls >= OWN, share, 0.0)
            total = lambda x: np.bincount(row, x, rows)  # noqa: B023, E731
            ids = b.column(0).slice(first, rows)  # as they are: an id may be null, or past what a double holds
            same = np.zeros(rows, np.uint64)
            np.add.at(same, row, fmix(h + np.arange(len(h), dtype=np.uint64) - np.searchsorted(row, np.arange(rows)).astype(np.uint64)[row]))
            rare = np.flatnonzero(~here)
            rare = rare[np.lexsort((h[rare], row[rare]))]
            fresh = np.ones(len(rare), bool)
            fresh[1:] = (row[rare[1:]] != row[rare[:-1]]) | (h[rare[1:]] != h[rare[:-1]])
            key = rare[fresh]
            tf = np.diff(np.append(np.flatnonzero(fresh), len(rare)))
            at, zeros = row[key], np.zeros(len(key))
            cols = {
                "doc_id": pa.concat_arrays([ids, ids.take(pa.array(at))]), "same": np.concatenate([same, same[at]]).view(np.int64), "h": np.concatenate([same, h[key]]).view(np.int64),
                "tf": np.concatenate([np.zeros(rows, np.int64), tf]), "heads": np.concatenate([np.ones(rows, np.int64), np.zeros(len(key), np.int64)]),
                "n": np.concatenate([total(np.ones(len(row))), zeros]).astype(np.int64), "known": np.concatenate([total(here), zeros]).astype(np.int64),
                "gain": np.concatenate([total(gain), zeros]), "model": np.concatenate([total(part), zeros]),
                "unseen": np.concatenate([np.zeros(rows), inside.unseen[cls[key]] * tf]),
            }
            yield pa.record_batch([v if isinstance(v, pa.Array) else pa.array(v) for v in cols.values()], list(cols))


def frequent(counts: DataFrame) -> DataFrame:
    """The most frequent tokens, at most TABLE: those over the least step of a logarithmic scale of counts that leaves so few."""
    step = F.floor(F.log2("c") * 64)
    steps = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, total = 1 << 20, 0
    for s, n in steps:
        total += n
        if total > TABLE:
            break
        least = s
    return counts.where(step >= least)


def score_documents(docs: DataFrame) -> DataFrame:
    """Score every whole text with an add-one unigram base and a log-bilinear model, both learnt from the texts whose
    crc32(doc_id) mod 7 is not 2.

    Counts of all training tokens come from one aggregation over the corpus. The model predicts a token's class from the
    class before it (768 frequent tokens, 256 classes of the others) and the token inside a class by absolute discounting, so
    probabilities sum to 1 over all tokens, one unseen token a class included. Counts of at most 131,072 most frequent tokens go to
    every task; those of the rarer ones come by a join on 64-bit token hashes, with only sums by document behind it.
    The driver holds that table, the classes' sums and at most 1024 x 1024 class pair counts, whatever the corpus.

    Defined cases: null text is empty: one end token; repeated rows are scored each; without training texts every
    count is 0 and classes are uniform; ties in frequency go by hash; other columns are ignored; a null doc_id is a
    training text.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    training = rows.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("text")
    counts = cut_lineage(training.mapInArrow(count_tokens, "h long, suffix int, c long").groupBy("h").agg(F.min("suffix").alias("suffix"), F.sum("c").alias("c")))
    top = frequent(counts).toPandas().sort_values(["c", "h"], ascending=[False, True], ignore_index=True)
    h, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    own = np.where(np.arange(len(h)) < OWN - 1, np.arange(len(h)), -1)
    if END in h:  # the end has a class of its own, however few texts there are
        own[h == END] = OWN - 1
    vocabulary = Vocabulary(h, c, own)
    start = OWN - 1
    once_or_twice = [F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2)]
    sums = counts.groupBy("suffix").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"), *once_or_twice).collect()
    count, distinct = np.zeros(OWN + SUFFIX), np.zeros(OWN + SUFFIX)
    for r in sums:
        count[OWN + r["suffix"]], distinct[OWN + r["suffix"]] = r["c"], r["v"]
    mine = own >= 0
    np.subtract.at(count, OWN + top["suffix"].to_numpy(np.int64)[mine], c[mine])
    np.subtract.at(distinct, OWN + top["suffix"].to_numpy(np.int64)[mine], 1)
    n1, n2 = (sum(r[k] for r in sums) for k in ("n1", "n2"))
    inside = Inside(float(np.clip(n1 / max(1, n1 + 2 * n2), 0.1, 0.9)), count, distinct)
    n_train, n_distinct = sum(r["c"] for r in sums), sum(r["v"] for r in sums)
    # Broadcasts carry arrays: executors need no copy of the library to read them.
    shared = sc.broadcast((vocabulary.h, vocabulary.c, vocabulary.own))
    got = training.mapInArrow(lambda b: count_pairs(b, Vocabulary(*shared.value), start), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toPandas()
    pairs = np.zeros((OWN + SUFFIX) ** 2)
    pairs[got["pair"].to_numpy(np.int64)] = got["c"].to_numpy(np.float64)
    discount = inside.discount
    model = sc.broadcast((train(pairs.reshape(OWN + SUFFIX, -1)), discount, count, distinct))
    parts = rows.mapInArrow(
        lambda b: score_rows(b, Vocabulary(*shared.value), model.value[0], start, Inside(*model.value[1:])),
        "doc_id long, same long, h long, tf long, heads long, n long, known long, gain double, model double, unseen double",
    )
    looked = parts.alias("p").join(counts.select("h", F.col("c").alias("_c")).alias("c"), (F.col("p.h") == F.col("c.h")) & (F.col("p.tf") > 0), "left")
    more = F.col("tf") * F.log10(F.coalesce("_c", F.lit(0)) + 1)
    inner = F.when(F.col("_c") > 0, F.col("tf") * F.log10(F.col("_c") - inside.discount)).otherwise(F.col("unseen"))
    total = looked.groupBy("doc_id", "same").agg(
        F.sum("heads").alias("heads"), F.sum("n").alias("n"), F.sum(F.col("known") + F.when(F.col("_c") > 0, F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("gain") + more).alias("gain"), F.sum(F.col("model") + inner).alias("model"))
    once = total.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("heads"))).alias("_i"), *((F.col(x) / F.col("heads")).alias(x) for x in ("n", "known", "gain", "model")))
    floor = float(np.log10(n_train + n_distinct + 1))
    return once.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("n").cast("long").alias("n_tokens"), F.col("known").cast("long").alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"), (F.col("gain") - F.col("n") * floor).alias("base_score"), F.col("model").alias("score"))

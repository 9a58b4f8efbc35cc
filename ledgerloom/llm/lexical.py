"""Ranked lexical search by the Best Position Algorithm over impact lists."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kit import shared_folder

#: Bytes of terms: digits, letters of ASCII (A-Z become a-z) and all of other characters; the rest parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A document's m is 50 for length alone, and 50 times its length against the mean.
SCALE, TF, LENGTH, FLAT = 1_000_000_000, 1000, 20, 50


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) -> a row for each term of an item."""
    for b in batches:
        own = [sorted(set(terms(t or b""))) for t in b.column(1).to_pylist()]
        at = np.repeat(np.arange(len(own)), [len(t) for t in own])
        yield pa.record_batch([b.column(0).take(pa.array(at)), pa.array([t for x in own for t in x], pa.binary())], ["item_id", "term"])


def post(batches: Iterator[pa.RecordBatch], numbers: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> doc_id, number of terms, asked terms and how often each occurs; documents without terms go."""
    for b in batches:
        keep, size, own, often = [], [], [], []
        for i, text in enumerate(b.column(1)):
            counts = Counter(terms(text.as_py() or b""))
            if counts:
                held = [(numbers[t], c) for t, c in counts.items() if t in numbers]
                keep.append(i)
                size.append(counts.total())
                own.append([t for t, _ in held])
                often.append([c for _, c in held])
        yield pa.record_batch([b.column(0).take(pa.array(keep, pa.int64())), pa.array(size, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tf"])


class Lists:
    """Impact lists of one block of documents: for each term its documents, greatest impact first, and for each document its places in the lists."""

    def __init__(self, sizes: np.ndarray, held: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, documents: int, total: int):
        m = FLAT + (FLAT * sizes * documents) // total
        doc = np.repeat(np.arange(len(sizes)), held)
        some = weights[term] > 0
        doc, term, tf = doc[some], term[some], tf[some].astype(np.int64)
        impact = (SCALE * tf) // (TF * tf + LENGTH * m[doc])
        order = np.lexsort((doc, -impact, term))
        #: By list: documents and impacts. By document: terms and places in the lists.
        self.docs, self.impact, self.term = doc[order], impact[order], term
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.own = np.searchsorted(doc, np.arange(len(sizes) + 1))
        self.first = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.weights, self.slot = weights, np.full(len(weights), -1, np.int64)
        self.accessed = 0

    def search(self, asked: np.ndarray, k: int, floor: int, step: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of those that may be among the k best; scores under `floor` cannot.

        A round reads the next positions of every list and looks the documents met up in all lists. A list's best position is the last of those
        seen without a gap from its start, by reading or by looking up; a document not met scores at most the sum of the impacts there. That sum
        strictly below the k-th score ends the search: an equal score might still win by its doc_id.
        """
        asked = asked[self.first[asked + 1] > self.first[asked]]
        lo, w = self.first[asked], self.weights[asked]
        size = self.first[asked + 1] - lo
        base = np.concatenate([[0], np.cumsum(size)])
        self.slot[asked] = np.arange(len(asked))
        seen, met = np.zeros(base[-1], bool), np.zeros(len(self.own) - 1, bool)
        best, depth = np.zeros(len(asked), np.int64), 0
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while (best < size).any():
            new = np.concatenate([self.docs[a + depth : a + min(depth + step, s)] for a, s in zip(lo, size, strict=True)])
            new = np.unique(new[~met[new]])
            met[new] = True
            many = self.own[new + 1] - self.own[new]
            at = np.arange(many.sum()) + np.repeat(self.own[new] - np.cumsum(many) + many, many)
            one, slot = np.repeat(np.arange(len(new)), many), self.slot[self.term[at]]
            one, slot, place = one[slot >= 0], slot[slot >= 0], self.place[at[slot >= 0]]
            self.accessed += len(place)
            seen[base[slot] + place - lo[slot]] = True
            gained = np.zeros(len(new), np.int64)
            np.add.at(gained, one, w[slot] * self.impact[place])
            found, scores = np.concatenate([found, new]), np.concatenate([scores, gained])
            for i in np.flatnonzero(best < size):
                rest = seen[base[i] + best[i] : base[i + 1]]
                gap = int(rest.argmin())
                best[i] += len(rest) if rest[gap] else gap
            open_ = best < size
            bound = int((w * self.impact[lo + np.maximum(best, 1) - 1])[open_].sum())
            kth = int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0
            if max(kth, floor) > bound:
                break
            depth, step = depth + step, 2 * step
        self.slot[asked] = -1
        keep = (scores > 0) & (scores >= floor)
        return found[keep], scores[keep]


def search_blocks(batches: Iterator[pa.RecordBatch], model: tuple, k: int, block_rows: int, block_postings: int) -> Iterator[pa.RecordBatch]:
    """Postings in batches -> each item's k best of every block; a block ends at so many documents or postings, so no task holds more."""
    weights, items, floors, documents, total = model
    held: list[pa.RecordBatch] = []

    def found() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        ids = t.column("doc_id").combine_chunks()
        own, often = (t.column(c).combine_chunks() for c in ("terms", "tf"))
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (own, often)]
        lists = Lists(t.column("n").to_numpy(), own.value_lengths().to_numpy(zero_copy_only=False), *flat, weights, documents, total)
        key, none = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        out: list[list[np.ndarray]] = [[], [], []]
        for i, (asked, floor) in enumerate(zip(items, floors, strict=True)):
            docs, scores = lists.search(asked, k, floor)
            top = np.lexsort((key[docs], none[docs], -scores))[:k]
            for column, value in zip(out, (np.full(len(top), i), docs[top], scores[top]), strict=True):
                column.append(value)
        item, docs, scores = (np.concatenate(x) for x in out)
        yield pa.record_batch([pa.array(item, pa.int32()), ids.take(pa.array(docs)), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    rows = postings = 0
    for b in batches:
        for part in (b.slice(i, block_rows) for i in range(0, b.num_rows, block_rows)):
            held.append(part)
            rows, postings = rows + part.num_rows, postings + len(part.column(2).flatten())
            if rows >= block_rows or postings >= block_postings:
                yield from found()
                held, rows, postings = [], 0, 0
    if held and rows and items:
        yield from found()


def top_rows(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, most_terms: int = 200_000, block_rows: int = 16_384, block_postings: int = 4_000_000, first: int = 8_192) -> DataFrame:
    """The k highest-scoring documents of each item: every document is indexed, every list is read as far as its threshold asks.

    Items are taken in groups whose terms together are at most `most_terms` (a group of one item may have more: the terms of one text), as these
    are broadcast; each group passes over the documents once. A pass counts each text's terms in Arrow batches and writes the asked ones as
    postings; counts over all documents make the weights. Tasks then build the impact lists of blocks of postings where they lie, with no
    shuffle, and search each for every item. About `first` documents, taken by hash, are searched before: the k-th score there is a floor for all blocks,
    below which nothing can be among the best. Only k rows an item and task are shuffled.

    Defined cases: null texts and texts without terms have no part, nor in counts; items without terms have no rows; rows of one item_id are one item
    with the terms of all (null is an item as well); repeated documents count and rank each on its own; a null doc_id ranks behind equal scores;
    no rows give no rows; other columns are ignored. Returns item_id, rank, doc_id, score.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    kind, named = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"item int, doc_id {kind}, score long"
    folder = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    asked = items.select("item_id", F.col("text").cast("binary")).mapInArrow(item_terms, f"item_id {named}, term binary").distinct()
    asked.write.parquet(f"{folder}/items")
    asked = spark.read.parquet(f"{folder}/items")
    pairs, each = asked.count(), asked.select("item_id").distinct().count()
    group = lambda n: F.pmod(F.xxhash64("item_id"), F.lit(n))
    groups = max(1, -(-pairs // most_terms))
    while groups < each and asked.groupBy(group(groups).alias("g")).count().agg(F.max("count")).first()[0] > most_terms:
        groups *= 2
    out = spark.createDataFrame([], f"item_id {named}, rank int, doc_id {kind}, score long")
    for g in range(groups if pairs else 0):
        own: dict = {}
        numbers: dict[bytes, int] = {}
        for r in asked.where(group(groups) == g).collect():
            own.setdefault(r["item_id"], []).append(numbers.setdefault(bytes(r["term"]), len(numbers)))
        known = sc.broadcast(numbers)
        path = f"{folder}/{g}"
        texts = docs.select("doc_id", F.col("text").cast("binary"))
        texts.mapInArrow(lambda b, known=known: post(b, known.value), f"doc_id {kind}, n long, terms array<int>, tf array<int>").write.parquet(path)
        posted = spark.read.parquet(path)
        documents, total = posted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            continue
        df = np.zeros(len(numbers), np.int64)
        for r in posted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        names = list(own)
        lists = [np.array(own[i], np.int64) for i in names]
        search = lambda rows, floors, w=weights, li=lists, n=documents, t=total: _searched(rows, (w, li, floors, n, t), k, schema, block_rows, block_postings)
        some = posted.where(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(max(1, documents // first))) == 0).repartition(1)
        floors = [0] * len(names)
        for r in top_rows(search(some, floors), k).where(F.col("rank") == k).collect():
            floors[r["item"]] = r["score"]
        top = top_rows(search(posted, floors), k).select("item", "rank", "doc_id", "score")
        held = spark.createDataFrame([(n, i) for n, i in enumerate(names)], f"item int, item_id {named}")
        out = out.union(top.join(held, "item").select("item_id", "rank", "doc_id", "score"))
    return out


def _searched(rows: DataFrame, model: tuple, k: int, schema: str, block_rows: int, block_postings: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(lambda b: search_blocks(b, sent.value, k, block_rows, block_postings), schema)


def rank_sql(k: int = 50) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut = lambda c: rf"regexp_extract_all(translate({c}, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {cut("text")} AS t FROM documents), s AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
p AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({cut("text")}) AS term FROM benchmark),
m AS (SELECT rid, doc_id, 50 + (50 * len(t)::BIGINT * n) // l AS m FROM d, s WHERE len(t) > 0),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY item_id, rid, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= {k}"""

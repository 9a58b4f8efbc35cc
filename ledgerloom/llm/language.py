"""Language identification with blended-spectrum presence kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import chunks
from .kit import small_batches

LETTER = r"\p{L}"
UNKNOWN = "und"


def gram_codes(raw: np.ndarray) -> np.ndarray:
    """Codes below 2**24 of the byte n-grams of 1 to 3 (as base-256 numbers, which differ by length as no text has byte 0)."""
    x = raw.astype(np.int32)
    one, two = x, (x[:-1] << 8) | x[1:]
    return np.concatenate([one, two, (two[:-1] << 8) | x[2:]]) if len(x) > 2 else np.concatenate([one, two])


def texts_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The lower-cased bytes of each text, with a blank at both ends."""
    for _, raw, ends in chunks(pc.utf8_lower(column)):
        for a, z in zip(ends[:-1], ends[1:], strict=True):
            yield np.concatenate([[32], raw[a:z], [32]]).astype(np.uint8)


class Model:
    """Labels and what a task needs to score: the n-gram vocabulary, landmarks' weights on it, and ridge coefficients."""

    def __init__(self, labels: list[str], grams: np.ndarray, landmarks: np.ndarray, whiten: np.ndarray, coef: np.ndarray, sharpness: float):
        self.labels, self.grams, self.landmarks, self.whiten, self.coef, self.sharpness = labels, grams, landmarks, whiten, coef, sharpness
        self._index = None

    @property
    def index(self) -> np.ndarray:
        """n-gram code -> place in the vocabulary, or one behind it."""
        if self._index is None:
            self._index = np.full(1 << 24, len(self.grams), np.min_scalar_type(len(self.grams)))
            self._index[self.grams] = np.arange(len(self.grams))
        return self._index

    @property
    def parts(self) -> tuple:
        """What a broadcast carries: executors need no copy of the library to read it."""
        return self.labels, self.grams, self.landmarks, self.whiten, self.coef, self.sharpness

    def presence(self, texts: list[np.ndarray]) -> np.ndarray:
        """Unit rows: which n-grams of the vocabulary are in each text, however often."""
        has = np.zeros((len(texts), len(self.grams) + 1), np.float32)
        for i, x in enumerate(texts):
            has[i, self.index[gram_codes(x)]] = 1
        has = has[:, :-1]
        has /= np.maximum(1, np.sqrt(has.sum(axis=1, keepdims=True)))
        return has

    def decide(self, texts: list[np.ndarray]) -> np.ndarray:
        """Decision values of all labels: kernel with the landmarks, then Nyström features, then ridge coefficients."""
        phi = (self.presence(texts) @ self.landmarks.T) @ self.whiten
        return np.concatenate([phi, np.ones((len(phi), 1), phi.dtype)], axis=1) @ self.coef


def fit(codes: list[np.ndarray], labels: list[str], landmarks: int = 192, ridge: float = 1e-2, rare: int = 3) -> Model:
    """One-versus-rest kernel ridge regression on Nyström features of a bounded sample.

    codes: each text's distinct n-gram codes. The kernel counts shared n-grams of 1 to 3 bytes, each once, over the
    root of both counts; n-grams in fewer than `rare` sample texts are left out. Landmarks are taken from all labels in turn.
    """
    names = sorted(set(labels))
    grams, seen = np.unique(np.concatenate(codes), return_counts=True)
    grams = grams[seen >= min(rare, len(codes))]
    model = Model(names, grams, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0)), 1.0)
    has = np.zeros((len(codes), len(grams) + 1), np.float32)
    for i, c in enumerate(codes):
        at = np.minimum(np.searchsorted(grams, c), max(0, len(grams) - 1))
        has[i, np.where(grams[at] == c, at, len(grams)) if len(grams) else 0] = 1
    has = has[:, :-1]
    has /= np.maximum(1, np.sqrt(has.sum(axis=1, keepdims=True)))
    y = np.array([names.index(x) for x in labels])
    turn = sorted(range(len(labels)), key=lambda i: (np.sum(y[:i] == y[i]), y[i]))[:landmarks]
    model.landmarks = has[turn]
    value, vector = np.linalg.eigh((model.landmarks @ model.landmarks.T).astype(np.float64))
    keep = value > 1e-5 * value.max()
    model.whiten = (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)
    phi = np.concatenate([(has @ model.landmarks.T) @ model.whiten, np.ones((len(has), 1), np.float32)], axis=1).astype(np.float64)
    goal = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1 / np.bincount(y, minlength=len(names))[y]  # languages count alike, however common
    a = (phi * weight[:, None]).T @ phi
    model.coef = np.linalg.solve(a + ridge * np.trace(a) / len(a) * np.diag([*[1.0] * (len(a) - 1), 1e-6]), (phi * weight[:, None]).T @ goal).astype(np.float32)
    model.sharpness = 4.0
    return model


def learn(docs: DataFrame, each: int = 400, **options) -> Model | None:
    """Fit on a bounded sample: of every lang the `each` different documents with the least hash of doc_id and text, of those whose
    crc32(doc_id) mod 5 is not 0, that have a lang and a letter.

    No task sorts a language: its count of rows tells under which hash about twice `each` of them lie (more in the next pass, if repeated rows
    leave too few), and only those are looked at, as distinct n-gram codes.
    """
    small_batches(docs.sparkSession)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    usable = docs.where((fold != 0) & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    hashed = usable.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62)).alias("_h"))
    left = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    factor, rows = 2, []
    while left:
        under = F.create_map(*[F.lit(x) for lang, n in left.items() for x in (lang, (1 << 62) * min(factor * each, n) // n)])
        slim = hashed.where(F.col("_h") <= F.try_element_at(under, F.col("lang"))).groupBy("lang", "_h").agg(F.first("text").alias("text"))
        got: dict[str, list] = {}
        for r in slim.select("_h", "lang", "text").mapInArrow(_codes, "h long, lang string, codes binary").collect():
            got.setdefault(r["lang"], []).append(r)
        for lang, n in list(left.items()):
            found = sorted(got.get(lang, ()), key=lambda r: r["h"])
            if len(found) >= each or factor * each >= n:
                rows += found[:each]
                del left[lang]
        factor *= 4
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["h"], r["codes"]))
    return fit([np.frombuffer(r["codes"], np.int32) for r in rows], [r["lang"] for r in rows], **options)


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = pa.array([np.unique(gram_codes(x)).astype(np.int32).tobytes() for x in texts_of(b.column(2))], pa.binary())
        yield pa.record_batch([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), codes], ["h", "lang", "codes"])


def _score(batches: Iterator[pa.RecordBatch], model: Model, rows: int = 128) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lettered = np.array(pc.fill_null(pc.match_substring_regex(b.column(1), LETTER), False).to_pylist(), bool)
        label, score, held = np.zeros(len(b), np.int64), np.zeros(len(b)), []
        for i, x in enumerate(texts_of(b.column(1))):
            if lettered[i]:
                held.append((i, x))
            if held and (len(held) == rows or i == len(b) - 1):
                at = [k for k, _ in held]
                z = model.decide([v for _, v in held]).astype(np.float64) * model.sharpness
                e = np.exp(z - z.max(axis=1, keepdims=True))
                label[at], score[at] = z.argmax(axis=1), (e / e.sum(axis=1, keepdims=True)).max(axis=1)
                held = []
        names = [model.labels[k] if ok else UNKNOWN for k, ok in zip(label, lettered, strict=True)]
        yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(names), pa.array(np.clip(score, 0, 1))], ["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """The language of every whole text.

    Defined cases: null text or no letter: `und`, score 0; without a model (no labelled rows) every text is `und`; equal
    decision values: the first label in order; repeated rows are scored each; other columns are ignored.
    Returns doc_id, lang_pred, score (softmax of the decision values: 0 to 1).
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model.parts)  # bounded: landmarks x vocabulary of the sample
    return rows.mapInArrow(lambda b: _score(b, Model(*shared.value)), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None, least: float = 0.3) -> DataFrame:
    """The rows whose language is known with a score of `least`; columns as they were."""
    small_batches(docs.sparkSession)
    columns = docs.columns
    if model is None:
        return docs.where("false")
    shared = docs.sparkSession.sparkContext.broadcast(model.parts)

    def keep(batches):
        own = Model(*shared.value)
        for b in batches:
            text = pa.record_batch([pa.nulls(len(b), pa.int64()), b.column(b.schema.get_field_index("text")).cast(pa.string())], ["doc_id", "text"])
            for out in _score(iter([text]), own):
                yield b.filter(pc.and_(pc.not_equal(out.column(1), UNKNOWN), pc.greater_equal(out.column(2), least)))

    return docs.mapInArrow(keep, docs.schema).select(*columns)

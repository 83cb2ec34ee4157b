"""A quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a document labelled good over one labelled bad) teach a linear score by the logistic loss of feature
differences, so no intercept is learnt. The threshold is then the quantile of the training scores that rejects as many
documents as the labels do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, trimmed

HASHED = 512
DENSE = 14
#: Labelled rows used for training at most (those with the least hash of their id); all documents are scored.
MAX_LABELLED = 12_000
ACCEPT = 0.3


def _share(a: int, b: int) -> float:
    return a / b if b else 0.0


def features(text: str | None) -> np.ndarray:
    """Shape statistics and hashed words of a whole text; zeros for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(DENSE + HASHED, np.float32)
    words, lines = raw.split(), raw.split(b"\n")
    if not words:
        return out
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, size = len(words), len(raw)
    upper, lower, digits, high = (int(count[a:b].sum()) for a, b in ((65, 91), (97, 123), (48, 58), (128, 256)))
    stops = int(count[[33, 44, 46, 58, 59, 63]].sum())
    spaces = int(count[[9, 10, 13, 32]].sum())
    marks = size - upper - lower - digits - high - stops - spaces
    kinds = len(set(words))
    twice = sum(map(bytes.__eq__, words[1:], words[:-1]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    shifted = int(count[33])
    out[:DENSE] = (
        np.log1p(n), size / n, _share(kinds, n), _share(twice, n), _share(pairs, n - 1), _share(upper, upper + lower + high), _share(marks, size), _share(digits, size),
        _share(stops, n), _share(shifted, n), np.log1p(size / len(lines)), _share(len(lines) - len(set(lines)), len(lines)), _share(int(count[124]), n), np.log1p(len(lines)),
    )
    buckets = np.fromiter(map(zlib.crc32, words), np.uint32, n) % HASHED
    out[DENSE:] = np.sqrt(np.bincount(buckets, minlength=HASHED) / n)
    return out


@dataclass(frozen=True)
class Ranker:
    """A trained score: weights over standardised features, threshold and scale."""

    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    threshold: float
    scale: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; ACCEPT at the threshold."""
        z = (self.raw(x) - self.threshold) / self.scale + np.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, good: np.ndarray, pairs_each: int = 8, rounds: int = 250, ridge: float = 1e-3, seed: int = 7) -> Ranker:
    """Fit on rows x with labels `good`. With one label alone there are no pairs: all scores are then the threshold's."""
    x = x.astype(np.float64)
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z, w = np.clip((x - mean) / spread, -6, 6), np.zeros(x.shape[1])
    yes, no = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(yes) or not len(no):
        return Ranker(w, mean, spread, 0.0, 1.0)
    draw = np.random.default_rng(seed)
    small = min(yes, no, key=len)
    own = np.repeat(small, max(pairs_each, -(-len(x) // len(small))))
    other = draw.choice(yes if small is no else no, len(own))
    better, worse = (other, own) if small is no else (own, other)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        s = z @ w
        pull = 1 / (1 + np.exp(np.clip(s[better] - s[worse], -40, 40))) / len(better)
        grad = ridge * w - z.T @ (np.bincount(better, pull, len(x)) - np.bincount(worse, pull, len(x)))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    s = np.sort(z @ w)
    k = len(no)
    return Ranker(w, mean, spread, float((s[k - 1] + s[k]) / 2), float(max(s.std(), 1e-9)))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Ranker:
    """Train on the labelled documents that aren't held out: at most max_labelled of them, by the hash of their ids.

    Labels without a document, null labels and null ids are passed over; of several labels of a document the greatest
    counts. Only features, never texts, come to the driver.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).filter(~held_out())
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = id_text(docs, id_col, text_col).join(F.broadcast(known), "doc_id").select("text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t).tobytes() for t in b["text"].to_pylist()], pa.binary()), b["quality"].cast(pa.int64())], ["x", "quality"])

    got = rows.mapInArrow(trimmed(run), "x binary, quality long").toArrow()
    if not got.num_rows:
        return train(np.zeros((1, DENSE + HASHED)), np.ones(1, bool))
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(got.num_rows, -1)
    order = np.lexsort(x.T[: DENSE + 4])  # the order in which rows arrive doesn't matter
    return train(x[order], got["quality"].to_numpy()[order] >= 1)


def quality_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from ACCEPT on).

    Inputs of the score are features of the whole text alone. Null and empty texts share one score; repeated rows are
    scored alike; an empty table gives no rows. Without usable labels every score is ACCEPT.
    """
    ranker = fit(docs, labels, max_labelled, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].to_pylist()
            scores = np.concatenate([held.value.score(np.stack([features(t) for t in texts[i : i + 512]])) for i in range(0, len(texts), 512)]) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(scores, pa.float64()), pa.array((scores >= ACCEPT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    source = id_text(docs, id_col, text_col).select("doc_id", held_out().alias("held_out"), "text")
    return source.mapInArrow(trimmed(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier accepts, all columns; the texts aren't shuffled."""
    ranker = fit(docs, labels, max_labelled, id_col, text_col)
    held, names = docs.sparkSession.sparkContext.broadcast(ranker), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b[names.index(text_col)].to_pylist()
            good = [bool(s >= ACCEPT) for i in range(0, len(texts), 512) for s in held.value.score(np.stack([features(t) for t in texts[i : i + 512]]))]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)

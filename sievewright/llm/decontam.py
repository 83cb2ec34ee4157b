"""Benchmark decontamination by winnowing.

Of each window of `span` words the least hash of its k-grams is kept, on either side. A span of that many words which
a document shares with an item therefore shares a kept fingerprint, whatever surrounds it. Equal fingerprints are
joined and each hit is extended word by word to both sides; what reaches `span` words, or a whole shorter item, counts.

Items of up to INDEX_BYTES of text are joined in memory: their fingerprints are broadcast. More items are joined by a
shuffle: either side's fingerprints travel with the words around them, as many as a span can reach, so a hit is
extended where it meets. A filter of bounded size over the items' fingerprints (a Bloom filter) goes to the documents
first, so that few others travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialize, trimmed

#: A-Z to a-z; digits, a-z and bytes above 127 belong to words; all else is a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
GRAM = 5
#: Bytes of item texts that are broadcast at most; more of them are joined by a shuffle.
INDEX_BYTES = 16 << 20
#: Bytes of the filter over the items' fingerprints at most, and bits for each of them below that.
FILTER_BYTES, FILTER_BITS = 16 << 20, 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def _grams(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    n = len(values) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ values[j : j + n]) * _ODD
        h ^= h >> np.uint64(29)
    return h


def winnowed(hashes: np.ndarray, window: int, good: np.ndarray | None = None) -> np.ndarray:
    """Positions of the least hash, the last of equals, of each window of hashes; good: which windows to look at."""
    if len(hashes) < window:
        return np.empty(0, np.int64)
    at = np.flatnonzero(good) if good is not None else np.arange(len(hashes) - window + 1)
    out = []
    for i in range(0, len(at), 1 << 16):
        block = at[i : i + (1 << 16), None] + np.arange(window - 1, -1, -1)
        out.append(at[i : i + (1 << 16)] + window - 1 - np.argmin(hashes[block], axis=1))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)


class Index:
    """Fingerprints of a block of items, by window length: `span` for most, its own length for a shorter item."""

    def __init__(self, items: list[tuple[object, str | None]], span: int) -> None:
        self.span, self.vocabulary, self.texts, self.ids = span, {}, [], []
        seen: dict[tuple[bytes, ...], int] = {}
        for item_id, text in items:
            words = tuple(words_of(text))
            if words:
                if words not in seen:
                    seen[words] = len(self.texts)
                    self.texts.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
                    self.ids.append([])
                self.ids[seen[words]].append(item_id)
        self.values = np.array([0, *(xxhash.xxh64_intdigest(w) for w in self.vocabulary)], np.uint64)
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for i, text in enumerate(self.texts):
            length = min(span, len(text))
            h = _grams(self.values[text], k := min(GRAM, length))
            rows.setdefault(length, []).extend((int(h[p]), i, int(p)) for p in winnowed(h, length - k + 1))
        self.kept = {length: self._sorted(r) for length, r in rows.items()}

    @staticmethod
    def _sorted(rows: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows.sort()
        return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[object]]:
        """Shared spans (from, to) of a document and the ids of the items they belong to."""
        get = self.vocabulary.get
        doc = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        known = np.concatenate(([0], np.cumsum(doc > 0)))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for length, (hashes, items, places) in self.kept.items():
            if len(doc) < length:
                continue
            good = known[length:] - known[:-length] == length
            if not good.any():
                continue
            h = _grams(self.values[doc], k := min(GRAM, length))
            at = winnowed(h, length - k + 1, good)
            first, last = np.searchsorted(hashes, h[at]), np.searchsorted(hashes, h[at], "right")
            reached: dict[tuple[int, int], int] = {}
            for p, i, j in zip(at[first < last].tolist(), first[first < last].tolist(), last[first < last].tolist(), strict=True):
                for r in range(i, j):
                    item, q = int(items[r]), int(places[r])
                    if reached.get((item, p - q), -1) > p:
                        continue
                    a, b = _extended(doc, p, self.texts[item], q)
                    reached[item, p - q] = b
                    if b - a >= length:
                        spans.append((a, b))
                        found.add(item)
        return spans, [x for i in found for x in self.ids[i]]


def _extended(doc: np.ndarray, p: int, item: np.ndarray, q: int) -> tuple[int, int]:
    """The longest equal run around doc[p] and item[q]; empty at p if these differ."""
    back = min(p, q)
    same = doc[p - back : p][::-1] == item[q - back : q][::-1]
    left = back if same.all() else int(np.argmin(same))
    ahead = min(len(doc) - p, len(item) - q)
    same = doc[p : p + ahead] == item[q : q + ahead]
    right = ahead if same.all() else int(np.argmin(same))
    return (p - left, p + right) if right else (p, p)


def _covered(spans: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _report(rows: list[tuple]) -> list[pa.Array]:
    """Columns behind doc_id for rows (n_words, spans, item ids)."""
    hit = [_covered(s) for _, s, _ in rows]
    listed = [sorted({str(i) for i in ids}) for _, _, ids in rows]
    return [
        pa.array([n for n, _, _ in rows], pa.int64()),
        pa.array(hit, pa.int64()),
        pa.array([len(x) for x in listed], pa.int64()),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]),
        pa.array([h > 0 and 20 * h >= n for h, (n, _, _) in zip(hit, rows, strict=True)], pa.bool_()),
    ]


_COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def decontaminate(docs: DataFrame, items: DataFrame, span: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (at least one word in 20 is hit).

    A word is hit if it lies in an occurrence of `span` consecutive words of an item, or of a whole item of fewer words.
    Null and empty texts have no words and no hits; an item without words never occurs; items with equal words all
    count; an item_id that occurs twice counts once. Repeated rows are returned as often as they occur. Empty tables
    give no rows or no hits. Items are broadcast if all their texts have index_bytes at most, and joined by a shuffle
    otherwise; the rows are the same.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    bench = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col("text"))
    source = id_text(docs, id_col, text_col)
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > index_bytes:
        return _joined(source, bench, span, kind)
    held = spark.sparkContext.broadcast([tuple(r) for r in bench.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(held.value, span)
        for b in batches:
            rows = [(len(w), *index.hits(w)) for w in map(words_of, b["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *_report(rows)], _COLUMNS)

    return source.mapInArrow(trimmed(run), f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


# --- the join by a shuffle ---------------------------------------------------------------------------------------------


@lru_cache(maxsize=1 << 16)
def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_word_hash, words), np.uint64, len(words))


def _kept(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and fingerprints of a text's windows of `length` words; the length is part of a fingerprint."""
    k = min(GRAM, length)
    grams = _grams(hashes, k) if len(hashes) >= length else np.empty(0, np.uint64)
    at = winnowed(grams, length - k + 1)
    return at, grams[at] ^ (np.uint64(length) * _ODD)


def _around(words: list[bytes], at: int, length: int) -> tuple[bytes, int]:
    """The words around a place that a window of `length` words over it can reach, and how many of them lie ahead of it."""
    first = max(0, at - length + 1)
    return b" ".join(words[first : at + length]), at - first


def _bits_of(prints: np.ndarray, bits: int) -> np.ndarray:
    """Three bit places of each fingerprint."""
    second = (prints * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (prints >> np.uint64(31)) | np.uint64(1)
    return (prints[:, None] + second[:, None] * np.arange(3, dtype=np.uint64)) % np.uint64(bits)


def _prints(rows: DataFrame, keys: dict[str, str], lengths: list[int], span: int, whole_items: bool, wanted=None) -> DataFrame:
    """(print, length, ahead, words, place, keys) of each kept fingerprint; rows: the keys, and text.

    Items have one length each, that of their windows; documents are looked at with each length that an item has.
    wanted: a broadcast filter (array of bytes) that a fingerprint must pass.
    """
    columns = ["print", "length", "ahead", "words", "place", *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            took: list[int] = []
            for i, text in enumerate(b["text"].to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                hashes = _hashed(words)
                for length in [min(span, len(words))] if whole_items else lengths:
                    at, prints = _kept(hashes, length)
                    if wanted is not None and len(at):
                        places = _bits_of(prints, 8 * len(wanted.value))
                        passed = ((wanted.value[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
                        at, prints = at[passed], prints[passed]
                    for p, h in zip(at.tolist(), prints.view(np.int64).tolist(), strict=True):
                        near, ahead = _around(words, p, length)
                        out.append((h, length, ahead, near, p))
                        took.append(i)
                if len(out) >= 1 << 14:
                    yield _print_rows(b, took, out)
                    out, took = [], []
            if out:
                yield _print_rows(b, took, out)

    def _print_rows(b: pa.RecordBatch, took: list[int], out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
        take = pa.array(took)
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)), *(b[k].take(take) for k in keys)], columns)

    return rows.select(*keys, "text").mapInArrow(trimmed(run), ", ".join(["print long, length int, ahead int, words binary, place long", *(f"{k} {t}" for k, t in keys.items())]))


def _filter_over(prints: DataFrame, n: int) -> np.ndarray:
    """The Bloom filter, as bytes: its 64-bit slots are made by a bitwise sum, so at most FILTER_BYTES / 8 rows come to the driver."""
    slots = max(1, min(FILTER_BYTES // 8, n * FILTER_BITS // 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = _bits_of(b["print"].to_numpy(zero_copy_only=False).view(np.uint64), 64 * slots).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64))], ["slot", "bits"])

    got = prints.select("print").mapInArrow(trimmed(run), "slot long, bits long").groupBy("slot").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(slots, np.uint64)
    out[got["slot"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out.view(np.uint8)


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows with a document's and an item's words around an equal fingerprint, the span they share, where it is long enough."""
    for b in batches:
        keep, first, last = [], [], []
        columns = ("d_words", "d_ahead", "i_words", "i_ahead", "length", "place")
        for i, (d, p, t, q, length, place) in enumerate(zip(*(b[c].to_pylist() for c in columns), strict=True)):
            doc, item = d.split(), t.split()
            left, right = 0, 0
            while left < min(p, q) and doc[p - left - 1] == item[q - left - 1]:
                left += 1
            while p + right < len(doc) and q + right < len(item) and doc[p + right] == item[q + right]:
                right += 1
            if right and left + right >= length:
                keep.append(i)
                first.append(place - left)
                last.append(place + right)
        yield pa.RecordBatch.from_arrays([*(b[c].take(pa.array(keep, pa.int64())) for c in ("doc_id", "sum", "item")), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["doc_id", "sum", "item", "first", "last"])


def _joined(source: DataFrame, bench: DataFrame, span: int, kind: str) -> DataFrame:
    """What decontaminate returns, for any number of items: neither they nor the documents are collected or broadcast.

    Documents are told apart by id and a hash of the text, items by their words; an item's ids come back at the end.
    """
    spark = source.sparkSession
    docs = source.withColumn("sum", F.coalesce(F.xxhash64("text"), F.lit(0)))
    plain = bench.withColumn("item", F.md5(_plain(F.col("text"))))
    texts = plain.groupBy("item").agg(F.first("text").alias("text"))
    items = materialize(_prints(texts, {"item": "string"}, [], span, True), "item-prints")
    # an item's fingerprint that recurs in it with other words around is another row; equal rows are one
    items_once = items.drop("place").distinct().withColumnsRenamed({"ahead": "i_ahead", "words": "i_words"})
    lengths = sorted(r.length for r in items.select("length").distinct().collect())  # no more than `span` of them
    n = items.count()
    wanted = spark.sparkContext.broadcast(_filter_over(items, n) if n else np.zeros(1, np.uint8))
    seen = _prints(docs.select("doc_id", "sum", "text"), {"doc_id": kind, "sum": "bigint"}, lengths, span, False, wanted)
    seen = seen.withColumnsRenamed({"ahead": "d_ahead", "words": "d_words"})
    met = seen.join(items_once, ["print", "length"]).select("doc_id", "sum", "item", "d_words", "d_ahead", "i_words", "i_ahead", "length", "place")
    spans = materialize(met.mapInArrow(trimmed(_meeting), f"doc_id {kind}, sum long, item string, first long, last long").distinct(), "shared-spans")
    ids = plain.select("item", "item_id").distinct()
    places = spans.groupBy("doc_id", "sum").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    named = spans.select("doc_id", "sum", "item").distinct().join(ids, "item").groupBy("doc_id", "sum").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    a, b = (x.withColumnsRenamed({"doc_id": f"{c}_id", "sum": f"{c}_sum"}) for c, x in (("a", places), ("b", named)))
    same = lambda c: F.col("doc_id").eqNullSafe(F.col(f"{c}_id")) & (F.col("sum") == F.col(f"{c}_sum"))
    counted = _counted(docs, kind)
    rows = counted.join(a, same("a"), "left").join(b, same("b"), "left").select("doc_id", "n_words", "spans", "items")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(n, [(s["first"], s["last"]) for s in spans or ()], ids or ()) for n, spans, ids in zip(*(batch[c].to_pylist() for c in ("n_words", "spans", "items")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *_report(out)], _COLUMNS)

    return rows.mapInArrow(trimmed(finish), f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _plain(text):
    """The words of a text, as a column: A-Z lower-cased, one space between them."""
    words = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    return F.trim(F.translate(words, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _counted(docs: DataFrame, kind: str) -> DataFrame:
    """(doc_id, sum, n_words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["sum"], pa.array([len(words_of(t)) for t in b["text"].to_pylist()], pa.int64())], ["doc_id", "sum", "n_words"])

    return docs.mapInArrow(trimmed(run), f"doc_id {kind}, sum long, n_words long")

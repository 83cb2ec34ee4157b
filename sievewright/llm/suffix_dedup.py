"""Suffix-array dedup: bytes covered by a long string that also starts anywhere else are removed.

Every window of `width` bytes has an anchor, the least hash of its GRAM-byte grams. Equal windows have equal anchors at
equal places, so the windows of one anchor, with the bytes they span (a context), only need comparing with those of
equal anchor hashes. That deals the corpus into shards without losing a pair: contexts that are alone under their hash
leave at once; equal contexts (copies of documents, the inside of shared passages) are settled by their digests, without
their bytes; and only one of each of the different contexts under a hash goes to a shard. A hash with more of them than
a shard holds is dealt out by more of the bytes around the anchor, by whole windows at last. In a shard, suffixes are sorted
by external induced sorting with common-prefix values, and a window whose common prefix with a neighbour reaches the
width is repeated.

No group lands in one task: a context that a task meets again is settled there and then, so that only its first
occurrence in each task meets those of other tasks; and the contexts of a very common hash are dealt to many tasks by
their digests, since whether a hash has several contexts needs a count alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .induced_sort import repeated_starts

GRAM = 64
#: Bytes of a text looked at together, and bytes of contexts after which a shard is closed at the next new hash.
_SLICE, SHARD_BYTES = 4 << 20, 4 << 20
#: Windows dealt out together where a key has too many contexts; the next step where that still leaves too many.
_STEPS = (64, 8, 1)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_PLACE = np.uint64((1 << 24) - 1)


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    h, size = raw.astype(np.uint64), 1
    for odd in _ODD:
        h = (h[:-size] * np.uint64(odd)) ^ (h[size:] + (h[size:] >> np.uint64(31)))
        size *= 2
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _window_least(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values."""
    n = len(values) - w + 1
    full = np.concatenate((values, np.full(-len(values) % w, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchored(raw: bytes, width: int) -> Iterator[tuple[int, int, int, int]]:
    """(hash, place of the anchor, first and last window start) of each run of windows with one anchor."""
    for begin in range(0, max(0, len(raw) - width + 1), _SLICE):
        part = np.frombuffer(raw, np.uint8)[begin : begin + _SLICE + width - 1]
        h = _gram_hashes(part)
        least = _window_least((h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64)), width - GRAM + 1)
        starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        ends = np.concatenate((starts[1:], [len(least)])) - 1
        places = (_PLACE - (least[starts] & _PLACE)).astype(np.int64)
        yield from zip(h[places].view(np.int64).tolist(), (places + begin).tolist(), (starts + begin).tolist(), (ends + begin).tolist(), strict=True)


class _Contexts:
    """Contexts as a task meets them: the first of each waits, those that come again are settled (known 1) and go at once.

    What waited goes with known 2 if it came again, else 0. route: where a row goes to be compared by its digest, which
    is its key's place, or its digest's for a very common key, or anywhere for what is settled.
    """

    def __init__(self, kind: pa.DataType, hot: frozenset[int]) -> None:
        self.kind, self.hot = kind, hot
        self.waiting: dict[tuple[int, bytes], list] = {}
        self.out: list[tuple] = []

    def add(self, key: int, digest: bytes, doc: object, check: int, first: int, last: int) -> Iterator[pa.RecordBatch]:
        found = self.waiting.get((key, digest))
        if found is None:
            self.waiting[key, digest] = [doc, check, first, last, 0]
        else:
            found[4] = 2
            self.out.append((key, digest, doc, check, first, last, 1, (check ^ first * 0x9E3779B1) & _LOW))
        if len(self.waiting) >= _WAITING or len(self.out) >= _ROWS:
            yield from self.rows(len(self.waiting) >= _WAITING)

    def rows(self, everything: bool = True) -> Iterator[pa.RecordBatch]:
        if everything:
            for (key, digest), row in self.waiting.items():
                self.out.append((key, digest, *row, int.from_bytes(digest[:7], "little") if key in self.hot else key))
            self.waiting = {}
        types = [pa.int64(), pa.binary(), self.kind, pa.int64(), pa.int32(), pa.int32(), pa.int8(), pa.int64()]
        for i in range(0, len(self.out), _ROWS):
            columns = zip(*self.out[i : i + _ROWS], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _CONTEXT)
        self.out = []


_CONTEXT = ["key", "digest", "doc_id", "sum", "first", "last", "known", "route"]
#: Contexts that wait in a task, and rows that go together: bounds of memory.
_WAITING, _ROWS, _LOW = 1 << 17, 1 << 15, (1 << 62) - 1


def _context_schema(kind: str) -> str:
    return f"key long, digest binary, doc_id {kind}, sum long, first int, last int, known byte, route long"


def _anchors(docs: DataFrame, kind: str, width: int, hot: frozenset[int] = frozenset()) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = None
        for b in batches:
            met = met or _Contexts(b.schema.field("doc_id").type, hot)
            for doc, check, text in zip(*(b[c].to_pylist() for c in ("doc_id", "sum", "text")), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for key, place, first, last in anchored(raw, width):
                    digest = hashlib.blake2b(raw[first : last + width], digest_size=12, salt=(place - first).to_bytes(8, "little")).digest()
                    yield from met.add(key, digest, doc, check, first, last)
        if met:
            yield from met.rows()

    return docs.select("doc_id", "sum", "text").mapInArrow(run, _context_schema(kind))


#: Of so many texts one is looked at for very common keys, and so many of these are dealt out by their digests. It spreads work alone: any keys give the same result.
_LOOK, _HOT_KEYS = 64, 4096


def _very_common(docs: DataFrame, width: int) -> frozenset[int]:
    """Keys that very many texts have, as far as one of _LOOK texts tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b["text"].to_pylist():
                keys = sorted({key for key, *_ in anchored((text or "").encode("utf-8", "surrogatepass"), width)})
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([1] * len(keys), pa.int64())], ["key", "n"])

    looked = docs.filter(F.pmod("sum", F.lit(_LOOK)) == 0).select("text").mapInArrow(run, "key long, n long")
    often = looked.groupBy("key").agg(F.sum("n").alias("n")).filter("n >= 8").orderBy(F.desc("n"), "key").limit(_HOT_KEYS)
    return frozenset(r.key for r in often.collect())


_SETTLED = ["doc_id", "sum", "first", "last", "key", "settled"]


def _settle(hot: frozenset[int] | None):
    """From rows sorted by key and digest: occurrences of contexts that occur twice, and one of each of several contexts under a key.

    settled 1: all windows from first to last are repeated; settled 0: these are to be compared; settled 2: both of it.
    A key's rows are never held: at most two of them wait. Of the keys in hot (None: of all) a task sees some contexts
    alone, so that each counts as one of several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = digest = held = None  # the last row is held until it is known whether its context, and its key, goes on
        twice = several = False
        schema = None
        for b in batches:
            schema = b.schema
            out: list[tuple] = []
            for row in zip(*(b[c].to_pylist() for c in ("key", "digest", "doc_id", "sum", "first", "last", "known")), strict=True):
                if row[6] == 1:
                    out.append((*row[2:6], row[0], 1))
                    continue
                if (row[0], row[1]) == (key, digest):
                    twice = True
                    out.append((*row[2:6], row[0], 1))
                    continue
                if held is not None:
                    more = row[0] == key
                    if several or more or hot is None or key in hot:
                        out.append((*held[2:6], held[0], 2 if twice else 0))
                    elif twice:
                        out.append((*held[2:6], held[0], 1))
                    several = more
                key, digest, held, twice = row[0], row[1], row, row[6] == 2
            if out:
                yield _settled_rows(out, schema)
        if held is not None and (several or twice or hot is None or key in hot):
            state = (2 if twice else 0) if several or hot is None or key in hot else 1
            yield _settled_rows([(*held[2:6], held[0], state)], schema)

    return run


def _settled_rows(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    types = [schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int8()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], _SETTLED)


def _contexts(rows: DataFrame, kind: str, width: int) -> DataFrame:
    """The bytes of the contexts to compare; rows: doc_id, sum, text, wanted (their first, last, key, settled)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (text, wanted) in enumerate(zip(b["text"].to_pylist(), b["wanted"].to_pylist(), strict=True)):
                raw = (text or "").encode("utf-8", "surrogatepass")
                n = len(wanted)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w["key"] for w in wanted], pa.int64()), pa.array([raw[w["first"] : w["last"] + width] for w in wanted], pa.binary()),
                        pa.array([w["settled"] == 2 for w in wanted]), b["doc_id"].slice(i, 1).take(pa.array([0] * n)), b["sum"].slice(i, 1).take(pa.array([0] * n)),
                        pa.array([w["first"] for w in wanted], pa.int32()),
                    ],
                    ["key", "bytes", "settled", "doc_id", "sum", "first"],
                )

    return rows.mapInArrow(run, f"key long, bytes binary, settled boolean, doc_id {kind}, sum long, first int")


def _shards(width: int, shard_bytes: int):
    def solved(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        text = np.frombuffer(b"\xff".join(r[1] for r in rows) + b"\xff", np.uint8)  # a byte that UTF-8 doesn't have
        hit = repeated_starts(text, width)
        at, out = 0, []
        for _, raw, settled, doc, check, first in rows:
            if not settled:
                whole = hit[at : at + len(raw) - width + 1]  # what starts behind runs into the next context
                mine = np.flatnonzero(np.diff(np.concatenate(([0], whole.view(np.int8), [0]))))
                out += [(doc, check, first + int(a), first + int(z) - 1) for a, z in zip(mine[::2], mine[1::2], strict=True)]
            at += len(raw) + 1
        columns = list(zip(*out, strict=True)) or [()] * 4
        types = [schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "sum", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, schema = 0, None
        for b in batches:
            schema = b.schema
            for row in zip(*(b[c].to_pylist() for c in ("key", "bytes", "settled", "doc_id", "sum", "first")), strict=True):
                if size >= shard_bytes and row[0] != rows[-1][0]:
                    yield solved(rows, schema)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[1]) + 1
        if rows:
            yield solved(rows, schema)

    return run


def _finer(rows: DataFrame, kind: str, width: int, step: int) -> DataFrame:
    """The rows of _anchors for groups of `step` windows by their distance to the anchor; rows: doc_id, sum, text, wanted.

    The key is that of the bytes which all windows of a group cover. Equal windows have equal distances to their anchors
    and so equal keys; a step of 1 has whole windows for keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = None
        for b in batches:
            met = met or _Contexts(b.schema.field("doc_id").type, frozenset())
            for doc, check, text, wanted in zip(*(b[c].to_pylist() for c in ("doc_id", "sum", "text", "wanted")), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for w in wanted:
                    (_, place, _, _), *_ = anchored(raw[w["first"] : w["last"] + width], width)
                    place += w["first"]
                    for k in range((place - w["last"]) // step, (place - w["first"]) // step + 1):
                        first, last = max(w["first"], place - (k + 1) * step + 1), min(w["last"], place - k * step)
                        core = raw[place - k * step : place - (k + 1) * step + 1 + width]
                        key = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=k.to_bytes(8, "little"), person=step.to_bytes(8, "little")).digest(), "little", signed=True)
                        digest = hashlib.blake2b(raw[first : last + width], digest_size=12, salt=(place - first).to_bytes(8, "little")).digest()
                        yield from met.add(key, digest, doc, check, first, last)
        if met:
            yield from met.rows()

    return rows.mapInArrow(run, _context_schema(kind))


def _with_text(docs: DataFrame, rows: DataFrame, few: bool = False) -> DataFrame:
    """doc_id, sum, text, wanted: the documents that have any of the rows, with these.

    few: there may be few rows. They are written first, so that Spark knows their size and, if it is small, broadcasts
    them instead of shuffling the texts.
    """
    wanted = rows.groupBy("doc_id", "sum").agg(F.collect_list(F.struct("first", "last", "key", "settled")).alias("wanted"))
    mine = wanted.select(F.col("doc_id").alias("w_id"), F.col("sum").alias("w_sum"), "wanted")
    mine = materialize(mine, "wanted") if few else mine
    return docs.join(mine, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("sum") == F.col("w_sum"))).select("doc_id", "sum", "text", "wanted")


def dealt_out(docs: DataFrame, width: int, kind: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sum, first, last) of windows known to be repeated, and the contexts to compare (doc_id, sum, first, last, key, settled).

    A key with over `most` different contexts (a common passage, shorter than the width, among different texts) is
    dealt out by finer keys, so no key has more in the end.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ", ".join(["doc_id " + kind, "sum long", "first int", "last int", "key long", "settled byte"])
    found, compare, hot = [], [], _very_common(docs, width)
    rows, place = _anchors(docs, kind, width, hot), F.col("route")
    for step in (*_STEPS, None):
        settled = materialize(rows.repartition(tasks, place).sortWithinPartitions("key", "digest").mapInArrow(_settle(hot), columns), "anchors")
        found.append(settled.filter("settled <> 0").select("doc_id", "sum", "first", "last"))
        open_ = settled.filter("settled <> 1")
        counts = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        great = materialize(counts.filter(F.col("n") > most).select("key"), "hot-keys")  # so small that Spark broadcasts it, or else a side of a shuffle
        if hot is None:  # keys with one context are still among them
            alone = materialize(counts.filter("n = 1").select("key"), "lone-keys")
            open_ = open_.join(alone, "key", "left_anti").select(*open_.columns)
        if step is None or great.isEmpty():
            compare.append(open_)
            break
        compare.append(open_.join(great, "key", "left_anti").select(*open_.columns))
        rows = _finer(_with_text(docs, open_.join(great, "key", "left_semi"), few=True), kind, width, step)
        hot, place = None, F.when(F.col("known") == 1, F.col("route")).otherwise(F.xxhash64("key", "digest"))
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, compare)


def repeated_windows(docs: DataFrame, width: int, kind: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, sum, first, last): runs of window starts that are repeated; docs: doc_id, text, sum (of the text)."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, compare = dealt_out(docs, width, kind, max(2, shard_bytes // (2 * width)))
    contexts = _contexts(_with_text(docs, compare), kind, width).repartition(tasks, "key").sortWithinPartitions("key")
    compared = contexts.mapInArrow(_shards(width, shard_bytes), f"doc_id {kind}, sum long, first int, last int")
    return found.unionByName(compared)


def remove_repeats(docs: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and the kept bytes if asked for.

    A byte goes if any string of `width` bytes that covers it also starts at another place of the corpus, in the same
    document or not; matches never cross documents and are judged on the input. Null is empty; texts shorter than the
    width lose nothing; rows that repeat each other lose all that is long enough, every one of them. Null ids are
    documents like any other. An empty table gives no rows.
    """
    if width < 2 * GRAM:
        raise ValueError(f"the width must be {2 * GRAM} at least")
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("sum"))
    runs = materialize(repeated_windows(source, width, kind, shard_bytes), "repeated")
    spans = runs.groupBy("doc_id", "sum").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    mine = spans.select(F.col("doc_id").alias("s_id"), F.col("sum").alias("s_sum"), "spans")
    rows = source.join(mine, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("sum") == F.col("s_sum")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, own in zip(b["text"].to_pylist(), b["spans"].to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                gone, stretches, kept, end = 0, 0, [], 0
                for first, last in sorted((s["first"], s["last"] + width) for s in own or ()):
                    if first > end or not stretches:
                        stretches += 1
                        kept.append(raw[end:first])
                        gone, end = gone + last - first, last
                    elif last > end:
                        gone, end = gone + last - end, last
                kept.append(raw[end:])
                left = b"".join(kept)
                out.append((len(raw), gone, stretches, hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *arrays[: 4 + with_text]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return rows.mapInArrow(run, schema)

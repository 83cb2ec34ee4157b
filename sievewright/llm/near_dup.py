"""Near-duplicates by the Jaccard similarity of shingle sets, complete at the threshold.

SimHash links within a few bits come first: they join most near copies cheaply, and each is verified by the sets. A
radius that reached a similarity of 0.8 (14 of 64 bits and more) would take far too many variants a fingerprint, so
the pairs further apart are found by prefixes: two sets that reach the threshold t share k of the first
n - ceil(t n) + k of their n shingles in any order that all sets agree on. Common shingles come last in that order, so
shared passages don't bring unlike documents together, and k is a tenth of the set (EXTRA): a document that shares
fewer of its first shingles with any others has no partner and leaves, alone, without a look at pairs.

What stays is compared within the groups that share a shingle, and only pairs of components that are yet apart. Parity
bits decide most of it there: each set has two bits or more for each shingle, a bit tells whether an odd number of
shingles falls on it, and sets that differ in k bits differ in k shingles at least. A few rounds come first in which
each set is in one group only, that of a shingle it picks by a hash as its near copies do, and is compared with one
member: a great group of near copies has then grown together, by no more pairs than it has sets, before all pairs are
looked at. What leaves a group are pairs that are as good as found; their sets are brought together to make sure.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialize, trimmed, where_id
from .components import components
from .simhash import fingerprint_of, near_links, shingle_hashes

#: Documents that the order of shingles is taken from, how often a common one occurs there, and how many are kept. Any order gives the same links.
SAMPLE, COMMON, MOST_COMMON = 20_000, 3, 1 << 17
_EPS = 1e-9
#: Of a set's first shingles so large a part more than needed is looked at, and as large a part must be shared with others.
EXTRA = 0.1
#: Parity bits of a set at most: a bound of memory. Fewer let more pairs through to the sets.
_MOST_BITS = 1024
#: Sets that a task remembers having met: a bound of memory, beyond which copies are sent again.
_SEEN_AT_ONCE = 1 << 20


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different shingle hashes, ascending."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, words)]))


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes())


def overlap_needed(a: int, b: int, similarity: float) -> int:
    """How many shingles sets of these sizes share at least where they reach the similarity."""
    return math.ceil(similarity * (a + b) / (1 + similarity) - _EPS)


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """Bytes of a power of two of bits, two a shingle or _MOST_BITS: each is the parity of the shingles whose hash ends in its number."""
    bits = min(_MOST_BITS, max(64, 1 << (2 * len(shingles) - 1).bit_length())) if len(shingles) else 64
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Parity bits (the last axis) of fewer numbers: the halves together keep the parities."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


class _Parities:
    """The parity bits of a group's sets, folded to each length that is asked for."""

    def __init__(self, bits: list[bytes]) -> None:
        self.bits, self.length = bits, np.fromiter(map(len, bits), np.int64, len(bits))
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _folded(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the sets with at least so many bytes the bits, and which row each set has there."""
        if size not in self.at:
            enough = self.length >= size
            out = np.empty((int(enough.sum()), size), np.uint8)
            row = np.cumsum(enough) - 1
            for own in np.unique(self.length[enough]).tolist():
                here = np.flatnonzero(self.length == own)
                out[row[here]] = folded(np.frombuffer(b"".join([self.bits[i] for i in here.tolist()]), np.uint8).reshape(len(here), own), size)
            self.at[size] = out.view(np.uint64), row
        return self.at[size]

    def differing(self, i: int, others: np.ndarray) -> np.ndarray:
        """In how many bits set i differs from each of the others, at the shorter of both lengths."""
        out = np.empty(len(others), np.int64)
        size = np.minimum(self.length[others], self.length[i])
        for x in {*size.tolist()}:
            bits, row = self._folded(x)
            here = size == x
            out[here] = np.bitwise_count(bits[row[others[here]]] ^ bits[row[i]]).sum(axis=1)
        return out


def _profiles(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, node, fp, n, bits): a hash of the shingle set, the fingerprint, the size of the set and its parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps, sizes, bits = [], [], [], []
            for t in b["text"].to_pylist():
                blocks = list(shingle_hashes(t, words))
                own = np.unique(np.concatenate([np.empty(0, np.uint64), *blocks]))
                nodes.append(_node(own))
                fps.append(fingerprint_of(blocks))
                sizes.append(len(own))
                bits.append(parity_bits(own).tobytes())
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *signed, pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())], ["doc_id", "node", "fp", "n", "bits"])

    return docs.mapInArrow(trimmed(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, fp long, n int, bits binary")


def _common(docs: DataFrame, words: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample, ascending, and how often they occur there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b["text"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words).view(np.int64))], ["token"])

    sample = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).mapInArrow(trimmed(run), "token long")
    rows = sample.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= COMMON).orderBy(F.desc("k"), "token").limit(MOST_COMMON).toArrow()
    token, often = (rows[c].to_numpy() for c in ("token", "k"))
    order = np.argsort(token.view(np.uint64))
    return token.view(np.uint64)[order], often[order].astype(np.int64)


def extra(n: int) -> int:
    """How many of their first shingles two sets share of which the smaller one has n."""
    return 1 + int(EXTRA * n)


def least_shared(n: int, similarity: float) -> int:
    """How many of its first shingles a set of n shares with any partner: a partner has `similarity` of n at least."""
    return extra(math.ceil(similarity * n - _EPS))


def prefix(shingles: np.ndarray, common: np.ndarray, often: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles by rareness, so many that a set reaching the similarity shares extra() of them and has them among its own first."""
    take = len(shingles) - math.ceil(similarity * len(shingles) - _EPS) + extra(len(shingles))
    if not len(common):
        return shingles[:take]
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    return shingles[np.lexsort((shingles, np.where(common[at] == shingles, often[at], 0)))[:take]]


def _prefixes(docs: DataFrame, words: int, common: tuple[np.ndarray, np.ndarray], similarity: float) -> DataFrame:
    """(token, node, n) of the prefix of each set, once for the copies that a task meets."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for t in b["text"].to_pylist():
                own = shingle_set(t, words)
                node = _node(own)
                if node in seen:
                    continue
                if len(seen) >= _SEEN_AT_ONCE:
                    seen.clear()
                seen.add(node)
                token = prefix(own, *shared.value, similarity).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.full(len(token), node, np.uint64).view(np.int64)), pa.array(np.full(len(token), len(own), np.int32))], ["token", "node", "n"])

    return docs.select("text").mapInArrow(trimmed(run), "token long, node long, n int")


def _runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns (token first, then node) of each token that several nodes have, from rows sorted by token and node; each node once."""
    held: list[np.ndarray] | None = None
    for b in batches:
        now = [b[c].to_numpy(zero_copy_only=False) for c in columns]
        now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        new = np.concatenate(([True], (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])))
        now = [x[new] for x in now]
        cuts = np.concatenate(([0], np.flatnonzero(now[0][1:] != now[0][:-1]) + 1))
        held = [x[cuts[-1] :] for x in now]
        several = np.flatnonzero(np.diff(cuts) > 1)
        for i, j in zip(cuts[several].tolist(), cuts[several + 1].tolist(), strict=True):
            yield tuple(x[i:j] for x in now)
    if held is not None and len(held[0]) > 1:
        yield tuple(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, node, n) of the tokens that several nodes have."""
    out: list[tuple[np.ndarray, ...]] = []
    waiting = 0
    names = ("token", "node", "n")
    for run in _runs(batches, names):
        out.append(run)
        waiting += len(run[0])
        if waiting >= 1 << 16:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)
            out, waiting = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)


def _near(i: int, others: np.ndarray, n: np.ndarray, parities: _Parities, similarity: float) -> np.ndarray:
    """Those of the others whose size and parity bits let them reach the similarity to set i."""
    others = others[np.minimum(n[others], n[i]) >= similarity * np.maximum(n[others], n[i]) - _EPS]
    if not len(others):
        return others
    both = (n[others] + n[i]).astype(np.float64)
    needed = np.ceil(similarity * both / (1 + similarity) - _EPS)
    return others[parities.differing(i, others) <= both - 2 * needed]


def _with_one(node: np.ndarray, root: np.ndarray, n: np.ndarray, parities: _Parities, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each of a group with its least member."""
    yield 0, _near(0, np.flatnonzero(root != root[0]), n, parities, similarity)


def _with_closest(node: np.ndarray, root: np.ndarray, n: np.ndarray, parities: _Parities, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each of a group, its largest component aside, with the one of another component whose bits differ least."""
    _, number, sizes = np.unique(root, return_inverse=True, return_counts=True)
    for i in np.flatnonzero(number != sizes.argmax()).tolist():
        others = _near(i, np.flatnonzero(number != number[i]), n, parities, similarity)
        if len(others):
            yield i, others[[int(np.argmin(parities.differing(i, others)))]]


def _all_apart(node: np.ndarray, root: np.ndarray, n: np.ndarray, parities: _Parities, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """All pairs of different components."""
    _, number, sizes = np.unique(root, return_inverse=True, return_counts=True)
    order = np.argsort(number == sizes.argmax(), kind="stable")  # the largest component last: its inside costs nothing
    for k in range(len(node) - int(sizes.max())):
        later = order[k + 1 :]
        yield int(order[k]), _near(int(order[k]), later[number[later] != number[order[k]]], n, parities, similarity)


def _pairs(of: Callable[..., Iterator[tuple[int, np.ndarray]]], similarity: float):
    """Pairs of nodes that share a prefix token, are of different components, and whose sizes and parity bits let them reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(out), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for _, node, root, n, bits in _runs(batches, ("token", "node", "root", "n", "bits")):
            if (root == root[0]).all():
                continue
            for i, others in of(node, root, n, _Parities(bits.tolist()), similarity):
                if len(others):
                    out.append(np.stack((np.minimum(node[others], node[i]), np.maximum(node[others], node[i])), axis=1))
                    waiting += len(others)
                if waiting >= 1 << 18:
                    yield flush()
                    out, waiting = [], 0
        if waiting:
            yield flush()

    return run


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity; nodes: node, first (the id of a document that has the set)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b["text"].to_pylist():
                own = shingle_set(t, words)
                yield pa.RecordBatch.from_arrays([pa.array([np.uint64(_node(own)).view(np.int64)]), pa.array([own.tobytes()])], ["node", "shingles"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b["x"], b["y"], strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.sort(np.concatenate((x, y)))
                keep.append(int((both[1:] == both[:-1]).sum()) >= overlap_needed(len(x), len(y), similarity))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select(F.col("first").alias("w_id")).distinct()
    have = where_id(docs, wanted, "left_semi").mapInArrow(trimmed(sets), "node long, shingles binary").dropDuplicates(["node"])
    sides = pairs.join(have.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(have.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return sides.select("a", "b", "x", "y").mapInArrow(trimmed(alike), "a long, b long")


def near_components(docs: DataFrame, similarity: float = 0.8, words: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, component_id (the smallest doc_id reachable by links of at least `similarity`, itself included).

    A link joins two texts whose sets of `words`-word shingles have a Jaccard similarity of at least `similarity`; all
    such pairs count, whatever the bits of their fingerprints. Words and short texts are those of simhash_components;
    texts without words are equal to each other. Repeated rows, null ids and empty tables are treated as there.
    """
    docs = id_text(docs, id_col, text_col)
    profiles = materialize(_profiles(docs, words), "profiles")
    nodes = materialize(profiles.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.first("bits").alias("bits")), "sets")
    heads = materialize(nodes.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    ends = [heads.select(F.col("fp").alias(f"fp_{c}"), F.col("head").alias(c)) for c in "ab"]
    across = near_links(heads.select("fp"), radius).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(ends[0], "fp_a").join(ends[1], "fp_b").select("a", "b")
    within = nodes.join(heads, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    close = materialize(across.unionByName(within).distinct(), "close")
    links = materialize(_verified(close, docs, nodes, words, similarity), "close-links")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = _common(docs, words, max(1, nodes.count() // SAMPLE))
    dealt = _prefixes(docs, words, common, similarity).repartition(tasks, "token").sortWithinPartitions("token", "node")
    shared = materialize(dealt.mapInArrow(trimmed(_shared), "token long, node long, n int"), "shared-tokens")
    least = F.floor(F.lit(EXTRA) * F.ceil(similarity * F.col("n") - _EPS)) + 1
    open_ = shared.groupBy("node", "n").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= least).select("node")
    open_ = materialize(nodes.join(open_, "node", "left_semi").select("node", "n", "bits"), "open-sets")
    shared = materialize(shared.join(open_.select("node", "bits"), "node"), "open-tokens")

    def between(of: Callable[..., Iterator[tuple[int, np.ndarray]]], links: DataFrame, salt: int | None = None) -> DataFrame:
        """The links, and those among the pairs that share a token and that the links leave apart; salt: each node's one token only, by a hash with it."""
        joined = materialize(components(links), "roots")
        groups = shared
        if salt is not None:
            one = shared.groupBy("node").agg(F.min(F.struct(F.xxhash64("token", F.lit(salt)).alias("h"), "token")).alias("one"))
            groups = open_.join(one.select("node", "one.token"), "node")
        rooted = groups.join(joined, "node", "left").select("token", "node", F.coalesce("root", "node").alias("root"), "n", "bits")
        pairs = rooted.repartition(tasks, "token").sortWithinPartitions("token", "node").mapInArrow(trimmed(_pairs(of, similarity)), "a long, b long").distinct()
        return materialize(links.unionByName(_verified(materialize(pairs, "pairs"), docs, nodes, words, similarity)), "links")

    found = between(_with_one, links, 0)
    found = between(_with_closest, found, 1)
    found = between(_all_apart, found)
    roots = materialize(components(found), "roots")
    named = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return profiles.select("doc_id", "node").join(named.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")

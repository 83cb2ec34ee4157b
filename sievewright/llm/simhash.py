"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within `radius` bits share a variant within half the radius of both, so every distinct fingerprint
emits all its variants and equal variants are brought together. The variants aren't shuffled one by one: those with
the same leading bits go to the same place, so a fingerprint is sent once to each prefix its ball reaches, with the
flips it has left, and writes out the variants there. All fingerprints that share a variant lie within the radius of
each other; each is compared with the least one of them, verified bit by bit, and only links that join something yet
apart leave the place, at most one per fingerprint. Prefixes with too many fingerprints (one great cluster) are split
by further bits in the same way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialize, trimmed
from .components import components

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Variants written out at a time in one place: a bound of memory.
VARIANTS_AT_ONCE = 1 << 21
_SHINGLES_AT_ONCE = 1 << 15


def shingle_hashes(text: str | None, words: int = 4, seed: int = 42) -> Iterator[np.ndarray]:
    """The hashes of the shingles in blocks; nothing for a text without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return
    whole = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _SHINGLES_AT_ONCE):
        k = min(n, i + _SHINGLES_AT_ONCE)
        a, b = starts[i:k].tolist(), (ends[i + words - 1 : k + words - 1] if len(parts) >= words else ends[-1:]).tolist()
        yield np.array([digest(whole[x:y], seed) for x, y in zip(a, b, strict=True)], np.uint64)


def fingerprint_of(blocks: Iterable[np.ndarray]) -> int:
    """64 bits: each is 1 if set in over half of the hashes."""
    sums, n = np.zeros(64, np.int64), 0
    for h in blocks:
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int((sums * 2 > n).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64 bits: each is 1 if set in over half of the shingles' hashes."""
    return fingerprint_of(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(trimmed(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long")


@lru_cache(maxsize=64)
def _masks(low: int, bits: int, flips: int) -> tuple[np.ndarray, np.ndarray]:
    """All masks of at most `flips` bits among `bits` bits from bit `low` on, and how many bits each has."""
    found = [(sum(1 << (low + i) for i in c), k) for k in range(flips + 1) for c in combinations(range(bits), k)]
    return np.array([m for m, _ in found], np.uint64), np.array([k for _, k in found], np.int8)


def _routed(rows: DataFrame, done: int, bits: int) -> DataFrame:
    """Send each (part, fp, flips left) on to the parts that its ball reaches by the next `bits` bits.

    part is the variant's first `done + bits` bits, right-aligned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, fp, left = (b[c].to_numpy(zero_copy_only=False) for c in ("part", "fp", "left"))
            for most in np.unique(left):
                masks, sizes = _masks(0, bits, int(most))
                step = max(1, (1 << 20) // len(masks))
                own = np.flatnonzero(left == most)
                for i in range(0, len(own), step):
                    k = own[i : i + step]
                    here = (fp[k].view(np.uint64) >> np.uint64(64 - done - bits)) & np.uint64((1 << bits) - 1)
                    to = (part[k].astype(np.uint64)[:, None] << np.uint64(bits)) | (here[:, None] ^ masks)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to.ravel().view(np.int64)), pa.array(np.repeat(fp[k], len(masks))), pa.array(np.tile(most - sizes, len(k)).astype(np.int8))], ["part", "fp", "left"]
                    )

    return rows.mapInArrow(trimmed(run), "part long, fp long, left byte")


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n nodes and links (a, b), the least node that each reaches."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (apart := x != y).sum() == 0:
            return root
        lo, hi = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(root, hi, lo)
        while (up := root[root]).tolist() != root.tolist() if n < 64 else not np.array_equal(up := root[root], root):
            root = up


def links_in_part(fp: np.ndarray, left: np.ndarray, bits: int, prefix: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints that share a variant with the given prefix of `bits` bits; one for each fingerprint at most.

    Variants are written out in blocks by their next bits where there are many, so memory doesn't grow with the part.
    """
    rest = 64 - bits
    per = {k: len(_masks(0, rest, k)[0]) for k in np.unique(left).tolist()}
    total = sum(per[k] * int((left == k).sum()) for k in per)
    blocks = 1 << max(0, min(rest, (total // VARIANTS_AT_ONCE).bit_length()))
    take = rest - (blocks.bit_length() - 1)
    low = np.uint64((1 << rest) - 1)
    base = (fp & low) | (np.uint64(prefix) << np.uint64(rest) if rest < 64 else np.uint64(0))
    pairs_a, pairs_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    sub = (base & low) >> np.uint64(take)
    for block in range(blocks):
        values, owners = [], []
        for k in per:
            of = np.flatnonzero(left == k)
            used = np.bitwise_count(sub[of] ^ np.uint64(block)).astype(np.int64) if blocks > 1 else np.zeros(len(of), np.int64)
            for u in range(k + 1):
                here = of[used == u]
                if len(here):
                    masks = _masks(0, take, k - u)[0]
                    start = (base[here] & ~low) | (np.uint64(block) << np.uint64(take)) | (base[here] & np.uint64((1 << take) - 1))
                    values.append((start[:, None] ^ masks).ravel())
                    owners.append(np.repeat(here, len(masks)))
        if not values:
            continue
        v, o = np.concatenate(values), np.concatenate(owners)
        s = np.sort(v)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if not len(twice):
            continue
        at = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
        hit = twice[at] == v
        at, o = at[hit], o[hit]
        least = np.full(len(twice), len(fp), np.int64)
        np.minimum.at(least, at, o)
        x, y = least[at], o
        pair = np.unique(x[x != y] * len(fp) + y[x != y])
        pairs_a.append(pair // len(fp))
        pairs_b.append(pair % len(fp))
    a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
    near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
    root = _joined(a[near], b[near], len(fp))
    own = np.flatnonzero(root != np.arange(len(fp)))
    return fp[own], fp[root[own]]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of each part of a stream sorted by part."""
    part, fps, lefts = None, [], []
    for b in batches:
        p, f, k = (b[c].to_numpy(zero_copy_only=False) for c in ("part", "fp", "left"))
        cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1), len(p)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if p[i] != part and fps:
                yield part, np.concatenate(fps), np.concatenate(lefts)
                fps, lefts = [], []
            part = int(p[i])
            fps.append(f[i:j])
            lefts.append(k[i:j])
    if fps:
        yield part, np.concatenate(fps), np.concatenate(lefts)


def near_links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within `radius` bits; distinct: a materialized frame (fp)."""
    half, spark = radius // 2, distinct.sparkSession
    if radius % 2:
        raise ValueError("the radius must be even: half of it is the ball")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, ball = distinct.count(), len(_masks(0, 64, half)[0])
    bits = min(40, max(6, (n * ball // VARIANTS_AT_ONCE).bit_length()))
    start = distinct.select(F.lit(0).cast("long").alias("part"), "fp", F.lit(half).cast("byte").alias("left"))
    rows = _routed(start, 0, bits)
    full = 1000 + 4 * n * len(_masks(0, bits, half)[0]) // (1 << bits)  # four times the mean
    counts = materialize(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > full), "hot-parts")
    most = counts.agg(F.max("n")).first()[0]
    plan = [(rows, bits)]
    if most:
        more = min(12, max(3, (most // full).bit_length() + 2))
        plan = [(rows.join(counts, "part", "left_anti"), bits), (_routed(rows.join(counts, "part", "left_semi"), bits, more), bits + more)]

    def found(bits: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, fp, left in _parts(batches):
                if len(fp) > 1:
                    a, b = links_in_part(fp.view(np.uint64), left.astype(np.int64), bits, part, radius)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        return run

    out = None
    for frame, depth in plan:
        links = frame.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(trimmed(found(depth)), "a long, b long")
        out = links if out is None else out.unionByName(links)
    return out


def simhash_components(docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links of at most `radius` differing bits, itself included).

    Words are runs of characters other than `[\\x20\\x09-\\x0D]`, A-Z lower-cased; shingles count as often as they occur.
    A text with fewer words than a shingle is one shingle. Null, empty and blank texts have fingerprint zero and are
    linked like any other. Repeated rows are returned as often as they occur. A null doc_id never becomes a
    component_id unless no other id is there. An empty table gives no rows. Equal fingerprints are one node, so a group
    of copies costs one row.
    """
    prints = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = materialize(components(near_links(nodes.select("fp"), radius)), "roots")
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = named.join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(by_print, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")

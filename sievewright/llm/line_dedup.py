"""Line dedup by a deletion-neighbourhood join: equal and near-equal lines go, the earliest stays.

The edit bound is one for lines of MIN_CHARS characters and more; shorter ones must be equal. Two lines within one edit agree in a half, so lines without a partner in either half leave first. The others emit the
hash of themselves and of each variant with one character deleted; equal keys meet, and within a key every line is
joined with the earliest one only, never with all. The edit distance of what met is verified on the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_text, materialize, remove, trimmed

#: Below this length the edit bound is zero: one edit makes something else of a short line.
MIN_CHARS = 12
#: A line of these alone is blank.
SPACES = " \t\x0b\x0c\r"
_SEEN_AT_ONCE = 1 << 18
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def line_id(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _short(data: str, mark: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data.encode("utf-8", "surrogatepass"), digest_size=8, key=mark).digest(), "little", signed=True)


def half_keys(line: str) -> list[int]:
    """Keys of which two lines within one edit share at least one: for the smaller length m of the two, the first or the last m // 2 characters."""
    out = []
    for m in (len(line), len(line) - 1):
        h = m // 2
        out += [_short(line[:h], b"a%d" % m), _short(line[len(line) - h :], b"b%d" % m)]
    return out


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    x = (values + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def variant_keys(line: str) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes, as two columns, of the line and of each variant with one character deleted, the line itself first."""
    chars = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    cols, n = [], len(chars)
    for salt, base in enumerate(_BASES):
        terms = _mixed(chars, salt + 1)
        power = _powers(n + 1, base)
        ahead = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms * power[:n], dtype=np.uint64)))
        behind = ahead[n] - ahead[1:]  # still at its old places, one too high
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        cols.append(np.concatenate((ahead[n:], ahead[:n] + behind * inverse)) ^ (np.concatenate(([n], np.full(n, n - 1))).astype(np.uint64) * base))
    return cols[0], cols[1]


def _agreeing(a: str, b: str) -> int:
    """How many characters two strings have in common from the start on, by halving: compared in blocks, not one by one."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def within_one(a: str, b: str) -> bool:
    """Whether the edit distance is one at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = _agreeing(a, b)
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def _lines(docs: DataFrame, kind: str, least: int) -> DataFrame:
    """(lid, doc_id, line_no, halves): the first occurrence of each line that isn't blank among the rows of a batch; no halves below the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[bytes, tuple] = {}
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                for k, line in enumerate((text or "").split("\n")):
                    if line.strip(SPACES):
                        at = (doc is None, doc, k)
                        lid = line_id(line)
                        if lid not in seen or at < seen[lid][0]:
                            seen[lid] = (at, line)
                if len(seen) > _SEEN_AT_ONCE:
                    yield _line_rows(seen, b.schema.field("doc_id").type, least)
                    seen = {}
            yield _line_rows(seen, b.schema.field("doc_id").type, least)

    return docs.mapInArrow(trimmed(run), f"lid binary, doc_id {kind}, line_no int, halves array<long>")


def _line_rows(seen: dict, kind: pa.DataType, least: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.binary()), pa.array([x[0][1] for x in seen.values()], kind), pa.array([x[0][2] for x in seen.values()], pa.int32()), pa.array([half_keys(x[1]) if len(x[1]) >= least else [] for x in seen.values()], pa.list_(pa.int64()))],
        ["lid", "doc_id", "line_no", "halves"],
    )


def _texts(docs: DataFrame, least: int) -> DataFrame:
    """(lid, line): each line once for the rows of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[bytes, str] = {}
            for text in b["text"].to_pylist():
                for line in (text or "").split("\n"):
                    if len(line) >= least:
                        seen[line_id(line)] = line
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.string())], ["lid", "line"])

    return docs.mapInArrow(trimmed(run), "lid binary, line string")


def _variants(survivors: DataFrame, kind: str) -> DataFrame:
    """(k1, k2, place, lid, doc_id, line_no): place -1 marks a line itself, else where the character was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for i, line in enumerate(b["line"].to_pylist()):
                rows.append((i, *variant_keys(line)))
                size += len(line) + 1
                if size > 1 << 17:
                    yield _variant_rows(b, rows)
                    rows, size = [], 0
            if rows:
                yield _variant_rows(b, rows)

    return survivors.select("lid", "doc_id", "line_no", "line").mapInArrow(trimmed(run), f"k1 long, k2 long, place int, lid binary, doc_id {kind}, line_no int")


def _variant_rows(b: pa.RecordBatch, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    take = pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([r[1] for r in rows]).view(np.int64)),
            pa.array(np.concatenate([r[2] for r in rows]).view(np.int64)),
            pa.array(np.concatenate([np.arange(-1, len(r[1]) - 1, dtype=np.int32) for r in rows])),
            b["lid"].take(take), b["doc_id"].take(take), b["line_no"].take(take),
        ],
        ["k1", "k2", "place", "lid", "doc_id", "line_no"],
    )


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, place and position: each line with the earliest that has the same key and place, and lines with the key that are whole there.

    Of a key, the row with place -1 comes first: the one line that is the key itself. Lines with the same key and place
    differ by that character alone.
    """
    key = whole = first = None
    for b in batches:
        later: list[bytes] = []
        before: list[bytes] = []
        for k1, k2, place, lid in zip(*(b[c].to_pylist() for c in ("k1", "k2", "place", "lid")), strict=True):
            if (k1, k2) != key:
                key, whole, first = (k1, k2), lid if place < 0 else None, (place, lid)
                continue
            if place != first[0]:
                first = (place, lid)
            elif lid != first[1]:
                later.append(lid)
                before.append(first[1])
            if whole is not None and lid != whole:
                later.append(lid)
                before.append(whole)
        if later:
            yield pa.RecordBatch.from_arrays([pa.array(later, pa.binary()), pa.array(before, pa.binary())], ["x", "y"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose lines are within one edit."""
    for b in batches:
        yield b.filter(pa.array([within_one(x.as_py(), y.as_py()) for x, y in zip(b["line_x"], b["line_y"], strict=True)], pa.bool_()))


def near_first(docs: DataFrame, kind: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Two materialized frames: all distinct lines (lid, doc_id, line_no) at their first place, and those of them that have an earlier one within one edit."""
    by = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = _lines(docs, kind, least).groupBy("lid").agg(F.min(by).alias("at"), F.first("halves").alias("halves"))
    first = materialize(first.select("lid", "at.doc_id", "at.line_no", "halves"), "lines")
    halves = first.select("lid", F.explode("halves").alias("half"))
    # a line of even and odd smaller length can emit one key twice; different lines are asked for
    shared = halves.groupBy("half").agg(F.min("lid").alias("a"), F.max("lid").alias("b")).filter("a <> b").select("half")
    partnered = halves.join(shared, "half", "left_semi").select("lid").distinct()
    texts = _texts(docs, least).join(partnered, "lid", "left_semi").dropDuplicates(["lid"])
    survivors = materialize(first.drop("halves").join(texts, "lid"), "partnered-lines")
    keyed = _variants(survivors, kind)
    order = ["k1", "k2", "place", F.col("doc_id").isNull(), "doc_id", "line_no"]
    pairs = keyed.repartition(tasks, "k1", "k2").sortWithinPartitions(*order).select("k1", "k2", "place", "lid").mapInArrow(trimmed(_met), "x binary, y binary").distinct()
    x = survivors.select(F.col("lid").alias("x"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no").alias("at_x"), F.col("line").alias("line_x"))
    y = survivors.select(F.col("lid").alias("y"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no").alias("at_y"), F.col("line").alias("line_y"))
    # levenshtein() walks a line from its start for each of its characters, which long lines don't bear
    checked = pairs.join(x, "x").join(y, "y").select("x", "at_x", "line_x", "y", "at_y", "line_y")
    near = checked.mapInArrow(trimmed(_verified), checked.schema)
    late = near.select(F.when(F.col("at_x") > F.col("at_y"), F.struct("x", "at_x")).otherwise(F.struct(F.col("y").alias("x"), F.col("at_y").alias("at_x"))).alias("r"))
    dropped = materialize(late.select(F.col("r.x").alias("lid"), F.col("r.at_x.doc_id").alias("doc_id"), F.col("r.at_x.line_no").alias("line_no")).distinct(), "near-lines")
    remove(survivors)
    return first.drop("halves"), dropped


def _kept_places(docs: DataFrame, kind: str, least: int) -> DataFrame:
    first, dropped = near_first(docs, kind, least)
    stay = first.join(dropped.select("lid"), "lid", "left_anti")
    return stay.groupBy("doc_id").agg(F.collect_list("line_no").alias("stays"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """The documents, all columns, with `text` rewritten, and the columns named by `counts` added (lines before, lines dropped; columns of these names are replaced).

    A line (what stands between newlines) goes if an earlier line of the corpus, by (id, line number), equals it, or if
    both have at least min_chars characters and are within one edit (a character inserted, deleted or replaced),
    whether or not that earlier line stays itself. Blank lines always stay. Null stays null and an empty text
    empty. Rows that repeat an id are taken as one document. A null id comes after all others. Line order, and all
    else of a row, is unchanged; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rest = [c for c in docs.columns if c not in counts]
    kept_doc, stays = fresh(docs, "kept_doc"), fresh(docs, "stays")
    places = _kept_places(id_text(docs, id_col, text_col), kind, min_chars).toDF(kept_doc, stays)
    joined = docs.select(*[F.col(f"`{c}`") for c in rest]).join(places, F.col(f"`{id_col}`").eqNullSafe(F.col(kept_doc)), "left").drop(kept_doc)
    text_at = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, total, gone = [], [], []
            for text, own in zip(b[text_at].to_pylist(), b[len(rest)].to_pylist(), strict=True):
                lines, stay = (text or "").split("\n"), frozenset(own or ())
                left = [x for k, x in enumerate(lines) if k in stay or not x.strip(SPACES)]
                texts.append(None if text is None else "\n".join(left))
                total.append(len(lines) if text else 0)
                gone.append(len(lines) - len(left))
            columns = [pa.array(texts, pa.string()) if i == text_at else b[i] for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*rest, *counts])

    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).withColumns(dict.fromkeys(counts, F.lit(0).cast("long"))).schema
    return joined.mapInArrow(trimmed(run), schema)

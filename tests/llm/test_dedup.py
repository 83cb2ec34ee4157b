"""Exact, SimHash, line and suffix dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sievewright.llm import induced_sort
from sievewright.llm.components import components
from sievewright.llm.exact_dedup import exact_dedup
from sievewright.llm.line_dedup import dedup_lines, variant_keys, within_one
from sievewright.llm.simhash import fingerprint, links_in_part, near_links, simhash_components
from sievewright.llm.suffix_dedup import remove_repeats


def table(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("digits", [64, 1])
def test_exact_dedup(odd_docs, tmp_path, digits):
    path = str(tmp_path / "docs")
    odd_docs.write.parquet(path)
    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((i, len(t)))
    want = []
    for norm, members in groups.items():
        keep = max(members, key=lambda m: (m[1], m[0] is not None, -(m[0] or 0)))[0]
        want += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    got = exact_dedup(odd_docs.sparkSession, path, digest_hex=digits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert table(got) == table(want)


def test_exact_dedup_joins_many_hits_by_a_shuffle(odd_docs, tmp_path):
    path = str(tmp_path / "docs")
    odd_docs.write.parquet(path)
    spark = odd_docs.sparkSession
    for digits in (64, 1):
        got = exact_dedup(spark, path, digest_hex=digits, hits_broadcast=0)
        assert table(got.collect()) == table(exact_dedup(spark, path).collect())


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    first = [("b", "one text"), ("c", "another"), ("d", None)]
    spark.createDataFrame(first, "doc_id string, text string").write.parquet(path)
    kept = {r.doc_id: r.keep_id for r in exact_dedup(spark, path, state_dir=state).collect()}
    assert kept == {"b": "b", "c": "c", "d": "d"}
    spark.createDataFrame([("a", "one text"), ("e", "one  text"), ("a", "")], "doc_id string, text string").write.mode("append").parquet(path)
    keys = spark.read.parquet(f"{state}/keys").count()
    rows = exact_dedup(spark, path, state_dir=state).collect()
    assert keys == 3 and spark.read.parquet(f"{state}/keys").count() == 6
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in rows) == [("a", "a", 2), ("a", "e", 3), ("b", "e", 3), ("c", "c", 1), ("d", "a", 2), ("e", "e", 3)]
    assert table(exact_dedup(spark, path).select("doc_id", "keep_id", "group_size").collect()) == table([r[:3] for r in rows])
    assert table(exact_dedup(spark, path, state_dir=state).collect()) == table(rows)  # nothing new: nothing is counted twice


def test_exact_dedup_of_nothing(no_docs, tmp_path):
    path = str(tmp_path / "none")
    no_docs.write.parquet(path)
    assert exact_dedup(no_docs.sparkSession, path).count() == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c d", "A b C d e é", "x " * 500])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_components(odd_docs):
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in odd_docs.collect()]
    fps = sorted({f for _, f in rows})
    root = roots(fps, [(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 4])
    least = {}
    for i, f in rows:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = [(i, f"{f:016x}", least.get(root[f])) for i, f in rows]
    assert table(simhash_components(odd_docs).collect()) == table(want)


def test_simhash_of_nothing(no_docs):
    assert simhash_components(no_docs).count() == 0


def test_near_links_find_every_component(spark, monkeypatch):
    """Planted balls, one of them great enough to be split into further parts."""
    draw = random.Random(5)
    center = [draw.getrandbits(64) for _ in range(40)]
    fps = set(center)
    for c in [*center, *[center[0]] * 400]:
        f = c
        for _ in range(draw.randrange(6)):
            f ^= 1 << draw.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    root = roots(fps, [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if bin(a ^ b).count("1") <= 4])
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in near_links(df).collect()]
    assert all(bin(a ^ b).count("1") <= 64 for a, b in found)
    assert roots(fps, found) == root


def test_links_in_part_in_small_blocks(monkeypatch):
    from sievewright.llm import simhash

    draw = random.Random(6)
    base = draw.getrandbits(64)
    fps = np.array(sorted({base ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for _ in range(30)}), np.uint64)
    left = np.full(len(fps), 2)
    whole = links_in_part(fps, left, 0, 0, 4)
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", 2000)
    parts = links_in_part(fps, left, 0, 0, 4)
    assert len(whole[0]) == len(parts[0]) == len(fps) - 1


def test_components(spark):
    draw = random.Random(7)
    linked = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(500, i) for i in range(501, 700)] + [(i, i + 1) for i in range(1000, 1060)]
    nodes = {n for a, b in linked if a != b for n in (a, b)}
    want = roots(nodes, [(a, b) for a, b in linked if a != b])
    got = {r.node: r.root for r in components(spark.createDataFrame(linked, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_within_one_and_variants():
    draw = random.Random(8)
    for _ in range(400):
        a = "".join(draw.choice("ab") for _ in range(draw.randrange(1, 9)))
        b = list(a)
        kind, at = draw.randrange(4), draw.randrange(len(a))
        if kind == 0:
            b[at] = draw.choice("abc")
        elif kind == 1:
            del b[at]
        elif kind == 2:
            b.insert(at, draw.choice("abc"))
        else:
            b = b[::-1]
        b = "".join(b)
        near = a == b or any(a[:i] + a[i + 1 :] == b for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b))) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1)
        assert within_one(a, b) == near
    k1, k2 = variant_keys("abcd")
    for i, v in enumerate(["abcd", "bcd", "acd", "abd", "abc"]):
        w1, w2 = variant_keys(v)
        assert (k1[i], k2[i]) == (w1[0], w2[0])


def slow_lines(rows, least=12):
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r\v\f"):
                first.setdefault(line, (i is None, i or 0, k))
    gone = {max(a, b, key=first.get) for a in first for b in first if a < b and min(len(a), len(b)) >= least and within_one(a, b)}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for k, x in enumerate(lines) if not x.strip(" \t\r\v\f") or (first[x] == (i is None, i or 0, k) and x not in gone)]
        out.append((i, None if t is None else "\n".join(left), len(lines) if t else 0, len(lines) - len(left)))
    return out


def test_line_dedup(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = dedup_lines(odd_docs)
    assert got.columns == [*[c for c in odd_docs.columns if c != "n_dropped"], "n_lines", "n_dropped"]
    assert table(got.select("doc_id", "text", "n_lines", "n_dropped").collect()) == table(slow_lines(rows))


def test_line_dedup_near_lines(spark):
    draw = random.Random(9)
    base = ["".join(draw.choice("abcdef ") for _ in range(draw.randrange(12, 30))) for _ in range(12)]
    lines = list(base)
    for _ in range(60):
        x = list(draw.choice(base))
        at = draw.randrange(len(x))
        if draw.random() < 0.4:
            x[at] = draw.choice("xyz")
        elif draw.random() < 0.5:
            del x[at]
        else:
            x.insert(at, draw.choice("xyz"))
        lines.append("".join(x))
    draw.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(18)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert table(got.collect()) == table(slow_lines(rows))


def test_short_lines_are_equal_or_differ(spark):
    rows = [(1, "ok\nyes\nlonger than twelve"), (2, "ok\n\nyeS\n \nlonger than twelv3"), (3, "ok\n\n"), (4, "elevenchars\ntwelve chars")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {1: rows[0][1], 2: "\nyeS\n ", 3: "\n", 4: rows[3][1]}


def test_very_long_lines_that_are_near_equal(spark):
    line = "".join(random.Random(4).choice("abcdef gh") for _ in range(1_000_000))
    rows = [(1, line), (2, line[:500_000] + line[500_001:]), (3, line[:700_000] + "X" + line[700_001:]), (4, line[:200_000]), (5, line[1:200_000]), (6, line[2:200_000])]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_dropped) for r in got.collect()) == [(1, 0), (2, 1), (3, 1), (4, 0), (5, 1), (6, 1)]


def test_line_dedup_of_nothing(no_docs):
    assert dedup_lines(no_docs).count() == 0


def slow_repeats(text, width):
    places = {}
    for i in range(len(text) - width + 1):
        places.setdefault(bytes(text[i : i + width]), []).append(i)
    out = [False] * len(text)
    for at in places.values():
        if len(at) > 1:
            for i in at:
                out[i] = True
    return out


@pytest.mark.parametrize("small", [False, True])
def test_induced_sort(monkeypatch, small):
    if small:  # recursion without a bound in memory, batches of two, and queues that overflow to files
        monkeypatch.setattr(induced_sort, "BATCH", 2)
        monkeypatch.setattr(induced_sort, "QUEUE_BYTES", 30)
        monkeypatch.setattr(induced_sort.DiskQueue.__init__, "__defaults__", (30,))
    draw = random.Random(10)
    for _ in range(150):
        b = [draw.randint(0, draw.choice([1, 2, 4])) for _ in range(draw.randint(2, 60))]
        b += b[2 : draw.randint(2, len(b))]
        order = induced_sort.suffix_order(np.array(b, np.int64), 10**9, 0 if small else 1 << 20).tolist()
        assert order == sorted(range(len(b)), key=lambda i: b[i:])
        w = draw.choice([1, 2, 3, 7])
        assert induced_sort.repeated_starts(np.array(b, np.uint8), w, 0 if small else 1 << 20).tolist() == slow_repeats(b, w)


def test_suffix_dedup(odd_docs):
    width, rows = 130, [(r.doc_id, (r.text or "").encode()) for r in odd_docs.collect()]
    seen = {}
    for _, t in rows:
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]] = seen.get(t[i : i + width], 0) + 1
    want = []
    for i, t in rows:
        edge = np.zeros(len(t) + 1, int)
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                edge[k] += 1
                edge[k + width] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want.append((i, len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert table(remove_repeats(odd_docs, width).collect()) == table(want)
    assert table(remove_repeats(odd_docs, width, shard_bytes=200).collect()) == table(want)


def test_suffix_dedup_of_nothing(no_docs):
    assert remove_repeats(no_docs).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(no_docs, 100)


def test_op10_hot_digest_is_one_row(odd_docs, tmp_path):
    path = str(tmp_path / "hot")
    odd_docs.filter("doc_id = 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn("doc_id", F.col("k").cast("long")).drop("k").write.parquet(path)
    got = exact_dedup(odd_docs.sparkSession, path).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(1, 50)} and sum(r.kept for r in got) == 1

"""The stages after one another, on the small table."""

import ctypes
import importlib.util
import re
from pathlib import Path

import pyarrow as pa
import pytest

from sievewright.llm.common import trimmed

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline was removed")


def test_stages(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    from sievewright.llm.common import materialize

    for name, stage in cp.STAGES[:-1]:
        docs = materialize(stage(spark, docs, d), f"test-{name}")
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= ids and len(now) == docs.count()
        ids = now
    assert ids
    out = cp.STAGES[-1][1](spark, docs, d)
    assert {r.doc_id for r in out.collect()} == ids
    assert sorted(r.ids_sha256 for r in cp.run(spark, d).select("ids_sha256").collect()) == sorted(r.ids_sha256 for r in out.select("ids_sha256").collect())


def test_stages_without_rows(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    none = spark.read.parquet(f"{d}/documents.parquet").filter("false")
    for _, stage in cp.STAGES:
        assert stage(spark, none, d).count() == 0


def test_against_brute_force(spark, tmp_path):
    """All stages over a small corpus with junk, repeated lines, near copies and benchmark passages, one by one in plain Python."""
    import hashlib
    import random
    import zlib

    import numpy as np
    import public_tokenizers
    from test_dedup import slow_lines
    from test_near_dup import slow as slow_near
    from test_text_ops import slow_contamination

    import corpus_pipeline as cp
    from sievewright.llm.quality import ACCEPT, DENSE, features, train
    from sievewright.llm.segment import Pieces, chunks_of

    draw = random.Random(21)
    words = [f"{a}{b}" for a in "tide reed stone lamp gate moss fern".split() for b in "abcdefghij"]
    say = lambda k: " ".join(draw.choice(words) for _ in range(k))
    bench = [(i, say(18)) for i in range(6)]
    rows = []
    for i in range(90):
        if i % 5 == 0:
            text = " ".join(draw.choice(["BUY!!", "win|now", "$$$", "99|9"]) for _ in range(40))
        elif i % 5 == 1 and rows:
            text = draw.choice([t for _, t in rows if "|" not in t] or [say(60)]).replace("\n", " ")
            cut = text.split(" ")
            cut[draw.randrange(len(cut))] = "changed"
            text = " ".join(cut)
        else:
            text = "\n".join(say(draw.choice([2, 25, 40])) for _ in range(4))
        if i % 11 == 3:
            text += "\n" + say(5) + " " + draw.choice(bench)[1] + " " + say(5)
        if i % 7 == 2:
            text += "\nsame footer on many pages here\nok"
        rows.append((i, text))
    rows += [(200, rows[7][1]), (201, rows[8][1].replace("t", "x", 1)), (202, "ok")]
    labels = [(i, int(i % 5 > 0), 0) for i in range(90)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    used = [(features(t), q) for i, t in rows for j, q, _ in labels if i == j and zlib.crc32(str(i).encode()) % 5]
    x = np.array([f for f, _ in used], np.float32)
    order = np.lexsort(x.T[: DENSE + 4])
    ranker = train(x[order], np.array([q for _, q in used])[order] >= 1)
    left = [(i, t) for i, t in rows if ranker.score(features(t)[None])[0] >= ACCEPT]
    counts = [len(rows), len(left)]
    left = [(i, t) for i, t, _, dropped in slow_lines(left) if not dropped or t.strip()]
    counts.append(len(left))
    left = [r for r, (_, least) in zip(sorted(left), sorted(slow_near(left)), strict=True) if r[0] == least]
    counts.append(len(left))
    left = [r for r, (_, _, n_hit, *_) in zip(left, slow_contamination(left, bench), strict=True) if not n_hit]
    counts.append(len(left))
    assert all(a > b for a, b in zip(counts, counts[1:], strict=False)), counts
    pieces = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: hashlib.sha256(b"".join(pieces.best(c)[0] for c in chunks_of(t))).hexdigest() for i, t in left}
    got = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.ids_sha256 for r in got} == want and len(got) == len(want) and all(r.round_trip for r in got)


@pytest.mark.parametrize("name", ["kept_doc", "stays", "first_id", "bad_id", "wanted_id", "n_lines", "n_dropped", "lines_dropped", "node", "component_id", "sum"])
def test_clashing_names(spark, name):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(30).selectExpr("*", f"'mine' AS {name}")
    for stage in ("line_dedup", "benchmark_decontamination"):
        out = dict(cp.STAGES)[stage](spark, docs, d)
        assert out.columns == docs.columns and {r[name] for r in out.select(name).distinct().collect()} == {"mine"}


def test_odd_rows(spark, odd_docs):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    docs = odd_docs
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == odd_docs.columns
    assert cp.STAGES[-1][1](spark, docs, d).count() == docs.count()


def test_workers_give_memory_back():
    """A worker keeps little of what a task took, also where small pieces of it lie apart."""

    def resident():
        return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10

    def run(batches):
        for b in batches:
            taken = [ctypes.create_string_buffer(2000) for _ in range(100_000)]
            held.append(taken[-1])  # at the end of the heap: nothing below it is given back without being asked to
            del taken
            yield b

    held, got = [], []
    before = resident()
    for _ in trimmed(run)(iter([pa.record_batch([pa.array([1])], ["x"])])):
        got.append(resident())
    assert got[0] - before > 100 and resident() - before < 60

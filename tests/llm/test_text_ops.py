"""Token counts, segmentation, decontamination, quality, licences and archives."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sievewright.llm import queries, warc
from sievewright.llm.common import shared_folder
from sievewright.llm.decontam import decontaminate, words_of
from sievewright.llm.license_scan import TEMPLATES, license_scan, needed_words
from sievewright.llm.quality import ACCEPT, features, keep_good, quality_scores, train
from sievewright.llm.segment import Memory, Pieces, decode, encode_group, encoded, marked
from sievewright.llm.token_count import _Counts, count_text, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "▁", "é", "中", "　", "<s>", "the", " the", "\x00", "😀", "!", "​", "\r\n", "1", "<0x0A>", "é", "ﬁ", "   ", "ing", "\xa0"]


def table(rows):
    return sorted(map(tuple, rows), key=repr)


def test_token_counts_match_the_library(odd_docs):
    sp, counts, draw = sentencepiece.SentencePieceProcessor(model_file=MODEL), _Counts(MODEL), random.Random(1)
    for _ in range(3000):
        t = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14)))
        assert count_text(t, counts) == len(sp.encode(t)), t
    want = [(r.doc_id, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 100) for r in odd_docs.collect()]
    assert table(token_counts(odd_docs, MODEL, 100).collect()) == table(want)


def test_token_counts_of_nothing(no_docs):
    assert token_counts(no_docs, MODEL, 10).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return Pieces(MODEL)


def all_segmentations(pieces, s):
    out = []

    def go(i, score, cuts):
        if i == len(s):
            out.append((score, tuple(pieces.pieces(s, cuts))))
            return
        for j in range(i + 1, len(s) + 1):
            v = pieces.table.get(s[i:j])
            if v is not None and v is not False:
                go(j, score + v, [*cuts, j])
        if s[i] not in pieces.ids:
            go(i + 1, score + pieces.unknown, [*cuts, i + 1])

    go(0, 0, [0])
    return sorted(out, reverse=True)


def test_segmentation_is_the_n_best(pieces):
    memory, draw = Memory(pieces), random.Random(2)
    for _ in range(400):
        t = "".join(draw.choice(["a", "e", "th", "in", " ", "é", "中", "😀", "\n", "aa", "s"]) for _ in range(draw.randint(0, 9)))
        every = all_segmentations(pieces, marked(t))
        ((ids, scores),) = encode_group([t], 4, memory)
        assert scores == [x[0] for x in every[:4]]
        assert (scores[0], tuple(ids.tolist())) in every
        assert decode(ids, pieces) == t
        if t:
            best = pieces.nbest(marked(t), 6)
            assert [x[0] for x in best] == [x[0] for x in every[:6]] and len({tuple(x[1]) for x in best}) == len(best)


def test_memory_forgets_without_changing_results(pieces, monkeypatch):
    from sievewright.llm import segment

    texts = [" ".join(random.Random(i).choices(["tide", "lantern", "harbour", "x", "granite9", "q\nq"], k=30)) for i in range(40)]
    whole = [(x.tolist(), s) for x, s in encode_group(texts, 3, Memory(pieces))]
    monkeypatch.setattr(segment, "_REMEMBERED", 3)
    small = Memory(pieces)
    assert [(x.tolist(), s) for t in texts for x, s in encode_group([t], 3, small)] == whole


def test_encoded(odd_docs, no_docs):
    rows = encoded(odd_docs, MODEL, n=3, with_ids=True).collect()
    assert len(rows) == odd_docs.count() and all(r.round_trip for r in rows) and all(len(r.ids) == r.n_tokens for r in rows)
    assert all(r.nbest_scores == sorted(r.nbest_scores, reverse=True) for r in rows)
    assert encoded(no_docs, MODEL).count() == 0


def slow_contamination(docs, items, span=13):
    windows = {}
    for i, t in items:
        w = words_of(t)
        n = min(span, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                ids = windows.get(tuple(w[k : k + n]))
                if ids:
                    hit.update(range(k, k + n))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("index_bytes", [1 << 20, 300])
def test_decontamination(spark, odd_docs, index_bytes):
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    a = texts[1].split(" ")
    items = [(1, " ".join(a[20:40])), (2, "unseen words " * 10), (3, " ".join(a[25:45]).upper()), (10, "WORD, word"), (11, ""), (12, None), (13, " ".join(a[5:8])), (14, " ".join(a[5:8])), (15, "中文 😀"), (15, "中文 😀")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = slow_contamination([(r.doc_id, r.text) for r in odd_docs.collect()], items)
    assert table(decontaminate(odd_docs, bench, index_bytes=index_bytes).collect()) == table(want)


def test_items_joined_by_a_shuffle_give_the_same_rows(spark):
    d = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    wide = bench.select("item_id", "text").unionByName(docs.selectExpr("doc_id + 100000 AS item_id", "concat_ws(' ', slice(split(text, ' '), 5, 30)) AS text"))
    joined = decontaminate(docs, wide, index_bytes=0)
    assert table(joined.collect()) == table(decontaminate(docs, wide).collect())
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_decontamination_without_rows(odd_docs, no_docs, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(no_docs, bench).count() == 0
    assert decontaminate(odd_docs, bench).filter("n_hit > 0 or n_items > 0").count() == 0


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = queries.QUERIES["op4_quality_classifier"](spark, d)
    assert out.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    rows = out.filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= ACCEPT) for r in rows)


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 1), (12, 0), (12, None), (None, 0), (99, 0)], "doc_id long, quality int")
    out = quality_scores(odd_docs, labels)
    assert out.count() == odd_docs.count() and out.filter("score is null or predicted is null").count() == 0
    assert quality_scores(no_docs, labels).count() == 0
    assert [r.score for r in quality_scores(odd_docs, labels.filter("false")).collect()] == [pytest.approx(ACCEPT)] * odd_docs.count()
    kept = keep_good(odd_docs, labels)
    assert kept.schema == odd_docs.schema and kept.count() == out.filter("predicted = 1").count()


def test_ranking_orders_pairs():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 6))
    good = x[:, 0] - 0.5 * x[:, 3] > -0.8
    ranker = train(x, good)
    s = ranker.raw(x)
    assert (s[good][:, None] > s[~good][None, :]).mean() > 0.99
    assert abs((ranker.score(x) >= ACCEPT).mean() - good.mean()) < 0.01
    assert not features(None).any() and not features("").any()


def slow_license(text, threshold=0.8):
    import re

    def grams(t):
        w = t.split(" ")
        return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}

    norm = re.sub(r"[^\w\n]+|_", " ", (text or "").lower())
    clean = lambda u: re.sub(r"[ \n]+", " ", u).strip(" ")
    paragraphs = [p for p in map(clean, re.split("\n *\n", norm)) if p]
    runs = [" ".join(paragraphs[i:j]) for i in range(len(paragraphs)) for j in range(i + 2, len(paragraphs) + 1)]
    most = max(int(round(1.5 * len(grams(clean(re.sub(r"[^\w]+|_", " ", t.lower())))), 9)) + 1 for t in TEMPLATES.values())
    units = {*map(clean, [*norm.split("\n"), norm]), *paragraphs, *(r for r in runs if len(r.split(" ")) <= most)}
    best = []
    for u in units:
        g = grams(u)
        scored = [(2 * len(g & grams(re.sub(r"[^\w]+|_", " ", t.lower()).strip())) / (len(g) + len(grams(re.sub(r"[^\w]+|_", " ", t.lower()).strip()))), n) for n, t in TEMPLATES.items()] if g else []
        if scored and max(scored)[0] >= threshold:
            best.append(max(scored))
    return (len({n for _, n in best}), *((max(best)[1], round(max(best)[0], 6)) if best else (None, None)))


def test_a_license_in_paragraphs_in_a_longer_file(spark):
    mit, words = TEMPLATES["MIT"], "reading the manual of this tool takes a while so better begin today " * 40
    cut = [mit[: mit.index("The above")], mit[mit.index("The above") : mit.index("THE SOFTWARE IS")], mit[mit.index("THE SOFTWARE IS") :]]
    wrapped = [c.replace(", ", ",\n * ") for c in cut]
    rows = [(1, words + "\n\nMIT License\n\nCopyright (c) 2020 Someone\n\n" + "\n\n".join(cut) + "\n\n" + words), (2, "/*\n * " + "\n *\n * ".join(wrapped) + "\n */\n\n" + words), (3, words + "\n\n" + cut[1] + "\n\n" + words)]
    rows += [(4, "\n\n".join(["software and the license"] * 700)), (5, "\n\n".join([*cut, *cut]) + "\n\nReleased under the MIT License.")]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert table(got) == table((i, *slow_license(t)) for i, t in rows)
    assert [r.license for r in sorted(got)][:3] == ["MIT", "MIT", None]


def test_license_scan(spark, odd_docs, no_docs):
    rows = [
        (1, "intro\nReleased under the MIT license!\nend"), (2, TEMPLATES["MIT"]), (3, "x\n\n" + TEMPLATES["ISC"].replace(". ", ".\n") + "\n\ny"), (4, "licensed"), (5, None), (6, ""), (7, "All rights reserved. " * 3),
        (8, "Licensed under CC BY-NC 4.0."), (9, "This work is licensed under the GNU General Public License, version 3, or later."), (10, "the mit licence " * 2000), (10, "Licensed under the Apache License, Version 2.0"),
    ]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert table(got.collect()) == table((i, *slow_license(t)) for i, t in rows)
    assert license_scan(odd_docs).filter("n_found > 0").count() == 0 and license_scan(odd_docs).count() == odd_docs.count()
    assert license_scan(no_docs).count() == 0
    assert "python" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_needed_words_lose_nothing():
    for text in TEMPLATES.values():
        from sievewright.llm.license_scan import _grams

        g = _grams(text)
        words = needed_words(g, 0.8)
        free = [x for x in g if not words & set(x.split(" "))]
        assert len(free) < 0.8 * len(g) / 1.2 + 1e-9


def test_warc_round_trip(spark):
    rows = [(1, "http://a.test/", "x" * 50), (2, None, "x" * 50), (3, "http://b.test/é \r\n", None), (4, "http://c.test/", ""), (5, "http://d.test/", "héllo\r\n\r\nWARC/1.1"), (5, "http://d.test/", "héllo\r\n\r\nWARC/1.1"), (None, "http://e.test/", "x" * 50), (7, "u", "y" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = shared_folder(spark, "test-warc")
    index = warc.write_archives(pages, folder)
    got = warc.read_records(index, folder, payloads=True).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.record_type): r for r in got}
    assert by[2, "revisit"].refers_to == 1 and by[4, "revisit"].refers_to == 3 and by[None, "response"].refers_to is None
    for i, _, html in rows:
        raw = (html or "").encode()
        r = by.get((i, "response")) or by[i, "revisit"]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), warc.base32_digest(raw))
        assert r.record_type == "revisit" or bytes(r.payload) == raw
    assert all(r.record_type == "response" for r in warc.archived(pages, min_payload=1 << 20).collect())
    some = warc.read_records(index.filter("page_id in (2, 7)"), folder).collect()
    assert {r.page_id for r in some} == {2, 7}
    assert warc.archived(pages.filter("false")).count() == 0


def test_clashing_columns_and_renamed_ids(odd_docs):
    renamed = odd_docs.withColumnRenamed("doc_id", "id").withColumnRenamed("text", "body").withColumn("text", F.lit(1))
    assert token_counts(renamed, MODEL, 10, "id", "body").count() == odd_docs.count()

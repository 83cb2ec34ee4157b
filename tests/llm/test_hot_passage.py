"""A passage shorter than the width in many different documents: no key keeps more contexts than a shard holds."""

import random

import pytest
from pyspark.sql import functions as F

from sievewright.llm import suffix_dedup
from sievewright.llm.suffix_dedup import dealt_out, remove_repeats

WIDTH = 200


def texts(passage_bytes):
    draw = random.Random(passage_bytes)

    def junk(n):
        return "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))

    passage = junk(passage_bytes)
    out = [junk(300) + passage + junk(300) for _ in range(60)]
    out += [junk(120) + out[k][300 - 150 : 300 + passage_bytes + k] + junk(120) for k in range(0, 50, 5)]  # some windows over the passage's edge are shared
    return [*out, out[3]]


def slow(rows):
    starts = {}
    for i, t in enumerate(rows):
        for p in range(len(t) - WIDTH + 1):
            starts.setdefault(t[p : p + WIDTH], []).append((i, p))
    gone = {(i, p + k) for found in starts.values() if len(found) > 1 for i, p in found for k in range(WIDTH)}
    return [(i, len(t), sum((i, p) in gone for p in range(len(t)))) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("passage_bytes", "look"), [(100, 64), (190, 64), (100, 1), (190, 1), (230, 1)])
def test_hot_passage(spark, monkeypatch, passage_bytes, look):
    monkeypatch.setattr(suffix_dedup, "_LOOK", look)  # 1: the passage's keys are known to be very common
    monkeypatch.setattr(suffix_dedup, "_WAITING", 50)
    rows = texts(passage_bytes)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = remove_repeats(docs, width=WIDTH, shard_bytes=8 * 2 * WIDTH).select("doc_id", "n_bytes", "n_removed")
    assert sorted(map(tuple, got.collect())) == slow(rows)
    _, compare = dealt_out(docs.withColumn("sum", F.xxhash64("text")), WIDTH, "bigint", 8)
    assert compare.groupBy("key").count().agg(F.max("count")).first()[0] <= 8


def test_the_passage_was_hot(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_STEPS", ())
    docs = spark.createDataFrame(list(enumerate(texts(100))), "doc_id long, text string")
    _, compare = dealt_out(docs.withColumn("sum", F.xxhash64("text")), WIDTH, "bigint", 8)
    assert compare.groupBy("key").count().agg(F.max("count")).first()[0] > 8

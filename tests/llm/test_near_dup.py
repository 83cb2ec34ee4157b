"""Near-duplicates of the pipeline against brute force."""

import random

import numpy as np

from sievewright.llm.near_dup import _Parities, extra, least_shared, near_components, parity_bits, prefix, shingle_set
from sievewright.llm.simhash import fingerprint


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(800)}" for _ in range(n))


def jaccard(a, b):
    x, y = set(shingle_set(a, 5).tolist()), set(shingle_set(b, 5).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


def slow(rows):
    name = {i: i for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if name[i] != name[j] and jaccard(rows[i][1], rows[j][1]) >= 0.8:
                old, new = name[i], name[j]
                name = {k: new if v == old else v for k, v in name.items()}
    least = {}
    for k, v in name.items():
        if rows[k][0] is not None:
            least[v] = min(least.get(v, rows[k][0]), rows[k][0])
    return sorted(((rows[k][0], least.get(v)) for k, v in name.items()), key=repr)


def edited(text, draw, edits):
    words = text.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
    return " ".join(words)


def near_texts():
    draw, texts = random.Random(11), []
    passage = prose(900, 40)
    for seed in range(25):
        base = prose(100 + seed, draw.choice([6, 40, 200, 400]))
        texts += [base, *(edited(base, draw, max(1, len(base.split()) * k // 100)) for k in (1, 2, 2, 3))]
        texts.append(passage + " " + prose(500 + seed, 60))
    return texts


def test_all_pairs_at_the_similarity_link(spark):
    texts = near_texts()
    far = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if 0.8 <= jaccard(a, b) < 1 and (fingerprint(a, 5) ^ fingerprint(b, 5)).bit_count() > 4]
    assert len(far) > 10
    rows = [*enumerate(texts), (None, texts[0]), (500, ""), (501, None), (502, " \n"), (503, "A few words"), (504, "a  few Words"), (505, "a few words more")]
    got = near_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == slow(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, near_components(odd_docs).collect()), key=repr) == slow(rows)
    assert near_components(no_docs).count() == 0


def test_stage_drops_near_copies_beyond_the_radius(spark):
    import corpus_pipeline as cp

    draw = random.Random(3)
    base = prose(77, 400)
    near = next(t for _ in range(200) if 0.8 <= jaccard(base, t := edited(base, draw, 8)) < 1 and (fingerprint(base, 4) ^ fingerprint(t, 4)).bit_count() > 4)
    docs = spark.createDataFrame([(1, base), (2, near), (3, prose(78, 400))], "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.simhash_near_dedup(spark, docs, "").collect()) == [1, 3]


def test_parity_bits_bound_the_difference():
    draw = np.random.default_rng(5)
    for n, m, both in [(0, 0, 0), (5, 9, 4), (40, 40, 39), (300, 70, 60), (1000, 1000, 900), (3000, 10, 0)]:
        own = np.unique(draw.integers(0, 1 << 63, n + m - both).astype(np.uint64))
        x, y = own[:n], own[n - both :]
        apart = len(np.setxor1d(x, y))
        bits = int(_Parities([parity_bits(x).tobytes(), parity_bits(y).tobytes()]).differing(0, np.array([1]))[0])
        assert bits <= apart and (apart - bits) % 2 == 0 and (bits >= 0.2 * apart or min(n, m) < 0.8 * max(n, m) or n > 512)


def test_a_great_group_of_near_copies(spark):
    draw = random.Random(8)
    base = prose(55, 120)
    rows = [(i, edited(base, draw, 4)) for i in range(300)] + [(400 + i, prose(600 + i, 120)) for i in range(20)]
    got = near_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == slow(rows)


def test_prefixes_share_what_they_must():
    draw = np.random.default_rng(6)
    common, often = np.empty(0, np.uint64), np.empty(0, np.int64)
    for _ in range(400):
        n = int(draw.integers(1, 120))
        own = np.unique(draw.integers(0, 1 << 60, 2 * n).astype(np.uint64))
        x = own[: len(own) // 2]
        y = np.unique(np.concatenate((draw.permutation(x)[: max(1, int(len(x) * draw.uniform(0.8, 1)))], own[len(own) // 2 :][: int(draw.integers(0, 1 + len(x) // 5))])))
        if len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.8:
            shared = len(np.intersect1d(prefix(x, common, often, 0.8), prefix(y, common, often, 0.8)))
            assert shared >= extra(min(len(x), len(y))) and shared >= max(least_shared(len(x), 0.8), least_shared(len(y), 0.8))

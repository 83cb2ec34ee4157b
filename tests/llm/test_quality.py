"""The quality classifier against a plain recomputation of its features, its training and its scores."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from sievewright.llm.quality import ACCEPT, DENSE, HASHED, Ranker, features, keep_good, quality_scores, train


def slow_features(text):
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * (DENSE + HASHED)
    lines, chars = raw.split(b"\n"), list(raw)
    is_in = lambda c, kind: bytes([c]) in [bytes([x]) for x in kind]
    upper, lower, digits = (sum(is_in(c, kind) for c in chars) for kind in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"))
    high, stops, spaces = sum(c > 127 for c in chars), sum(is_in(c, b"!,.:;?") for c in chars), sum(is_in(c, b"\t\n\r ") for c in chars)
    n, size = len(words), len(raw)
    pairs = list(zip(words, words[1:], strict=False))
    dense = [
        math.log(1 + n), size / n, len(set(words)) / n, sum(a == b for a, b in pairs) / n, len(set(pairs)) / len(pairs) if pairs else 0.0,
        upper / (upper + lower + high) if upper + lower + high else 0.0, (size - upper - lower - digits - high - stops - spaces) / size, digits / size, stops / n, chars.count(33) / n,
        math.log(1 + size / len(lines)), (len(lines) - len(set(lines))) / len(lines), chars.count(124) / n, math.log(1 + len(lines)),
    ]
    buckets = Counter(zlib.crc32(w) % HASHED for w in words)
    return dense + [math.sqrt(buckets[k] / n) for k in range(HASHED)]


def test_features():
    for text in [None, "", " \n", "One", "Hi! A b, a b. 42|7", "É été\nline\nline\n", "x " * 300, "a\tb\r\nC"]:
        assert np.allclose(features(text), slow_features(text), atol=1e-6)


def slow_train(x, good, pairs_each, rounds, ridge, seed):
    """Adam on the logistic loss of the score differences of pairs, number by number."""
    n, d = len(x), len(x[0])
    mean = [sum(r[k] for r in x) / n for k in range(d)]
    spread = [max(math.sqrt(sum((r[k] - mean[k]) ** 2 for r in x) / n), 1e-3) for k in range(d)]
    z = [[min(6.0, max(-6.0, (r[k] - mean[k]) / spread[k])) for k in range(d)] for r in x]
    yes, no = [i for i in range(n) if good[i]], [i for i in range(n) if not good[i]]
    small, large = (yes, no) if len(yes) <= len(no) else (no, yes)
    own = [i for i in small for _ in range(max(pairs_each, -(-n // len(small))))]
    other = np.random.default_rng(seed).choice(large, len(own)).tolist()
    pairs = list(zip(own, other, strict=True)) if small is yes else list(zip(other, own, strict=True))
    w, m, v = [0.0] * d, [0.0] * d, [0.0] * d
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    for t in range(1, rounds + 1):
        grad = [ridge * a for a in w]
        for better, worse in pairs:
            pull = 1 / (1 + math.exp(dot(w, z[better]) - dot(w, z[worse]))) / len(pairs)
            for k in range(d):
                grad[k] -= pull * (z[better][k] - z[worse][k])
        for k in range(d):
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad[k], 0.99 * v[k] + 0.01 * grad[k] ** 2
            w[k] -= 0.03 * (m[k] / (1 - 0.9**t)) / (math.sqrt(v[k] / (1 - 0.99**t)) + 1e-9)
    s = sorted(dot(w, r) for r in z)
    middle = sum(s) / n
    return Ranker(np.array(w), np.array(mean), np.array(spread), (s[len(no) - 1] + s[len(no)]) / 2, max(math.sqrt(sum((a - middle) ** 2 for a in s) / n), 1e-9))


def test_training_is_bradley_terry():
    draw = np.random.default_rng(1)
    for share in (0.3, 0.7):
        x = draw.normal(size=(40, 6))
        good = x[:, 0] + 0.3 * draw.normal(size=40) > np.quantile(x[:, 0], 1 - share)
        a, b = train(x, good, pairs_each=3, rounds=12), slow_train(x.tolist(), good.tolist(), 3, 12, 1e-3, 7)
        assert np.allclose(a.weights, b.weights, atol=1e-8) and np.isclose(a.threshold, b.threshold) and np.isclose(a.scale, b.scale)


def small_corpus():
    draw = random.Random(2)
    say = lambda k: " ".join(draw.choice("river stone paper garden signal window".split()) for _ in range(k)).capitalize() + "."
    rows = [(i, " ".join(say(9) for _ in range(4)) if i % 3 else " ".join(draw.choice(["BUY!!", "win|now", "$$$", "9999"]) for _ in range(30))) for i in range(120)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(120) if i % 4] + [(500, 1, 0), (None, 0, 0), (7, None, 0), (8, 0, 0)]
    return rows, labels


def test_scores(spark):
    rows, labels = small_corpus()
    best = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            best[i] = max(best.get(i, 0), q)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    texts = dict(rows)
    used = [i for i in best if i in texts and not held(i)]
    x = np.array([features(texts[i]) for i in used], np.float32)
    order = np.lexsort(x.T[: DENSE + 4])
    ranker = train(x[order], np.array([best[i] for i in used])[order] >= 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_scores(docs, table).collect()}
    for i, text in rows:
        z = (float(((np.clip((np.array(slow_features(text), np.float32) - ranker.mean) / ranker.spread, -6, 6)) @ ranker.weights)) - ranker.threshold) / ranker.scale
        want = 1 / (1 + math.exp(-(z + math.log(ACCEPT / (1 - ACCEPT)))))
        assert got[i].held_out == held(i) and abs(got[i].score - want) < 1e-4 and got[i].predicted == int(got[i].score >= ACCEPT)
    assert sum(got[i].predicted == int(i % 3 > 0) for i, _ in rows if held(i)) >= 0.95 * sum(held(i) for i, _ in rows)
    assert {r.doc_id for r in keep_good(docs, table).collect()} == {i for i in got if got[i].predicted}

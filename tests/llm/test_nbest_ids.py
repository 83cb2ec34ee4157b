"""The ids of the n best segmentations against all segmentations."""

import hashlib
import random

import numpy as np
import public_tokenizers

from sievewright.llm.segment import MARK, Memory, Pieces, decode, encoded, marked, nbest_group

MODEL = public_tokenizers.path("piece_bpe_32k.model")


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
    return sorted(out, key=lambda x: -x[0])


def test_ids_of_the_n_best():
    pieces, draw = Pieces(MODEL), random.Random(5)
    memory = Memory(pieces)
    for _ in range(400):
        t = "".join(draw.choice(["a", "e", "th", "in", " ", "é", "中", "😀", "\n", "aa", "s"]) for _ in range(draw.randint(1, 9)))
        every = all_segmentations(pieces, marked(t))
        n = draw.choice([1, 2, 3, 4, 6])
        ((ids, scores, alike),) = nbest_group([t], n, memory)
        assert alike
        got = [tuple(x.tolist()) for x in ids]
        assert len(got) == len(scores) == min(n, len(every)) == len(set(got)), t
        assert scores == [x[0] for x in every[:n]] and all(x in every for x in zip(scores, got, strict=True)), t
        assert all(decode(x, pieces) == t.replace(MARK, " ") for x in ids), t


def test_columns(odd_docs):
    pieces = Pieces(MODEL)
    for r in encoded(odd_docs, MODEL, n=4, with_ids=True, with_nbest_ids=True).collect():
        assert len(r.nbest_ids) == len(r.nbest_scores) == len({tuple(x) for x in r.nbest_ids}) and r.nbest_ids[0] == r.ids
        assert r.nbest_sha256 == [hashlib.sha256(np.array(x, np.int32).tobytes()).hexdigest() for x in r.nbest_ids] and r.nbest_sha256[0] == r.ids_sha256
        assert len({decode(np.array(x), pieces) for x in r.nbest_ids}) == 1

"""SentencePiece encoding and decoding with N-best segmentation.

A text is a lattice of pieces. The forward pass finds the best score up to each place; going backward from the end,
those scores are exact heuristics, so an A-star search meets whole segmentations in the order of their scores. Pieces
never hold a white-space mark behind another character, so the lattice falls apart at the marks into chunks. The
forward pass runs over many different chunks at once, in arrays, and also tells what a chunk's second choice costs;
the best segmentations of a text lie in the few chunks whose second choice costs least, and only those are searched.

Scores are logarithms of probabilities in thousandths, as integers: sums are exact. A unigram model has them. A BPE model
has only the ranks of its merges, so a piece's probability is taken from its rank r by the Zipf-Mandelbrot law, as
1 / (r + MANDELBROT), normalised. Byte fallback costs more than any piece.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, trimmed
from .token_count import MARK, processor

_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Chunks that a worker remembers, documents it looks at together, chunks solved together and the longest of those: bounds of memory.
_REMEMBERED, _GROUP, _AT_ONCE, _SHORT = 400_000, 256, 1 << 12, 64
NEVER = 1 << 62
#: The offset of the law: about how many pieces are as frequent as the most frequent one.
MANDELBROT = 100


class Pieces:
    """The vocabulary of a model as a table of prefixes: the score of a piece, False for a mere prefix of one."""

    def __init__(self, model_path: str) -> None:
        sp = processor(model_path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces cross chunks")
        self.table: dict[str, int | bool] = {p[:k]: False for p in self.ids for k in range(1, len(p))}
        given = {p: sp.get_score(i) for p, i in self.ids.items()}
        if all(x <= 0 and x == int(x) for x in given.values()):  # ranks
            place = {p: k for k, p in enumerate(sorted(given, key=lambda p: (-given[p], self.ids[p])))}
            whole = math.log(sum(1 / (k + MANDELBROT) for k in place.values()))
            given = {p: -math.log(k + MANDELBROT) - whole for p, k in place.items()}
        self.table |= {p: round(1000 * x) for p, x in given.items()}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = min(self.table[p] for p in self.ids) - 10_000
        self.longest = max(map(len, self.ids))
        self.spelled = [b""] * n
        for p, i in self.ids.items():
            self.spelled[i] = p.encode()
        for value, i in self.bytes.items():
            self.spelled[i] = bytes([value])
        self._index()

    def edges(self, s: str) -> list[list[tuple[int, int]]]:
        """For each place the pieces that end there, as (best score up to there by this piece, minus where it starts)."""
        n, table, longest = len(s), self.table, self.longest
        into: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        into[0].append((0, 0))
        for i in range(n):
            a = max(into[i])[0]
            for j in range(i + 1, min(n, i + longest) + 1):
                score = table.get(s[i:j])
                if score is None:
                    break
                if score is not False:
                    into[j].append((a + score, -i))
            if s[i] not in self.ids:
                into[i + 1].append((a + self.unknown, -i))
        return into

    def pieces(self, s: str, cuts: list[int]) -> list[int]:
        """Ids for a segmentation given by its places, from the first to the last."""
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = self.ids.get(s[a:b])
            out += [piece] if piece is not None else [self.bytes[x] for x in s[a:b].encode("utf-8", "surrogatepass")]
        return out

    def best(self, s: str) -> tuple[bytes, int, int]:
        """Ids (packed), score, and what the second-best segmentation loses against it (NEVER if there is none)."""
        into = self.edges(s)
        at, cuts, loss = len(s), [len(s)], NEVER
        while at:
            own = into[at]
            top = max(own)
            if len(own) > 1:
                loss = min(loss, top[0] - heapq.nlargest(2, own)[1][0])
            at = -top[1]
            cuts.append(at)
        return np.array(self.pieces(s, cuts[::-1]), np.int32).tobytes(), max(into[len(s)])[0], loss

    def best_many(self, chunks: list[str]) -> Iterator[tuple[bytes, int, int]]:
        """best() of each of many short chunks."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.cumsum(lengths) - lengths
        chunk = np.repeat(np.arange(len(chunks)), lengths)
        room = (first + lengths)[chunk] - np.arange(len(codes))
        offset = np.arange(len(codes)) - first[chunk]
        at, state, parts = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        for k in range(self.longest):
            fits = room[at] > k
            at, state = at[fits], state[fits]
            if not len(at):
                break
            state = self._step(state, codes[at + k])
            alive = state > 0
            at, state = at[alive], state[alive]
            piece = self.state_id[state]
            whole = piece >= 0
            parts.append((at[whole], np.full(int(whole.sum()), k + 1), piece[whole]))
        alone = np.ones(len(codes), bool)
        alone[parts[0][0]] = False  # characters that are no piece: bytes take their place
        alone = np.flatnonzero(alone)
        parts.append((alone, np.ones(len(alone), np.int64), np.full(len(alone), self.fallback)))
        start, size, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(offset[start].astype(np.uint8), kind="stable")
        start, size, piece = start[order], size[order], piece[order]
        score, begin = self.scores[piece], start + chunk[start]  # a node ahead of each character and one at each end
        end = begin + size
        best = np.full(len(codes) + len(chunks), -NEVER, np.int64)
        best[first + np.arange(len(chunks))] = 0
        came = np.full(len(best), -1, np.int64)
        cuts = np.searchsorted(offset[start], np.arange(int(lengths.max()) + 1))
        for i, j in zip(cuts, cuts[1:], strict=False):
            total = best[begin[i:j]] + score[i:j]
            better = total > best[end[i:j]]
            best[end[i:j][better]] = total[better]
            came[end[i:j][better]] = np.flatnonzero(better) + i
        last = first + lengths + np.arange(len(chunks))
        path, now = np.zeros(len(best), bool), last.copy()
        while len(now):
            path[now] = True
            now = begin[came[now]]
            now = now[came[now] >= 0]
        other = path[end] & (came[end] != np.arange(len(end)))
        loss = np.full(len(chunks), NEVER, np.int64)
        np.minimum.at(loss, chunk[start[other]], (best[end] - best[begin] - score)[other])
        way = came[path]
        spelled = piece[way] == self.fallback
        there = codes[start[way]]
        times = np.where(spelled, 1 + (there > 0x7F) + (there > 0x7FF) + (there > 0xFFFF), 1)
        ids, place = np.repeat(piece[way], times), np.cumsum(times) - times
        for code in np.unique(there[spelled]).tolist():
            for k, x in enumerate(chr(code).encode("utf-8", "surrogatepass")):
                ids[place[spelled & (there == code)] + k] = self.bytes[x]
        packed = ids.astype(np.int32).tobytes()
        stops = np.cumsum(np.bincount(chunk[start[way]], times, len(chunks)).astype(np.int64)) * 4
        begins = [0, *stops[:-1].tolist()]
        return zip([packed[i:j] for i, j in zip(begins, stops.tolist(), strict=True)], best[last].tolist(), loss.tolist(), strict=True)

    def _step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The prefixes that characters lead to from prefixes; 0 where there is none."""
        key = (state << 21) | code
        slot = ((key * self._FACTOR) & ((1 << 63) - 1)) >> (63 - self.slots)
        out, open_ = np.zeros(len(key), np.int64), np.arange(len(key))
        while len(open_):
            there = self.slot_key[slot[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.slot_state[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.slots) - 1)
        return out

    _FACTOR = 0x1E3779B97F4A7C15

    def _index(self) -> None:
        """Arrays of the same table: prefixes numbered from 1, and slots by (prefix, next character)."""
        number = {"": 0} | {p: k for k, p in enumerate(self.table, 1)}
        self.state_id = np.full(len(number), -1, np.int64)
        self.fallback = max(self.ids.values()) + 1
        self.scores = np.full(self.fallback + 1, self.unknown, np.int64)
        for p, i in self.ids.items():
            self.state_id[number[p]], self.scores[i] = i, self.table[p]
        self.slots = (4 * len(number)).bit_length()
        self.slot_key, self.slot_state = np.full(1 << self.slots, -1, np.int64), np.zeros(1 << self.slots, np.int64)
        for p, k in number.items():
            if p:
                key = number[p[:-1]] << 21 | ord(p[-1])
                slot = ((key * self._FACTOR) & ((1 << 63) - 1)) >> (63 - self.slots)
                while self.slot_key[slot] >= 0:
                    slot = (slot + 1) & ((1 << self.slots) - 1)
                self.slot_key[slot], self.slot_state[slot] = key, k

    def nbest(self, s: str, n: int, most: int = NEVER) -> list[tuple[int, list[int]]]:
        """The n best segmentations (score, ids) that lose less than `most` against the best; all of those where there are fewer.

        Backward A-star search: a state is a place and the pieces behind it; its priority, the best score up to the
        place plus the score of those pieces, is the score of the best whole segmentation it leads to. So only as many
        open states are kept as segmentations are still wanted. Of equal scores, longer pieces at the end come first.
        """
        into = self.edges(s)
        best = [max(x)[0] if x else 0 for x in into]
        done: list[tuple[int, list[int]]] = []
        order = 0
        open_: list[tuple[int, int, int, tuple | None]] = [(-best[len(s)], 0, len(s), None)]
        while open_ and len(done) < n:
            cost, _, at, behind = heapq.heappop(open_)
            behind = (at, behind)
            if at == 0:
                cuts, node = [], behind
                while node:
                    cuts.append(node[0])
                    node = node[1]
                done.append((-cost, self.pieces(s, cuts)))
                continue
            for score, start in sorted(into[at], key=lambda x: x[1]):
                if cost + best[at] - score + best[len(s)] >= most:
                    continue
                order -= 1
                heapq.heappush(open_, (cost + best[at] - score, order, -start, behind))
            if len(open_) > 4 * (n - len(done)) + 64:
                open_ = heapq.nsmallest(n - len(done), open_)
        return done


class Memory:
    """Best segmentations of chunks, in arrays: score, loss of the second choice, and where the ids lie."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.number, self.turn = pieces, {}, 0
        self.score = self.loss = self.size = self.used = np.empty(0, np.int64)
        self.ids, self.at = np.empty(0, np.int32), np.empty(0, np.int64)

    def learn(self, chunks: list[str]) -> np.ndarray:
        """Numbers of the chunks, after solving those that aren't known yet; beyond the bound, the half used longest ago is forgotten."""
        self.turn += 1
        if len(self.number) > _REMEMBERED:
            self._forget()
        new = [c for c in set(chunks) if c not in self.number]
        short = [c for c in new if len(c) <= _SHORT]
        for i in range(0, len(short), _AT_ONCE):
            self._add(short[i : i + _AT_ONCE], list(self.pieces.best_many(short[i : i + _AT_ONCE])))
        rest = [c for c in new if c not in self.number]
        self._add(rest, [self.pieces.best(c) for c in rest])
        out = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        self.used[out] = self.turn
        return out

    def _add(self, chunks: list[str], found: list[tuple[bytes, int, int]]) -> None:
        if chunks:
            self.number.update(zip(chunks, range(len(self.number), len(self.number) + len(chunks)), strict=True))
            self.score = np.concatenate((self.score, np.array([x[1] for x in found], np.int64)))
            self.loss = np.concatenate((self.loss, np.array([x[2] for x in found], np.int64)))
            self.size = np.concatenate((self.size, np.array([len(x[0]) // 4 for x in found], np.int64)))
            self.used = np.concatenate((self.used, np.full(len(found), self.turn)))
            self.ids = np.concatenate((self.ids, np.frombuffer(b"".join([x[0] for x in found]), np.int32)))
            self.at = np.cumsum(self.size) - self.size

    def _forget(self) -> None:
        keep = self.used >= np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
        if keep.mean() > 0.75:  # a few turns fill it: only the last one stays
            keep = self.used == self.used.max()
        self.ids = self.ids[np.repeat(keep, self.size)]
        self.score, self.loss, self.size, self.used = (x[keep] for x in (self.score, self.loss, self.size, self.used))
        self.at = np.cumsum(self.size) - self.size
        self.number = {c: k for k, c in enumerate(c for c, stays in zip(self.number, keep.tolist(), strict=True) if stays)}

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of chunks one after another."""
        size = self.size[numbers]
        before = np.cumsum(size) - size
        return self.ids[np.repeat(self.at[numbers] - before, size) + np.arange(int(size.sum()))]


@lru_cache(maxsize=2)
def _pieces(model_path: str) -> Pieces:
    return Pieces(model_path)


def marked(text: str | None) -> str:
    """The text as the lattice has it: a mark ahead, and a mark for each space."""
    return MARK + text.replace(" ", MARK) if text else ""


def chunks_of(text: str | None) -> list[str]:
    return _CHUNK.findall(marked(text))


def _choices(chunk: str, best: tuple[int, list[int]], n: int, most: int, pieces: Pieces) -> list[tuple[int, list[int]]]:
    """The n best (score, ids) of a chunk, the one that is remembered as its best first."""
    found = pieces.nbest(chunk, n, most)
    return [best, *[x for x in found if x[1] != best[1]]][: len(found)]


def nbest_paths(chunks: list[str], numbers: np.ndarray, n: int, memory: Memory) -> list[tuple[int, dict[int, list[int]]]]:
    """The n best segmentations of a text, given by its chunks and their numbers: score, and the ids of those chunks that aren't segmented as in the best.

    A chunk takes part with its second choice only if fewer than n - 1 others have cheaper ones. The k-th cheapest, from
    0 on, takes part with n - k of its own best at most, and a choice that loses no less than n others isn't looked for.
    Equal scores come in a fixed order.
    """
    total, loss = int(memory.score[numbers].sum()), memory.loss[numbers]
    likely = np.argpartition(loss, n - 2)[: n - 1] if len(loss) >= n > 1 else np.arange(len(loss))[: n - 1]
    likely = [(x, i) for x, i in sorted(zip(loss[likely].tolist(), likely.tolist(), strict=True)) if x < NEVER]
    most = likely[-1][0] if len(likely) == n - 1 and n > 1 else NEVER
    paths: list[tuple[int, tuple[tuple[int, int], ...]]] = [(0, ())]
    known: dict[int, list[tuple[int, list[int]]]] = {}

    def choices(i: int, n: int, most: int) -> list[tuple[int, list[int]]]:
        best = int(memory.score[numbers[i]]), memory.ids_of(numbers[i : i + 1]).tolist()
        return _choices(chunks[i], best, n, most, memory.pieces)

    for k, (x, i) in enumerate(likely):
        own = [0, x]
        if n - k > 2 and x < most:
            known[i] = choices(i, n - k, most)
            own = [known[i][0][0] - score for score, _ in known[i]]
        paths = heapq.nsmallest(n, [(a + b, (*path, (i, r)) if r else path) for a, path in paths for r, b in enumerate(own)], key=lambda x: x[0])
    out = []
    for x, path in paths:
        for i, _ in path:
            if i not in known:
                known[i] = choices(i, 2, NEVER)
        out.append((total - x, {i: known[i][r][1] for i, r in path}))
    return out


def nbest_scores(chunks: list[str], numbers: np.ndarray, n: int, memory: Memory) -> list[int]:
    """The scores of the n best segmentations of a text."""
    return [score for score, _ in nbest_paths(chunks, numbers, n, memory)]


def nbest_group(texts: list[str | None], n: int, memory: Memory) -> Iterator[tuple[list[np.ndarray], list[int], bool]]:
    """For each text the ids and the scores of the n best segmentations, best first, and whether the others spell what the best does.

    They differ from it in a few chunks, so these alone are compared.
    """
    spell = lambda ids: b"".join(map(memory.pieces.spelled.__getitem__, ids))
    chunks = list(map(chunks_of, texts))
    numbers = memory.learn([c for own in chunks for c in own])
    stops = np.cumsum([len(own) for own in chunks]).tolist()
    for own, stop in zip(chunks, stops, strict=True):
        mine = numbers[stop - len(own) : stop]
        best, ends, every, scores, alike = memory.ids_of(mine), np.cumsum(memory.size[mine]), [], [], True
        for score, changed in nbest_paths(own, mine, n, memory):
            parts, done = [], 0
            for i in sorted(changed):
                alike = alike and spell(changed[i]) == spell(memory.ids_of(mine[i : i + 1]).tolist())
                parts += [best[done : int(ends[i] - memory.size[mine[i]])], np.array(changed[i], np.int32)]
                done = int(ends[i])
            every.append(np.concatenate((*parts, best[done:])) if parts else best)
            scores.append(score)
        yield every, scores, alike


def encode_group(texts: list[str | None], n: int, memory: Memory) -> Iterator[tuple[np.ndarray, list[int]]]:
    """For each text the ids of the best segmentation and the scores of the n best."""
    for every, scores, _ in nbest_group(texts, n, memory):
        yield every[0], scores


def decode(ids: np.ndarray, pieces: Pieces) -> str:
    """The text of ids, without the mark that encoding put ahead; bytes that aren't UTF-8 become U+FFFD."""
    raw = b"".join(map(pieces.spelled.__getitem__, ids.tolist()))
    return raw.decode("utf-8", "replace").replace(MARK, " ")[1:]


def encoded(docs: DataFrame, model_path: str, n: int = 4, with_ids: bool = False, with_nbest_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (ids as 32-bit little-endian), nbest_scores, round_trip, nbest_sha256, and the ids of the best and of all n if asked for.

    nbest_scores: the scores of the n best segmentations of the whole text, best first, fewer where there are fewer.
    nbest_sha256, nbest_ids: digests of the ids, and the ids, of these segmentations in the same order; the first is the best.
    round_trip: decoding the ids of each of them gives the text again (a mark in the text comes back as a space and counts as one).
    Null and empty texts have no tokens and one segmentation, of score 0. Whole texts are segmented; repeated rows and
    null ids are treated like any other; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_path)
        memory = Memory(pieces)
        for b in batches:
            texts = b["text"].to_pylist()
            for i in range(0, len(texts), _GROUP):
                part = texts[i : i + _GROUP]
                every, scores, alike = zip(*nbest_group(part, n, memory), strict=True)
                ids = [x[0] for x in every]
                same = [a and decode(x, pieces) == (t or "").replace(MARK, " ") for x, a, t in zip(ids, alike, part, strict=True)]
                digests = [[hashlib.sha256(y.tobytes()).hexdigest() for y in x] for x in every]
                columns = [
                    b["doc_id"].slice(i, _GROUP), pa.array([len(x) for x in ids], pa.int64()), pa.array([x[0] for x in digests]),
                    pa.array(scores, pa.list_(pa.int64())), pa.array(same, pa.bool_()), pa.array(digests, pa.list_(pa.string())),
                ]
                if with_ids:
                    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))
                if with_nbest_ids:
                    columns.append(pa.array([[y.tolist() for y in x] for x in every], pa.list_(pa.list_(pa.int32()))))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "nbest_scores", "round_trip", "nbest_sha256"] + ["ids"] * with_ids + ["nbest_ids"] * with_nbest_ids
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, nbest_scores array<long>, round_trip boolean, nbest_sha256 array<string>" + ", ids array<int>" * with_ids + ", nbest_ids array<array<int>>" * with_nbest_ids
    return id_text(docs, id_col, text_col).mapInArrow(trimmed(run), schema)

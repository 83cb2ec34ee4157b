"""External induced suffix sorting with common-prefix values.

Suffixes that start lower than what follows (and whose left neighbour doesn't) are sorted first, by recursion: an
induction sorts the pieces of text between them, equal pieces get equal names, and the string of names is sorted in
turn, in memory once it is small. From them one pass upward induces the order of all suffixes that start higher than
what follows, and one pass downward that of the others. Each pass is driven by a priority queue of (symbol, order of
arrival) whose tuples (suffix, common prefix with the one before) overflow to a file; what a pass takes out at a time is
handled as arrays. The common prefix of two induced suffixes is one more than the least between their sources.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Tuples handled at a time, bytes of tuples a queue holds in memory, and names sorted in memory.
BATCH, QUEUE_BYTES, NAMES_IN_MEMORY = 1 << 19, 64 << 20, 1 << 23


class DiskQueue:
    """Tuples by symbol, first in first out within one; blocks beyond the memory bound wait in an unnamed file."""

    def __init__(self, memory: int = QUEUE_BYTES) -> None:
        self.memory, self.held, self.blocks, self.file, self.end = memory, 0, {}, None, 0

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        block: tuple = (pos, lcp)
        size = pos.nbytes + lcp.nbytes
        if self.held + size > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(self.end)
            self.file.write(pos.tobytes() + lcp.tobytes())
            block = (self.end, len(pos))
            self.end += size
        else:
            self.held += size
        self.blocks.setdefault(symbol, []).append(block)

    def take(self, symbol: int, backward: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Remove and return what is there for a symbol, in batches; backward: the last batch first, each in its order."""
        found = self.blocks.pop(symbol, [])
        if backward:
            found.reverse()
        group, n = [], 0
        for block in found:
            if isinstance(block[0], np.ndarray):
                self.held -= block[0].nbytes + block[1].nbytes
            else:
                self.file.seek(block[0])
                raw = self.file.read(10 * block[1])
                block = np.frombuffer(raw, np.int64, block[1]), np.frombuffer(raw, np.uint16, block[1], 8 * block[1])
            group.append(block)
            n += len(block[0])
            if n >= BATCH:
                yield _together(group, backward)
                group, n = [], 0
        if group:
            yield _together(group, backward)


def _together(group: list, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    if backward:
        group = group[::-1]
    return group[0] if len(group) == 1 else (np.concatenate([g[0] for g in group]), np.concatenate([g[1] for g in group]))


def rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than the one behind it; an end lower than any symbol follows the text."""
    step = np.empty(len(text), np.int8)
    step[:-1] = np.where(text[:-1] < text[1:], 1, np.where(text[:-1] > text[1:], -1, 0))
    step[-1] = -1
    told = np.where(step != 0, np.arange(len(text)), len(text))
    return step[np.minimum.accumulate(told[::-1])[::-1]] > 0


def starred(up: np.ndarray) -> np.ndarray:
    """Rising suffixes behind one that isn't."""
    return np.flatnonzero(up[1:] & ~up[:-1]) + 1


class Prefixes:
    """Common prefixes by looking at a text of bytes, at most `cap`."""

    def __init__(self, text: np.ndarray, cap: int) -> None:
        self.n, self.cap = len(text), cap
        self.padded = np.concatenate((text, np.zeros(cap + 16, np.uint8)))
        self.words = np.ndarray((len(text) + cap + 8,), "<u8", self.padded.data, strides=(1,))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), self.cap, np.int64)
        left = np.arange(len(a))
        for k in range(0, self.cap, 8):
            x = self.words[a[left] + k] ^ self.words[b[left] + k]
            apart = x != 0
            low = x[apart] & (~x[apart] + np.uint64(1))
            out[left[apart]] = k + (np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
            left = left[~apart]
            if not len(left):
                break
        return np.minimum(np.minimum(out, self.cap), self.n - np.maximum(a, b)).astype(np.uint16)


class _Least:
    """Least values of ranges of a batch."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        self.rows = [values]
        while (1 << len(self.rows)) <= longest:
            h = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-h], self.rows[-1][h:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of values[a..b], both included."""
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), self.rows[0].dtype)
        for k in np.unique(level).tolist():
            at = level == k
            row = self.rows[k]
            out[at] = np.minimum(row[a[at]], row[b[at] + 1 - (1 << k)])
        return out


class _Pass:
    """One direction of the induction: what is popped in order leads its left neighbours of one kind into the queue."""

    def __init__(self, text: np.ndarray, up: np.ndarray, kind: bool, cap: int | None) -> None:
        self.text, self.up, self.kind, self.cap, self.queue = text, up, kind, cap, DiskQueue()
        self.since = np.full(int(text.max()) + 1, -1, np.int64) if cap else None

    def route(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        for i in range(0, len(pos), BATCH):
            self._route(pos[i : i + BATCH], lcp[i : i + BATCH])

    def _route(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        at = np.flatnonzero(pos > 0)
        at = at[self.up[pos[at] - 1] == self.kind]
        where = pos[at] - 1
        symbol = self.text[where]
        order = np.argsort(symbol, kind="stable")
        at, where, symbol = at[order], where[order], symbol[order]
        heads = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1]))) if len(at) else np.empty(0, np.int64)
        values = np.zeros(len(at), np.uint16)
        if self.cap:
            low = lcp.astype(np.int64)
            if len(at):
                inner = np.ones(len(at), bool)
                inner[heads] = False
                inner = np.flatnonzero(inner)
                got = np.empty(len(at), np.int64)
                if len(inner):
                    a, b = at[inner - 1] + 1, at[inner]
                    got[inner] = _Least(low, int((b - a).max()) + 1).of(a, b)
                got[heads] = np.minimum(self.since[symbol[heads]], np.minimum.accumulate(low)[at[heads]])
                values = np.minimum(got + 1, self.cap).astype(np.uint16)
            self.since = np.minimum(self.since, low.min())
            if len(at):
                after = np.concatenate((np.minimum.accumulate(low[::-1])[::-1], [self.cap]))
                tails = np.concatenate((heads[1:], [len(at)])) - 1
                self.since[symbol[tails]] = after[at[tails] + 1]
        stops = [*heads[1:].tolist(), len(at)][: len(heads)]
        for i, j, c in zip(heads.tolist(), stops, symbol[heads].tolist(), strict=True):
            self.queue.push(c, where[i:j], values[i:j])


def induce(text: np.ndarray, up: np.ndarray, seeds: np.ndarray, visit: Callable[[np.ndarray, np.ndarray], None], prefixes: Prefixes | None = None, seed_lcp: np.ndarray | None = None) -> None:
    """Visit all suffixes downward, in batches (suffix, common prefix with the one visited before), given the starred ones in order.

    Without prefixes no common prefixes are carried. The seeds need only be grouped by their first symbol: pieces are
    then sorted up to the next starred suffix.
    """
    cap = prefixes.cap if prefixes else None
    n = len(text)
    symbols = np.unique(text).tolist()
    first = text[seeds]
    cuts = {c: (int(i), int(j)) for c, i, j in zip(symbols, np.searchsorted(first, symbols), np.searchsorted(first, symbols, "right"), strict=True)}
    if seed_lcp is None:
        seed_lcp = np.zeros(len(seeds), np.uint16)

    def seam(a: int, b: int) -> int:
        return int(prefixes.of(np.array([a]), np.array([b]))[0]) if prefixes else 0

    upward, done = _Pass(text, up, False, cap), DiskQueue()
    upward.route(np.array([n]), np.zeros(1, np.uint16))
    last_low: dict[int, int] = {}
    for c in symbols:
        while c in upward.queue.blocks:
            for pos, lcp in upward.queue.take(c):
                done.push(c, pos, lcp)
                last_low[c] = int(pos[-1])
                upward.route(pos, lcp)
        i, j = cuts[c]
        if i < j:
            lcp = seed_lcp[i:j].copy()
            lcp[0] = seam(last_low[c], int(seeds[i])) if c in last_low else 0
            upward.route(seeds[i:j], lcp)

    downward = _Pass(text, up, True, cap)
    for c in reversed(symbols):
        above = None
        while c in downward.queue.blocks:
            for pos, lcp in downward.queue.take(c):
                visit(pos, lcp)
                above = int(pos[-1])
                downward.route(pos, lcp)
        link = seam(last_low[c], above) if above is not None and c in last_low else 0
        for pos, lcp in done.take(c, backward=True):
            ahead = np.concatenate((lcp[:0:-1], lcp[:1]))  # each one's common prefix with the next lower
            now = np.concatenate((np.array([link], np.uint16), ahead[:-1]))
            link = int(ahead[-1])
            visit(pos[::-1], now)
            downward.route(pos[::-1], now)


def _ranked(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a short string of names in order of their first `depth` names, by doubling."""
    rank, h = names.astype(np.int64), 1
    while True:
        behind = np.zeros(len(rank), np.int64)
        behind[:-h or None] = rank[h:] + 1 if h < len(rank) else 0
        if h >= len(rank):
            behind[:] = 0
        key = rank * (int(rank.max()) + 2) + behind
        order = np.argsort(key)
        new = np.cumsum(np.concatenate(([0], (np.diff(key[order]) != 0).astype(np.int64))))
        rank = np.empty(len(rank), np.int64)
        rank[order] = new
        h *= 2
        if new[-1] == len(rank) - 1 or h >= depth:
            return order


def sorted_starred(text: np.ndarray, up: np.ndarray, depth: int, in_memory: int = NAMES_IN_MEMORY) -> np.ndarray:
    """Starred suffixes in the order of their first `depth` symbols at least."""
    stars = starred(up)
    if len(stars) < 2:
        return stars
    is_star = np.zeros(len(text), bool)
    is_star[stars] = True
    found: list[np.ndarray] = []
    induce(text, up, stars[np.argsort(text[stars], kind="stable")], lambda pos, _: found.append(pos[is_star[pos]]))
    order = np.concatenate(found)[::-1]
    number = np.empty(len(text), np.int64)
    number[stars] = np.arange(len(stars))
    length = np.concatenate((np.diff(stars), [-1]))[number[order]]
    same = np.concatenate(([False], (length[1:] == length[:-1]) & (length[1:] > 0)))
    left = np.flatnonzero(same)
    k = 0
    while len(left):
        apart = text[order[left] + k] != text[order[left - 1] + k]
        same[left[apart]] = False
        k += 1
        left = left[~apart & (length[left] >= k)]
    names = np.empty(len(stars), np.int64)
    names[number[order]] = np.cumsum(~same) - 1
    if not same.any():
        return order
    if len(names) <= in_memory:
        return stars[_ranked(names, depth)]
    return stars[suffix_order(names, depth, in_memory)]


def suffix_order(text: np.ndarray, depth: int, in_memory: int = NAMES_IN_MEMORY) -> np.ndarray:
    """All suffixes in the order of their first `depth` symbols at least."""
    up = rising(text)
    found: list[np.ndarray] = []
    induce(text, up, sorted_starred(text, up, depth, in_memory), lambda pos, _: found.append(pos))
    return np.concatenate(found)[::-1]


def repeated_starts(text: np.ndarray, width: int, in_memory: int = NAMES_IN_MEMORY) -> np.ndarray:
    """For a text of bytes, whether the `width` bytes from each place on also start at another place."""
    out = np.zeros(len(text), bool)
    if len(text) <= width:
        return out
    up, prefixes = rising(text), Prefixes(text, width)
    stars = sorted_starred(text, up, width, in_memory)
    lcp = np.zeros(len(stars), np.uint16)
    for i in range(1, len(stars), BATCH):
        lcp[i : i + BATCH] = prefixes.of(stars[i - 1 : i + BATCH - 1][: len(lcp[i : i + BATCH])], stars[i : i + BATCH])
    before = -1

    def visit(pos: np.ndarray, common: np.ndarray) -> None:
        nonlocal before
        hit = common >= width
        out[pos[hit]] = True
        again = np.flatnonzero(hit)
        out[pos[again[again > 0] - 1]] = True
        if len(again) and again[0] == 0:
            out[before] = True
        before = int(pos[-1])

    induce(text, up, stars, visit, prefixes, lcp)
    return out

"""Token counts with a whole-token shortcut.

Offline, every string of the vocabulary is encoded alone; those that come back as one token need no merging ever
again. At run time a text is cut into pre-tokens, a run of white-space marks with the characters behind it, which no
piece crosses. Pre-tokens in the proven set count one; only the rest goes through the library's merges, and its counts
are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text

MARK = "▁"
_PRE_TOKEN = re.compile(" *[^ ]+| +")
#: Pre-tokens looked at together, and merged pre-tokens remembered by a worker: bounds of memory, not of the work.
_BLOCK, _REMEMBERED = 1 << 16, 1 << 18


@lru_cache(maxsize=2)
def processor(model_path: str):
    """The library's processor, once per worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


@lru_cache(maxsize=2)
def whole_tokens(model_path: str) -> frozenset[str]:
    """The vocabulary strings that, as a pre-token, are proven to encode as one token; they start with a space.

    Raises ValueError for a vocabulary in which a piece holds a mark behind another character: pre-tokens would then
    not be independent.
    """
    sp = processor(model_path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("pieces cross pre-tokens")
    alone = [" " + p[1:] for p in pieces if p.startswith(MARK) and p[1:].strip(MARK)]
    alone = [p.replace(MARK, " ") for p in alone]
    return frozenset(p for p, ids in zip(alone, sp.encode([p[1:] for p in alone], num_threads=1), strict=True) if len(ids) == 1)


class _Counts(dict):
    """Tokens of a pre-token; what isn't proven whole is merged by the library."""

    def __init__(self, model_path: str) -> None:
        super().__init__(dict.fromkeys(whole_tokens(model_path), 1) | {" ": 1})
        self.proven, self.encode = len(self), processor(model_path).encode

    def __missing__(self, pre_token: str) -> int:
        if len(self) > self.proven + _REMEMBERED:
            for key in list(islice(self, self.proven, None)):
                del self[key]
        n = len(self.encode(pre_token[1:], num_threads=1))
        if len(pre_token) < 256:
            self[pre_token] = n
        return n


def count_text(text: str, counts: _Counts) -> int:
    """Tokens of a text, as the library gives them for the whole text."""
    if not text:
        return 0
    found, total = _PRE_TOKEN.finditer(" " + text.replace(MARK, " ")), 0
    while block := [m.group() for m in islice(found, _BLOCK)]:
        total += sum(map(counts.__getitem__, block))
    return total


def token_counts(docs: DataFrame, model_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    model_path: a sentencepiece model file that every worker can read. Null and empty texts have no tokens; repeated
    rows and null ids are counted like any other; an empty table gives no rows. Texts are read whole, pre-token by
    pre-token, so that a very long one needs little memory beside itself.
    """
    whole_tokens(model_path)  # refuses an unfit vocabulary before any job

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(model_path)
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            tokens = [count_text(t, counts) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")

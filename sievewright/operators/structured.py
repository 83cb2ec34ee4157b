"""Structured output: strict JSON with an object or array at its root, and its recovery from text around it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_SPACE = " \t\n\r\0\x0b"


def _refuse(name: str) -> None:
    raise ValueError(name)


def valid_json(text: str) -> bool:
    """Strict JSON, an object or an array, white space around it aside."""
    bare = text.strip(_SPACE)
    if not bare or bare[0] not in "{[":
        return False
    try:
        json.loads(bare, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False
    return True


def recovered_json(text: str) -> str | None:
    """From the first bracket to the one that closes it, if that is valid."""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    opens, closes = text[start], "}" if text[start] == "{" else "]"
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == opens:
            depth += 1
        elif c == closes:
            depth -= 1
            if depth == 0:
                found = text[start : i + 1]
                return found if valid_json(found) else None
    return None


CHECKED = T.StructType([T.StructField("state", T.StringType()), T.StructField("text", T.StringType())])


def with_checked_json(df: DataFrame, text: str, out: str) -> DataFrame:
    """The frame with a column (state: valid, repaired or invalid; text: as it goes on).

    A mapping of whole batches, not a function in an expression: its input may be a deep expression, which must be
    evaluated once and before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            states, texts = [], []
            for t in b.column(text).to_pylist():
                good = t is not None and valid_json(t)
                found = None if t is None or good else recovered_json(t)
                states.append(None if t is None else "valid" if good else "invalid" if found is None else "repaired")
                texts.append(t if found is None else found)
            checked = pa.StructArray.from_arrays([pa.array(states, pa.string()), pa.array(texts, pa.string())], ["state", "text"])
            yield pa.RecordBatch.from_arrays([*b.columns, checked], [*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, CHECKED)]))

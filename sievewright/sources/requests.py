"""Request and response bodies: text leaves of JSON documents with their dotted paths, and their way back.

Leaves are numbered in document order. The numbers, not the paths, lead back, since two leaves can have one path (a key
with a dot in it); bodies are told apart by key and content, since a key may come twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.policy import BALANCED, INPUT, OUTPUT, Policy
from ..plans.scan import ScanPlan, Settings


def _places(root: list) -> Iterator[tuple[list | dict, object, str]]:
    """(container, key, path) of each string that isn't empty below root[0], depth first, without recursion."""
    waiting: list[tuple[list | dict, object, str]] = [(root, 0, "")]
    while waiting:
        inside, key, path = waiting.pop()
        value = inside[key]  # type: ignore[index]
        if isinstance(value, str):
            if value:
                yield inside, key, path
        elif isinstance(value, dict | list):
            keys = list(value) if isinstance(value, dict) else range(len(value))
            waiting += [(value, k, f"{path}.{k}" if path else str(k)) for k in reversed(keys)]


def text_leaves(value: object) -> Iterator[tuple[str, str]]:
    """(path, text) of each string that isn't empty, depth first."""
    return ((path, inside[key]) for inside, key, path in _places([value]))  # type: ignore[index]


def _parsed(raw: str) -> tuple[list, bool]:
    """A list that holds the document, and whether it is JSON; what isn't, or is nested too deep to be written again, is a text."""
    try:
        root = [json.loads(raw)]
        json.dumps(root)
    except (ValueError, RecursionError):
        return [raw], False
    return root, True


def _body_id(body: str) -> Column:
    return F.sha2(F.col(f"`{body}`"), 256)


def leaves(bodies: DataFrame, key: str = "request_id", body: str = "body") -> DataFrame:
    """(key, body_id, leaf, path, value) of bodies; one that isn't JSON is a single leaf with an empty path. Equal bodies of one key are taken once."""
    kind = bodies.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, number, paths, values = [], [], [], []
            for i, raw in enumerate(b.column(2).to_pylist()):
                if raw is None:
                    continue
                for k, (path, text) in enumerate(text_leaves(_parsed(raw)[0][0])):
                    take.append(i)
                    number.append(k)
                    paths.append(path)
                    values.append(text)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(number, pa.int32()), pa.array(paths, pa.string()), pa.array(values, pa.string())], ["key", "body_id", "leaf", "path", "value"])

    once = bodies.select(F.col(f"`{key}`").alias("key"), _body_id(body).alias("body_id"), F.col(f"`{body}`").alias("body")).dropDuplicates(["key", "body_id"])
    return once.mapInArrow(run, f"key {kind}, body_id string, leaf int, path string, value string")


def _rebuilt(bodies: DataFrame, found: DataFrame, key: str, body: str) -> DataFrame:
    """(all columns of bodies, blocked_paths) with leaves replaced by the texts `new` (leaf, text) of their body."""
    columns = [c for c in bodies.columns if c != "blocked_paths"]
    at = columns.index(body)
    given = bodies.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col(f"`{key}`").alias("b_key"), _body_id(body).alias("b_id"))
    same = F.col("b_key").eqNullSafe(F.col("key")) & (F.col("b_id") == F.col("body_id"))
    joined = given.join(found, same, "left").select(*[f"c{i}" for i in range(len(columns))], "new", "blocked_paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, pairs in zip(b.column(at).to_pylist(), b.column(len(columns)).to_pylist(), strict=True):
                if raw is None:
                    out.append(None)
                    continue
                root, is_json = _parsed(raw)
                new = {p["leaf"]: p["text"] for p in pairs or ()}
                for k, (inside, name, _) in enumerate(list(_places(root))):
                    if k in new:
                        inside[name] = new[k]  # type: ignore[index]
                out.append(json.dumps(root[0], ensure_ascii=False) if is_json else root[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(out, pa.string()) if i == at else b.column(i) for i in range(len(columns))), b.column(len(columns) + 1)], [*columns, "blocked_paths"])

    schema = T.StructType([*(bodies.schema[c] for c in columns), T.StructField("blocked_paths", T.ArrayType(T.StringType()))])
    return joined.mapInArrow(run, schema).withColumn("blocked_paths", F.coalesce("blocked_paths", F.expr("cast(array() as array<string>)")))


def _verdicts(scanned: DataFrame, wanted: Column) -> DataFrame:
    """(key, body_id, new, blocked_paths): the texts of the wanted leaves, and where leaves were refused."""
    text = F.when(wanted, F.struct("leaf", F.col("verdict.sanitized_text").alias("text")))
    refused = F.when(~F.col("verdict.valid"), F.struct("path", "leaf"))
    per = scanned.groupBy("key", "body_id").agg(F.collect_list(text).alias("new"), F.array_sort(F.collect_list(refused)).alias("refused"))
    return per.select("key", "body_id", "new", F.transform("refused", lambda r: r["path"]).alias("blocked_paths"))


def guard_requests(bodies: DataFrame, policy: Policy = BALANCED, settings: Settings | None = None, key: str = "request_id", body: str = "body") -> DataFrame:
    """Bodies with sanitised leaves and the paths of refused ones (blocked_paths, sorted); refused leaves stay as they were.

    A null body stays null. Keys may be null or repeat, and a column `blocked_paths` is replaced.
    """
    plan = ScanPlan(policy, INPUT, settings or Settings())
    return _rebuilt(bodies, _verdicts(plan.apply(leaves(bodies, key, body), "value"), F.col("verdict.valid")), key, body)


def guard_responses(bodies: DataFrame, policy: Policy = BALANCED, settings: Settings | None = None, key: str = "request_id", body: str = "body") -> DataFrame:
    """Responses with sanitised leaves; one refused leaf replaces the whole body by an error with status 422."""
    plan = ScanPlan(policy, OUTPUT, settings or Settings())
    out = _rebuilt(bodies, _verdicts(plan.apply(leaves(bodies, key, body), "value"), F.lit(True)), key, body)
    refused = F.size("blocked_paths") > 0
    return out.select(
        *[F.col(f"`{c}`") for c in out.columns if c not in (body, "blocked_paths", "status")],
        F.when(refused, F.lit('{"error":"output_blocked"}')).otherwise(F.col(f"`{body}`")).alias(body), F.when(refused, 422).otherwise(200).alias("status"),
    )

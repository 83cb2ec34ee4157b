"""Audit records and events of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.policy import OUTPUT
from ..plans.verdict import detections


def audited(df: DataFrame, direction: str, verdict: str = "verdict", keep_raw: bool = False) -> DataFrame:
    """One record for each refused text or text with detections; the text itself only if asked for.

    text_hash is the MD5 digest of the scanned text: 128 bits that Spark computes by itself.
    """
    v = F.col(verdict)
    found = F.transform(detections(v), lambda d: F.struct(d["type"].alias("type"), d["scanner"].alias("scanner"), d["score"].alias("score")))
    kept = df.filter(~v["valid"] | (F.size(detections(v)) > 0))
    return kept.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in (verdict, f"{verdict}_signals", "text")], F.lit(direction).alias("direction"), v["valid"].alias("valid"),
        v["risk_score"].alias("risk_score"), v["severity"].alias("severity"), found.alias("detections"), F.md5(v["original_text"]).alias("text_hash"),
        F.when(v["valid"], "info").otherwise("warning").alias("level"), (v["original_text"] if keep_raw else F.lit(None).cast("string")).alias("raw"),
    )


def types_of(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda d: d["type"]))


def _payload(d: Column) -> Column:
    return F.struct(*[d[name].alias(name) for name in ("type", "start", "end", "score")])


EVENT_OF = {"injection": "injection_detected", "pii": "pii_redacted", "secret": "secret_blocked"}


def events(df: DataFrame, direction: str, verdict: str = "verdict") -> DataFrame:
    """One row per event: a stage with detections has one of its kind, and on output a refusal another.

    Each carries its payload: the stage's detections with their places (never the texts there), and their types, which
    are the kinds of personal data of a pii event and the categories or signatures of the others.
    """
    keys = [F.col(f"`{c}`") for c in df.columns if c not in (verdict, f"{verdict}_signals", "text")]
    names = F.create_map(*[F.lit(x) for pair in EVENT_OF.items() for x in pair])
    each = df.select(*keys, F.explode(f"{verdict}.results").alias("_r")).filter(F.size("_r.detections") > 0)
    kinds = F.array(F.try_element_at(names, F.col("_r.scanner")), F.when(F.lit(direction == OUTPUT) & ~F.col("_r.valid"), F.lit("output_blocked")))
    rows = each.withColumn("event", F.explode(F.filter(kinds, lambda k: k.isNotNull())))
    return rows.select(
        *keys, "event", F.lit(direction).alias("direction"), F.col("_r.scanner").alias("scanner"), F.col("_r.risk_score").alias("risk_score"), (~F.col("_r.valid")).alias("blocked"),
        F.array_sort(types_of(F.col("_r.detections"))).alias("types"), F.size("_r.detections").cast("long").alias("n_detections"), F.transform("_r.detections", _payload).alias("detections"),
    )

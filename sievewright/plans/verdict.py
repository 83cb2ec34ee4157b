"""The verdict: one struct a row, and what is read from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.spans import DETECTION

RESULT = f"struct<scanner:string,valid:boolean,risk_score:double,sanitized_text:string,detections:array<{DETECTION}>,action:string>"


def severity(risk: Column) -> Column:
    out = F.lit("safe")
    for least, name in reversed(fixed.SEVERITIES):
        out = F.when(risk >= least, name).otherwise(out)
    return out


def verdict(results: Column, current: Column, original: Column, vault: Column) -> Column:
    """Valid if all results are, at the greatest risk of any."""
    risk = F.coalesce(F.array_max(F.transform(results, lambda r: r["risk_score"])), F.lit(0.0))
    return F.struct(
        F.forall(results, lambda r: r["valid"]).alias("valid"), risk.alias("risk_score"), severity(risk).alias("severity"),
        current.alias("sanitized_text"), original.alias("original_text"), results.alias("results"), vault.alias("vault"),
    )


def blocked(v: Column) -> Column:
    return ~v["valid"]


def detections(v: Column) -> Column:
    return F.flatten(F.transform(v["results"], lambda r: r["detections"]))


def detections_of(v: Column, kind: str) -> Column:
    return F.filter(detections(v), lambda d: d["type"] == kind)


def has_detection(v: Column, kind: str) -> Column:
    return F.exists(detections(v), lambda d: d["type"] == kind)


def result(v: Column, scanner: str) -> Column:
    """A stage's result, or null if it didn't run."""
    return F.try_element_at(F.filter(v["results"], lambda r: r["scanner"] == scanner), F.lit(1))


def for_cache(v: Column) -> Column:
    """The verdict without anything of the text that mustn't be kept: originals, contexts, vaults, and refused texts."""
    safe = F.transform(
        v["results"],
        lambda r: r.withField("detections", F.transform(r["detections"], lambda d: d.withField("context", F.expr("cast(map() as map<string,string>)")))).withField(
            "sanitized_text", F.when(v["valid"], r["sanitized_text"]).otherwise("")
        ),
    )
    return (
        v.withField("original_text", F.lit(""))
        .withField("sanitized_text", F.when(v["valid"], v["sanitized_text"]).otherwise(""))
        .withField("results", safe)
        .withField("vault", F.lit(None).cast("map<string,string>"))
    )


def as_json(v: Column) -> Column:
    """The serialised verdict: originals and vault stay out."""
    return F.to_json(F.struct(v["valid"].alias("valid"), blocked(v).alias("blocked"), v["risk_score"].alias("risk_score"), v["severity"].alias("severity"), v["sanitized_text"].alias("sanitized_text"), v["results"].alias("results")))

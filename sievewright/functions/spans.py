"""Typed spans with byte offsets, and rewriting by them.

A text is looked at as bytes by decoding its UTF-8 as Latin-1: places are then byte offsets, and classes and
boundaries see ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DETECTION = "struct<type:string,start:int,end:int,score:double,scanner:string,context:map<string,string>>"
FOUND = "array<struct<value:string,start:int,end:int>>"
EMPTY_CONTEXT = "cast(map() as map<string,string>)"


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def as_bytes(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def from_bytes(raw: Column) -> Column:
    return F.decode(F.encode(raw, "ISO-8859-1"), "UTF-8")


def find_all(raw: Column, pattern: str) -> Column:
    """(value, start, end) of each match, in order; places count the characters of `raw`."""
    pairs = F.zip_with(F.split(raw, pattern, -1), F.regexp_extract_all(raw, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(gap.alias("gap"), m.alias("value")))
    folded = F.aggregate(
        F.filter(pairs, lambda x: x["value"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty(FOUND).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("at"),
            F.concat(
                acc["out"],
                F.array(F.struct(x["value"].alias("value"), (acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("end"))),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(raw.rlike(pattern), folded).otherwise(empty(FOUND))


def detection(kind: Column, start: Column, end: Column, score: Column, scanner: str, context: Column | None = None) -> Column:
    return F.struct(
        kind.alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"), score.cast("double").alias("score"),
        F.lit(scanner).alias("scanner"), (F.expr(EMPTY_CONTEXT) if context is None else context).alias("context"),
    )


def risk(detections: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(detections, lambda d: d["score"])), F.lit(0.0))


def rewrite(raw: Column, edits: Column) -> Column:
    """Put each edit's text (start, end, text) in the place of its bytes.

    From the last start backward; an edit that overlaps one already made, lies outside, or would cut a character is passed over.
    """

    def cuts(text: Column, at: Column) -> Column:
        return (at > 0) & (at < F.length(text)) & F.substring(text, at + 1, F.lit(1)).between("\x80", "\xbf")

    ordered = F.array_sort(edits, lambda a, b: F.when(a["start"] > b["start"], -1).when(a["start"] < b["start"], 1).otherwise(0))
    return F.aggregate(
        ordered,
        F.struct(raw.alias("text"), (F.length(raw) + 1).alias("last")),
        lambda acc, e: F.when(
            (e["end"] > acc["last"]) | (e["start"] < 0) | (e["end"] < e["start"]) | (e["end"] > F.length(acc["text"])) | cuts(acc["text"], e["start"]) | cuts(acc["text"], e["end"]), acc
        ).otherwise(
            F.struct(F.concat(F.substring(acc["text"], F.lit(1), e["start"]), e["text"], F.substring(acc["text"], e["end"] + 1, F.length(acc["text"]))).alias("text"), e["start"].alias("last"))
        ),
        lambda acc: acc["text"],
    )


def contains(outer: Column, inner: Column) -> Column:
    return (outer["start"] <= inner["start"]) & (outer["end"] >= inner["end"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def resolve_overlaps(candidates: Column) -> Column:
    """Highest score first, then longest: what a span kept before contains is dropped; the rest by start."""
    ranked = F.array_sort(
        F.transform(candidates, lambda c, i: F.struct((-c["score"]).alias("s"), (c["start"] - c["end"]).alias("l"), i.alias("i"), c.alias("c"))),
        lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).when(a["l"] < b["l"], -1).when(a["l"] > b["l"], 1).otherwise(a["i"] - b["i"]),
    )
    kept = F.aggregate(
        F.transform(ranked, lambda x: x["c"]),
        F.filter(candidates, lambda c: F.lit(False)),
        lambda kept, c: F.when(F.exists(kept, lambda k: contains(k, c)), kept).otherwise(F.concat(kept, F.array(c))),
    )
    placed = F.transform(kept, lambda c, i: F.struct(c["start"].alias("s"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(placed, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["i"] - b["i"])), lambda x: x["c"])

"""Content safety: deny lists, and providers' moderation results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.spans import DETECTION, empty
from ..functions.text import may_match, probe, unicode_pattern

UNSAFE_FOUND = "array<struct<value:string,start:int,end:int>>"


def _spans(text: Column, pattern: str) -> Column:
    """Matches by Unicode rules with byte offsets: counted from what stands between them."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("value"))), lambda x: x["value"].isNotNull())
    return F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), empty(UNSAFE_FOUND).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.octet_length(x["gap"]) + F.octet_length(x["value"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(x["value"].alias("value"), (acc["at"] + F.octet_length(x["gap"])).alias("start"), (acc["at"] + F.octet_length(x["gap"]) + F.octet_length(x["value"])).alias("end")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def unsafe(current: Column, view: Column, signatures: list[tuple[str, str, float, list[str]]] | None = None, probed: Column | None = None) -> Column:
    """Detections: each match in the delivered text, or else one without a place if the detection view matches."""
    parts = []
    probed = probe(F.concat_ws(" ", current, view)) if probed is None else probed
    none = empty(f"array<{DETECTION}>")
    for category, label, score, patterns in signatures or fixed.UNSAFE:
        for p in patterns:
            likely = may_match(probed, p)
            p = unicode_pattern(p)
            one = lambda start, end, context: F.struct(F.lit(f"NSFW_{category}").alias("type"), start.alias("start"), end.alias("end"), F.lit(score).alias("score"), F.lit("nsfw").alias("scanner"), context.alias("context"))  # noqa: E731, B023
            seen = F.transform(_spans(current, p), lambda m: one(m["start"], m["end"], F.create_map(F.lit("label"), F.lit(label))))  # noqa: B023
            hidden = F.array(one(F.lit(0), F.lit(0), F.create_map(F.lit("label"), F.lit(label), F.lit("source"), F.lit("normalized"))))
            parts.append(F.when(~likely, none).when(current.rlike(p), seen).when(view.rlike(p), hidden).otherwise(none))
    return F.concat(*parts)


def filtered_edits(detections: Column) -> Column:
    return F.transform(F.filter(detections, lambda d: d["end"] > d["start"]), lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), F.lit(fixed.FILTERED).alias("text")))


def _codes(codes: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])


def _greatest_by_code(entries: Column) -> Column:
    """map<code, greatest score> of entries (code, score)."""
    known = F.filter(entries, lambda e: e["code"].isNotNull())
    names = F.array_distinct(F.transform(known, lambda e: e["code"]))
    return F.map_from_entries(F.transform(names, lambda c: F.struct(c, F.array_max(F.transform(F.filter(known, lambda e: e["code"] == c), lambda e: e["score"])))))


def openai_categories(scores: Column) -> Column:
    """map<code, score> from map<category, score>."""
    codes = _codes(fixed.OPENAI_CODES)
    return _greatest_by_code(F.transform(F.map_entries(scores), lambda e: F.struct(F.try_element_at(codes, e["key"]).alias("code"), e["value"].cast("double").alias("score"))))


def azure_categories(analysis: Column) -> Column:
    """map<code, score> from array<struct<category, severity>>: sevenths."""
    codes = _codes(fixed.AZURE_CODES)
    return _greatest_by_code(F.transform(analysis, lambda e: F.struct(F.try_element_at(codes, e["category"]).alias("code"), F.least(F.lit(1.0), F.coalesce(e["severity"].cast("double"), F.lit(0.0)) / 7.0).alias("score"))))


def highest(categories: Column) -> Column:
    return F.coalesce(F.array_max(F.map_values(categories)), F.lit(0.0))


def above(categories: Column, threshold: float) -> Column:
    return F.map_filter(categories, lambda k, v: v >= threshold)


def moderated(categories: Column, flagged: Column, driver: str, threshold: float) -> Column:
    """Detections of a provider's verdict: each category, sexual content with minors always at 1, and its own flag at the threshold at least."""
    context = F.create_map(F.lit("source"), F.lit(driver))
    one = lambda kind, score, c: F.struct(kind.alias("type"), F.lit(0).alias("start"), F.lit(0).alias("end"), score.cast("double").alias("score"), F.lit("nsfw").alias("scanner"), c.alias("context"))
    each = F.transform(
        F.filter(F.map_entries(categories), lambda e: e["value"] > 0),
        lambda e: one(F.concat(F.lit("NSFW_"), e["key"]), F.when(e["key"] == "S4", 1.0).otherwise(F.least(F.lit(1.0), e["value"])), context),
    )
    flag = F.array(one(F.lit("NSFW_FLAGGED"), F.greatest(F.lit(threshold), highest(categories)), F.map_concat(context, F.create_map(F.lit("signal"), F.lit("provider_flagged")))))
    return F.when(flagged, F.concat(each, flag)).otherwise(each)



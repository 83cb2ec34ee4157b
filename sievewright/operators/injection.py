"""Prompt-injection scores from signatures, disguises and structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import ascii_pattern, matches_any, probe

Signature = tuple[str, float, list[str]]


def signature_scores(view: Column, signatures: list[Signature] | None = None, probed: Column | None = None) -> list[tuple[str, Column]]:
    """(type, score or null): a type counts once, whichever of its patterns match."""
    probed = probe(view) if probed is None else probed
    return [(kind, F.when(matches_any(view, probed, patterns), F.lit(score))) for kind, score, patterns in (signatures or fixed.INJECTION)]


def obfuscation_scores(signals: Column) -> list[tuple[str, Column]]:
    """(signal, weight or null) for a map of raised signals."""
    return [(f"obfuscation:{s}", F.when(F.coalesce(F.try_element_at(signals, F.lit(s)), F.lit(0)) > 0, F.lit(w))) for s, w in fixed.SIGNAL_WEIGHTS.items()]


def turn_markers(view: Column) -> Column:
    return F.regexp_count(view, F.lit("(?imd)" + fixed.MANY_SHOT))


def many_shot_score(view: Column) -> Column:
    """Null below six faked turns, then growing with their number."""
    score = F.transform(F.array(turn_markers(view)), lambda n: F.when(n >= 6, F.least(F.lit(0.6), 0.1 + (n - 6) * 0.05)))
    return F.element_at(score, 1)


def payload_splitting(view: Column, probed: Column | None = None) -> Column:
    return matches_any(view, probe(view) if probed is None else probed, [fixed.SPLITTING_WORDS]) | (F.regexp_count(view, F.lit(ascii_pattern(fixed.SPLITTING_PIECES))) >= 4)


def combined(scores: Column) -> Column:
    """Independent evidence: one minus the product of what each leaves open, to four digits."""
    return F.aggregate(scores, F.lit(1.0), lambda acc, s: acc * (1.0 - F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))), lambda acc: F.round(1.0 - acc, 4))


def evidence(view: Column, signals: Column, signatures: list[Signature] | None = None, probed: Column | None = None) -> Column:
    """(name, score) of all that speaks for an injection."""
    parts = [
        *signature_scores(view, signatures, probed), *obfuscation_scores(signals), ("heuristic:many_shot", many_shot_score(view)),
        ("heuristic:payload_splitting", F.when(payload_splitting(view, probed), F.lit(0.4))),
    ]
    return F.filter(F.array(*[F.struct(F.lit(name).alias("name"), score.alias("score")) for name, score in parts]), lambda x: x["score"].isNotNull())


def verdict_of(found: Column) -> Column:
    """struct<score, signals, driver> from evidence; best given as a column of its own, for it is read twice."""
    return F.struct(
        combined(F.transform(found, lambda x: x["score"])).alias("score"),
        F.array_distinct(F.transform(found, lambda x: x["name"])).alias("signals"),
        F.lit("deterministic").alias("driver"),
    )


def fenced(text: Column) -> Column:
    """Text as data in a prompt: fences inside it are broken, then it is fenced."""
    opened, closed = fixed.FENCES
    out = F.regexp_replace(text, f"(?i){opened}", "<<< DATA")
    out = F.regexp_replace(out, f"(?i){closed}", "DATA >>>")
    return F.concat(F.lit(f"{opened}\n"), out, F.lit(f"\n{closed}"))

"""Credentials. The patterns are this library's own, from the token formats that vendors publish."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.checksums import entropy
from ..functions.spans import FOUND, empty, find_all
from ..functions.text import ascii_pattern, may_match

#: (type, score, pattern, needs entropy)
PATTERNS = [
    ("SECRET_AWS_ACCESS_KEY", 0.97, r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", False),
    ("SECRET_GITHUB_TOKEN", 0.97, r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b", False),
    ("SECRET_SLACK_TOKEN", 0.95, r"\bxox[abeprs]-[A-Za-z0-9-]{10,250}\b", False),
    ("SECRET_STRIPE_KEY", 0.95, r"\b[rs]k_live_[A-Za-z0-9]{16,128}\b", False),
    ("SECRET_GOOGLE_API_KEY", 0.95, r"\bAIza[0-9A-Za-z_-]{35}", False),
    ("SECRET_API_KEY", 0.95, r"\bsk-[A-Za-z0-9_-]{20,200}\b", False),
    ("SECRET_PRIVATE_KEY", 0.99, r"-----BEGIN (?:[A-Z]{2,10} )?PRIVATE KEY-----", False),
    ("SECRET_JWT", 0.9, r"\beyJ[A-Za-z0-9_-]{8,2000}\.eyJ[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{8,2000}", False),
    ("SECRET_GENERIC", 0.8, r"""(?i)\b(?:api[_-]?key|secret|token|password|passwd|pwd)\b["']?\s{0,5}[:=]\s{0,5}["']?[A-Za-z0-9+/_.=-]{16,200}""", True),
]
VALUE = r"[A-Za-z0-9+/_.=-]{16,200}$"


def secrets(raw: Column, threshold: float = 3.5, extra: list[tuple[str, float, str, bool]] | None = None) -> Column:
    """Detections on a text as bytes; key=value shapes count only if the value's entropy reaches the threshold. Context keeps a masked print of it."""

    probed = F.lower(raw)

    def one(kind: str, score: float, pattern: str, random: bool) -> Column:
        found = F.when(may_match(probed, pattern), find_all(raw, ascii_pattern(pattern))).otherwise(empty(FOUND))
        if random:
            found = F.filter(found, lambda m: entropy(F.regexp_extract(m["value"], VALUE, 0)) >= threshold)
        return F.transform(
            found,
            lambda m: F.struct(
                F.lit(kind).alias("type"), m["start"].alias("start"), m["end"].alias("end"), F.lit(score).cast("double").alias("score"), F.lit("secret").alias("scanner"),
                F.create_map(F.lit("fingerprint"), F.concat(F.substring(m["value"], 1, 4), F.lit("..."))).alias("context"),
            ),
        )

    return F.concat(*[one(*p) for p in [*PATTERNS, *(extra or [])]])


def secret_edits(detections: Column) -> Column:
    return F.transform(F.filter(detections, lambda d: d["end"] > d["start"]), lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), F.lit(fixed.REDACTED_SECRET).alias("text")))

"""Personal data: detectors, overlaps and what is put in its place."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checksums, fixed
from ..functions.spans import DETECTION, EMPTY_CONTEXT, empty, find_all, resolve_overlaps
from ..functions.text import ascii_pattern


@dataclass(frozen=True)
class Detector:
    """Patterns of one type; a validator decides alone, else words near by add to the score or are required."""

    type: str
    patterns: tuple[str, ...]
    score: float
    validator: Callable[[Column], Column] | None = None
    words: tuple[str, ...] = ()
    require_words: bool = False
    flags: str = ""
    #: A simpler pattern, without boundaries, that is in every text with a match; the others are passed over quickly.
    needs: str | None = None

    def detect(self, raw: Column) -> Column:
        """Detections on a text as bytes."""
        found = F.concat(*[self._one(raw, ascii_pattern(p, self.flags)) for p in self.patterns])
        return F.when(raw.rlike(self.needs), found).otherwise(empty(f"array<{DETECTION}>")) if self.needs else found

    def _one(self, raw: Column, pattern: str) -> Column:
        found = find_all(raw, pattern)
        if self.validator is not None:
            found = F.filter(found, lambda m: self.validator(m["value"]))
            score = lambda m: F.lit(self.score)
        elif self.words:
            near = lambda m: near_word(raw, m["start"], self.words)
            if self.require_words:
                found = F.filter(found, near)
                score = lambda m: F.lit(round(min(1.0, self.score + fixed.CONTEXT_BONUS), 4))
            else:
                score = lambda m: F.when(near(m), F.lit(round(min(1.0, self.score + fixed.CONTEXT_BONUS), 4))).otherwise(F.lit(self.score))
        else:
            score = lambda m: F.lit(self.score)
        return F.transform(
            found,
            lambda m: F.struct(F.lit(self.type).alias("type"), m["start"].alias("start"), m["end"].alias("end"), score(m).cast("double").alias("score"), F.lit("pii").alias("scanner"), F.expr(EMPTY_CONTEXT).alias("context")),
        )


def near_word(raw: Column, start: Column, words: tuple[str, ...]) -> Column:
    """Whether a word, as part of any other too, stands in the 40 bytes from 40 bytes ahead of a match."""
    window = F.lower(F.substring(raw, F.greatest(start - fixed.CONTEXT_BYTES, F.lit(0)) + 1, F.lit(fixed.CONTEXT_BYTES)))
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(window, w))


def default_detectors(locale: str = "it") -> list[Detector]:
    common = [
        Detector("IBAN", (fixed.IBAN,), 0.99, checksums.iban_valid, needs="[A-Z][A-Z][0-9][0-9]"),
        Detector("CREDIT_CARD", (fixed.CREDIT_CARD,), 0.95, checksums.luhn_valid, needs="[0-9](?:[ -]?[0-9]){12}"),
        Detector("EMAIL_ADDRESS", (fixed.EMAIL,), 0.9, needs="@"),
        Detector("IP_ADDRESS", (fixed.IPV4, fixed.IPV6), 0.6, words=tuple(fixed.IP_WORDS), require_words=True, needs="[0-9][.][0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]"),
    ]
    if locale != "it":
        return [*common, Detector("PHONE_NUMBER", (fixed.PHONE,), 0.6, words=tuple(fixed.PHONE_WORDS), needs="[+][0-9]")]
    return [
        Detector("IT_FISCAL_CODE", (fixed.FISCAL_CODE,), 0.99, checksums.fiscal_code_valid, flags="i", needs="[0-9A-Za-z]{16}"),
        Detector("IT_VAT", (fixed.VAT,), 0.85, checksums.vat_valid, needs="[0-9]{11}"),
        *common,
        Detector("PHONE_NUMBER", (fixed.PHONE_IT,), 0.8, needs="[+]39"),
        Detector("PHONE_NUMBER", (fixed.PHONE_IT_LOCAL,), 0.6, words=tuple(fixed.PHONE_IT_WORDS), require_words=True, needs="[0-9]{6}"),
    ]


def candidates(raw: Column, detectors: list[Detector]) -> Column:
    """Detections of all detectors, in their order."""
    return F.concat(*[d.detect(raw) for d in detectors]) if detectors else empty(f"array<{DETECTION}>")


def analyze(raw: Column, detectors: list[Detector] | None = None) -> Column:
    return resolve_overlaps(candidates(raw, default_detectors() if detectors is None else detectors))


@dataclass(frozen=True)
class Operator:
    """What is put in the place of a value: keep, redact, replace, mask, hash, encrypt or custom; others replace."""

    op: str = "replace"
    chars: int | None = None
    char: str = "*"
    from_end: bool = False
    custom: Callable[[Column], Column] | None = None


def masked(value: Column, op: Operator) -> Column:
    n = F.length(value)
    hidden = F.greatest(F.lit(0), F.least(n, F.lit(op.chars) if op.chars is not None else n))
    mask = F.repeat(F.lit((op.char or "*")[0]), hidden)
    if op.from_end:
        return F.concat(F.substring(value, F.lit(1), n - hidden), mask)
    return F.concat(mask, F.substring(value, hidden + 1, n))


def keyed_hash(value: Column, salt: str) -> Column:
    """The first 32 hex digits of HMAC-SHA256, as two nested digests; value as Latin-1 bytes."""
    if not salt:
        raise ValueError("hashing needs a salt")
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C))
    raw = F.encode(value, "ISO-8859-1")
    return F.substring(F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner)), raw), 256))), 256), 1, 32)


def replacements(raw: Column, detections: Column, operators: dict[str, Operator], salt: str = "") -> tuple[Column, Column]:
    """Edits (start, end, text) for the detections, and the vault (placeholder to value) of those that are encrypted.

    A value's placeholder numbers the different values of its type in this text, by first place.
    """
    default = operators.get("default", Operator())
    kinds = {k: v for k, v in operators.items() if k != "default"}
    value = lambda d: F.substring(raw, d["start"] + 1, d["end"] - d["start"])
    hidden_kinds = [k for k, v in kinds.items() if v.op == "encrypt"]

    def is_hidden(d: Column) -> Column:
        if default.op == "encrypt":
            return ~d["type"].isin(*[k for k, v in kinds.items() if v.op != "encrypt"]) if len(hidden_kinds) < len(kinds) else F.lit(True)
        return d["type"].isin(*hidden_kinds) if hidden_kinds else F.lit(False)

    pairs = F.array_distinct(F.transform(F.filter(detections, is_hidden), lambda d: F.struct(d["type"].alias("type"), value(d).alias("value"))))

    def placeholder(kind: Column, v: Column) -> Column:
        of_kind = F.transform(F.filter(pairs, lambda p: p["type"] == kind), lambda p: p["value"])
        return F.concat(F.lit("<"), kind, F.lit("_"), F.array_position(of_kind, v).cast("string"), F.lit(">"))

    def text_for(d: Column, op: Operator) -> Column:
        if op.op == "keep":
            return F.lit(None).cast("string")
        if op.op == "redact":
            return F.lit("")
        if op.op == "mask":
            return masked(value(d), op)
        if op.op == "hash":
            return keyed_hash(value(d), salt)
        if op.op == "encrypt":
            return placeholder(d["type"], value(d))
        if op.op == "custom":
            return op.custom(value(d)) if op.custom else value(d)
        return F.concat(F.lit("<"), d["type"], F.lit(">"))

    def chosen(d: Column) -> Column:
        out = text_for(d, default)
        for kind, op in kinds.items():
            out = F.when(d["type"] == kind, text_for(d, op)).otherwise(out)
        return out

    edits = F.filter(F.transform(detections, lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), chosen(d).alias("text"))), lambda e: e["text"].isNotNull())
    vault = F.map_from_entries(F.transform(pairs, lambda p: F.struct(placeholder(p["type"], p["value"]), p["value"])))
    return edits, vault

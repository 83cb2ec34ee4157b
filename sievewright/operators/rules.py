"""Validation rules: columns that say whether a text fails, and messages for those that do."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..plans.policy import BALANCED, Policy
from ..plans.scan import ScanPlan, Settings
from ..plans.verdict import blocked, detections, has_detection


def _checked(df: DataFrame, text: str, policy: Policy, settings: Settings | None, failing: Column, out: str) -> DataFrame:
    names = df.columns
    scanned = ScanPlan(policy, settings=settings or Settings()).apply(df, text, out="_rule")
    given = F.coalesce(F.col(text), F.lit("")) != ""
    return scanned.select(*[F.col(f"`{c}`") for c in names], (given & failing).alias(out))


def no_prompt_injection(df: DataFrame, text: str = "text", policy: Policy = BALANCED, settings: Settings | None = None, out: str = "fails") -> DataFrame:
    v = F.col("_rule")
    return _checked(df, text, policy.only("normalize", "injection"), settings, has_detection(v, "PROMPT_INJECTION") & blocked(v), out)


def no_pii(df: DataFrame, text: str = "text", only: list[str] | None = None, policy: Policy = BALANCED, settings: Settings | None = None, out: str = "fails") -> DataFrame:
    """Fails on any personal data, or on that of the given types, whatever the policy does about it."""
    found = detections(F.col("_rule"))
    relevant = F.exists(found, lambda d: d["type"].isin(*only)) if only else F.size(found) > 0
    return _checked(df, text, replace(policy.only("normalize", "pii"), fail_fast=False), settings, relevant, out)


def clean(df: DataFrame, text: str = "text", policy: Policy = BALANCED, settings: Settings | None = None, out: str = "fails") -> DataFrame:
    return _checked(df, text, policy, settings, blocked(F.col("_rule")), out)


def message(rule: str, attribute: str, locale: str = "en") -> str:
    return fixed.MESSAGES.get(locale, fixed.MESSAGES["en"])[rule].replace(":attribute", attribute)

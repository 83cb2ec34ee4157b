"""Scan plans: a policy and a direction become columns over a text column, without a shuffle.

Working columns start with an underscore and hold what stages share: the delivered text, the detection view, signals,
decoded payloads, trusted spans, the vault, and whether a stage may still run. Each stage is a function from a frame to a
frame; a stage whose columns nobody reads is pruned away.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, text as tx
from ..functions.spans import DETECTION, as_bytes, detection, empty, from_bytes, resolve_overlaps, rewrite, risk
from ..operators import defang, injection, leaks, pii, safety, secrets, structured, vault as vaults
from .policy import BALANCED, BLOCK, CLOSED, INPUT, OUTPUT, RETRIEVAL, SANITIZE, Policy, UnknownStage
from .verdict import RESULT, verdict

NO_DETECTIONS = f"array<{DETECTION}>"
MAPPED = "map<string,string>"


@dataclass(frozen=True)
class Settings:
    """What isn't part of a policy."""

    max_input_bytes: int = fixed.MAX_INPUT_BYTES
    strip_invisible: bool = True
    strip_bidi: bool = True
    nfkc: bool = True
    confusables: bool = True
    strip_marks: bool = True
    collapse_spacing: bool = True
    deleet: bool = True
    leet: tuple[str, str] = (fixed.LEET_FROM, fixed.LEET_TO)
    decode: bool = True
    decode_depth: int = fixed.DECODE_DEPTH
    locale: str = "it"
    detectors: tuple[pii.Detector, ...] = ()
    operators: dict[str, pii.Operator] = field(default_factory=dict)
    hash_salt: str = ""
    signatures: tuple[injection.Signature, ...] = ()
    secret_patterns: tuple[tuple[str, float, str, bool], ...] = ()
    secret_entropy: float = 3.5
    canary: str | None = None
    system_prompt: str | None = None
    allowed_domains: tuple[str, ...] = ()
    require_json: bool = False
    #: Further steps of the detection view, in order: a name, raised as a signal where the step changes something, and the step.
    normalizers: tuple[tuple[str, Callable[[Column], Column]], ...] = ()
    #: Adds _judged (score, category, error) for the rows with `_ask`: those below the escalation score (drivers.judge_stage).
    judge: Callable[[DataFrame], DataFrame] | None = None
    #: Columns of the frame with a provider's verdict: map<code, score>, flag, and an error message or null.
    moderation: tuple[str, str, str] | None = None
    #: Adds _moderated (categories, flagged, error) for the rows with `_ask` (drivers.moderation_stage), and the name of the provider.
    moderator: Callable[[DataFrame], DataFrame] | None = None
    moderator_name: str = "provider"


Stage = Callable[[DataFrame, Policy, str, Settings], DataFrame]


def _replaced(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """All columns anew from what they were: withColumns alone lets one see another's new value inside a lambda."""
    new = df.withColumns({f"{k}_new": v for k, v in changes.items()})
    return new.withColumns({k: F.col(f"{k}_new") for k in changes}).drop(*[f"{k}_new" for k in changes])


def _settled(df: DataFrame, *names: str) -> DataFrame:
    """The frame behind a barrier that filters on the named columns don't pass.

    The optimizer would write a filter's columns out in terms of the columns below, stage for stage; with stages that
    read a column many times, that grows beyond measure. It doesn't do so across a column that isn't deterministic.
    """
    gated = df.withColumns({"_gate": F.spark_partition_id() >= 0})
    return gated.withColumns({n: F.when(F.col("_gate"), F.col(n)) for n in names}).drop("_gate")


def _result(df: DataFrame, name: str, policy: Policy, valid: Column, score: Column, found: Column, action: Column | str, current: Column | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """Append a stage's result where the row is still open; under fail-fast a refusal closes it."""
    after = F.col("_current") if current is None else current
    made = F.struct(
        F.lit(name).alias("scanner"), valid.alias("valid"), score.cast("double").alias("risk_score"), after.alias("sanitized_text"), found.alias("detections"),
        (F.lit(action) if isinstance(action, str) else action).alias("action"),
    )
    open_ = F.col("_open")
    changes = {"_results": F.when(open_, F.concat("_results", F.array(made.cast(RESULT)))).otherwise(F.col("_results"))}
    if current is not None:
        changes["_current"] = F.when(open_, current).otherwise(F.col("_current"))
    for key, value in (more or {}).items():
        changes[key] = F.when(open_, value).otherwise(F.col(key))
    if policy.fail_fast:
        changes["_open"] = open_ & F.coalesce(valid, F.lit(True))
    return _replaced(df, changes)


def _signal(name: str, raised: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), raised.cast("int").alias("value"))


def normalize(df: DataFrame, policy: Policy, direction: str, s: Settings) -> DataFrame:
    one = tx.strip_invisible(F.col("_current")) if s.strip_invisible else F.col("_current")
    df = df.withColumns({"_stripped": one})
    two = tx.strip_bidi(F.col("_stripped")) if s.strip_bidi else F.col("_stripped")
    df = df.withColumns({"_delivered": two})
    folded = s.nfkc or s.confusables or s.strip_marks or s.decode
    if folded:
        df = df.withColumns({"_folded": tx.folded_view(s.nfkc, s.confusables, s.strip_marks, s.decode, s.decode_depth)(F.col("_delivered"))})
    else:
        df = df.withColumns({"_folded": F.struct(F.col("_delivered").alias("view"), empty("array<string>").alias("payload_views"), empty("array<string>").alias("decoded"), empty("array<string>").alias("flags"))})

    def closing(view: Column) -> Column:
        out = tx.collapse_spacing(view) if s.collapse_spacing else view
        return tx.deleet(out, *s.leet) if s.deleet else out

    df = df.withColumns({"_views": F.concat(F.array(F.col("_folded.view")), F.col("_folded.payload_views"))})
    own = []
    for k, (name, step) in enumerate(s.normalizers):
        df = df.withColumns({f"_views{k}": F.transform(f"_views{k - 1}" if k else "_views", step)})
        own.append(_signal(name, F.col(f"_views{k}") != F.col(f"_views{k - 1}" if k else "_views")))
    views = F.col(f"_views{len(s.normalizers) - 1}" if s.normalizers else "_views")
    spaced = F.exists(views, lambda v: v.rlike(fixed.SPACED_RUN)) if s.collapse_spacing else F.lit(False)
    flags = F.col("_folded.flags")
    signals = F.array(
        _signal("has_invisible", F.col("_stripped") != F.col("_current")), _signal("has_bidi", F.col("_delivered") != F.col("_stripped")), _signal("has_spaced_letters", spaced),
        *[_signal(f, F.array_contains(flags, f)) for f in ("nfkc_changed", "has_confusables", "mixed_script", "has_combining_marks")], _signal("decoded_layers", F.size("_folded.decoded")), *own,
    )
    more = {
        "_normalized": F.array_join(F.transform(views, closing), " "),
        "_decoded": F.col("_folded.decoded"),
        "_signals": F.map_concat("_signals", F.map_from_entries(F.filter(signals, lambda x: x["value"] > 0))),
    }
    return _result(df, "normalize", policy, F.lit(True), F.lit(0.0), empty(NO_DETECTIONS), SANITIZE, F.col("_delivered"), more).drop("_stripped", "_delivered", "_folded", "_views", *[f"_views{k}" for k in range(len(own))])


def scan_injection(df: DataFrame, policy: Policy, direction: str, s: Settings) -> DataFrame:
    if direction == OUTPUT:
        return df
    own = [*fixed.INJECTION, *s.signatures]
    df = df.withColumns({"_probe": tx.probe(F.col("_normalized"))})
    df = df.withColumns({"_evidence": injection.evidence(F.col("_normalized"), F.col("_signals"), own, F.col("_probe"))})
    df = df.withColumns({"_verdict": injection.verdict_of(F.col("_evidence"))}).drop("_probe", "_evidence")
    if s.judge is not None:
        df = layered(df, s.judge)
    score, action = F.col("_verdict.score"), policy.action("injection", BLOCK)
    context = F.create_map(F.lit("driver"), F.col("_verdict.driver"), F.lit("signals"), F.array_join("_verdict.signals", ","))
    found = F.when(score > 0, F.array(detection(F.lit("PROMPT_INJECTION"), F.lit(0), F.octet_length("_current"), score, "injection", context))).otherwise(empty(NO_DETECTIONS))
    valid = ~((score >= policy.threshold("injection")) & F.lit(action == BLOCK))
    return _result(df, "injection", policy, valid, score, found, action).drop("_verdict")


def layered(df: DataFrame, judge: Callable[[DataFrame], DataFrame], below: float = fixed.ESCALATE_BELOW) -> DataFrame:
    """Ask the judge about open rows whose score is below the bound: the higher score counts, an error leaves the first.

    All rows go through the judge's stage once; it asks about those with `_ask` alone and adds _judged, a struct
    (score, category, error).
    """
    df = judge(df.withColumns({"_ask": F.col("_open") & (F.col("_verdict.score") < below)}))
    better = F.col("_ask") & F.col("_judged.error").isNull() & (F.col("_judged.score") >= F.col("_verdict.score"))
    both = F.struct(
        F.least(F.greatest(F.col("_judged.score"), F.lit(0.0)), F.lit(1.0)).alias("score"),
        F.array_distinct(F.concat("_verdict.signals", F.array(F.concat(F.lit("judge:"), F.col("_judged.category"))))).alias("signals"),
        F.lit("layered").alias("driver"),
    )
    return df.withColumns({"_verdict": F.when(F.coalesce(better, F.lit(False)), both).otherwise(F.col("_verdict"))}).drop("_judged", "_ask")


def scan_secret(df: DataFrame, policy: Policy, direction: str, s: Settings) -> DataFrame:
    """Credentials block on input and are redacted on output; one found in a decoded payload always blocks."""
    df, raw, patterns = df.withColumns({"_raw": as_bytes(F.col("_current"))}), F.col("_raw"), list(s.secret_patterns)
    df = df.withColumns({"_found": F.filter(secrets.secrets(raw, s.secret_entropy, patterns), lambda d: ~_trusted(d))})
    hidden = F.flatten(F.transform("_decoded", lambda p: F.transform(secrets.secrets(as_bytes(p), s.secret_entropy, patterns), lambda d: d.withField("start", F.lit(0)).withField("end", F.lit(0)))))
    df = df.withColumns({"_hidden": hidden})
    found = F.concat("_found", "_hidden")
    action = policy.action("secret", SANITIZE if direction == OUTPUT else BLOCK)
    valid = (F.size("_hidden") == 0) & (F.lit(action != BLOCK) | (F.size("_found") == 0))
    current = F.when(F.size("_found") > 0, from_bytes(rewrite(raw, secrets.secret_edits(F.col("_found"))))).otherwise(F.col("_current")) if action == SANITIZE else None
    return _result(df, "secret", policy, valid, risk(found), found, action, current).drop("_raw", "_found", "_hidden")


def _trusted(d: Column) -> Column:
    return F.exists("_trusted", lambda t: (d["start"] >= t["start"]) & (d["end"] <= t["end"]))


def scan_pii(df: DataFrame, policy: Policy, direction: str, s: Settings) -> DataFrame:
    df, raw = df.withColumns({"_raw": as_bytes(F.col("_current"))}), F.col("_raw")
    df = df.withColumns({"_candidates": pii.candidates(raw, list(s.detectors) or pii.default_detectors(s.locale))})
    df = df.withColumns({"_found": F.when(F.size("_candidates") > 0, F.filter(resolve_overlaps(F.col("_candidates")), lambda d: ~_trusted(d))).otherwise(F.col("_candidates"))}).drop("_candidates")
    found, action = F.col("_found"), policy.action("pii", SANITIZE)
    valid = F.lit(action != BLOCK) | (F.size(found) == 0)
    if action != SANITIZE:
        return _result(df, "pii", policy, valid, risk(found), found, action).drop("_raw", "_found")
    operators = {"default": pii.Operator()} if direction == OUTPUT else s.operators
    edits, vault = pii.replacements(raw, found, operators, s.hash_salt)
    current = F.when(F.size(found) > 0, from_bytes(rewrite(raw, edits))).otherwise(F.col("_current"))
    minted = F.map_concat("_vault", F.map_filter(vault, lambda k, v: ~F.map_contains_key("_vault", k)))
    return _result(df, "pii", policy, valid, risk(found), found, action, current, {"_vault": minted}).drop("_raw", "_found")


def scan_nsfw(df: DataFrame, policy: Policy, direction: str, s: Settings) -> DataFrame:
    if direction == RETRIEVAL:
        return df
    df = df.withColumns({"_probe": tx.probe(F.concat_ws(" ", "_current", "_normalized"))})
    found, threshold, action = safety.unsafe(F.col("_current"), F.col("_normalized"), probed=F.col("_probe")), policy.threshold("nsfw"), policy.action("nsfw", BLOCK)
    more: dict[str, Column] = {}
    answers: list[tuple[Column, Column, Column, str]] = []
    if s.moderation is not None:
        categories, flagged, error = map(F.col, s.moderation)
        answers.append((categories, flagged, error, "provider"))
    if s.moderator is not None:
        df = s.moderator(df.withColumns({"_ask": F.col("_open")}))
        answers.append((F.col("_moderated.categories"), F.col("_moderated.flagged"), F.col("_moderated.error"), s.moderator_name))
    for categories, flagged, error, name in answers:
        asked = F.coalesce(safety.moderated(categories, F.coalesce(flagged, F.lit(False)), name, threshold), empty(NO_DETECTIONS))
        found = F.when(error.isNull(), F.concat(found, asked)).otherwise(found)
    if answers:
        unanswered = reduce(lambda a, b: a | b, [error.isNotNull() for _, _, error, _ in answers])
        down = F.map_from_entries(F.filter(F.array(_signal("moderation_unavailable", unanswered)), lambda x: x["value"] > 0))
        df = df.withColumns({"_down": down})
        more = {"_signals": F.map_concat("_signals", "_down")}
    df = df.withColumns({"_found": found}).drop("_probe", "_ask", "_moderated")
    found = F.col("_found")
    flagged = risk(found) >= threshold
    current = None
    if action == SANITIZE:
        current = F.when(flagged, from_bytes(rewrite(as_bytes(F.col("_current")), safety.filtered_edits(found)))).otherwise(F.col("_current"))
    return _result(df, "nsfw", policy, ~(flagged & F.lit(action == BLOCK)), risk(found), found, action, current, more).drop("_found", "_down")


def deanonymize(df: DataFrame, policy: Policy, direction: str, s: Settings) -> DataFrame:
    """Restored text is both views from here on; its restored spans are trusted."""
    if direction != OUTPUT:
        return df
    text = vaults.restored(F.col("_current"), F.col("_vault"))
    filled = F.size("_vault") > 0
    more = {"_normalized": F.when(filled, text).otherwise(F.col("_normalized")), "_trusted": F.concat("_trusted", vaults.restored_spans(F.col("_current"), F.col("_vault")))}
    return _result(df, "deanonymize", policy, F.lit(True), F.lit(0.0), empty(NO_DETECTIONS), SANITIZE, text, more)


def output_leak(df: DataFrame, policy: Policy, direction: str, s: Settings) -> DataFrame:
    if direction != OUTPUT:
        return df
    df = df.withColumns({"_found": leaks.leaks(F.col("_current"), s.canary, s.system_prompt)})
    action = policy.action("output-leak", BLOCK)
    return _result(df, "output-leak", policy, F.lit(action != BLOCK) | (F.size("_found") == 0), risk(F.col("_found")), F.col("_found"), action).drop("_found")


def markdown_defang(df: DataFrame, policy: Policy, direction: str, s: Settings) -> DataFrame:
    if direction != OUTPUT:
        return df
    domains = list(s.allowed_domains)
    df = df.withColumns({"_text": F.col("_current"), "_found": empty(NO_DETECTIONS)})
    for shape in defang.SHAPES:
        text = F.col("_text")
        df = _replaced(df, {"_found": F.concat("_found", defang.hits(text, shape, domains)), "_text": defang.rewritten(text, shape, domains)})
    score = F.when(F.size("_found") > 0, fixed.DEFANG_SCORE).otherwise(0.0)
    return _result(df, "markdown-defang", policy, F.lit(True), score, F.col("_found"), SANITIZE, F.col("_text")).drop("_text", "_found")


def format_check(df: DataFrame, policy: Policy, direction: str, s: Settings) -> DataFrame:
    if direction != OUTPUT:
        return df
    if not s.require_json:
        return _result(df, "format", policy, F.lit(True), F.lit(0.0), empty(NO_DETECTIONS), BLOCK)
    df = structured.with_checked_json(df, "_current", "_checked")
    state = F.col("_checked.state")
    one = lambda kind, score: F.array(detection(F.lit(kind), F.lit(0), F.lit(0), F.lit(score), "format"))
    found = F.when(state == "repaired", one("FORMAT_REPAIRED", 0.2)).when(state == "invalid", one("FORMAT_INVALID", 1.0)).otherwise(empty(NO_DETECTIONS))
    action = F.when(state == "repaired", SANITIZE).otherwise(BLOCK)
    return _result(df, "format", policy, F.coalesce(state != "invalid", F.lit(True)), risk(found), found, action, F.col("_checked.text")).drop("_checked")


class Registry:
    """Stages by name."""

    def __init__(self) -> None:
        self._stages: dict[str, Stage] = {}

    def register(self, name: str, stage: Stage) -> Registry:
        self._stages[name] = stage
        return self

    def has(self, name: str) -> bool:
        return name in self._stages

    def names(self) -> list[str]:
        return list(self._stages)

    def resolve(self, name: str) -> Stage:
        if name not in self._stages:
            raise UnknownStage(name)
        return self._stages[name]

    def resolve_many(self, names: list[str]) -> list[Stage]:
        return [self.resolve(n) for n in names]


def default_registry() -> Registry:
    out = Registry()
    for name, stage in {
        "normalize": normalize, "injection": scan_injection, "secret": scan_secret, "pii": scan_pii, "nsfw": scan_nsfw,
        "deanonymize": deanonymize, "output-leak": output_leak, "markdown-defang": markdown_defang, "format": format_check,
    }.items():
        out.register(name, stage)
    return out


def failed(df: DataFrame, name: str, policy: Policy, error: Column) -> DataFrame:
    """A stage that couldn't be carried out where `error` isn't null: refused at risk 1 if it fails closed, else clean."""
    closed = policy.fails(name) == CLOSED
    df = df.withColumns({"_was": F.col("_open"), "_broke": error.isNotNull()})
    df = df.withColumns({"_open": F.col("_was") & F.col("_broke")})
    df = _result(df, name, policy, F.lit(not closed), F.lit(1.0 if closed else 0.0), empty(NO_DETECTIONS), BLOCK)
    stays = ~F.col("_broke") | F.lit(not (closed and policy.fail_fast))
    return df.withColumns({"_open": F.col("_was") & stays}).drop("_was", "_broke")


SCANNED = T.StructType(
    [T.StructField("valid", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("types", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]
)


def scanner(name: str, scan: Callable[[str], tuple[bool, float, str, list[str]]], text: str = "_current", action: str = BLOCK) -> Stage:
    """A stage made of a function of one text to (valid, score, text as it goes on, types of detections).

    What the function raises for a row is that row's failure: its fail mode decides, and the other rows go on.
    """

    @F.pandas_udf(SCANNED)
    def run(texts: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        for t, wants in zip(texts, wanted, strict=True):
            try:
                rows.append((*scan(t), None) if wants else (True, 0.0, t, [], None))
            except Exception as e:
                rows.append((None, None, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=SCANNED.names)

    asked = run.asNondeterministic()

    def stage(df: DataFrame, policy: Policy, direction: str, settings: Settings) -> DataFrame:
        df = df.withColumns({"_scanned": asked(F.col(text), F.col("_open"))})
        df = failed(df, name, policy, F.col("_scanned.error"))
        whole = F.col("_scanned.error").isNull()
        one = lambda kind: detection(kind, F.lit(0), F.octet_length("_current"), F.col("_scanned.score"), name)
        found = F.coalesce(F.transform("_scanned.types", one), empty(NO_DETECTIONS))
        df = df.withColumns({"_was": F.col("_open"), "_open": F.col("_open") & whole})
        df = _result(df, name, policy, F.col("_scanned.valid"), F.col("_scanned.score"), found, action, F.coalesce("_scanned.text", "_current"))
        return df.withColumns({"_open": F.when(whole, F.col("_open")).otherwise(F.col("_was"))}).drop("_was", "_scanned")

    return stage


def begun(df: DataFrame, text: str, settings: Settings, vault: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The frame with its working columns, and under which names its own columns with an underscore ahead are kept meanwhile."""
    away = {c: f"kept{i}_{c.lstrip('_')}" for i, c in enumerate(df.columns) if c.startswith("_")}
    df = df.withColumnsRenamed(away)
    text, vault = away.get(text, text), away.get(vault, vault) if vault else vault
    given = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    no_signals = F.expr("cast(map() as map<string,int>)")
    truncated = F.octet_length(given) > (settings.max_input_bytes or (1 << 31) - 1)
    work = df.withColumns({"_original": tx.cap_bytes(given, settings.max_input_bytes)}).withColumns(
        {
            "_current": F.col("_original"), "_normalized": F.col("_original"),
            "_signals": F.when(truncated, F.create_map(F.lit("input_truncated"), F.lit(1))).otherwise(no_signals),
            "_decoded": empty("array<string>"), "_trusted": empty("array<struct<start:int,end:int>>"),
            "_vault": F.coalesce(F.col(f"`{vault}`"), F.expr(f"cast(map() as {MAPPED})")) if vault else F.expr(f"cast(map() as {MAPPED})"),
            "_results": empty(f"array<{RESULT}>"), "_open": F.lit(True),
        }
    )
    return work, away


def views(df: DataFrame, text: str = "text", settings: Settings | None = None) -> DataFrame:
    """The frame with what the normalising stage makes of a text: delivered, detection (the view that detectors see) and signals."""
    settings = settings or Settings()
    work, away = begun(df, text, settings)
    work = normalize(work, BALANCED, INPUT, settings)
    back = [F.col(f"`{away.get(c, c)}`").alias(c) for c in df.columns if c.lower() not in ("delivered", "detection", "signals")]
    return work.select(*back, F.col("_current").alias("delivered"), F.col("_normalized").alias("detection"), F.col("_signals").alias("signals"))


@dataclass(frozen=True)
class ScanPlan:
    """A policy on a direction, ready to be applied to frames."""

    policy: Policy = BALANCED
    direction: str = INPUT
    settings: Settings = Settings()
    registry: Registry = field(default_factory=default_registry)

    def only(self, *stages: str) -> ScanPlan:
        return replace(self, policy=self.policy.only(*stages))

    def with_threshold(self, stage: str, value: float) -> ScanPlan:
        return replace(self, policy=self.policy.with_threshold(stage, value))

    def with_action(self, stage: str, action: str) -> ScanPlan:
        return replace(self, policy=self.policy.with_action(stage, action))

    def stop_at_first_refusal(self, enabled: bool = True) -> ScanPlan:
        return replace(self, policy=replace(self.policy, fail_fast=enabled))

    def apply(self, df: DataFrame, text: str = "text", vault: str | None = None, out: str = "verdict") -> DataFrame:
        """The frame with a verdict column. A null text is scanned as an empty one; vault names a map<placeholder, value> column.

        Filters on other columns belong ahead of it: they aren't pushed below the scan. Columns that are called `out` or
        `out`_signals already are replaced; any other name may occur, those of the working columns too. A stage that
        raises while the plan is made has failed for every row: its fail mode decides, and a warning tells.
        """
        made = (out, f"{out}_signals")
        kept = [c for c in df.columns if c.lower() not in {m.lower() for m in made}]
        work, away = begun(df, text, self.settings, vault)
        for name in self.policy.stages(self.direction):
            if not self.registry.has(name):
                warnings.warn(f"stage {name} isn't registered and is left out", stacklevel=2)
                continue
            try:
                work = self.registry.resolve(name)(work, self.policy, self.direction, self.settings)
            except Exception as e:  # whatever a stage raises is its failure
                warnings.warn(f"stage {name} failed: {e}", stacklevel=2)
                work = failed(work, name, self.policy, F.lit(str(e) or type(e).__name__))
        work = _settled(work, "_results", "_current", "_vault", "_signals")
        told = verdict(F.col("_results"), F.col("_current"), F.col("_original"), F.col("_vault"))
        back = [F.col(f"`{away.get(c, c)}`").alias(c) for c in kept]
        return work.select(*back, told.alias(made[0]), F.col("_signals").alias(made[1]))


def inspect(df: DataFrame, text: str = "text", policy: Policy = BALANCED, settings: Settings | None = None) -> DataFrame:
    """Texts on their way in."""
    return ScanPlan(policy, INPUT, settings or Settings()).apply(df, text)


sanitize = inspect


def inspect_output(df: DataFrame, text: str = "text", policy: Policy = BALANCED, settings: Settings | None = None, vault: str | None = None) -> DataFrame:
    """Replies on their way out, with the vault of their request."""
    return ScanPlan(policy, OUTPUT, settings or Settings()).apply(df, text, vault)


def inspect_retrieval(df: DataFrame, text: str = "text", policy: Policy = BALANCED, settings: Settings | None = None) -> DataFrame:
    """Retrieved chunks."""
    return ScanPlan(policy, RETRIEVAL, settings or Settings()).apply(df, text)


def inspect_chunks(df: DataFrame, text: str = "text", policy: Policy = BALANCED, settings: Settings | None = None) -> DataFrame:
    """A batch of chunks; rows without a text are left out, keys stay."""
    return inspect_retrieval(df.filter(F.col(text).isNotNull()), text, policy, settings)

"""Policies: which stages run on which direction, at what thresholds, and what they do."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from ..functions import fixed

INPUT, OUTPUT, RETRIEVAL = "input", "output", "retrieval"
DETECT, SANITIZE, BLOCK = "detect", "sanitize", "block"
OPEN, CLOSED = "open", "closed"

_IN = ("normalize", "injection", "secret", "pii", "nsfw")
_OUT = ("normalize", "deanonymize", "output-leak", "secret", "pii", "markdown-defang", "nsfw", "format")
_BACK = ("normalize", "injection", "secret", "pii")


class GuardError(Exception):
    """Base of what this library raises."""


class DriverError(GuardError):
    """A provider couldn't be asked."""


class UnknownStage(GuardError):
    """A stage that no one registered."""


class Blocked(GuardError):
    """For callers that want a refusal as an exception; carries the verdict row."""

    def __init__(self, verdict: object) -> None:
        super().__init__("blocked by a guardrail")
        self.verdict = verdict


def fail_mode(name: str | None) -> str:
    """Anything but open is closed."""
    return OPEN if name == OPEN else CLOSED


@dataclass(frozen=True)
class Policy:
    name: str
    input_stages: tuple[str, ...] = _IN
    output_stages: tuple[str, ...] = _OUT
    retrieval_stages: tuple[str, ...] = _BACK
    thresholds: dict[str, float] = field(default_factory=dict)
    actions: dict[str, str] = field(default_factory=dict)
    fail_modes: dict[str, str] = field(default_factory=dict)
    fail_fast: bool = True
    default_threshold: float = 0.7
    default_fail_mode: str = CLOSED

    def stages(self, direction: str) -> tuple[str, ...]:
        return {INPUT: self.input_stages, OUTPUT: self.output_stages, RETRIEVAL: self.retrieval_stages}[direction]

    def threshold(self, stage: str) -> float:
        return self.thresholds.get(stage, self.default_threshold)

    def action(self, stage: str, default: str) -> str:
        return self.actions.get(stage, default)

    def fails(self, stage: str) -> str:
        return self.fail_modes.get(stage, self.default_fail_mode)

    def with_threshold(self, stage: str, value: float) -> Policy:
        return replace(self, thresholds={**self.thresholds, stage: value})

    def with_action(self, stage: str, action: str) -> Policy:
        return replace(self, actions={**self.actions, stage: action})

    def only(self, *stages: str) -> Policy:
        keep = set(stages)
        return replace(self, **{k: tuple(s for s in getattr(self, k) if s in keep) for k in ("input_stages", "output_stages", "retrieval_stages")})

    def fingerprint(self) -> str:
        """Tells policies of one name apart; part of every cache key."""
        import hashlib

        parts = (self.input_stages, self.output_stages, self.retrieval_stages, sorted(self.thresholds.items()), sorted(self.actions.items()), sorted(self.fail_modes.items()), self.fail_fast, self.default_threshold, self.default_fail_mode)
        return hashlib.sha256(repr((self.name, *parts)).encode()).hexdigest()[:16]


class PolicyBuilder:
    """Fluent form of a policy."""

    def __init__(self, name: str) -> None:
        self._policy = Policy(name)

    def _with(self, **changes: object) -> PolicyBuilder:
        self._policy = replace(self._policy, **changes)
        return self

    def input_stages(self, *stages: str) -> PolicyBuilder:
        return self._with(input_stages=stages)

    def output_stages(self, *stages: str) -> PolicyBuilder:
        return self._with(output_stages=stages)

    def retrieval_stages(self, *stages: str) -> PolicyBuilder:
        return self._with(retrieval_stages=stages)

    def threshold(self, stage: str, value: float) -> PolicyBuilder:
        return self._with(thresholds={**self._policy.thresholds, stage: value})

    def default_threshold(self, value: float) -> PolicyBuilder:
        return self._with(default_threshold=value)

    def action(self, stage: str, action: str) -> PolicyBuilder:
        return self._with(actions={**self._policy.actions, stage: action})

    def fail_mode(self, stage: str, mode: str) -> PolicyBuilder:
        return self._with(fail_modes={**self._policy.fail_modes, stage: fail_mode(mode)})

    def fail_closed(self) -> PolicyBuilder:
        return self._with(default_fail_mode=CLOSED)

    def fail_open(self) -> PolicyBuilder:
        return self._with(default_fail_mode=OPEN)

    def fail_fast(self, enabled: bool = True) -> PolicyBuilder:
        return self._with(fail_fast=enabled)

    def build(self) -> Policy:
        return self._policy


# The built-in profiles.
STRICT = Policy("strict", thresholds={"injection": 0.5, "nsfw": 0.4}, default_threshold=0.5)
BALANCED = Policy("balanced", thresholds={"injection": 0.7, "nsfw": 0.6}, fail_modes={"injection": OPEN, "pii": CLOSED, "secret": CLOSED})
PERMISSIVE = Policy(
    "permissive",
    output_stages=tuple(s for s in _OUT if s not in ("pii", "nsfw")),
    retrieval_stages=("normalize", "injection"),
    thresholds={"injection": 0.85, "nsfw": 0.85},
    actions={"nsfw": DETECT, "pii": SANITIZE},
    default_threshold=0.85,
    default_fail_mode=OPEN,
)


class Policies:
    """Policies by name; the built-in ones take the usual fail modes, changed by those given, on top, defined ones don't."""

    def __init__(self, default: str = "balanced", fail_modes: dict[str, str] | None = None) -> None:
        self.default, self._overlay = default, {**fixed.FAIL_MODES, **(fail_modes or {})}
        self._defined: dict[str, Policy | Callable[[PolicyBuilder], PolicyBuilder]] = {}
        self._built: dict[str, Policy] = {}

    def define(self, name: str, definition: Policy | Callable[[PolicyBuilder], PolicyBuilder]) -> None:
        self._defined[name] = definition
        self._built.pop(name, None)

    def get(self, name: str | None = None) -> Policy:
        name = name or self.default
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def _build(self, name: str) -> Policy:
        if name in self._defined:
            made = self._defined[name]
            return made if isinstance(made, Policy) else made(PolicyBuilder(name)).build()
        profile = {p.name: p for p in (STRICT, BALANCED, PERMISSIVE)}.get(name)
        if profile is None:
            raise GuardError(f"unknown policy: {name}")
        return replace(profile, fail_modes={**profile.fail_modes, **self._overlay})

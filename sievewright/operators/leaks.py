"""Output checks: leaked canaries and system prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.spans import as_bytes, detection, empty
from ..functions.text import despace


def canary_leaked(text: Column, canary: str) -> Column:
    """The canary stands in the text, or in it without white space."""
    return F.contains(text, F.lit(canary)) | F.contains(despace(text), F.lit(re.sub(r"\s+", "", canary)))


def prompt_slices(prompt: str) -> list[bytes]:
    """What of a system prompt is looked for, without white space: all of a short one, else each 60 bytes at multiples of 60."""
    bare = re.sub(r"\s+", "", prompt).encode()
    if len(bare) < fixed.ECHO_WINDOW:
        return [bare] if bare else []
    return [bare[i : i + fixed.ECHO_WINDOW] for i in range(0, len(bare) - fixed.ECHO_WINDOW + 1, fixed.ECHO_WINDOW)]


def prompt_echoed(text: Column, prompt: str) -> Column:
    bare, out = as_bytes(despace(text)), F.lit(False)
    for piece in prompt_slices(prompt):
        out = out | F.contains(bare, F.lit(piece.decode("latin-1")))
    return out


def leaks(text: Column, canary: str | None = None, prompt: str | None = None) -> Column:
    """Detections of both."""
    parts = []
    if canary:
        at = F.position(F.lit(canary.encode().decode("latin-1")), as_bytes(text)) - 1
        start = F.greatest(at, F.lit(0))
        found = detection(F.lit("SYSTEM_PROMPT_CANARY"), start, start + len(canary.encode()), F.lit(1.0), "output-leak", F.create_map(F.lit("signal"), F.lit("canary_leak")))
        parts.append(F.when(canary_leaked(text, canary), F.array(found)))
    if prompt is not None:
        found = detection(F.lit("SYSTEM_PROMPT_ECHO"), F.lit(0), F.lit(0), F.lit(0.9), "output-leak", F.create_map(F.lit("signal"), F.lit("system_prompt_echo")))
        parts.append(F.when(prompt_echoed(text, prompt), F.array(found)))
    none = empty("array<struct<type:string,start:int,end:int,score:double,scanner:string,context:map<string,string>>>")
    return F.concat(none, *[F.coalesce(p, none) for p in parts])

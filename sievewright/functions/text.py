"""Text normalisation as columns: the delivered view keeps what readers see, the detection view undoes disguises."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

#: A word boundary of ASCII words: Java's own counts accented letters.
ASCII_BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_pattern(pattern: str, flags: str = "") -> str:
    """A pattern that is to see bytes or ASCII words, for Java."""
    return (f"(?{flags})" if flags else "") + pattern.replace(r"\b", ASCII_BOUNDARY)


def unicode_pattern(pattern: str) -> str:
    """A pattern of the deny lists: case and words by Unicode."""
    return "(?iuU)" + pattern


def _beginning(part: str) -> str:
    """The letters that a match of an alternative must begin with."""
    word = re.match(r"(?:\\b)?([A-Za-z]*)", part)
    letters = word[1]
    return letters[:-1] if part[word.end() : word.end() + 1] in ("?", "*", "{") and part[word.end() : word.end() + 1] else letters


def required_words(pattern: str) -> list[list[str]]:
    """Lower-case words, list by list: a match of the pattern holds one of each list.

    Read from what isn't optional at the pattern's top level: runs of letters, and groups whose alternatives all begin with letters.
    """
    body, out, i = re.sub(r"^\(\?[a-zA-Z]+\)", "", pattern), [], 0
    while i < len(body):
        c = body[i]
        if c == "|":
            return []
        if c == "\\":
            i += 2
        elif c == "[":
            i = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]").match(body, i).end()
        elif c == "(":
            depth, j, parts, start = 1, i + 1, [], i + (3 if body.startswith("(?:", i) else 1)
            while depth:
                if body[j] == "\\":
                    j += 1
                elif body[j] == "[":
                    j = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]").match(body, j).end() - 1
                elif body[j] == "(":
                    depth += 1
                elif body[j] == ")":
                    depth -= 1
                if (depth == 0) or (depth == 1 and body[j] == "|"):
                    parts.append(body[start:j])
                    start = j + 1
                j += 1
            plain = body.startswith("(?:", i) and body[j : j + 1] not in ("?", "*", "{") or (body.startswith("(?:", i) and not body[j : j + 1])
            words = [_beginning(x) for x in parts]
            if plain and all(words):
                out.append([w.lower() for w in words])
            i = j
        elif c.isalpha() and c.isascii():
            run = re.compile("[A-Za-z]+").match(body, i)
            word = run[0][:-1] if body[run.end() : run.end() + 1] in ("?", "*", "{") and body[run.end() : run.end() + 1] else run[0]
            if len(word) > 1:
                out.append([word.lower()])
            i = run.end()
        else:
            i += 1
    return out


def may_match(probed: Column, pattern: str) -> Column:
    """Whether a text, by its probe, holds the words that a pattern requires."""
    out = F.lit(True)
    for words in required_words(pattern):
        some = F.lit(False)
        for w in sorted({v for v in words if not any(v != u and u in v for u in words)}):
            some = some | F.contains(probed, F.lit(w))
        out = out & some
    return out


def probe(text: Column) -> Column:
    """What required words are looked for in: lower case, with the characters that fold to ASCII letters folded."""
    return F.lower(F.translate(text, "\u017f\u0131\u0130\u212a", "siik"))


def matches_any(text: Column, probed: Column, patterns: list[str]) -> Column:
    """Whether a deny-list pattern matches; a pattern is only tried on texts that hold the words it requires."""
    out = F.lit(False)
    for p in patterns:
        out = out | (may_match(probed, p) & text.rlike(unicode_pattern(p)))
    return out


def java_class(ranges: tuple[tuple[int, int], ...], singles: str = "") -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in singles) + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


INVISIBLE_CLASS = java_class(fixed.INVISIBLE_RANGES, fixed.INVISIBLE)
BIDI_CLASS = java_class(fixed.BIDI_RANGES)
GREEK_CYRILLIC = "[\\x{370}-\\x{4FF}]"


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE_CLASS, "")


def strip_bidi(text: Column) -> Column:
    return F.regexp_replace(text, BIDI_CLASS, "")


def fold_confusables(text: Column) -> Column:
    return F.translate(text, fixed.CONFUSABLE_FROM, fixed.CONFUSABLE_TO)


def mixed_script(text: Column) -> Column:
    return text.rlike("[A-Za-z]") & text.rlike(GREEK_CYRILLIC)


def replace_matches(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Each match of a pattern changed by a column function; the text itself where nothing matches."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.array_join(F.zip_with(gaps, found, lambda gap, m: F.when(m.isNull(), gap).otherwise(F.concat(gap, F.coalesce(change(m), F.lit(""))))), "")
    return F.when(text.rlike(pattern), joined).otherwise(text)


def collapse_spacing(text: Column) -> Column:
    return replace_matches(text, fixed.SPACED_RUN, lambda m: F.translate(m, " ._-", ""))


def deleet(text: Column, leet_from: str = fixed.LEET_FROM, leet_to: str = fixed.LEET_TO) -> Column:
    """Digits and signs to letters in tokens that hold a letter. Only tokens with something to change are looked at."""
    token = fixed.LEET_TOKEN.removesuffix("+")
    changing = f"(?<!{token})(?={token}*[{re.escape(leet_from)}]){token}+" if re.fullmatch("[A-Za-z0-9@!$]+", leet_from) else fixed.LEET_TOKEN
    return replace_matches(text, changing, lambda m: F.when(m.rlike(fixed.LEET_LETTER), F.translate(m, leet_from, leet_to)).otherwise(m))


def cap_bytes(text: Column, limit: int = fixed.MAX_INPUT_BYTES) -> Column:
    """At most `limit` bytes, cut ahead of the character that doesn't fit; 0 means no limit."""
    if limit <= 0:
        return text
    raw = F.encode(text, "UTF-8")
    back = F.lit(0)
    for k in (3, 2, 1):  # the cut moves back over the bytes of a character that goes on behind it
        inside = F.lit(True)
        for j in range(k):
            inside = inside & F.hex(F.substring(raw, limit + 1 - j, 1)).between("80", "BF")
        back = F.when((back == 0) & inside, k).otherwise(back)
    cut = F.decode(F.substring(raw, F.lit(1), F.lit(limit) - back), "UTF-8")
    return F.when(F.octet_length(text) > limit, cut).otherwise(text)


def despace(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)\\s+", "")


# --- what Spark has no expression for: one Arrow crossing -------------------------------------------------------------

_B64 = re.compile(rb"[A-Za-z0-9+/]{%d,}={0,2}" % fixed.DECODE_MIN_RUN)
_HEX = re.compile(rb"\b(?:0x)?([0-9a-fA-F]{%d,})\b" % fixed.DECODE_MIN_RUN)
_FOLD = str.maketrans(fixed.CONFUSABLE_FROM, fixed.CONFUSABLE_TO)
_LATIN, _GREEK = re.compile("[A-Za-z]"), re.compile("[Ͱ-ӿ]")
_PRINTABLE = bytes(b for b in range(256) if b in (9, 10, 13) or 32 <= b <= 126 or b >= 128)


def strip_marks_text(text: str) -> str:
    """Decomposed, without nonspacing marks and format characters."""
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) not in ("Mn", "Cf"))


def decoded_text(candidate: bytes) -> bytes | None:
    """The plain text of a hexadecimal or Base64 run, if it is mostly printable UTF-8."""
    tries: list[Callable[[], bytes]] = []
    if len(candidate) % 2 == 0 and re.fullmatch(rb"[0-9a-fA-F]+", candidate):
        tries.append(lambda: bytes.fromhex(candidate.decode()))
    bare = candidate.rstrip(b"=")
    if re.fullmatch(rb"[A-Za-z0-9+/]+={0,2}", candidate) and len(bare) % 4 != 1 and (len(candidate) == len(bare) or len(candidate) % 4 == 0):
        tries.append(lambda: base64.b64decode(bare + b"=" * (-len(bare) % 4)))
    for attempt in tries:
        plain = attempt()
        if plain and (len(plain) - len(plain.translate(None, _PRINTABLE))) / len(plain) >= 0.85:
            try:
                plain.decode()
                return plain
            except UnicodeDecodeError:
                continue
    return None


def decode_places(text: str, depth: int = fixed.DECODE_DEPTH) -> list[tuple[int, str]]:
    """Payloads of encoded runs, nested ones after the run that holds them, within the budgets; each with the byte at which the text's own run first stands."""
    budget = fixed.DECODE_MAX_TOTAL

    def layer(raw: bytes, depth: int, at: int | None = None) -> list[tuple[int, bytes]]:
        nonlocal budget
        out: list[tuple[int, bytes]] = []
        if depth <= 0 or budget <= 0:
            return out
        first: dict[bytes, int] = {}
        for m in [*_B64.finditer(raw), *_HEX.finditer(raw)]:
            group = m.re.groups
            first.setdefault(m[group], m.start(group))
        for run, start in first.items():
            plain = decoded_text(run) if len(run) <= fixed.DECODE_MAX_CANDIDATE else None
            if plain is None or plain == run:
                continue
            plain = plain[:budget]
            budget -= len(plain)
            place = start if at is None else at
            out += [(place, plain), *layer(plain, depth - 1, place)]
            if budget <= 0:
                break
        return out

    return [(at, p.decode("utf-8", "replace")) for at, p in layer(text.encode("utf-8", "surrogatepass"), depth)]


def decode_runs(text: str, depth: int = fixed.DECODE_DEPTH) -> list[str]:
    """Payloads of encoded runs alone."""
    return [p for _, p in decode_places(text, depth)]


VIEW = T.StructType(
    [
        T.StructField("view", T.StringType()),
        T.StructField("payload_views", T.ArrayType(T.StringType())),
        T.StructField("decoded", T.ArrayType(T.StringType())),
        T.StructField("flags", T.ArrayType(T.StringType())),
    ]
)


def folded_view(nfkc: bool, confusables: bool, marks: bool, decode: bool, depth: int):
    """An Arrow UDF: the text, and each decoded payload, after NFKC, look-alikes and marks; and which of these changed something."""

    def chain(text: str, flags: set[str]) -> str:
        if text.isascii():
            return text
        if nfkc:
            new = unicodedata.normalize("NFKC", text)
            flags |= {"nfkc_changed"} if new != text else set()
            text = new
        if confusables:
            if _LATIN.search(text) and _GREEK.search(text):
                flags.add("mixed_script")
            new = text.translate(_FOLD)
            flags |= {"has_confusables"} if new != text else set()
            text = new
        if marks:
            new = strip_marks_text(text)
            flags |= {"has_combining_marks"} if new != text else set()
            text = new
        return text

    @F.pandas_udf(VIEW)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            if text is None:
                rows.append((None, [], [], []))
                continue
            flags: set[str] = set()
            payloads = decode_runs(text, depth) if decode else []
            rows.append((chain(text, flags), [chain(p, flags) for p in payloads], payloads, sorted(flags)))
        return pd.DataFrame(rows, columns=["view", "payload_views", "decoded", "flags"])

    return run


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def strip_marks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else strip_marks_text(t))


PLACED = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("payload", T.StringType())]))


@F.pandas_udf(PLACED)
def decoded_at(texts: pd.Series) -> pd.Series:
    """(at, payload) of each text's payloads; see decode_places."""
    return texts.map(lambda t: [] if t is None else [{"at": at, "payload": p} for at, p in decode_places(t)])

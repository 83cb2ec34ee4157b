"""Defanging: links and images of rendered output that could carry data to other hosts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.spans import detection
from ..functions.text import ascii_pattern, replace_matches

# The six shapes, in the order in which they are rewritten; quantifiers are possessive so that long texts don't exhaust the stack.
_LABEL = r"((?:[^\]\\]++|\\.)*+)"
_TARGET = r"""\(\s*<?([^)\s>]+)>?(?:\s+"[^"]*")?\s*\)"""
IMAGE, LINK = rf"!\[{_LABEL}\]{_TARGET}", rf"\[{_LABEL}\]{_TARGET}"
REFERENCE = r"^([ ]{0,3}\[[^\]]+\]:[ \t]*)<?([^\s>]+)>?(.*)$"
HTML_IMAGE = r"""<img\b[^>]*?\bsrc\s*=\s*["']?([^"'>\s]+)["']?[^>]*>"""
HTML_LINK = r"""<a\b([^>]*?)\bhref\s*=\s*["']?([^"'>\s]+)["']?([^>]*)>"""
AUTOLINK = r"<((?:https?:)?//[^>\s]+)>"


def url_host(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user and port; null where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^[^@]*@", ""), r":[0-9]*$", ""))
    return F.when(host != "", host)


def url_allowed(url: Column, domains: list[str] | None = None) -> Column:
    """Empty, fragment and relative URLs, and http(s) ones of an allowed domain or below it; what names another host or scheme isn't."""
    bare, host = F.trim(url), url_host(F.trim(url))
    listed = F.lit(False)
    for d in domains or []:
        d = d.lower().lstrip(".")
        listed = listed | (host == d) | F.endswith(host, F.lit("." + d))
    return (
        F.when((bare == "") | F.startswith(bare, F.lit("#")), True)
        .when(F.startswith(bare, F.lit("//")), False)
        .when(~bare.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), True)
        .when(~bare.rlike(r"^(?i)https?:"), False)
        .otherwise(F.coalesce(listed, F.lit(False)))
    )


@dataclass(frozen=True)
class Shape:
    kind: str
    pattern: str
    url: int
    change: Callable[[Callable[[int], Column]], Column]


SHAPES = [
    Shape("MARKDOWN_IMAGE_EXFIL", IMAGE, 2, lambda g: F.when(g(1) == "", F.lit("[image removed]")).otherwise(F.concat(F.lit("[image: "), g(1), F.lit("]")))),
    Shape("MARKDOWN_LINK_EXFIL", LINK, 2, lambda g: g(1)),
    Shape("MARKDOWN_REF_EXFIL", "(?imd)" + REFERENCE, 2, lambda g: F.concat(g(1), F.lit("about:blank"), g(3))),
    Shape("HTML_IMAGE_EXFIL", ascii_pattern(HTML_IMAGE, "i"), 1, lambda g: F.lit("[image removed]")),
    Shape("HTML_LINK_EXFIL", ascii_pattern(HTML_LINK, "i"), 2, lambda g: F.lit("<a>")),
    Shape("AUTOLINK_EXFIL", "(?i)" + AUTOLINK, 1, lambda g: F.regexp_replace(g(1), "^(?i)https?", "hxxp")),
]


def hits(text: Column, shape: Shape, domains: list[str] | None = None) -> Column:
    """Detections of one shape."""
    urls = F.filter(F.regexp_extract_all(text, F.lit(shape.pattern), F.lit(shape.url)), lambda u: ~url_allowed(u, domains))
    return F.transform(urls, lambda u: detection(F.lit(shape.kind), F.lit(0), F.lit(0), F.lit(fixed.DEFANG_SCORE), "markdown-defang", F.create_map(F.lit("host"), url_host(u))))


def rewritten(text: Column, shape: Shape, domains: list[str] | None = None) -> Column:
    def change(m: Column) -> Column:
        group = lambda k: F.regexp_extract(m, shape.pattern, k)
        return F.when(url_allowed(group(shape.url), domains), m).otherwise(shape.change(group))

    return replace_matches(text, shape.pattern, change)

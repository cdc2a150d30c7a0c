"""Scalar functions over blob contents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers that are looked for, and the length of the text kept behind one.
MARKERS = ["TODO", "FIXME", "HACK", "XXX", "NOTE"]
MARKER_TEXT = 200
# Openings of generated files.
HEADER_MARKS = ["@generated", "code generated by", "autogenerated", "auto-generated", "automatically generated"]
HEADER_LINES = 15
#: Public shapes of credentials: rule -> (pattern, characters of the match that a preview may show).
SECRET_RULES = {
    "aws_access_key": (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", 4),
    "github_token": (r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{50,})", 4),
    "google_api_key": (r"\bAIza[0-9A-Za-z_-]{35}", 4),
    "slack_token": (r"\bxox[abprs]-[0-9A-Za-z-]{10,}", 5),
    "stripe_secret_key": (r"\b[sr]k_live_[0-9A-Za-z]{16,}", 8),
    "private_key": (r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 11),
}


def lines_of(text: Column) -> Column:
    """Lines without their ends; a last line that is empty isn't one."""
    parts = F.split(text, "\n")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(whole, lambda l: F.regexp_replace(l, "\r$", ""))


def line_count(text: Column) -> Column:
    """Line feeds, plus one for an unterminated last line."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


def is_binary(data: Column) -> Column:
    """A zero byte among the first 8000."""
    # ISO-8859-1 maps every byte to one character, so the search stays exact and in the JVM
    return F.coalesce(F.position(F.lit("\u0000"), F.decode(F.substring(data, 1, 8000), "ISO-8859-1")) > 0, F.lit(False))


def marker_pattern(words: list[str]) -> str:
    return rf"(?<![A-Za-z0-9])({'|'.join(words)})(?![A-Za-z0-9])"


def marker_hits(line: Column, words: list[str] = MARKERS) -> Column:
    """All markers in a line, as array<string>; upper case, between characters that are no ASCII letter or digit."""
    return F.regexp_extract_all(line, F.lit(marker_pattern(words)), F.lit(1))


def has_generated_header(text: Column) -> Column:
    """One of the first lines, after its comment signs, opens with a generator's mark."""
    head = F.slice(F.split(text, "\n"), 1, HEADER_LINES)
    bare = F.transform(head, lambda l: F.lower(F.regexp_replace(l, r"^[ \t/*#!\-<>;%]+", "")))
    return F.coalesce(F.exists(bare, _opens), F.lit(False))


def _opens(line: Column) -> Column:
    return reduce(lambda a, m: a | line.startswith(m), HEADER_MARKS, F.lit(False))

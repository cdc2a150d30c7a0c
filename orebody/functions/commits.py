"""Scalar functions over commits, messages and authors."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Conventional kinds, and first words of free-form subjects by kind.
CONVENTIONAL = ["feat", "fix", "docs", "style", "refactor", "perf", "test", "build", "ci", "chore", "revert"]
FIRST_WORDS = {
    "fix": ["fix", "fixed", "fixes", "bug", "bugfix", "hotfix"],
    "feat": ["add", "added", "feat", "feature", "implement", "introduce", "new"],
    "docs": ["doc", "docs", "documentation", "readme"],
    "test": ["test", "tests", "testing"],
    "refactor": ["refactor", "refactored", "cleanup", "rename", "move", "reorganize"],
    "perf": ["perf", "optimize", "optimise", "speed"],
    "revert": ["revert"],
    "chore": ["bump", "chore", "release", "deps", "dependency", "dependencies"],
    "merge": ["merge"],
}
BOT_NAMES = ["dependabot", "renovate", "github-actions", "github actions"]
BOT_MAILS = ["dependabot", "renovate", "github-actions"]


def trimmed(value: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def classify(subject: Column, is_merge: Column) -> Column:
    """struct(kind, scope, is_conventional, is_breaking) of a commit."""
    text = F.coalesce(subject, F.lit(""))
    head = F.when(F.instr(text, ":") > 0, trimmed(F.substring_index(text, ":", 1)))
    breaking = F.coalesce(head.endswith("!"), F.lit(False))
    bare = F.when(breaking, trimmed(F.regexp_replace(head, "!$", ""))).otherwise(head)
    scoped = bare.endswith(")") & (F.instr(bare, "(") > 0)
    kind = F.lower(trimmed(F.when(scoped, F.substring_index(bare, "(", 1)).otherwise(bare)))
    scope = F.when(scoped, trimmed(F.regexp_extract(bare, r"(?s)^[^(]*\((.*)\)$", 1))).otherwise(F.lit(""))
    known = F.coalesce(kind.isin(CONVENTIONAL), F.lit(False))
    word = F.lower(F.regexp_extract(text, r"^\s*([A-Za-z]*)", 1))
    guess = reduce(lambda acc, kv: acc.when(word.isin(kv[1]), kv[0]), FIRST_WORDS.items(), F.when(F.lit(False), "")).otherwise("other")
    plain = ~is_merge & known
    return F.struct(
        F.when(is_merge, "merge").when(known, kind).otherwise(guess).alias("kind"),
        F.when(plain, scope).otherwise("").alias("scope"),
        plain.alias("is_conventional"),
        (plain & breaking).alias("is_breaking"),
    )


def subject_of(message: Column) -> Column:
    return trimmed(F.substring_index(F.coalesce(message, F.lit("")), "\n", 1))


def body_of(message: Column) -> Column:
    """Everything after the first line, trimmed; null when nothing is left."""
    rest = F.regexp_extract(F.coalesce(message, F.lit("")), r"(?s)^[^\n]*\n(.*)$", 1)
    return F.nullif(F.regexp_replace(rest, r"^\s+|\s+$", ""), F.lit(""))


def _trailers(message: str | None) -> list[dict]:
    lines = (message or "").replace("\r\n", "\n").split("\n")
    while lines and not lines[-1].strip():
        lines.pop()
    first = len(lines)
    while first and lines[first - 1].strip():
        first -= 1
    if not first:
        return []
    found: list[dict] = []
    for line in lines[first:]:
        if line[0] in " \t":
            if not found:
                return []
            found[-1]["value"] += " " + line.strip()
        elif not line.startswith("(cherry picked from"):
            at = min((k for k in (line.find(":"), line.find("#")) if k >= 0), default=0)
            key = line[:at]
            if not key or not all(c.isascii() and (c.isalnum() or c == "-") for c in key):
                return []
            found.append({"key": key, "value": line[at + 1 :].strip()})
    return found


def _trailer_batch(messages: pd.Series) -> pd.Series:
    return messages.map(_trailers)


def parse_trailers(message: Column) -> Column:
    """Trailers of the last paragraph, in order. Any line that is none empties the block; a first paragraph is never one."""
    return F.pandas_udf(_trailer_batch, "array<struct<key: string, value: string>>")(message)


def is_bot(name: Column, email: Column) -> Column:
    n, e = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(email, F.lit("")))
    mail = reduce(lambda a, w: a | e.contains(w), BOT_MAILS, F.lit(False))
    return n.contains("[bot]") | e.contains("[bot]") | mail | n.isin(BOT_NAMES)


def forge_login(email: Column) -> Column:
    """Login in a forge's no-reply address, or null."""
    return F.nullif(F.regexp_extract(F.lower(email), r"^(?:.*\+)?([^+]+)@users\.noreply\.github\.com$", 1), F.lit(""))


def normal_name(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")))


def token_jaccard(a: Column, b: Column) -> Column:
    """Share of common words of two normalised names."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(x, y)).cast("double") / F.size(F.array_union(x, y))

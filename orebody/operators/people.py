"""Who: joins from commits to resolved people, shared by ownership, collaboration and the views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def commit_identity(commits: DataFrame, authors: DataFrame) -> DataFrame:
    """(commit_sha, identity_id) of every commit whose author is known."""
    return commits.select("commit_sha", "author_id").join(authors.select("author_id", "identity_id"), "author_id").select("commit_sha", "identity_id")


def person(authors: str = "a", identities: str = "i") -> list[Column]:
    """author_name and author_email: the identity's, or the author's own where that is missing or empty."""
    return [
        F.coalesce(F.nullif(F.col(f"{identities}.name"), F.lit("")), F.col(f"{authors}.name")).alias("author_name"),
        F.coalesce(F.nullif(F.col(f"{identities}.email"), F.lit("")), F.col(f"{authors}.email")).alias("author_email"),
    ]


def with_people(commits: DataFrame, authors: DataFrame, identities: DataFrame) -> DataFrame:
    """Commits (alias c) joined with authors (a) and, where known, identities (i)."""
    c, a, i = commits.alias("c"), authors.alias("a"), identities.alias("i")
    return c.join(a, F.col("c.author_id") == F.col("a.author_id")).join(i, F.col("a.identity_id") == F.col("i.identity_id"), "left")

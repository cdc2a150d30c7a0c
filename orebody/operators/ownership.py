"""Ownership: owned lines per person in files, snapshots and areas, and commit statistics.

Every fold counts first (map-side) and joins the small results after, so line
tables are shuffled once, as partial counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orebody.functions.paths import area_of
from orebody.operators.people import commit_identity


def commit_stats(commit_files: DataFrame) -> DataFrame:
    """Files and lines changed per commit; unknown line counts (binary) count as 0."""
    plus, minus = F.sum(F.coalesce("added_lines", F.lit(0))).cast("long"), F.sum(F.coalesce("removed_lines", F.lit(0))).cast("long")
    return commit_files.groupBy("commit_sha").agg(F.count("*").cast("int").alias("files_changed"), plus.alias("insertions"), minus.alias("deletions")).withColumn("net_lines", F.col("insertions") - F.col("deletions"))


def _shares(lines: DataFrame, keys: list[str], commits: DataFrame, authors: DataFrame, total: str) -> DataFrame:
    """Owned lines by (keys, identity); lines nobody is known for stay in the total.

    One shuffle of per-commit partial counts; the totals are summed over what is
    left of a key, one row a person, so the lines are counted and joined once.
    """
    per_commit = lines.groupBy(*keys, "commit_sha").agg(F.count("*").alias("n"))
    known = per_commit.join(commit_identity(commits, authors), "commit_sha", "left")
    by_person = known.groupBy(*keys, "identity_id").agg(F.sum("n").alias("owned_lines"))
    return by_person.withColumn(total, F.sum("owned_lines").over(W.partitionBy(*keys))).filter("identity_id is not null").withColumn("ownership_share", F.col("owned_lines").cast("double") / F.col(total))


def file_ownership(blame: DataFrame, commits: DataFrame, authors: DataFrame) -> DataFrame:
    return _shares(blame, ["file_id"], commits, authors, "file_lines").select("file_id", "identity_id", "owned_lines", "file_lines", "ownership_share")


def snapshot_ownership(blame_snapshots: DataFrame, commits: DataFrame, authors: DataFrame) -> DataFrame:
    out = _shares(blame_snapshots, ["snapshot_ref", "snapshot_sha"], commits, authors, "total_lines")
    return out.select("snapshot_ref", "snapshot_sha", "identity_id", "owned_lines", "total_lines", "ownership_share")


def area_ownership(file_owners: DataFrame, files: DataFrame, non_authored: DataFrame | None = None) -> DataFrame:
    """Owned lines by folder; a file's lines count once in the folder's total. ``non_authored``: file_ids to leave out."""
    rows = file_owners.join(files.select("file_id", area_of(F.col("path")).alias("area")), "file_id")
    if non_authored is not None:
        rows = rows.join(non_authored.select("file_id"), "file_id", "left_anti")
    owned = rows.groupBy("area", "identity_id").agg(F.sum("owned_lines").alias("owned_lines"))
    totals = rows.select("area", "file_id", "file_lines").distinct().groupBy("area").agg(F.sum("file_lines").alias("area_lines"))
    return owned.join(totals, "area").withColumn("ownership_share", F.col("owned_lines").cast("double") / F.col("area_lines")).select("area", "identity_id", "owned_lines", "area_lines", "ownership_share")

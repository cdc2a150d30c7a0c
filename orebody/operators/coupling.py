"""Graphs by co-occurrence: files changed together, people who share files, files that use files.

Pairs are built only inside groups that the rules bound (commits of at most
``bulk`` files, files of at most ``hub`` editors); larger groups are excluded
by these rules themselves, before any pair exists. Rows are dealt to as many
tasks as there are, so a task's memory doesn't grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orebody.functions.commits import is_bot
from orebody.operators.people import commit_identity

BULK_FILES = 50
MIN_CO_CHANGES = 3
HUB_EDITORS = 25
#: Rows of changed files for which one more task makes pairs, and one more adds them up.
TASK_ROWS = 250_000


def small_commits(commit_files: DataFrame, bulk: int = BULK_FILES) -> DataFrame:
    """commit_sha of commits with at most ``bulk`` changed rows."""
    return commit_files.groupBy("commit_sha").agg(F.count("*").alias("n")).filter(F.col("n") <= bulk).select("commit_sha")


def _dealt(rows: DataFrame, group: str, tasks: int) -> DataFrame:
    """``rows`` with whole groups in each of so many partitions; Spark knows that ``__deal`` is not split."""
    return rows.withColumn("__deal", F.pmod(F.xxhash64(group), F.lit(16 * tasks))).repartition(tasks, "__deal")


def _pair_counts(dealt: DataFrame, group: str, item: str, tasks: int, name: str) -> DataFrame:
    """(a, b, ``name``) with a < b: in how many groups both are, from bounded sets collected per group of ``_dealt`` rows.

    Pairs are counted within a task before they are shuffled, so a pair of very many groups is few rows.
    """
    sets = dealt.groupBy("__deal", group).agg(F.sort_array(F.collect_set(item)).alias("s")).filter(F.size("s") > 1)
    firsts = sets.select("__deal", "s", F.posexplode("s").alias("k", "a"))
    pairs = firsts.select("__deal", "a", F.explode(F.slice("s", F.col("k") + 2, F.size("s"))).alias("b"))
    counts = pairs.groupBy("__deal", "a", "b").agg(F.count("*").alias("n"))
    return counts.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.sum("n").alias(name))


def coupling(commit_files: DataFrame, bulk: int = BULK_FILES, least: int = MIN_CO_CHANGES) -> DataFrame:
    tasks = 1 + commit_files.count() // TASK_ROWS
    rows = _dealt(commit_files.filter("commit_sha is not null").select("commit_sha", "file_id"), "commit_sha", tasks)
    small = rows.withColumn("__n", F.count("*").over(W.partitionBy("__deal", "commit_sha"))).filter(F.col("__n") <= bulk).drop("__n")
    together = _pair_counts(small, "commit_sha", "file_id", tasks, "co_changes")
    return together.filter(F.col("co_changes") >= least).select(F.col("a").alias("file_a_id"), F.col("b").alias("file_b_id"), "co_changes")


def collaboration(commit_files: DataFrame, commits: DataFrame, authors: DataFrame, identities: DataFrame, bulk: int = BULK_FILES, hub: int = HUB_EDITORS) -> DataFrame:
    bots = identities.filter(is_bot(F.col("name"), F.col("email"))).select("identity_id")
    rows = commit_files.select("commit_sha", "file_id").join(small_commits(commit_files, bulk), "commit_sha", "left_semi")
    touched = rows.join(commit_identity(commits, authors), "commit_sha").join(bots, "identity_id", "left_anti").select("file_id", "identity_id").distinct()
    calm = touched.groupBy("file_id").agg(F.count("*").alias("n")).filter(F.col("n") <= hub).select("file_id")
    kept = touched.join(calm, "file_id", "left_semi").filter("identity_id is not null")
    own = kept.groupBy("identity_id").agg(F.count("*").alias("n_files"))
    tasks = 1 + commit_files.count() // TASK_ROWS
    shared = _pair_counts(_dealt(kept, "file_id", tasks), "file_id", "identity_id", tasks, "shared_files")
    out = shared.join(own.select(F.col("identity_id").alias("a"), F.col("n_files").alias("a_files")), "a").join(own.select(F.col("identity_id").alias("b"), F.col("n_files").alias("b_files")), "b")
    union = F.col("a_files") + F.col("b_files") - F.col("shared_files")
    return out.select(F.col("a").alias("identity_a"), F.col("b").alias("identity_b"), "shared_files", "a_files", "b_files", F.when(union > 0, F.col("shared_files").cast("double") / union).otherwise(0.0).alias("strength"))


def module_deps(symbol_refs: DataFrame) -> DataFrame:
    """Number of references between files; unresolved and own ones left out."""
    return symbol_refs.filter("def_file_id is not null and def_file_id <> file_id").groupBy(F.col("file_id").alias("from_file_id"), F.col("def_file_id").alias("to_file_id")).agg(F.count("*").alias("ref_count"))

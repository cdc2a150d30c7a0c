"""The stable views over index tables, as DataFrames and as temporary views for raw SQL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orebody.operators.people import person, with_people

Tables = Mapping[str, DataFrame]


def v_commits(t: Tables) -> DataFrame:
    rows = with_people(t["commits"], t["authors"], t["identities"])
    return rows.select("c.commit_sha", "c.subject", *person(), "c.authored_at_epoch", "c.committed_at_epoch", "c.is_merge", "c.is_root")


def v_changes(t: Tables) -> DataFrame:
    people = with_people(t["commits"], t["authors"], t["identities"]).select("c.commit_sha", *person(), "c.committed_at_epoch")
    f = t["files"].select("file_id", "path")
    old = t["files"].select(F.col("file_id").alias("old_path_id"), F.col("path").alias("old_path"))
    rows = t["commit_files"].join(f, "file_id").join(old, "old_path_id", "left").join(people, "commit_sha")
    return rows.select("commit_sha", "path", "old_path", "change_type", "similarity", "added_lines", "removed_lines", "author_name", "author_email", "committed_at_epoch")


def v_blame(t: Tables) -> DataFrame:
    people = with_people(t["commits"], t["authors"], t["identities"]).select("c.commit_sha", *person(), "c.committed_at_epoch")
    rows = t["blame"].join(t["files"].select("file_id", "path"), "file_id").join(people, "commit_sha")
    return rows.select("path", "line_number", "commit_sha", "author_name", "author_email", "committed_at_epoch")


def v_ownership(t: Tables) -> DataFrame:
    """The person with the most lines of each file, of the lines whose commit is known."""
    people = with_people(t["commits"], t["authors"], t["identities"]).select("c.commit_sha", *person())
    lines = t["blame"].groupBy("file_id", "commit_sha").agg(F.count("*").alias("n")).join(people, "commit_sha").groupBy("file_id", "author_email", "author_name").agg(F.sum("n").alias("n"))
    of = W.partitionBy("file_id")
    ranked = lines.select("*", F.sum("n").over(of).alias("total"), F.row_number().over(of.orderBy(F.desc("n"), "author_email", "author_name")).alias("rk")).filter("rk = 1")
    return ranked.join(t["files"].select("file_id", "path"), "file_id").select(
        "path", F.col("author_name").alias("owner_name"), F.col("author_email").alias("owner_email"), F.col("n").alias("owned_lines"), F.col("total").alias("file_lines"), F.round(F.col("n").cast("double") / F.col("total"), 3).alias("ownership")
    )


def v_symbols(t: Tables) -> DataFrame:
    return t["symbols"].join(t["files"].select("file_id", "path"), "file_id").select("path", "name", "kind", "start_line", "end_line", "lang", "blob_sha")


def v_references(t: Tables) -> DataFrame:
    at = t["files"].select("file_id", F.col("path").alias("ref_path"))
    target = t["files"].select(F.col("file_id").alias("def_file_id"), F.col("path").alias("def_path"))
    return t["symbol_refs"].join(at, "file_id").join(target, "def_file_id", "left").select("ref_path", "line", "name", "ref_kind", "def_path", "lang")


def v_symbol_usage(t: Tables) -> DataFrame:
    """Resolved references per definition; counted before the join, so equal definitions add up as a join would."""
    used = t["symbol_refs"].filter("def_file_id is not null").groupBy(F.col("def_file_id").alias("file_id"), "name").agg(F.count("name").alias("n"))
    rows = t["symbols"].join(used, ["file_id", "name"], "left").join(t["files"].select("file_id", "path"), "file_id")
    return rows.groupBy(F.col("path").alias("def_path"), "name", "kind", "start_line").agg(F.sum(F.coalesce("n", F.lit(0))).alias("resolved_refs"))


def v_dependencies(t: Tables) -> DataFrame:
    return t["dependencies"].select("ecosystem", "name", "version", "scope", "manifest_path")


def v_markers(t: Tables) -> DataFrame:
    return t["code_markers"].join(t["files"].select("file_id", "path"), "file_id").select("path", "line", "marker", "text")


def v_risks(t: Tables) -> DataFrame:
    return t["insights"].select("kind", "severity", "subject", "metric", "detail")


def v_semantic(t: Tables) -> DataFrame:
    at = t["files"].select("file_id", F.col("path").alias("ref_path"))
    target = t["files"].select(F.col("file_id").alias("def_file_id"), F.col("path").alias("def_path"))
    return t["semantic_refs"].join(at, "file_id").join(target, "def_file_id").select("ref_path", "line", "name", "ref_kind", "def_path", "def_line", "lang")


#: view -> (function, tables it needs)
VIEWS = {
    "v_commits": (v_commits, ("commits", "authors", "identities")),
    "v_changes": (v_changes, ("commit_files", "files", "commits", "authors", "identities")),
    "v_blame": (v_blame, ("blame", "files", "commits", "authors", "identities")),
    "v_ownership": (v_ownership, ("blame", "files", "commits", "authors", "identities")),
    "v_symbols": (v_symbols, ("symbols", "files")),
    "v_references": (v_references, ("symbol_refs", "files")),
    "v_symbol_usage": (v_symbol_usage, ("symbols", "symbol_refs", "files")),
    "v_dependencies": (v_dependencies, ("dependencies",)),
    "v_markers": (v_markers, ("code_markers", "files")),
    "v_risks": (v_risks, ("insights",)),
    "v_semantic": (v_semantic, ("semantic_refs", "files")),
}


def register(spark: SparkSession, t: Tables) -> list[str]:
    """Temporary views of all tables and of every stable view whose tables are there."""
    for name, df in t.items():
        df.createOrReplaceTempView(name)
    made = [v for v, (_, needs) in VIEWS.items() if all(n in t for n in needs)]
    for v in made:
        VIEWS[v][0](t).createOrReplaceTempView(v)
    return made


def sql(spark: SparkSession, t: Tables, text: str) -> DataFrame:
    """Raw SQL over the registered tables and views."""
    register(spark, t)
    return spark.sql(text)

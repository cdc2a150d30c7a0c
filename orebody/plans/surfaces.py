"""Ten question-shaped functions over the views. Each returns a DataFrame; ``envelope`` runs one for a caller.

A path scope is a file or a folder. Formulas that the public contract leaves
open are ours: reviewers look back 180 days from the newest commit, blast
radius leaves out commits of more than 50 files, search ranks an exact symbol 3,
a prefix 2 and any other hit 1.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.operators.coupling import small_commits
from orebody.plans import views

DAY = 86400
RECENT_DAYS = 180
#: surface -> (default limit, largest limit)
LIMITS = {"ownership": (10, 50), "reviewers": (10, 50), "blast_radius": (20, 100), "activity": (1, 1), "contributors": (20, 500), "search": (20, 100), "graph": (30, 200), "dependencies": (50, 500), "risks": (20, 200), "markers": (50, 500)}

Tables = Mapping[str, DataFrame]


def in_scope(path: Column, scope: str | None) -> Column:
    if not scope or scope in (".", "/"):
        return F.lit(True)
    scope = scope.rstrip("/")
    return (path == scope) | path.startswith(scope + "/")


def ownership(t: Tables, path: str | None = None) -> DataFrame:
    rows = views.v_blame(t).filter(in_scope(F.col("path"), path))
    people = rows.groupBy("author_name", "author_email").agg(F.count("*").alias("owned_lines"), F.countDistinct("path").alias("files"), F.max("committed_at_epoch").alias("last_touch_epoch"))
    total = rows.agg(F.count("*").alias("total"))
    out = people.join(F.broadcast(total)).withColumn("share", F.round(F.col("owned_lines") / F.col("total"), 3))  # one-row side
    return out.select("author_name", "author_email", "owned_lines", "files", "share", "last_touch_epoch").orderBy(F.desc("owned_lines"), "author_email", "author_name")


def reviewers(t: Tables, path: str | None = None) -> DataFrame:
    owned = views.v_blame(t).filter(in_scope(F.col("path"), path)).groupBy("author_name", "author_email").agg(F.count("*").alias("owned_lines"))
    newest = t["commits"].agg(F.max("committed_at_epoch").alias("newest"))
    changes = views.v_changes(t).filter(in_scope(F.col("path"), path))
    last = changes.groupBy("author_name", "author_email").agg(F.max("committed_at_epoch").alias("last_touch_epoch"))
    recent = changes.join(F.broadcast(newest)).filter(F.col("committed_at_epoch") > F.col("newest") - RECENT_DAYS * DAY).groupBy("author_name", "author_email").agg(F.count("*").alias("recent_changes"))
    who = ["author_name", "author_email"]
    out = owned.join(recent, who, "full_outer").join(last, who, "left")
    return out.select(*who, F.coalesce("owned_lines", F.lit(0)).alias("owned_lines"), F.coalesce("recent_changes", F.lit(0)).alias("recent_changes"), "last_touch_epoch").orderBy(F.desc("owned_lines"), F.desc("recent_changes"), "author_email", "author_name")


def blast_radius(t: Tables, path: str) -> DataFrame:
    rows = views.v_changes(t).join(small_commits(t["commit_files"]), "commit_sha", "left_semi").select("commit_sha", "path", "committed_at_epoch")
    inside = in_scope(F.col("path"), path)
    touched = rows.filter(inside).select("commit_sha").distinct()
    near = rows.filter(~inside).join(touched, "commit_sha", "left_semi")
    return near.groupBy("path").agg(F.countDistinct("commit_sha").alias("co_changes"), F.max("committed_at_epoch").alias("last_co_change_epoch")).orderBy(F.desc("co_changes"), "path")


def activity(t: Tables, path: str | None = None, days: int = 90) -> DataFrame:
    window = t["commits"].agg(F.max("committed_at_epoch").alias("window_end_epoch")).withColumn("window_start_epoch", F.col("window_end_epoch") - max(1, min(days, 3650)) * DAY)
    rows = views.v_changes(t).filter(in_scope(F.col("path"), path)).join(F.broadcast(window)).filter("committed_at_epoch > window_start_epoch")
    one = rows.agg(
        F.countDistinct("commit_sha").alias("commits"), F.count("*").alias("file_changes"), F.countDistinct("path").alias("files"), F.countDistinct("author_email").alias("authors"),
        F.coalesce(F.sum("added_lines"), F.lit(0)).cast("long").alias("lines_added"), F.coalesce(F.sum("removed_lines"), F.lit(0)).cast("long").alias("lines_removed"),
    )
    return one.join(window).select("commits", "file_changes", "files", "authors", "lines_added", "lines_removed", "window_start_epoch", "window_end_epoch")  # two one-row sides


def contributors(t: Tables, path: str | None = None) -> DataFrame:
    rows = views.v_changes(t).filter(in_scope(F.col("path"), path))
    out = rows.groupBy("author_name", "author_email").agg(F.countDistinct("commit_sha").alias("commits"), F.count("*").alias("file_changes"), F.countDistinct("path").alias("files"), F.min("committed_at_epoch").alias("first_seen_epoch"), F.max("committed_at_epoch").alias("last_seen_epoch"))
    return out.orderBy(F.desc("commits"), F.desc("file_changes"), "author_email", "author_name")


def search(t: Tables, query: str) -> DataFrame:
    want = query.lower()
    sym = views.v_symbols(t).filter(F.contains(F.lower("name"), F.lit(want)))
    rank = F.when(F.lower("name") == want, 3).when(F.lower("name").startswith(want), 2).otherwise(1)
    null = lambda kind: F.lit(None).cast(kind)
    hits = sym.select(F.lit("symbol").alias("type"), F.col("name").alias("title"), "path", F.col("start_line").alias("line"), null("string").alias("sha"), F.col("kind").alias("detail"), rank.alias("rank"))
    paths = t["files"].filter(F.contains(F.lower("path"), F.lit(want))).select(F.lit("path").alias("type"), F.col("path").alias("title"), "path", null("int").alias("line"), null("string").alias("sha"), null("string").alias("detail"), F.lit(1).alias("rank"))
    commits = views.v_commits(t).filter(F.contains(F.lower("subject"), F.lit(want))).select(F.lit("commit").alias("type"), F.col("subject").alias("title"), null("string").alias("path"), null("int").alias("line"), F.col("commit_sha").alias("sha"), F.col("author_name").alias("detail"), F.lit(1).alias("rank"))
    kind = F.when(F.col("type") == "symbol", 0).when(F.col("type") == "path", 1).otherwise(2)
    return hits.unionByName(paths).unionByName(commits).orderBy(F.desc("rank"), kind, "title", "path", "line", "sha")


def graph(t: Tables, path: str | None = None) -> DataFrame:
    a = t["files"].select(F.col("file_id").alias("from_file_id"), F.col("path").alias("from_path"))
    b = t["files"].select(F.col("file_id").alias("to_file_id"), F.col("path").alias("to_path"))
    rows = t["module_deps"].join(a, "from_file_id").join(b, "to_file_id").filter(in_scope(F.col("from_path"), path) | in_scope(F.col("to_path"), path))
    return rows.select("from_path", "to_path", F.col("ref_count").alias("refs")).orderBy(F.desc("refs"), "from_path", "to_path")


def dependencies(t: Tables, query: str | None = None) -> DataFrame:
    rows = views.v_dependencies(t)
    if query:
        rows = rows.filter(F.contains(F.lower("name"), F.lit(query.lower())) | (F.lower("ecosystem") == query.lower()))
    return rows.orderBy("ecosystem", "name", "manifest_path", "scope", "version")


def risks(t: Tables, path: str | None = None) -> DataFrame:
    rows = views.v_risks(t)
    if path:
        hit = F.lit(False)
        for part in (F.col("subject"), F.substring_index("subject", " ↔ ", 1), F.substring_index("subject", " ↔ ", -1)):
            hit = hit | in_scope(part, path)
        rows = rows.filter(hit)
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return rows.orderBy(rank, F.desc("metric"), "kind", "subject")


def markers(t: Tables, path: str | None = None) -> DataFrame:
    return views.v_markers(t).filter(in_scope(F.col("path"), path)).orderBy("path", "line", "marker", "text")


SURFACES: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (ownership, reviewers, blast_radius, activity, contributors, search, graph, dependencies, risks, markers)}


def envelope(surface: str, t: Tables, tenant: str = "local", limit: int | None = None, **params) -> dict:
    """Run a surface: at most ``limit`` rows, with a flag that there were more."""
    began = time.monotonic()
    default, most = LIMITS[surface]
    limit = max(1, min(limit or default, most))
    params = {k: v for k, v in params.items() if v not in (None, "")}
    rows = [r.asDict() for r in SURFACES[surface](t, **params).limit(limit + 1).collect()]  # bounded by the limit
    return {"tenant": tenant, "surface": surface, "params": params | {"limit": limit}, "rows": rows[:limit], "row_count": min(limit, len(rows)), "truncated": len(rows) > limit, "elapsed_ms": int((time.monotonic() - began) * 1000)}

"""Building an index of a repository: extraction, assembly, derived tables; full or as an update.

Extraction gives path-keyed raw tables, ``assemble`` turns them into id-keyed
tables and derives the rest by level. An update reads the old index back to raw
tables, adds the new commits and assembles again, so both ways end in the same
tables; only commits, blame and blobs that are new are read from git.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.functions import commits as fc
from orebody.functions import manifests
from orebody.functions import paths as fp
from orebody.functions.content import is_binary
from orebody.operators import code_graph, content, coupling, identity, insights, ownership, renames
from orebody.schema import empty
from orebody.sources import git, index
from orebody.storage import durable, ranked_ids
from orebody.symbols import resolve

LEVELS = ("basic", "mid", "high")

Raw = dict[str, DataFrame]


@dataclass(frozen=True)
class Options:
    level: str = "mid"
    refs: str = "auto"
    snapshots: str | None = None  # None: tags at high, else none
    chunk_average: int | None = None  # None: the default at high, else no chunks
    chunk_scope: str = "all"  # or "head"
    trees: bool | None = None  # None: at high
    full: bool = False


def level_of(value: str | None) -> str:
    """A known level; anything else is mid."""
    value = (value or "").strip().lower()
    return value if value in LEVELS else "mid"


def suggest(commits: int, files: int) -> str:
    """The level that a repository of this size affords."""
    if commits > 200_000 or files > 40_000:
        return "basic"
    return "high" if commits < 2_000 and files < 3_000 else "mid"


# -- extraction -----------------------------------------------------------------------------------


def walk(spark: SparkSession, repo: str, tips: list[str], hidden: list[str] = ()) -> Raw:
    """Raw tables of the commits reachable from ``tips`` and not from ``hidden``."""
    read = durable(git.commits(git.commit_names(spark, repo, tips, list(hidden)), repo), "commits")
    mail = lambda c: F.lower(F.trim(F.col(c)))
    n = F.size("parents")
    commits = read.select(
        "commit_sha", mail("author_email").alias("author_id"), "authored_at_epoch", "authored_at_offset_minutes", mail("committer_email").alias("committer_id"), "committed_at_epoch", "committed_at_offset_minutes",
        fc.subject_of(F.col("message")).alias("subject"), n.alias("parent_count"), (n >= 2).alias("is_merge"), (n == 0).alias("is_root"),
    )
    people = read.select(mail("author_email").alias("author_id"), F.col("author_name").alias("name"), F.col("author_email").alias("email"))
    people = people.unionByName(read.select(mail("committer_email").alias("author_id"), F.col("committer_name").alias("name"), F.col("committer_email").alias("email"))).distinct()
    plain = durable(git.changes(read.select("commit_sha", F.expr("try_element_at(parents, 1)").alias("parent")), repo), "changes")
    full = durable(with_renames(plain, repo), "changes")
    merged = commits.filter("is_merge").select("commit_sha")
    return {
        "commits": commits,
        "commit_parents": read.select("commit_sha", F.posexplode("parents").alias("parent_index", "parent_sha")),
        "commit_messages": read.select("commit_sha", fc.body_of(F.col("message")).alias("body"), "encoding", "is_signed"),
        "commit_trailers": read.select("commit_sha", F.posexplode(fc.parse_trailers("message")).alias("seq", "t")).select("commit_sha", "seq", "t.key", "t.value"),
        "observations": people,
        "changes": full.join(merged, "commit_sha", "left_anti"),
        "merges": full.join(merged, "commit_sha", "left_semi"),
        "roots": read.select("commit_sha", F.col("tree_sha").alias("root_tree_sha")),
    }


def with_renames(changes: DataFrame, repo: str) -> DataFrame:
    """Deletions and additions of one file folded into renames: exact by blob, else by similar lines."""
    none = F.lit(None)
    rows = changes.withColumn("old_path", none.cast("string")).withColumn("similarity", none.cast("int"))
    exact = renames.exact_renames(changes.filter("src_mode <> '160000' and dst_mode <> '160000'")).select("commit_sha", "old_path", "path", F.lit(100).alias("sim"))
    pool = changes.filter("change_type in ('A', 'D')")
    # only commits that have both sides left can have an inexact rename, so only their blobs are read
    left = pool.filter("change_type = 'D'").join(exact.select("commit_sha", F.col("old_path").alias("path")), ["commit_sha", "path"], "left_anti").unionByName(pool.filter("change_type = 'A'").join(exact.select("commit_sha", "path"), ["commit_sha", "path"], "left_anti"))
    both = left.groupBy("commit_sha").agg(F.count_distinct("change_type").alias("n")).filter("n = 2").select("commit_sha")
    open_ = durable(left.join(both, "commit_sha", "left_semi").filter("src_mode <> '160000' and dst_mode <> '160000'"), "open")
    blob = F.when(F.col("change_type") == "D", F.col("src_blob_sha")).otherwise(F.col("dst_blob_sha"))
    texts = git.read_blobs(open_.select(blob.alias("blob_sha")).distinct(), repo).filter(~is_binary(F.col("bytes"))).select("blob_sha", F.decode("bytes", "ISO-8859-1").alias("text"))
    near = renames.inexact_renames(open_.select("commit_sha", "change_type", "path", "src_blob_sha", "dst_blob_sha"), texts).withColumnRenamed("similarity", "sim")
    pairs = durable(exact.unionByName(near), "renames")
    gone = changes.filter("change_type = 'D'").select("commit_sha", F.col("path").alias("old_path"), F.col("src_mode").alias("old_mode"), F.col("src_blob_sha").alias("old_sha"))
    moved = rows.drop("old_path", "similarity").filter("change_type = 'A'").join(pairs, ["commit_sha", "path"]).join(gone, ["commit_sha", "old_path"])
    moved = moved.select("commit_sha", F.lit("R").alias("change_type"), "path", F.col("old_mode").alias("src_mode"), "dst_mode", F.col("old_sha").alias("src_blob_sha"), "dst_blob_sha", "old_path", F.col("sim").cast("int").alias("similarity"))
    again = git.redo_diffs(moved.filter("src_blob_sha <> dst_blob_sha"), repo)
    same = F.col("src_blob_sha") == F.col("dst_blob_sha")
    moved = moved.join(again, ["src_blob_sha", "dst_blob_sha"], "left").withColumn("added_lines", F.when(same, 0).otherwise(F.col("added_lines"))).withColumn("removed_lines", F.when(same, 0).otherwise(F.col("removed_lines")))
    taken_old = pairs.select("commit_sha", F.col("old_path").alias("path"), F.lit("D").alias("change_type"))
    taken_new = pairs.select("commit_sha", "path", F.lit("A").alias("change_type"))
    rest = rows.join(taken_old.unionByName(taken_new), ["commit_sha", "path", "change_type"], "left_anti")
    return rest.unionByName(moved.select(*rest.columns))


def line_counts(repo: str, entries: DataFrame) -> DataFrame:
    rows = git.read_blobs(entries.select("path", "blob_sha"), repo)
    return rows.select("path", F.when(is_binary(F.col("bytes")), 0).otherwise(fc_lines(F.col("bytes"))).alias("n"))


def fc_lines(data):
    from orebody.functions.content import line_count

    return line_count(F.decode(data, "ISO-8859-1"))


def blame_head(spark: SparkSession, repo: str, head: str, entries: DataFrame, raw: Raw, paths: list[str] | None = None) -> DataFrame:
    """(path, line_number, commit_sha) of text files at ``head``.

    A file with a single change, an addition, that no merge touched is that
    commit's in every line; only the others go through git's blame.
    """
    files = entries.filter(F.col("entry_type").isin("blob", "executable"))
    if paths is not None:
        wanted = spark.createDataFrame([(p,) for p in paths], "path string")
        files = files.join(wanted, "path", "left_semi")
    history = raw["changes"].select("path", "change_type", "commit_sha").unionByName(raw["changes"].filter("old_path is not null").select(F.col("old_path").alias("path"), "change_type", "commit_sha"))
    once = history.groupBy("path").agg(F.count("*").alias("c"), F.min("change_type").alias("k"), F.min("commit_sha").alias("commit_sha")).filter("c = 1 and k = 'A'")
    once = once.join(raw["merges"].select("path").unionByName(raw["merges"].filter("old_path is not null").select(F.col("old_path").alias("path"))).distinct(), "path", "left_anti").select("path", "commit_sha")
    easy = line_counts(repo, files.join(once, "path", "left_semi")).join(once, "path").filter("n > 0")
    quick = easy.select("path", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("line_number"), "commit_sha")
    hard = files.join(once, "path", "left_anti").select(F.lit(head).alias("rev"), "path").repartition(F.col("path"))
    text = line_counts(repo, files.join(once, "path", "left_anti")).filter("n > 0").select("path")
    return durable(quick.unionByName(git.blame(hard.join(text, "path", "left_semi"), repo).select("path", "line_number", "commit_sha")), "blame")


def blame_snapshots(spark: SparkSession, repo: str, targets: list[tuple[str, str]]) -> DataFrame | None:
    out = None
    for label, sha in targets:
        entries = git.head_entries(spark, repo, sha).filter(F.col("entry_type").isin("blob", "executable"))
        text = line_counts(repo, entries).filter("n > 0").select("path")
        rows = git.blame(text.select(F.lit(sha).alias("rev"), "path"), repo).select(F.lit(label).alias("snapshot_ref"), F.col("rev").alias("snapshot_sha"), "path", "line_number", "commit_sha")
        out = rows if out is None else out.unionByName(rows)
    return out


# -- assembly -------------------------------------------------------------------------------------


def assemble(spark: SparkSession, raw: Raw, level: str) -> dict[str, DataFrame]:
    """Id-keyed and derived tables from raw ones; pure DataFrame work, no git."""
    t: dict[str, DataFrame] = {k: raw[k] for k in ("commits", "commit_parents", "commit_messages", "commit_trailers")}
    changes, merges = raw["changes"], raw["merges"]
    sources = [changes.select("path"), changes.filter("old_path is not null").select(F.col("old_path").alias("path")), raw["blame"].select("path")]
    if "symbols" in raw:
        sources += [raw["symbols"].select("path"), raw["refs"].select("path"), raw["refs"].filter("def_path is not null").select(F.col("def_path").alias("path"))]
    seen = sources[0]
    for s in sources[1:]:
        seen = seen.unionByName(s)
    files = durable(ranked_ids(seen.distinct(), ["path"], "file_id").select("file_id", "path"), "files")
    t["files"] = files
    by_path = lambda path, name: files.select(F.col("path").alias(path), F.col("file_id").alias(name))
    authors, identities, aliases = identity.resolve(raw["observations"])
    authors, identities, aliases = durable(authors, "authors"), durable(identities, "identities"), durable(aliases, "aliases")
    t |= {"authors": authors, "identities": identities, "identity_aliases": aliases, "identity_reviews": identity.review_queue(identities, aliases), "observations": raw["observations"]}
    cf = durable(changes.join(by_path("path", "file_id"), "path").join(by_path("old_path", "old_path_id"), "old_path", "left"), "cf")
    t["commit_files"] = cf.drop("hunks")
    t["hunks"] = cf.select("commit_sha", "file_id", F.posexplode("hunks").alias("seq", "h")).select("commit_sha", "file_id", "seq", "h.*")
    t["merge_changes"] = merges
    t["commit_stats"] = ownership.commit_stats(cf)
    t["commit_classes"] = raw["commits"].select("commit_sha", fc.classify(F.col("subject"), F.col("is_merge")).alias("r")).select("commit_sha", "r.*")
    t["blame"] = durable(raw["blame"].join(by_path("path", "file_id"), "path").select("file_id", "line_number", "commit_sha"), "blame")
    entries = raw["entries"].join(files, "path")
    t["tree_entries"] = entries
    at_head = entries.select("file_id", "path")
    t["test_files"], t["test_coverage"] = code_graph.test_files(at_head), code_graph.test_coverage(at_head)
    by_rule = at_head.select("file_id", fp.generated_reason(F.col("path")).alias("r")).filter("r is not null").select("file_id", "r.*")
    t["generated_files"] = by_rule
    for k in ("refs", "notes", "submodules", "dependencies"):
        t[k] = raw[f"git_{k}"]
    if level != "basic":
        _mid(t, raw, files, by_path, by_rule, cf, authors, identities)
    if level == "high":
        t["symbol_edges"] = code_graph.symbol_edges(t["symbols"], t["symbol_refs"])
    return t


def _mid(t: dict[str, DataFrame], raw: Raw, files: DataFrame, by_path, by_rule: DataFrame, cf: DataFrame, authors: DataFrame, identities: DataFrame) -> None:
    blobs = raw["head_blobs"].join(files, "path")
    texts = durable(blobs.filter(~is_binary(F.col("bytes"))).select("file_id", F.decode("bytes", "UTF-8").alias("text")), "texts")
    header = content.generated_by_header(texts, ["file_id"]).join(by_rule.select("file_id"), "file_id", "left_anti")
    t["generated_files"] = durable(by_rule.unionByName(header), "generated")
    t["code_markers"], t["secret_findings"] = content.markers(texts, ["file_id"]), content.secrets(texts, ["file_id"])
    t["blob_facts"] = content.blob_facts(blobs.select("blob_sha", "bytes"))
    t["symbols"] = durable(raw["symbols"].join(by_path("path", "file_id"), "path"), "symbols")
    t["symbol_refs"] = durable(raw["refs"].join(by_path("path", "file_id"), "path").join(by_path("def_path", "def_file_id"), "def_path", "left"), "refs")
    # generated by rule over all files that ever had an id, by header over those at head
    ever = files.filter(fp.generated_reason(F.col("path")).isNotNull()).select("file_id")
    non_authored = durable(ever.unionByName(t["generated_files"].select("file_id")).distinct(), "skip")
    t["file_ownership"] = durable(ownership.file_ownership(t["blame"], t["commits"], authors), "owners")
    t["area_ownership"] = durable(ownership.area_ownership(t["file_ownership"], files, non_authored), "areas")
    t["coupling"] = durable(coupling.coupling(cf), "coupling")
    t["collaboration"] = coupling.collaboration(cf, t["commits"], authors, identities)
    t["module_deps"] = durable(coupling.module_deps(t["symbol_refs"]), "deps")
    t["insights"] = insights.insights(t["file_ownership"], t["area_ownership"], t["coupling"], cf, files, identities, t["module_deps"], non_authored)


def head_tables(spark: SparkSession, repo: str, level: str) -> Raw:
    """What is read at head in every run: entries, refs, notes, submodules, manifests and, from mid on, contents and code."""
    entries = durable(git.head_entries(spark, repo), "entries")
    plain = entries.filter(F.col("entry_type").isin("blob", "executable"))
    wanted = plain.filter(F.substring_index("path", "/", -1).isin(list(manifests.KINDS)))
    raw = {
        "entries": entries, "git_refs": git.refs(spark, repo), "git_notes": git.notes(spark, repo), "git_submodules": git.submodules(spark, repo),
        "git_dependencies": manifests.dependencies(git.read_blobs(wanted.select("path", "blob_sha"), repo)),
    }
    if level != "basic":
        blobs = durable(git.read_blobs(plain.select("path", "blob_sha"), repo), "blobs")
        syms, refs = resolve.resolve(resolve.parse(blobs), plain.select("path"), resolve.go_modules(blobs), resolve.path_aliases(blobs))
        raw |= {"head_blobs": blobs, "symbols": durable(syms, "syms"), "refs": durable(refs, "srefs")}
    return raw


def extras(spark: SparkSession, repo: str, raw: Raw, tables: dict[str, DataFrame], options: Options) -> None:
    """Snapshots, chunks and trees, where the level or an option asks for them."""
    high = options.level == "high"
    spec = options.snapshots if options.snapshots is not None else ("tags" if high else None)
    shots = blame_snapshots(spark, repo, git.snapshot_targets(spark, repo, spec)) if spec else None
    if shots is not None:
        tables["blame_snapshots"] = durable(shots, "shots")
        tables["snapshot_ownership"] = ownership.snapshot_ownership(tables["blame_snapshots"], tables["commits"], tables["authors"])
    average = options.chunk_average if options.chunk_average is not None else (content.AVERAGE if high else None)
    if average is not None:
        names = git.all_blobs(spark, repo) if options.chunk_scope == "all" else raw["entries"].filter(F.col("entry_type").isin("blob", "executable", "symlink")).select("blob_sha").distinct()
        parts = durable(content.blob_chunks(git.read_blobs(names, repo), average or content.AVERAGE), "chunks")
        tables["blob_chunks"], tables["chunks"] = parts.drop("bytes"), content.chunk_store(parts)
    if options.trees if options.trees is not None else high:
        tables["commit_trees"] = raw["roots"]
        tables["tree_objects"] = git.tree_objects(raw["roots"].select(F.col("root_tree_sha").alias("tree_sha")), repo)


# -- entry points ---------------------------------------------------------------------------------


def build_index(spark: SparkSession, repo: str, folder: str, options: Options = Options()) -> dict:
    """Index ``repo`` into ``folder``: an update when the old index allows it, else a full run. Returns the card with ``mode``."""
    level, head = level_of(options.level), git.head_sha(repo)
    mode = options.refs if options.refs != "auto" else ("active" if level == "high" else "head")
    old = index.manifest(spark, folder)
    usable = old and not options.full and mode == "head" and old.get("level") == level and git.is_ancestor(repo, old["head_sha"], head)
    if usable:
        raw, how = updated(spark, repo, folder, old["head_sha"], head, level), "incremental"
    else:
        raw, how = fresh(spark, repo, git.select_refs(repo, mode)[0], head, level), "full"
    tables = assemble(spark, raw, level)
    if how == "full":
        extras(spark, repo, raw, tables, options)
    card = index.write_index(spark, folder, tables, head, level)
    raw["observations"].write.mode("overwrite").parquet(f"{folder}/.observations.new")
    spark.read.parquet(f"{folder}/.observations.new").write.mode("overwrite").parquet(f"{folder}/observations.parquet")
    return card | {"mode": how}


def fresh(spark: SparkSession, repo: str, tips: list[str], head: str, level: str) -> Raw:
    raw = walk(spark, repo, tips) | head_tables(spark, repo, level)
    return raw | {"blame": blame_head(spark, repo, head, raw["entries"], raw)}


def updated(spark: SparkSession, repo: str, folder: str, old_head: str, head: str, level: str) -> Raw:
    """Raw tables of the old index plus the commits since; blame is kept for files that didn't change."""
    past, new = raw_of(index.read_index(spark, folder)), walk(spark, repo, [head], [old_head])
    raw = {k: durable(past[k].unionByName(new[k].select(*past[k].columns)), "raw") for k in ("commits", "commit_parents", "commit_messages", "commit_trailers", "changes", "merges")}
    raw["observations"] = durable(past["observations"].unionByName(new["observations"]).distinct(), "raw")
    raw |= {"roots": new["roots"]} | head_tables(spark, repo, level)
    changed = spark.createDataFrame([(p,) for p in git.changed_paths(repo, old_head, head)], "path string")
    kept = durable(past["blame"].join(changed, "path", "left_anti").join(raw["entries"].select("path"), "path", "left_semi"), "blame")
    todo = raw["entries"].join(kept.select("path").distinct(), "path", "left_anti")
    return raw | {"blame": durable(kept.unionByName(blame_head(spark, repo, head, todo, raw)), "blame")}


def raw_of(t: Mapping[str, DataFrame]) -> Raw:
    """Path-keyed tables back from an index."""
    files = t["files"]
    old = files.select(F.col("file_id").alias("old_path_id"), F.col("path").alias("old_path"))
    one = F.struct("old_start", "old_lines", "new_start", "new_lines")
    hunks = t["hunks"].groupBy("commit_sha", "file_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", one.alias("h")))), lambda x: x["h"]).alias("hunks"))
    changes = t["commit_files"].join(files, "file_id").join(old, "old_path_id", "left").join(hunks, ["commit_sha", "file_id"], "left")
    none = F.expr("CAST(array() AS array<struct<old_start: int, old_lines: int, new_start: int, new_lines: int>>)")
    cols = ["commit_sha", "change_type", "path", "src_mode", "dst_mode", "src_blob_sha", "dst_blob_sha", "added_lines", "removed_lines", "old_path", "similarity"]
    return {
        "commits": t["commits"], "commit_parents": t["commit_parents"], "commit_messages": t["commit_messages"], "commit_trailers": t["commit_trailers"],
        "changes": changes.select(*cols, F.coalesce("hunks", none).alias("hunks")), "merges": t["merge_changes"].select(*cols, none.alias("hunks")),
        "observations": t["observations"].select("author_id", "name", "email"), "blame": t["blame"].join(files, "file_id").select("path", "line_number", "commit_sha"),
    }


def open_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of an index, with its stable views registered for SQL."""
    from orebody.plans import views

    tables = index.read_index(spark, folder)
    for name in index.SCHEMAS:
        tables.setdefault(name, empty(spark, name))
    views.register(spark, tables)
    return tables

"""Registered queries of the git sources, on a small generated repository; what they must give comes from git's own commands.

The repository has fixed dates and contents, so its object names are the same
everywhere. It is made in the shared work folder when first asked for.
"""

from __future__ import annotations

import hashlib
import re
import shutil
import subprocess
import tempfile
import uuid
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.functions import manifests
from orebody.functions.content import is_binary
from orebody.operators import content
from orebody.plans import build
from orebody.sources import git, sample
from orebody.storage import durable, work_dir
from orebody.symbols import resolve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_EXPECTED: dict[str, Callable[[str], str]] = {}
_MADE: dict[str, str] = {}
_EMPTY = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"  # the empty tree's object name


def repository(spark: SparkSession) -> str:
    folder = re.sub(r"^file:(//)?", "", work_dir(spark))
    if folder not in _MADE:
        _MADE[folder] = str(sample.build(Path(folder) / f"repo-{uuid.uuid4().hex}").path)
    return _MADE[folder]


def values(names: str, kinds: str, rows: list[tuple]) -> str:
    """A SELECT of the given rows."""
    cols, types = names.split(), kinds.split()
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool | int) else "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) or "(" + ", ".join(["NULL"] * len(cols)) + ")"
    text = "SELECT " + ", ".join(f"CAST({c} AS {k}) AS {c}" for c, k in zip(cols, types, strict=True)) + f" FROM (VALUES {body}) v({', '.join(cols)})"
    return text if rows else text + " WHERE false"


def query(names: str, kinds: str):
    """Register a query and, as the next function, the rows that git's commands give for it."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, folder: fn(spark, repository(spark)).select(*names.split())

        def expect(rows):
            _EXPECTED[fn.__name__] = lambda repo: values(names, kinds, rows(repo))
            return rows

        fn.expect = expect
        return fn

    return add


@cache
def oracles() -> dict[str, str]:
    """Definitions by query; empty where git can't make a repository."""
    if shutil.which("git") is None:
        return {}
    with tempfile.TemporaryDirectory(prefix="orebody-sample-") as folder:
        try:
            repo = str(sample.build(Path(folder) / "r").path)
        except (OSError, subprocess.CalledProcessError):  # git can't make repositories here
            return {}
        return {name: make(repo) for name, make in _EXPECTED.items()}


def out(repo: str, *args: str) -> str:
    return git.git(repo, *args).decode("utf-8", "replace")


def _names(repo: str) -> list[str]:
    return out(repo, "rev-list", "--branches").split()


def _tips(repo: str) -> list[str]:
    return out(repo, "for-each-ref", "--format=%(objectname)", "refs/heads").split()


def _commits(spark: SparkSession, repo: str) -> DataFrame:
    return git.commits(git.commit_names(spark, repo, _tips(repo)), repo)


def _named(spark: SparkSession, repo: str) -> DataFrame:
    return _commits(spark, repo).select("commit_sha", F.expr("try_element_at(parents, 1)").alias("parent"))


# -- commits and refs -----------------------------------------------------------------------------


@query("commit_sha tree_sha parents author_name author_email authored_at_epoch authored_at_offset_minutes committed_at_epoch message_sha", "VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR BIGINT INT BIGINT VARCHAR")
def git_commits(spark, repo):
    return _commits(spark, repo).withColumn("parents", F.array_join("parents", " ")).withColumn("message_sha", F.sha1(F.col("message").cast("binary")))


@git_commits.expect
def _(repo):
    rows = []
    for sha in _names(repo):
        tree, parents, name, mail, at, when, body = out(repo, "show", "-s", "--format=%T%x00%P%x00%an%x00%ae%x00%at%x00%ct%x00%B", sha).split("\0")
        rows.append((sha, tree, parents, name, mail, int(at), 120, int(when), hashlib.sha1(body[:-1].encode()).hexdigest()))
    return rows


@query("name kind object_sha peeled_commit_sha is_symbolic tagger_name tagger_email tagged_at_epoch tag_subject tag_body", "VARCHAR VARCHAR VARCHAR VARCHAR BOOLEAN VARCHAR VARCHAR BIGINT VARCHAR VARCHAR")
def git_refs(spark, repo):
    return git.refs(spark, repo)


@git_refs.expect
def _(repo):
    rows = []
    for name in out(repo, "for-each-ref", "--format=%(refname)").split():
        sha, tag = out(repo, "rev-parse", name).strip(), out(repo, "cat-file", "-t", name).strip() == "tag"
        kind = "branch" if name.startswith("refs/heads/") else "other" if not name.startswith("refs/tags/") else "tag-annotated" if tag else "tag-lightweight"
        at = out(repo, "for-each-ref", "--format=%(taggerdate:unix)", name).strip()
        subject = out(repo, "for-each-ref", "--format=%(contents:subject)", name).strip()
        rows.append((name, kind, sha, out(repo, "rev-parse", f"{name}^{{commit}}").strip(), False, "Ann Lee" if tag else None, "ann@x.example" if tag else None, int(at) if tag else None, subject or None, "Tag body" if tag else None))
    head = out(repo, "rev-parse", "HEAD").strip()
    return [*rows, ("HEAD", "symbolic", head, head, True, None, None, None, "refs/heads/main", None)]


@query("mode tips deferred", "VARCHAR BIGINT BIGINT")
def git_ref_selection(spark, repo):
    return spark.createDataFrame([(m, len(t), len(d)) for m in ("head", "active", "all") for t, d in [git.select_refs(repo, m, 3)]], "mode string, tips long, deferred long")


@git_ref_selection.expect
def _(repo):
    heads = [x.split() for x in out(repo, "for-each-ref", "--format=%(objectname) %(committerdate:unix)", "refs/heads").splitlines()]
    newest = max(int(t) for _, t in heads)
    live = {s for s, t in heads if newest - int(t) <= 3 * 86400} | {out(repo, "rev-parse", "HEAD").strip()}
    return [("head", 1, 0), ("active", len(live), sum(newest - int(t) > 3 * 86400 for _, t in heads)), ("all", len({s for s, _ in heads}), 0)]


@query("label sha", "VARCHAR VARCHAR")
def git_snapshot_targets(spark, repo):
    return spark.createDataFrame(git.snapshot_targets(spark, repo, "tags:2") + git.snapshot_targets(spark, repo, "side, nothing,HEAD"), "label string, sha string")


@git_snapshot_targets.expect
def _(repo):
    return [(x, out(repo, "rev-parse", f"{x}^{{commit}}").strip()) for x in ("v1", "light", "side", "HEAD")]


@query("notes_ref target_sha body", "VARCHAR VARCHAR VARCHAR")
def git_notes(spark, repo):
    return git.notes(spark, repo)


@git_notes.expect
def _(repo):
    return [("refs/notes/commits", target, "a note\n") for target in (x.split()[1] for x in out(repo, "notes", "list").splitlines())]


@query("path name url pinned_sha in_gitmodules in_tree", "VARCHAR VARCHAR VARCHAR VARCHAR BOOLEAN BOOLEAN")
def git_submodules(spark, repo):
    return git.submodules(spark, repo)


@git_submodules.expect
def _(repo):
    return [("sub/mod", "m", "https://x.example/m", "1" * 40, True, True)]


# -- trees and blobs ------------------------------------------------------------------------------


@query("path mode entry_type blob_sha size", "VARCHAR VARCHAR VARCHAR VARCHAR BIGINT")
def git_head_entries(spark, repo):
    return git.head_entries(spark, repo)


_TYPES = {"100644": "blob", "100755": "executable", "120000": "symlink", "160000": "submodule"}


@git_head_entries.expect
def _(repo):
    rows = []
    for line in out(repo, "ls-files", "-s").splitlines():
        (mode, sha, _), path = line.split("\t")[0].split(), line.split("\t")[1]
        rows.append((path, mode, _TYPES[mode], sha, None if mode == "160000" else int(out(repo, "cat-file", "-s", sha))))
    return rows


@query("path blob_sha", "VARCHAR VARCHAR")
def git_files_at_tag(spark, repo):
    return git.head_entries(spark, repo, "v1").select("path", "blob_sha")


@git_files_at_tag.expect
def _(repo):
    paths = out(repo, "ls-tree", "-r", "--name-only", "v1").splitlines()
    return [(p, out(repo, "rev-parse", f"v1:{p}").strip()) for p in paths]


@query("path size_bytes content_sha is_binary", "VARCHAR BIGINT VARCHAR BOOLEAN")
def git_head_blobs(spark, repo):
    rows = git.read_blobs(git.head_entries(spark, repo).filter("mode <> '160000'").select("path", "blob_sha"), repo)
    return rows.select("path", F.octet_length("bytes").cast("long").alias("size_bytes"), F.sha1("bytes").alias("content_sha"), is_binary(F.col("bytes")).alias("is_binary"))


@git_head_blobs.expect
def _(repo):
    rows = []
    for path in out(repo, "ls-files").splitlines():
        if path != "sub/mod":
            raw = git.git(repo, "show", f"HEAD:{path}")
            rows.append((path, len(raw), hashlib.sha1(raw).hexdigest(), path == "bin.dat"))
    return rows


@query("blob_sha", "VARCHAR")
def git_all_blobs(spark, repo):
    return git.all_blobs(spark, repo)


@git_all_blobs.expect
def _(repo):
    names = {x.split()[0] for x in out(repo, "rev-list", "--objects", "--all").splitlines()}
    return [(n,) for n in sorted(names) if out(repo, "cat-file", "-t", n).strip() == "blob"]


@query("commit_sha path entry_sha", "VARCHAR VARCHAR VARCHAR")
def git_tree_walk(spark, repo):
    """All files of all commits, put together from tree objects that are read once each."""
    roots = durable(_commits(spark, repo).select("commit_sha", "tree_sha"), "roots")
    trees = durable(git.tree_objects(roots.select("tree_sha"), repo), "trees")
    level, done = roots.select("commit_sha", "tree_sha", F.lit("").alias("base")), None
    for _ in range(4):  # the sample is three folders deep
        here = level.join(trees, "tree_sha").select("commit_sha", F.concat("base", "name").alias("path"), "entry_sha", "mode")
        files = here.filter("mode <> '040000'").select("commit_sha", "path", "entry_sha")
        done = files if done is None else done.unionByName(files)
        level = here.filter("mode = '040000'").select("commit_sha", F.col("entry_sha").alias("tree_sha"), F.concat("path", F.lit("/")).alias("base"))
    return done


@git_tree_walk.expect
def _(repo):
    rows = []
    for sha in _names(repo):
        for line in out(repo, "ls-tree", "-r", sha).splitlines():
            meta, path = line.split("\t")
            rows.append((sha, path, meta.split()[2]))
    return rows


# -- changes --------------------------------------------------------------------------------------


@query("commit_sha path change_type added_lines removed_lines", "VARCHAR VARCHAR VARCHAR INT INT")
def git_changes(spark, repo):
    return git.changes(_named(spark, repo), repo)


def _pairs(repo: str) -> list[tuple[str, str]]:
    return [(s, (out(repo, "show", "-s", "--format=%P", s).split() or [_EMPTY])[0]) for s in _names(repo)]


@git_changes.expect
def _(repo):
    rows = []
    for sha, old in _pairs(repo):
        kinds = {x.split("\t")[1]: x.split("\t")[0] for x in out(repo, "diff", "--no-renames", "--name-status", old, sha).splitlines()}
        for line in out(repo, "diff", "--no-renames", "--numstat", old, sha).splitlines():
            a, d, path = line.split("\t")
            untold = a == "-" or path == "sub/mod"
            rows.append((sha, path, kinds[path], None if untold else int(a), None if untold else int(d)))
    return rows


@query("commit_sha path old_start old_lines new_start new_lines", "VARCHAR VARCHAR INT INT INT INT")
def git_hunks(spark, repo):
    return git.changes(_named(spark, repo), repo).select("commit_sha", "path", F.inline("hunks"))


@git_hunks.expect
def _(repo):
    rows = []
    for sha, old in _pairs(repo):
        for path in out(repo, "diff", "--no-renames", "--name-only", old, sha).splitlines():
            for m in re.finditer(r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", out(repo, "diff", "--no-renames", "-U0", old, sha, "--", path)) if path != "sub/mod" else ():
                rows.append((sha, path, int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)))
    return rows


@query("commit_sha old_path path similarity", "VARCHAR VARCHAR VARCHAR INT")
def git_renames(spark, repo):
    plain = durable(git.changes(_named(spark, repo), repo), "changes")
    return build.with_renames(plain, repo).filter("change_type = 'R'")


@git_renames.expect
def _(repo):
    rows = []
    for sha, old in _pairs(repo):
        for line in out(repo, "diff", "-M50%", "--name-status", old, sha).splitlines():
            if line.startswith("R"):
                kind, a, b = line.split("\t")
                x, y = ([len(out(repo, "show", f"{r}:{p}").splitlines()) for r, p in ((old, a), (sha, b))])
                # the similarity is counted in lines here and in bytes by git: one line of the sample's edited file differs
                rows.append((sha, a, b, 100 if kind == "R100" else round(100 * (min(x, y) - 1) / max(x, y))))
    return rows


@query("path line_number commit_sha", "VARCHAR INT VARCHAR")
def git_blame(spark, repo):
    head, entries = git.head_sha(repo), durable(git.head_entries(spark, repo), "entries")
    return build.blame_head(spark, repo, head, entries, build.walk(spark, repo, [head]))


def _blame(repo: str, rev: str) -> list[tuple]:
    rows = []
    for line in out(repo, "ls-tree", "-r", rev).splitlines():
        mode, path = line.split()[0], line.split("\t")[1]
        if mode in ("100644", "100755") and path != "bin.dat":
            rows += [(path, k + 1, x.split()[0].lstrip("^")) for k, x in enumerate(out(repo, "blame", "-l", "--root", rev, "--", path).splitlines())]
    return rows


@git_blame.expect
def _(repo):
    return _blame(repo, "HEAD")


@query("snapshot_ref path line_number commit_sha", "VARCHAR VARCHAR INT VARCHAR")
def git_snapshot_blame(spark, repo):
    return build.blame_snapshots(spark, repo, git.snapshot_targets(spark, repo, "tags"))


@git_snapshot_blame.expect
def _(repo):
    return [(tag, *row) for tag in ("light", "v1") for row in _blame(repo, tag)]


@query("blob_sha size_bytes rebuilt_sha", "VARCHAR BIGINT VARCHAR")
def git_chunk_store(spark, repo):
    parts = durable(content.blob_chunks(git.read_blobs(git.all_blobs(spark, repo), repo), 64), "chunks")
    whole = content.rebuild(parts, content.chunk_store(parts))
    return whole.select("blob_sha", F.octet_length("bytes").cast("long").alias("size_bytes"), F.sha1("bytes").alias("rebuilt_sha"))


@git_chunk_store.expect
def _(repo):
    rows = []
    for name in sorted({x.split()[0] for x in out(repo, "rev-list", "--objects", "--all").splitlines()}):
        if out(repo, "cat-file", "-t", name).strip() == "blob" and (raw := git.git(repo, "cat-file", "blob", name)):
            rows.append((name, len(raw), hashlib.sha1(raw).hexdigest()))
    return rows


# -- manifests and code: the expected rows are read off the sample's own sources -------------------


def _sources(spark: SparkSession, repo: str) -> DataFrame:
    return durable(git.read_blobs(git.head_entries(spark, repo).filter("mode in ('100644', '100755')").select("path", "blob_sha"), repo), "blobs")


@query("manifest_path ecosystem name version scope", "VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR")
def git_manifests(spark, repo):
    return manifests.dependencies(_sources(spark, repo))


@git_manifests.expect
def _(repo):
    return [("package.json", "npm", "left", "^1.0", "runtime"), ("package.json", "npm", "right", "2", "dev")]


@query("path name kind start_line end_line lang", "VARCHAR VARCHAR VARCHAR INT INT VARCHAR")
def code_definitions(spark, repo):
    return resolve.symbols(resolve.parse(_sources(spark, repo))).filter("path <> 'vendor/v.c'")


@code_definitions.expect
def _(repo):
    return [
        ("lib/util.py", "helper", "function", 1, 3, "python"), ("lib/util.py", "Box", "class", 6, 8, "python"), ("lib/util.py", "get", "function", 7, 8, "python"), ("lib/test_util.py", "test_helper", "function", 4, 5, "python"),
        ("web/math.ts", "add", "function", 1, 3, "ts"), ("web/more.ts", "twice", "function", 1, 1, "ts"), ("web/app.ts", "far2", "function", 3, 3, "ts"), ("web/app.ts", "main", "function", 4, 9, "ts"), ("web/deep/use.ts", "both", "function", 4, 8, "ts"),
    ]


@query("path name line def_path", "VARCHAR VARCHAR INT VARCHAR")
def code_references(spark, repo):
    blobs = _sources(spark, repo)
    _, refs = resolve.resolve(resolve.parse(blobs), blobs.select("path"), resolve.go_modules(blobs), resolve.path_aliases(blobs))
    return refs.filter("ref_kind = 'call'")


@code_references.expect
def _(repo):
    return [
        ("lib/util.py", "helper", 8, "lib/util.py"), ("lib/test_util.py", "helper", 5, "lib/util.py"), ("web/app.ts", "plus", 5, "web/math.ts"), ("web/app.ts", "twice", 6, "web/more.ts"), ("web/app.ts", "far2", 8, "web/app.ts"),
        ("web/deep/use.ts", "add", 5, "web/math.ts"), ("web/deep/use.ts", "twice", 6, "web/more.ts"),
    ]


@query("path module target", "VARCHAR VARCHAR VARCHAR")
def code_modules(spark, repo):
    """Relative and aliased modules of all imports and re-exports, with the files they stand for."""
    blobs = _sources(spark, repo)
    parsed = resolve.parse(blobs).filter(F.col("lang").isin(*resolve.TS))
    uses = parsed.select("path", F.explode("imports.module").alias("module")).unionByName(parsed.select("path", F.explode("reexports.module").alias("module")))
    return resolve.resolve_modules(uses, blobs.select("path"), resolve.path_aliases(blobs))


@code_modules.expect
def _(repo):
    return [("web/app.ts", ".", "web/index.ts"), ("web/index.ts", "./math", "web/math.ts"), ("web/index.ts", "./more", "web/more.ts"), ("web/deep/use.ts", "@sums", "web/math.ts"), ("web/deep/use.ts", "@m/more", "web/more.ts")]

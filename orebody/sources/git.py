"""Partitioned readers over a git object store. The git binary does the reading; tasks run one process per partition.

The repository folder must be readable on the executors (a shared mount or a
clone at the same path). Lists of names (commits, files, tags) are made on the
driver by one git call; contents are only ever read in tasks.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orebody.functions.paths import entry_type, peeled_commit, ref_kind

ZERO = "0" * 40
COMMITS = "commit_sha string, tree_sha string, parents array<string>, author_name string, author_email string, authored_at_epoch long, authored_at_offset_minutes int, committer_name string, committer_email string, committed_at_epoch long, committed_at_offset_minutes int, encoding string, is_signed boolean, message string"
CHANGES = "commit_sha string, change_type string, path string, src_mode string, dst_mode string, src_blob_sha string, dst_blob_sha string, added_lines int, removed_lines int, hunks array<struct<old_start: int, old_lines: int, new_start: int, new_lines: int>>"


def git(repo: str, *args: str, data: bytes | None = None, check: bool = True) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], input=data, capture_output=True, check=check).stdout


def text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


class Objects:
    """One ``cat-file --batch`` process: contents by object name."""

    def __init__(self, repo: str):
        self.p = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def get(self, name: str) -> tuple[str, bytes] | None:
        self.p.stdin.write(name.encode() + b"\n")
        self.p.stdin.flush()
        head = self.p.stdout.readline().split()
        if len(head) < 3:
            return None
        body = self.p.stdout.read(int(head[2]))
        self.p.stdout.read(1)
        return head[1].decode(), body

    def close(self) -> None:
        self.p.stdin.close()
        self.p.wait()


def _spread(spark: SparkSession, rows: list[tuple], schema: str, key: str, parts: int | None = None) -> DataFrame:
    """A list of names as a DataFrame dealt over the cluster."""
    n = parts or max(1, min(spark.sparkContext.defaultParallelism * 4, len(rows) // 16 + 1))
    return spark.createDataFrame(rows, schema).repartition(n, key)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _map(df: DataFrame, schema: str, each, chunk: int = 256) -> DataFrame:
    """Apply ``each(rows, emit)`` per partition with one list of output rows at a time."""
    kind = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in each(r for b in batches for r in b.to_pylist()):
            held.append(row)
            if len(held) >= chunk:
                yield _batch(held, kind)
                held = []
        yield _batch(held, kind)

    return df.mapInArrow(run, schema)


# -- commits --------------------------------------------------------------------------------------


def head_sha(repo: str) -> str:
    return git(repo, "rev-parse", "HEAD").decode().strip()


def commit_names(spark: SparkSession, repo: str, tips: list[str], hidden: list[str] = ()) -> DataFrame:
    """Commits reachable from ``tips`` and not from ``hidden``."""
    names = git(repo, "rev-list", "--stdin", data="\n".join([*tips, *(f"^{h}" for h in hidden)]).encode() + b"\n").decode().split()
    return _spread(spark, [(n,) for n in names], "commit_sha string", "commit_sha")


_PERSON = re.compile(rb"^(.*?) ?<(.*?)> (-?\d+) ([+-]?\d+)\s*$", re.DOTALL)


def parse_person(raw: bytes) -> tuple[str, str, int, int]:
    """Name, address, seconds and offset in minutes of an author or committer line."""
    m = _PERSON.match(raw)
    if not m:
        return text(raw), "", 0, 0
    zone = int(m[4])
    return text(m[1].strip()), text(m[2]), int(m[3]), (1 if zone >= 0 else -1) * (abs(zone) // 100 * 60 + abs(zone) % 100)


def parse_commit(sha: str, raw: bytes) -> tuple:
    head, _, message = raw.partition(b"\n\n")
    tree, parents, people, encoding, signed = "", [], {}, None, False
    for line in head.split(b"\n"):
        key, _, value = line.partition(b" ")
        if key == b"tree":
            tree = value.decode()
        elif key == b"parent":
            parents.append(value.decode())
        elif key in (b"author", b"committer") and key not in people:
            people[key] = parse_person(value)
        elif key == b"encoding":
            encoding = text(value)
        elif key.startswith(b"gpgsig"):
            signed = True
    author, committer = people.get(b"author", ("", "", 0, 0)), people.get(b"committer", ("", "", 0, 0))
    return (sha, tree, parents, *author, *committer, encoding, signed, text(message))


def commits(names: DataFrame, repo: str) -> DataFrame:
    def each(rows):
        objects = Objects(repo)
        for r in rows:
            found = objects.get(r["commit_sha"])
            if found and found[0] == "commit":
                yield parse_commit(r["commit_sha"], found[1])
        objects.close()

    return _map(names, COMMITS, each)


# -- changes --------------------------------------------------------------------------------------

_HUNK = re.compile(rb"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_DIFF = ["diff-tree", "--stdin", "-r", "--root", "--no-renames", "--no-ext-diff", "--no-textconv", "--no-color"]


def parse_patch(lines: list[bytes]) -> tuple[int | None, int | None, list[tuple]]:
    """Added and removed lines and hunks of one patch section; nulls for binary contents."""
    hunks = []
    for line in lines:
        if line.startswith(b"Binary files "):
            return None, None, []
        if m := _HUNK.match(line):
            hunks.append((int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)))
    return sum(h[3] for h in hunks), sum(h[1] for h in hunks), hunks


def blob_diff(repo: str, src: str, dst: str) -> tuple[int | None, int | None, list[tuple]]:
    return parse_patch(git(repo, "diff", "--no-ext-diff", "--no-textconv", "--no-color", "-U0", src, dst, check=False).split(b"\n"))


def _raw_entries(out: bytes) -> dict[str, list[tuple]]:
    """Per commit the raw entries of ``diff-tree -z``."""
    found: dict[str, list[tuple]] = {}
    now, fields, k = "", out.split(b"\0"), 0
    while k < len(fields):
        f = fields[k]
        if f.startswith(b":"):
            a, b, x, y, kind = f[1:].decode().split(" ")
            found[now].append((kind[0], text(fields[k + 1]), a, b, x, y))
            k += 2
        else:
            if f:
                now = f.decode().strip()
                found.setdefault(now, [])
            k += 1
    return found


def _sections(out: bytes) -> dict[str, list[list[bytes]]]:
    """Per commit the patch sections of ``diff-tree -p``; content lines always carry a sign in front."""
    found: dict[str, list[list[bytes]]] = {}
    now = ""
    for line in out.split(b"\n"):
        if line.startswith(b"diff --git "):
            found[now].append([])
        elif len(line) == 40 and re.fullmatch(rb"[0-9a-f]{40}", line):
            now = line.decode()
            found.setdefault(now, [])
        elif line.startswith((b"@@ ", b"Binary files ")) and found.get(now):
            found[now][-1].append(line)
    return found


def changes(named: DataFrame, repo: str, group: int = 64) -> DataFrame:
    """Changes of each commit against its first parent; ``named``: commit_sha, parent (null at a root). No renames yet."""

    def each(rows):
        rows = list(rows)
        for k in range(0, len(rows), group):
            part = rows[k : k + group]
            feed = "".join(f"{r['commit_sha']} {r['parent'] or ''}".rstrip() + "\n" for r in part).encode()
            raw = _raw_entries(git(repo, *_DIFF, "--raw", "-z", "--abbrev=40", data=feed))
            patches = _sections(git(repo, *_DIFF, "-p", "-U0", data=feed))
            for r in part:
                sha = r["commit_sha"]
                queue = iter(patches.get(sha, []))
                for kind, path, a, b, x, y in raw.get(sha, []):
                    section = next(queue, [])
                    if kind == "T":  # shown as a deletion and an addition
                        next(queue, [])
                    if "160000" in (a, b):
                        told = (None, None, [])
                    elif kind == "T":
                        told = blob_diff(repo, x, y)
                    else:
                        told = parse_patch(section)
                    hunks = [dict(zip(("old_start", "old_lines", "new_start", "new_lines"), h, strict=True)) for h in told[2]]
                    yield (sha, kind, path, a, b, x, y, told[0], told[1], hunks)

    return _map(named.select("commit_sha", "parent"), CHANGES, each)


def redo_diffs(pairs: DataFrame, repo: str) -> DataFrame:
    """(src_blob_sha, dst_blob_sha, added_lines, removed_lines, hunks) of distinct blob pairs, for renamed files."""
    schema = "src_blob_sha string, dst_blob_sha string, added_lines int, removed_lines int, hunks array<struct<old_start: int, old_lines: int, new_start: int, new_lines: int>>"

    def each(rows):
        for r in rows:
            added, removed, hunks = blob_diff(repo, r["src_blob_sha"], r["dst_blob_sha"])
            yield (r["src_blob_sha"], r["dst_blob_sha"], added, removed, [dict(zip(("old_start", "old_lines", "new_start", "new_lines"), h, strict=True)) for h in hunks])

    return _map(pairs.select("src_blob_sha", "dst_blob_sha").distinct(), schema, each)


# -- trees and blobs ------------------------------------------------------------------------------


def head_entries(spark: SparkSession, repo: str, rev: str = "HEAD") -> DataFrame:
    """(path, mode, entry_type, blob_sha, size) of all entries at ``rev``."""
    rows = []
    for entry in git(repo, "ls-tree", "-r", "-l", "-z", rev).split(b"\0"):
        if entry:
            meta, path = entry.split(b"\t", 1)
            mode, _, sha, size = meta.decode().split()
            rows.append((text(path), mode, sha, None if size == "-" else int(size)))
    return _spread(spark, rows, "path string, mode string, blob_sha string, size long", "path").select("path", "mode", entry_type(F.col("mode")).alias("entry_type"), "blob_sha", "size")


def read_blobs(names: DataFrame, repo: str) -> DataFrame:
    """``names`` (with blob_sha) plus ``bytes``; names that are no blob are left out."""
    schema = names.select(*names.columns, F.lit(None).cast("binary").alias("bytes")).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    cols = names.columns

    def each(rows):
        objects = Objects(repo)
        for r in rows:
            found = objects.get(r["blob_sha"])
            if found and found[0] == "blob":
                yield (*(r[c] for c in cols), found[1])
        objects.close()

    return _map(names, ddl, each, chunk=32)


def all_blobs(spark: SparkSession, repo: str) -> DataFrame:
    """blob_sha of every blob in the object store."""
    out = git(repo, "cat-file", "--batch-all-objects", "--batch-check=%(objectname) %(objecttype)").decode().split("\n")
    return _spread(spark, [(x.split()[0],) for x in out if x.endswith(" blob")], "blob_sha string", "blob_sha")


def tree_objects(trees: DataFrame, repo: str, most: int = 4096) -> DataFrame:
    """Entries of all distinct trees below the given roots (tree_sha), level by level."""
    from orebody.storage import durable

    schema = "tree_sha string, seq int, name string, mode string, entry_sha string"

    def each(rows):
        objects = Objects(repo)
        for r in rows:
            found = objects.get(r["tree_sha"])
            body, seq = found[1] if found else b"", 0
            while body:
                mode, _, rest = body.partition(b" ")
                name, _, rest = rest.partition(b"\0")
                yield (r["tree_sha"], seq, text(name), mode.decode().zfill(6), rest[:20].hex())
                body, seq = rest[20:], seq + 1
        objects.close()

    level = trees.select("tree_sha").distinct()
    done = None
    for _ in range(most):
        rows = durable(_map(level, schema, each), "trees")
        done = rows if done is None else done.unionByName(rows)
        level = durable(rows.filter("mode = '040000'").select(F.col("entry_sha").alias("tree_sha")).distinct().join(done.select("tree_sha").distinct(), "tree_sha", "left_anti"), "level")
        if level.isEmpty():
            return done.select("tree_sha", "seq", "name", "mode", entry_type(F.col("mode")).alias("entry_type"), "entry_sha")
    raise RuntimeError("trees deeper than the bound")


# -- blame ----------------------------------------------------------------------------------------

_HEADER = re.compile(rb"^([0-9a-f]{40}) \d+ (\d+)")


def parse_blame(out: bytes) -> Iterator[tuple[int, str]]:
    """(line, commit) of ``blame --porcelain``: headers stand before every line, contents after a tab."""
    for line in out.split(b"\n"):
        if not line.startswith(b"\t") and (m := _HEADER.match(line)):
            yield int(m[2]), m[1].decode()


def blame(files: DataFrame, repo: str) -> DataFrame:
    """(rev, path, line_number, commit_sha); ``files``: rev, path."""

    def each(rows):
        for r in rows:
            for line, sha in parse_blame(git(repo, "blame", "--porcelain", r["rev"], "--", r["path"], check=False)):
                yield (r["rev"], r["path"], line, sha)

    return _map(files.select("rev", "path"), "rev string, path string, line_number int, commit_sha string", each, chunk=4096)


# -- refs, notes, submodules ----------------------------------------------------------------------

_REF = ["refname", "objectname", "objecttype", "*objectname", "*objecttype", "symref", "tagger", "creatordate:unix", "contents:subject", "contents:body"]
_RAW_REFS = "name string, object_sha string, object_type string, target_sha string, target_type string, symref string, tagger string, created long, subject string, body string"
_TAGGER = r"^(.*?) ?<(.*)> (-?\d+) [+-]\d+$"


def listed_refs(spark: SparkSession, repo: str, *spaces: str) -> DataFrame:
    """The refs below ``spaces`` as git knows them, from one call; fields end with a zero byte, which none of them can hold."""
    out = git(repo, "for-each-ref", "--format=" + "".join(f"%({f})%00" for f in _REF), *spaces)
    cells = text(out).split("\0")
    rows = []
    for k in range(0, len(cells) - len(_REF), len(_REF)):
        name, *rest = cells[k : k + len(_REF)]
        rows.append((name.lstrip("\n"), *rest[:6], int(rest[6]) if rest[6] else None, *rest[7:]))
    return spark.createDataFrame(rows, _RAW_REFS)


def refs(spark: SparkSession, repo: str) -> DataFrame:
    """One row per ref, and HEAD where it is symbolic (its target stands as the subject)."""
    raw = listed_refs(spark, repo)
    at = text(git(repo, "symbolic-ref", "-q", "HEAD", check=False)).strip()
    if at:
        raw = raw.unionByName(spark.createDataFrame([("HEAD", head_sha(repo), "commit", "", "", at, "", None, at, "")], _RAW_REFS))
    symbolic, some = F.col("symref") != "", lambda c: F.nullif(F.trim(c), F.lit(""))
    tagger = lambda k: some(F.regexp_extract("tagger", _TAGGER, k))
    kind, peeled = ref_kind(F.col("name"), F.col("object_type"), symbolic), peeled_commit(F.col("object_type"), F.col("object_sha"), F.col("target_type"), F.col("target_sha"))
    body = F.when(F.col("object_type") == "tag", F.nullif(F.regexp_replace("body", r"^\s+|\s+$", ""), F.lit("")))
    return raw.select(
        "name", kind.alias("kind"), "object_sha", peeled.alias("peeled_commit_sha"), symbolic.alias("is_symbolic"), tagger(1).alias("tagger_name"), tagger(2).alias("tagger_email"),
        tagger(3).cast("long").alias("tagged_at_epoch"), some(F.col("subject")).alias("tag_subject"), body.alias("tag_body"),
    )


def notes(spark: SparkSession, repo: str) -> DataFrame:
    rows = []
    for name in text(git(repo, "for-each-ref", "--format=%(refname)", "refs/notes")).split():
        for line in text(git(repo, "notes", f"--ref={name}", "list", check=False)).split("\n"):
            if len(parts := line.split()) == 2:
                rows.append((name, parts[1], parts[0]))
    listed = spark.createDataFrame(rows, "notes_ref string, target_sha string, blob_sha string")
    return read_blobs(listed, repo).select("notes_ref", "target_sha", F.col("blob_sha").alias("note_sha"), F.decode("bytes", "UTF-8").alias("body"))


def submodules(spark: SparkSession, repo: str) -> DataFrame:
    """Declared submodules and pinned links, matched by path from both sides."""
    by_name: dict[str, dict[str, str]] = {}
    for record in text(git(repo, "config", "--blob", "HEAD:.gitmodules", "-l", "-z", check=False)).split("\0"):
        key, _, value = record.partition("\n")
        if key.startswith("submodule."):
            name, _, field = key.removeprefix("submodule.").rpartition(".")
            by_name.setdefault(name, {})[field] = value
    rows = [(d["path"], n, d.get("url"), d.get("branch"), True) for n, d in sorted(by_name.items()) if "path" in d]
    declared = spark.createDataFrame(list({r[0]: r for r in rows}.values()), "path string, name string, url string, branch string, in_gitmodules boolean")
    links = head_entries(spark, repo).filter("mode = '160000'").select("path", F.col("blob_sha").alias("pinned_sha"), F.lit(True).alias("in_tree"))
    no = F.lit(False)
    return declared.join(links, "path", "full_outer").select("path", "name", "url", "branch", "pinned_sha", F.coalesce("in_gitmodules", no).alias("in_gitmodules"), F.coalesce("in_tree", no).alias("in_tree"))


# -- selection ------------------------------------------------------------------------------------

ACTIVE_DAYS = 90
_US = "\x1f"


def select_refs(repo: str, mode: str = "head", days: int = ACTIVE_DAYS) -> tuple[list[str], list[str]]:
    """(tips, deferred branch names): HEAD alone, all branches, or those within ``days`` of the newest tip; HEAD's tip first."""
    head = head_sha(repo)
    if mode == "head":
        return [head], []
    lines = text(git(repo, "for-each-ref", "--format=%(refname)" + _US + "%(objectname)" + _US + "%(committerdate:unix)", "refs/heads", "refs/remotes")).split("\n")
    tips = [(n, s, int(t or 0)) for n, s, t in (x.split(_US) for x in lines if x)]
    newest = max((t for _, _, t in tips), default=0)
    live = [x for x in tips if mode == "all" or newest - x[2] <= days * 86400]
    kept = {n for n, _, _ in live}
    return list(dict.fromkeys([head, *(s for _, s, _ in live)])), [n for n, _, _ in tips if n not in kept]


SNAPSHOT_TAGS = 20


def snapshot_targets(spark: SparkSession, repo: str, spec: str | None = None, most: int = SNAPSHOT_TAGS) -> list[tuple[str, str]]:
    """(label, commit) to blame: ``tags``, ``tags:n`` or a comma list of revisions; each commit once, tags newest first."""
    kind, _, count = (spec or "").strip().partition(":")
    if kind.strip() == "tags":
        sha = peeled_commit(F.col("object_type"), F.col("object_sha"), F.col("target_type"), F.col("target_sha"))
        tags = listed_refs(spark, repo, "refs/tags").select(F.expr("substring(name, 11)").alias("label"), sha.alias("sha"), "created", "name").filter("sha is not null")
        newest = [F.desc("created"), F.col("name")]
        first = tags.withColumn("nth", F.row_number().over(W.partitionBy("sha").orderBy(*newest))).filter("nth = 1")
        return [(r.label, r.sha) for r in first.orderBy(*newest).limit(int(count) if count.strip().isdigit() else most).collect()]
    labels = [x.strip() for x in (spec or "").split(",") if x.strip() and "\n" not in x]
    told = git(repo, "cat-file", "--batch-check", data="".join(f"{x}^{{commit}}\n" for x in labels).encode()).decode().splitlines() if labels else []
    found = {line.split()[0]: label for label, line in reversed(list(zip(labels, told, strict=True))) if line.split()[1:2] == ["commit"]}
    return [(label, sha) for label, sha in sorted(((v, k) for k, v in found.items()), key=lambda x: labels.index(x[0]))]


def is_ancestor(repo: str, old: str, new: str) -> bool:
    return subprocess.run(["git", "-C", repo, "merge-base", "--is-ancestor", old, new], capture_output=True).returncode == 0


def changed_paths(repo: str, old: str, new: str) -> list[str]:
    return [text(p) for p in git(repo, "diff", "--name-only", "--no-renames", "-z", old, new).split(b"\0") if p]

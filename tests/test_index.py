import subprocess

import pytest
from pyspark.sql import functions as F

from orebody.plans import build, render, surfaces, views
from orebody.schema import SCHEMAS
from orebody.sources import git, index, sample


def out(repo, *args):
    return subprocess.run(["git", "-C", str(repo), *args], check=True, capture_output=True, text=True).stdout


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    return sample.build(tmp_path_factory.mktemp("git") / "r")


@pytest.fixture(scope="module")
def card(spark, repo, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index") / "i")
    made = build.build_index(spark, str(repo.path), folder, build.Options(level="high"))
    return made | {"folder": folder}


@pytest.fixture(scope="module")
def t(spark, card):
    return build.open_index(spark, card["folder"])


def test_all_tables_are_written(card):
    assert card["table_count"] == 41 and card["mode"] == "full"
    for told in card["tables"]:
        assert told["columns"] == SCHEMAS[told["name"]].names


def test_commits_match_git(t, repo):
    shas = set(out(repo.path, "rev-list", "--branches").split())
    assert {r.commit_sha for r in t["commits"].collect()} == shas
    for r in t["commits"].collect():
        name, mail, at, n = out(repo.path, "show", "-s", "--format=%s%x1f%ae%x1f%at%x1f%P", r.commit_sha).strip("\n").split("\x1f")
        assert (r.subject, r.author_id, r.authored_at_epoch, r.parent_count, r.authored_at_offset_minutes) == (name, mail.lower(), int(at), len(n.split()), 120)


def test_changes_match_git(t, repo):
    got = {}
    for r in t["commit_files"].join(t["files"], "file_id").collect():
        got.setdefault(r.commit_sha, {})[r.path] = (r.change_type, r.added_lines, r.removed_lines)
    for r in t["commits"].filter("not is_merge").collect():
        want = {}
        for line in out(repo.path, "show", "--format=", "--numstat", "--no-renames", "--root", r.commit_sha).splitlines():
            a, d, p = line.split("\t")
            want[p] = (None if a == "-" else int(a), None if d == "-" else int(d))
        mine = got.get(r.commit_sha, {})
        for p, (kind, a, d) in mine.items():
            if kind in ("A", "M") and p != "sub/mod":
                assert want[p] == (a, d), (p, want[p])
        renamed = sum(k == "R" for k, _, _ in mine.values())
        assert len(mine) == len(want) - renamed


def test_renames_hunks_modes(t):
    rows = {r.path: r for r in views.v_changes(t).filter("change_type = 'R'").collect()}
    assert rows["src/b.txt"].old_path == "src/a.txt" and (rows["src/b.txt"].added_lines, rows["src/b.txt"].removed_lines) == (1, 1)
    assert rows["src/b.txt"].similarity == 98 and rows["kept.txt"].similarity == 100
    flip = t["commit_files"].join(t["files"], "file_id").filter("path = 'crlf.txt' and dst_mode = '100755' and src_mode = '100644'").first()
    assert (flip.change_type, flip.added_lines) == ("M", 0)
    assert t["merge_changes"].filter("path = 'yarn.lock'").first().added_lines == 1
    hunk = t["hunks"].join(t["files"], "file_id").filter("path = 'src/b.txt'").first()
    assert (hunk.old_start, hunk.old_lines, hunk.new_start, hunk.new_lines) == (8, 1, 8, 1)


def test_blame_matches_git(t, repo):
    got = {}
    for r in t["blame"].join(t["files"], "file_id").collect():
        got.setdefault(r.path, {})[r.line_number] = r.commit_sha
    for p in ("src/b.txt", "kept.txt", "crlf.txt", "yarn.lock", "src/side.txt", "lib/util.py"):
        want = {i + 1: line.split()[0].lstrip("^") for i, line in enumerate(out(repo.path, "blame", "-l", "--root", "HEAD", "--", p).splitlines())}
        assert got[p] == want, p
    assert "empty.txt" not in got and "bin.dat" not in got


def test_refs_notes_trees(t, repo):
    refs = {r.name: r for r in t["refs"].collect()}
    head = out(repo.path, "rev-parse", "HEAD").strip()
    assert refs["refs/tags/v1"].kind == "tag-annotated" and refs["refs/tags/v1"].tag_body == "Tag body" and refs["refs/tags/light"].kind == "tag-lightweight"
    assert refs["HEAD"].object_sha == head and refs["HEAD"].tag_subject == "refs/heads/main"
    assert t["notes"].first().body == "a note\n"
    sub = t["submodules"].first()
    assert (sub.path, sub.pinned_sha, sub.in_gitmodules, sub.in_tree) == ("sub/mod", "1" * 40, True, True)
    tree = {r.path: (r.mode, r.blob_sha) for r in t["tree_entries"].collect()}
    for line in out(repo.path, "ls-tree", "-r", "HEAD").splitlines():
        meta, path = line.split("\t")
        assert tree[path] == (meta.split()[0], meta.split()[2])
    root = t["commit_trees"].filter(F.col("commit_sha") == head).first().root_tree_sha
    names = {r.name for r in t["tree_objects"].filter(F.col("tree_sha") == root).collect()}
    assert names == set(out(repo.path, "ls-tree", "--name-only", "HEAD").split())


def test_people(t):
    ann = {r.author_id: r.identity_id for r in t["authors"].collect()}
    assert ann["ann@x.example"] == ann["5+annlee@users.noreply.github.com"] and ann["bob@x.example"] == ann["bob@y.example"]
    assert {r.method for r in t["identity_aliases"].collect()} == {"name-exact"}
    trailers = [(r.seq, r.key, r.value) for r in t["commit_trailers"].orderBy("seq").collect()]
    assert trailers == []  # a key may not hold a blank, and one line that is no trailer empties the block


def test_content_tables(t):
    path = dict((r.file_id, r.path) for r in t["files"].collect())
    assert {path[r.file_id]: r.reason for r in t["generated_files"].collect()} == {"yarn.lock": "lockfile", "vendor/v.c": "vendored-dir", "gen.py": "content-marker"}
    mark = t["code_markers"].first()
    assert (path[mark.file_id], mark.line, mark.marker, mark.text) == ("lib/util.py", 2, "TODO", "tidy")
    assert {(r.name, r.version, r.scope) for r in t["dependencies"].collect()} == {("left", "^1.0", "runtime"), ("right", "2", "dev")}
    cover = t["test_coverage"].first()
    assert (path[cover.test_file_id], path[cover.source_file_id], cover.method) == ("lib/test_util.py", "lib/util.py", "same_dir")
    facts = {r.blob_sha: r for r in t["blob_facts"].collect()}
    sha = {r.path: r.blob_sha for r in t["tree_entries"].collect()}
    assert facts[sha["bin.dat"]].is_binary and facts[sha["kept.txt"]].line_count == 2 and facts[sha["empty.txt"]].line_count == 0


def test_code_graph(t):
    refs = {(r.ref_path, r.name): r.def_path for r in views.v_references(t).collect()}
    assert refs["lib/util.py", "helper"] == "lib/util.py" and refs["lib/test_util.py", "helper"] == "lib/util.py"
    assert refs["web/app.ts", "plus"] == "web/math.ts" and refs["web/app.ts", "twice"] == "web/more.ts"
    assert ("web/app.ts", "far") not in refs and refs["web/app.ts", "far2"] == "web/app.ts"
    edge = t["symbol_edges"].filter("dst_name = 'helper' and src_name = 'get'").first()
    assert edge.src_kind == "function" and edge.dst_start_line == 1


def test_snapshots_and_chunks(t):
    assert {r.snapshot_ref for r in t["blame_snapshots"].select("snapshot_ref").distinct().collect()} == {"v1", "light"}
    shares = t["snapshot_ownership"].groupBy("snapshot_ref").agg(F.sum("ownership_share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in shares)
    sizes = t["blob_chunks"].join(t["chunks"], "chunk_hash").filter(t["blob_chunks"]["size"] != t["chunks"]["size"])
    assert sizes.count() == 0
    refs = t["blob_chunks"].groupBy("chunk_hash").count().join(t["chunks"], "chunk_hash").filter("count <> ref_count")
    assert refs.count() == 0


def test_ownership_invariants(t):
    shares = t["file_ownership"].groupBy("file_id").agg(F.sum("ownership_share").alias("s"), F.min("ownership_share").alias("m")).collect()
    assert shares and all(0 < r.m and r.s <= 1 + 1e-9 for r in shares)


def test_surfaces_and_sql(spark, t):
    env = surfaces.envelope("ownership", t, path="src", limit=1)
    assert env["rows"][0]["author_name"] and env["row_count"] == 1 and env["truncated"]
    assert "Who owns src" in render.render(env)
    for name, params in {"reviewers": {"path": "src"}, "blast_radius": {"path": "src"}, "activity": {"days": 30}, "contributors": {}, "search": {"query": "helper"}, "graph": {}, "dependencies": {"query": "npm"}, "risks": {}, "markers": {"path": "lib"}}.items():
        env = surfaces.envelope(name, t, **params)
        assert render.render(env).startswith("## ")
    assert surfaces.envelope("search", t, query="helper")["rows"][0]["rank"] == 3
    assert views.sql(spark, t, "SELECT count(*) AS n FROM v_commits WHERE is_merge").first().n == 1


def comparable(tables):
    """Rows by natural keys, without ids."""
    path = {r.file_id: r.path for r in tables["files"].collect()}
    mail = {r.identity_id: r.email for r in tables["identities"].collect()}
    swap = {"file_id": path, "old_path_id": path, "def_file_id": path, "src_file_id": path, "dst_file_id": path, "from_file_id": path, "to_file_id": path, "file_a_id": path, "file_b_id": path, "test_file_id": path, "source_file_id": path, "identity_id": mail, "identity_a": mail, "identity_b": mail}
    skip = {"files", *index.KEEP_IF_EMPTY}
    return {n: sorted(str(sorted((k, swap[k].get(v) if k in swap else v) for k, v in r.asDict().items())) for r in tables[n].collect()) for n in SCHEMAS if n not in skip}


def test_update_equals_full_run(spark, tmp_path):
    r = sample.build(tmp_path / "r")
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    assert build.build_index(spark, str(r.path), one)["mode"] == "full"
    sample.later(r)
    assert build.build_index(spark, str(r.path), one)["mode"] == "incremental"
    assert build.build_index(spark, str(r.path), two, build.Options(full=True))["mode"] == "full"
    a, b = comparable(index.read_index(spark, one)), comparable(index.read_index(spark, two))
    for name in a:
        assert a[name] == b[name], name


def test_manifest_gate(spark, tmp_path):
    folder = str(tmp_path)
    assert index.manifest(spark, folder) is None
    index.write_text(spark, f"{folder}/manifest.json", '{"head_sha": "x"}')
    assert index.manifest(spark, folder) is None
    index.write_text(spark, f"{folder}/manifest.json", '{"head_sha": "x", "schema_version": 2}')
    assert index.manifest(spark, folder)["head_sha"] == "x"


def test_selection(spark, repo):
    tips, deferred = git.select_refs(str(repo.path), "active", days=3)
    assert tips[0] == git.head_sha(str(repo.path)) and "refs/heads/old" in deferred
    assert len(git.select_refs(str(repo.path), "all")[0]) >= 2
    assert [x[0] for x in git.snapshot_targets(spark, str(repo.path), "tags:1")] == ["v1"]
    assert git.snapshot_targets(spark, str(repo.path), "HEAD,main,nothing")[0][0] == "HEAD"


def test_levels():
    assert [build.level_of(x) for x in ("basic", " HIGH ", "x", None)] == ["basic", "high", "mid", "mid"]
    assert [build.suggest(*x) for x in ((300_000, 1), (1000, 100), (5000, 100), (10, 50_000))] == ["basic", "high", "mid", "basic"]

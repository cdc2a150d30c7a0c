"""Index tables fed from a star-schema of other tables, so derived tables run and can be checked on any data.

The texts are plain SQL that other engines read as well: a name in braces is a
source table, ``EPOCH(x)`` stands for the seconds of a timestamp.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

_WHO = """CASE WHEN {k} % 11 = 0 THEN CAST({k} AS STRING) || '+login' || CAST({k} % 90 AS STRING) || '@users.noreply.github.com'
 WHEN {k} % 13 = 0 THEN 'name' || CAST({k} % 40 AS STRING) || '@h' || CAST({k} % 7 AS STRING) || '.example'
 ELSE 'dev' || CAST({k} % 700 AS STRING) || '@mail' || CAST({k} % 4 AS STRING) || '.example' END"""
_NAME = """'Given' || CAST({k} % 29 AS STRING) || ' ' || CASE WHEN {k} % 5 = 0 THEN 'Mid ' ELSE '' END || 'Family' || CAST({k} % 23 AS STRING)"""

ADAPTERS: dict[str, str] = {
    "commits": """SELECT CAST(o_orderkey AS STRING) AS commit_sha, CAST(o_custkey AS STRING) AS author_id, EPOCH(o_orderdate) AS authored_at_epoch,
 CAST((o_orderkey % 24) * 60 - 720 AS INT) AS authored_at_offset_minutes, CAST(o_custkey AS STRING) AS committer_id, EPOCH(o_orderdate) + o_orderkey % 1000 AS committed_at_epoch,
 CAST(0 AS INT) AS committed_at_offset_minutes, CASE o_orderkey % 18 WHEN 14 THEN 'feat!!: ' WHEN 15 THEN 'feat( core ): ' WHEN 16 THEN 'Feat(x) !: ' WHEN 17 THEN '  fixed it ' WHEN 0 THEN 'feat(core)!: add ' WHEN 1 THEN 'Fix: the ' WHEN 2 THEN 'docs(readme): ' WHEN 3 THEN 'Added new ' WHEN 4 THEN 'bump ' WHEN 5 THEN 'Cleanup of '
 WHEN 6 THEN 'perf : ' WHEN 7 THEN '  speed up ' WHEN 8 THEN 'wip(x): ' WHEN 9 THEN 'Merge branch ' WHEN 10 THEN 'refactor(a(b))!: ' WHEN 11 THEN '' WHEN 12 THEN 'Testing ' ELSE 'update: ' END || o_orderpriority AS subject,
 CAST(CASE WHEN o_orderkey % 13 = 0 THEN 2 ELSE 1 END AS INT) AS parent_count, o_orderkey % 13 = 0 AS is_merge, o_orderkey = 1 AS is_root FROM {orders}""",
    "authors": "SELECT CAST(c_custkey AS STRING) AS author_id, c_name AS name, lower(c_name) || '@a.example' AS email, CASE WHEN c_custkey % 50 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(c_nationkey AS BIGINT) + 1 END AS identity_id FROM {customer}",
    "identities": "SELECT CAST(n_nationkey AS BIGINT) + 1 AS identity_id, CASE n_nationkey WHEN 3 THEN '' WHEN 4 THEN 'dependabot' ELSE n_name END AS name, CASE WHEN n_nationkey = 5 THEN '' ELSE lower(n_name) || '@n.example' END AS email, CAST(1.0 AS DOUBLE) AS confidence, CAST(1 AS INT) AS alias_count FROM {nation}",
    "files": """SELECT p_partkey AS file_id, lower(replace(p_brand, '#', '/')) || CASE p_partkey % 17 WHEN 0 THEN '/vendor' WHEN 1 THEN '/tests' WHEN 2 THEN '/a/b' ELSE '' END ||
 CASE p_partkey % 19 WHEN 0 THEN '/yarn.lock' WHEN 1 THEN '/x' || CAST(p_partkey % 60 AS STRING) || '.min.js' WHEN 2 THEN '/api_pb2.py' WHEN 3 THEN '/m' || CAST(p_partkey % 60 AS STRING) || '.test.ts' WHEN 4 THEN '/test_m' || CAST(p_partkey % 60 AS STRING) || '.py'
 WHEN 5 THEN '/m' || CAST(p_partkey % 60 AS STRING) || '_test.go' WHEN 6 THEN '/M' || CAST(p_partkey % 60 AS STRING) || 'Tests.java' WHEN 7 THEN '/M' || CAST(p_partkey % 60 AS STRING) || '.java' WHEN 8 THEN '/m' || CAST(p_partkey % 60 AS STRING) || '.go'
 WHEN 9 THEN '/m' || CAST(p_partkey % 60 AS STRING) || '.py' WHEN 10 THEN '/m' || CAST(p_partkey % 60 AS STRING) || '.ts' WHEN 11 THEN '/view.generated.ts' ELSE '/f' || CAST(p_partkey AS STRING) || '.c' END AS path FROM {part}""",
    "commit_files": """SELECT CAST(l_orderkey AS STRING) AS commit_sha, l_partkey AS file_id, CASE WHEN l_returnflag = 'R' THEN l_suppkey ELSE CAST(NULL AS BIGINT) END AS old_path_id,
 CASE l_returnflag WHEN 'N' THEN 'M' ELSE l_returnflag END AS change_type, CASE WHEN l_returnflag = 'R' THEN CAST(50 + l_suppkey % 51 AS INT) ELSE CAST(NULL AS INT) END AS similarity,
 CASE WHEN l_linenumber = 7 THEN CAST(NULL AS INT) ELSE CAST(l_quantity AS INT) END AS added_lines, CASE WHEN l_linenumber = 7 THEN CAST(NULL AS INT) ELSE CAST(l_linenumber AS INT) END AS removed_lines FROM {lineitem}""",
    "blame": """SELECT l_partkey AS file_id, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS INT) AS line_number,
 CASE WHEN l_linenumber = 5 THEN 'gone' ELSE CAST(l_orderkey AS STRING) END AS commit_sha FROM {lineitem}""",
    "blame_snapshots": "SELECT 'v' || l_returnflag AS snapshot_ref, 's' || l_linestatus AS snapshot_sha, CAST(l_partkey AS STRING) AS path, CAST(l_linenumber AS INT) AS line_number, CASE WHEN l_linenumber = 5 THEN 'gone' ELSE CAST(l_orderkey AS STRING) END AS commit_sha FROM {lineitem}",
    "symbols": """SELECT 1 + (o_orderkey >> 3) AS file_id, 'b' || CAST(o_orderkey >> 3 AS STRING) AS blob_sha, 'fn' || CAST(o_custkey % 400 AS STRING) AS name, CASE o_orderkey % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' ELSE 'type' END AS kind,
 CAST(o_orderkey % 611 AS INT) AS start_line, CAST(o_orderkey % 611 + o_custkey % 35 AS INT) AS end_line, 'py' AS lang FROM {orders}""",
    "symbol_refs": """SELECT 1 + (l_orderkey >> 3) AS file_id, 'b' || CAST(l_orderkey >> 3 AS STRING) AS blob_sha, 'fn' || CAST(l_partkey % 400 AS STRING) AS name, CASE l_linenumber % 3 WHEN 0 THEN 'call' WHEN 1 THEN 'method' ELSE 'new' END AS ref_kind,
 CAST(l_orderkey % 611 + l_partkey % 40 AS INT) AS line, 'py' AS lang, CASE WHEN l_suppkey % 3 = 0 THEN 1 + (l_suppkey * 7) % 150 ELSE CAST(NULL AS BIGINT) END AS def_file_id FROM {lineitem}""",
    "observations": f"SELECT {_WHO.format(k='c_custkey')} AS author_id, {_NAME.format(k='c_custkey')} AS name, {_WHO.format(k='c_custkey')} AS email FROM {{customer}}",
    "dependencies": "SELECT 'pkg/' || CAST(s_suppkey % 9 AS STRING) || '/package.json' AS manifest_path, CASE WHEN s_suppkey % 3 = 0 THEN 'npm' ELSE 'cargo' END AS ecosystem, s_name AS name, '^' || CAST(s_nationkey AS STRING) AS version, CASE WHEN s_suppkey % 4 = 0 THEN 'dev' ELSE 'runtime' END AS scope FROM {supplier}",
    "semantic_refs": "SELECT l_partkey AS file_id, CAST(l_linenumber AS INT) AS line, 'fn' || CAST(l_suppkey % 40 AS STRING) AS name, 'call' AS ref_kind, l_suppkey AS def_file_id, CAST(l_linenumber * 3 AS INT) AS def_line, 'ts' AS lang FROM {lineitem}",
    "secret_texts": """SELECT doc_id AS file_id, text || CASE doc_id % 7 WHEN 0 THEN chr(10) || 'id = AKIA' || repeat('A7', 8) || ';' WHEN 1 THEN chr(10) || '"ghp_' || repeat('a1B', 12) || '"' WHEN 2 THEN chr(10) || 'AIza' || repeat('x-_4Z', 7) WHEN 3 THEN chr(10) || 'xoxb-' || repeat('12-', 5) || 'k'
 WHEN 4 THEN chr(10) || 'sk_live_' || repeat('9a', 8) WHEN 5 THEN chr(10) || '-----BEGIN RSA PRIVATE KEY-----' ELSE chr(10) || 'AKIA' || repeat('A', 9) END AS text FROM {documents}""",
    "head_texts": "SELECT doc_id AS file_id, lang || '/' || source || '/' || CAST(doc_id AS STRING) || '.txt' AS path, text FROM {documents}",
    "commit_parents": "SELECT CAST(conv_id AS STRING) || '.' || CAST(turn AS STRING) AS commit_sha, CAST(0 AS INT) AS parent_index, CAST(conv_id AS STRING) || '.' || CAST(turn - 1 AS STRING) AS parent_sha FROM {conversations} WHERE turn > 0",
    "messages": """SELECT CAST(conv_id AS STRING) || '.' || CAST(turn AS STRING) AS commit_sha, CASE turn % 6 WHEN 0 THEN text WHEN 5 THEN ' \t' || text || chr(13) || chr(10) || chr(13) || chr(10) || text || ' ' WHEN 1 THEN 'Subject' || chr(10) || chr(10) || 'Body text.' || chr(10) || chr(10) || 'Signed-off-by: ' || role || chr(10) || ' more' || chr(10) || 'Fixes #12'
 WHEN 2 THEN 'Subject' || chr(10) || chr(10) || 'Reviewed-by: ' || role || chr(10) || 'prose line without a key' WHEN 3 THEN 'S' || chr(10) || chr(10) || 'Acked-by:' || role || chr(10) || '(cherry picked from commit 1)' ELSE 'Only: subject' END AS message FROM {conversations}""",
    "declared": "SELECT 'mod/' || CAST(s_suppkey AS STRING) AS path, s_name AS name, 'https://x.example/' || s_name AS url FROM {supplier} WHERE s_suppkey % 2 = 0",
    "gitlinks": "SELECT 'mod/' || CAST(s_suppkey AS STRING) AS path, 'sha' || CAST(s_nationkey AS STRING) AS pinned_sha FROM {supplier} WHERE s_suppkey % 3 = 0",
    "refs": "SELECT 'refs/heads/' || CAST(c_custkey AS STRING) AS name, max(EPOCH(o_orderdate)) AS tip_epoch FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey",
}

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def for_spark(text: str) -> str:
    return re.sub(r"EPOCH\((\w+)\)", r"unix_seconds(CAST(\1 AS TIMESTAMP))", text)


def portable(text: str) -> str:
    """The same text for an engine where the sources are views of their own names."""
    return re.sub(r"EPOCH\((\w+)\)", r"CAST(epoch(\1) AS BIGINT)", re.sub(r"\{(\w+)\}", r"\1", text))


class Adapted(Mapping):
    """Index tables over the Parquet tables of a folder, made when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder, {}

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            text = ADAPTERS[name]
            used = {s: self.source(s) for s in re.findall(r"\{(\w+)\}", text)}
            self.made[name] = self.spark.sql(for_spark(text), **used)
        return self.made[name]

    def __iter__(self):
        return iter(ADAPTERS)

    def __len__(self) -> int:
        return len(ADAPTERS)


def with_tables(names: list[str], body: str, recursive: bool = False) -> str:
    """``body`` after common table expressions of the named adapters, for the other engine."""
    ctes = ", ".join(f"{n} AS ({portable(ADAPTERS[n])})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {body}" if body.lstrip().startswith(",") is False else f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{body}"

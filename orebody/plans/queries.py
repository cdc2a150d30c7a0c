"""Registered queries of the index operators over adapted tables, with their definitions in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.functions import commits as fc
from orebody.functions import paths as fp
from orebody.functions.content import SECRET_RULES
from orebody.operators import code_graph, content, coupling, identity, insights, ownership, renames
from orebody.plans import surfaces, views
from orebody.plans.adapters import Adapted, with_tables
from orebody.storage import durable

#: Thresholds that leave rows on small tables; the rules are the same.
LOW = insights.Rules(bus_lines=10, bus_share=0.25, area_lines=50, area_share=0.05, hotspot=25, hidden=2, hub=15, fragile=15)
BULK, HUB = 8, 25

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Index(Adapted):
    """Adapted tables plus those derived from them."""

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.made:
            return self.made[name]
        make = {
            "file_ownership": lambda: ownership.file_ownership(self["blame"], self["commits"], self["authors"]),
            "non_authored": lambda: self["files"].filter(fp.generated_reason(F.col("path")).isNotNull()).select("file_id"),
            "area_ownership": lambda: ownership.area_ownership(self["file_ownership"], self["files"], self["non_authored"]),
            "coupling": lambda: coupling.coupling(self["commit_files"], BULK, 2),
            "module_deps": lambda: coupling.module_deps(self["symbol_refs"]),
            "insights": lambda: self.written("non_authored", "file_ownership", "area_ownership", "module_deps") or insights.insights(self["file_ownership"], self["area_ownership"], self["coupling"], self["commit_files"], self["files"], self["identities"], self["module_deps"], self["non_authored"], LOW),
            "code_markers": lambda: content.markers(self["head_texts"], ["file_id"], ["token", "the"]),
            "symbol_edges": lambda: code_graph.symbol_edges(self["symbols"], self["symbol_refs"]),
        }.get(name)
        if make is None:
            return super().__getitem__(name)
        self.made[name] = make()
        return self.made[name]

    def written(self, *names: str) -> None:
        """Tables that several rules read are written once, instead of being made again for each."""
        for name in names:
            self.made[name] = durable(self[name], name)

    def __contains__(self, name: object) -> bool:
        return name in ("file_ownership", "area_ownership", "coupling", "module_deps", "insights", "code_markers", "symbol_edges") or super().__contains__(name)


def query(tables: str = "", sql: str | None = None, recursive: bool = False):
    """Register a function of an Index; ``sql`` is its definition after the named adapters."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, folder: fn(Index(spark, folder))
        QUERIES[fn.__name__].__doc__ = fn.__doc__
        if sql is not None:
            ORACLES[fn.__name__] = with_tables(tables.split(), sql, recursive) if tables else sql
        return fn

    return add


_PERSON = "COALESCE(NULLIF(i.name, ''), a.name) AS author_name, COALESCE(NULLIF(i.email, ''), a.email) AS author_email"
_PEOPLE = "JOIN authors a ON c.author_id = a.author_id LEFT JOIN identities i ON a.identity_id = i.identity_id"
_CI = ", ci AS (SELECT c.commit_sha, a.identity_id FROM commits c JOIN authors a USING (author_id))"
_FO = _CI + """, tot AS (SELECT file_id, count(*) AS file_lines FROM blame GROUP BY 1), fo AS (SELECT b.file_id, ci.identity_id, count(*) AS owned_lines, any_value(tot.file_lines) AS file_lines
 FROM blame b JOIN ci USING (commit_sha) JOIN tot USING (file_id) WHERE ci.identity_id IS NOT NULL GROUP BY 1, 2)"""
_GEN = r"""CASE WHEN regexp_matches(path, '(^|/)(node_modules|bower_components|vendor|vendored|third_party|third-party|Godeps)(/|$)') THEN 'vendored-dir'
 WHEN regexp_matches(path, '(^|/)(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|poetry\.lock|Pipfile\.lock|Gemfile\.lock|composer\.lock|go\.sum|flake\.lock)$') THEN 'lockfile'
 WHEN regexp_matches(path, '\.min\.(js|css)$') THEN 'minified' WHEN path LIKE '%.map' THEN 'sourcemap' WHEN path LIKE '%.snap' THEN 'snapshot'
 WHEN regexp_matches(path, '(\.pb\.go|\.pb\.cc|\.pb\.h|_pb2\.py|_pb2_grpc\.py)$') THEN 'protobuf' WHEN regexp_matches(path, '\.generated\.[^/]*$|(\.g\.dart|\.freezed\.dart|\.designer\.cs|\.g\.cs)$') THEN 'codegen-name' END"""
_NA = f", na AS (SELECT file_id FROM files WHERE {_GEN} IS NOT NULL)"
_AREA = "CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END"
_SMALL = f", small AS (SELECT commit_sha FROM commit_files GROUP BY 1 HAVING count(*) <= {BULK})"
_CO = _SMALL + """, cf AS (SELECT DISTINCT commit_sha, file_id FROM commit_files JOIN small USING (commit_sha)), co AS (SELECT x.file_id AS file_a_id, y.file_id AS file_b_id, count(*) AS co_changes
 FROM cf x JOIN cf y ON x.commit_sha = y.commit_sha AND x.file_id < y.file_id GROUP BY 1, 2 HAVING count(*) >= 2)"""
_DEPS = ", deps AS (SELECT file_id AS from_file_id, def_file_id AS to_file_id, count(*) AS ref_count FROM symbol_refs WHERE def_file_id IS NOT NULL AND def_file_id <> file_id GROUP BY 1, 2)"
_AO = f""", fa AS (SELECT fo.*, {_AREA} AS area FROM fo JOIN files USING (file_id) WHERE file_id NOT IN (SELECT file_id FROM na)),
 ao AS (SELECT area, identity_id, CAST(sum(owned_lines) AS BIGINT) AS owned_lines FROM fa GROUP BY 1, 2), at_ AS (SELECT area, CAST(sum(file_lines) AS BIGINT) AS area_lines FROM (SELECT DISTINCT area, file_id, file_lines FROM fa) GROUP BY 1)"""


@query("blame commits authors identities files", f""", l AS (SELECT b.file_id, {_PERSON}, count(*) AS n FROM blame b JOIN commits c USING (commit_sha) {_PEOPLE} GROUP BY ALL),
 r AS (SELECT *, sum(n) OVER (PARTITION BY file_id) AS total, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, author_email, author_name) AS rk FROM l)
 SELECT path, author_name AS owner_name, author_email AS owner_email, n AS owned_lines, CAST(total AS BIGINT) AS file_lines, round(CAST(n AS DOUBLE) / total, 3) AS ownership FROM r JOIN files USING (file_id) WHERE rk = 1""")
def ownership_top(t):
    return views.v_ownership(t)


@query("commits authors identities", f" SELECT c.commit_sha, c.subject, {_PERSON}, c.authored_at_epoch, c.committed_at_epoch, c.is_merge, c.is_root FROM commits c {_PEOPLE}")
def commits_resolved(t):
    return views.v_commits(t)


@query("commit_files files commits authors identities", f""" SELECT cf.commit_sha, f.path, o.path AS old_path, cf.change_type, cf.similarity, cf.added_lines, cf.removed_lines, {_PERSON}, c.committed_at_epoch
 FROM commit_files cf JOIN files f ON cf.file_id = f.file_id LEFT JOIN files o ON cf.old_path_id = o.file_id JOIN commits c ON cf.commit_sha = c.commit_sha {_PEOPLE}""")
def changes_resolved(t):
    return views.v_changes(t)


@query("blame files commits authors identities", f" SELECT f.path, b.line_number, b.commit_sha, {_PERSON}, c.committed_at_epoch FROM blame b JOIN files f USING (file_id) JOIN commits c ON b.commit_sha = c.commit_sha {_PEOPLE}")
def blame_resolved(t):
    return views.v_blame(t)


@query("commit_files", " SELECT commit_sha, CAST(count(*) AS INT) AS files_changed, CAST(sum(coalesce(added_lines, 0)) AS BIGINT) AS insertions, CAST(sum(coalesce(removed_lines, 0)) AS BIGINT) AS deletions, CAST(sum(coalesce(added_lines, 0)) - sum(coalesce(removed_lines, 0)) AS BIGINT) AS net_lines FROM commit_files GROUP BY 1")
def commit_stats(t):
    return ownership.commit_stats(t["commit_files"])


@query("blame commits authors", _FO + " SELECT file_id, identity_id, owned_lines, file_lines, round(CAST(owned_lines AS DOUBLE) / file_lines, 9) AS ownership_share FROM fo")
def file_ownership(t):
    return t["file_ownership"].withColumn("ownership_share", F.round("ownership_share", 9))


@query("blame_snapshots commits authors", _CI + """, tot AS (SELECT snapshot_ref, snapshot_sha, count(*) AS total_lines FROM blame_snapshots GROUP BY 1, 2)
 SELECT b.snapshot_ref, b.snapshot_sha, identity_id, count(*) AS owned_lines, any_value(total_lines) AS total_lines, round(CAST(count(*) AS DOUBLE) / any_value(total_lines), 9) AS ownership_share
 FROM blame_snapshots b JOIN ci USING (commit_sha) JOIN tot ON b.snapshot_ref = tot.snapshot_ref AND b.snapshot_sha = tot.snapshot_sha WHERE identity_id IS NOT NULL GROUP BY 1, 2, 3""")
def snapshot_ownership(t):
    return ownership.snapshot_ownership(t["blame_snapshots"], t["commits"], t["authors"]).withColumn("ownership_share", F.round("ownership_share", 9))


@query("blame commits authors files", _FO + _NA + _AO + " SELECT area, identity_id, owned_lines, area_lines, round(CAST(owned_lines AS DOUBLE) / area_lines, 9) AS ownership_share FROM ao JOIN at_ USING (area)")
def area_ownership(t):
    return t["area_ownership"].withColumn("ownership_share", F.round("ownership_share", 9))


@query("commit_files", _CO + " SELECT * FROM co")
def coupling_pairs(t):
    return t["coupling"]


@query("commit_files commits authors identities", _CI + _SMALL + f""", bots AS (SELECT identity_id FROM identities WHERE lower(name) IN ('dependabot', 'renovate', 'github-actions', 'github actions') OR lower(name) LIKE '%[bot]%' OR regexp_matches(lower(email), '\\[bot\\]|dependabot|renovate|github-actions')),
 te AS (SELECT DISTINCT file_id, identity_id FROM commit_files JOIN small USING (commit_sha) JOIN ci USING (commit_sha) WHERE identity_id IS NOT NULL AND identity_id NOT IN (SELECT identity_id FROM bots)),
 k AS (SELECT te.* FROM te JOIN (SELECT file_id FROM te GROUP BY 1 HAVING count(*) <= {HUB}) USING (file_id)), n AS (SELECT identity_id, count(*) AS c FROM k GROUP BY 1),
 s AS (SELECT x.identity_id AS a, y.identity_id AS b, count(*) AS c FROM k x JOIN k y ON x.file_id = y.file_id AND x.identity_id < y.identity_id GROUP BY 1, 2)
 SELECT a AS identity_a, b AS identity_b, s.c AS shared_files, na.c AS a_files, nb.c AS b_files, round(CAST(s.c AS DOUBLE) / (na.c + nb.c - s.c), 9) AS strength FROM s JOIN n na ON a = na.identity_id JOIN n nb ON b = nb.identity_id""")
def collaboration(t):
    return coupling.collaboration(t["commit_files"], t["commits"], t["authors"], t["identities"], BULK, HUB).withColumn("strength", F.round("strength", 9))


@query("symbol_refs", _DEPS + " SELECT * FROM deps")
def module_deps(t):
    return t["module_deps"]


_WHO = "coalesce(i.name, '(unknown)')"


@query("blame commits authors identities files", _FO + _NA + f""", f AS (SELECT * FROM fo WHERE file_id NOT IN (SELECT file_id FROM na)), tt AS (SELECT CAST(sum(file_lines) AS BIGINT) AS total FROM (SELECT DISTINCT file_id, file_lines FROM f)),
 o AS (SELECT identity_id, CAST(sum(owned_lines) AS BIGINT) AS owned FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
 SELECT 'codebase_bus_factor' AS kind, CASE WHEN owned / total >= 0.8 THEN 'critical' WHEN owned / total >= 0.5 THEN 'warning' ELSE 'info' END AS severity, 'repository' AS subject, round(CAST(owned AS DOUBLE) / total, 9) AS metric,
 {_WHO} || ' owns ' || CAST(CAST(round(CAST(owned AS DOUBLE) / total * 100) AS BIGINT) AS VARCHAR) || '% of all lines (' || owned || ' of ' || total || ')' AS detail FROM o CROSS JOIN tt LEFT JOIN identities i USING (identity_id)""")
def insights_codebase_bus_factor(t):
    return insights.codebase_bus_factor(t["file_ownership"], t["identities"], t["non_authored"], LOW).withColumn("metric", F.round("metric", 9))


@query("blame commits authors identities files", _FO + _NA + f""" SELECT 'bus_factor_risk' AS kind, 'critical' AS severity, path AS subject, round(CAST(owned_lines AS DOUBLE) / file_lines, 9) AS metric,
 {_WHO} || ' alone holds ' || CAST(CAST(round(CAST(owned_lines AS DOUBLE) / file_lines * 100) AS BIGINT) AS VARCHAR) || '% of ' || path || ' (' || file_lines || ' lines)' AS detail
 FROM fo JOIN files USING (file_id) LEFT JOIN identities i USING (identity_id) WHERE file_id NOT IN (SELECT file_id FROM na) AND file_lines >= {LOW.bus_lines} AND CAST(owned_lines AS DOUBLE) / file_lines >= {LOW.bus_share} ORDER BY file_lines DESC, path LIMIT 20""")
def insights_bus_factor_risk(t):
    return insights.bus_factor_risk(t["file_ownership"], t["files"], t["identities"], t["non_authored"], LOW).withColumn("metric", F.round("metric", 9))


@query("blame commits authors identities files", _FO + _NA + _AO + f""" SELECT 'area_key_person' AS kind, 'warning' AS severity, area AS subject, round(CAST(owned_lines AS DOUBLE) / area_lines, 9) AS metric,
 {_WHO} || ' holds ' || CAST(CAST(round(CAST(owned_lines AS DOUBLE) / area_lines * 100) AS BIGINT) AS VARCHAR) || '% of folder ' || area || ' (' || area_lines || ' lines)' AS detail
 FROM ao JOIN at_ USING (area) LEFT JOIN identities i USING (identity_id) WHERE area_lines >= {LOW.area_lines} AND CAST(owned_lines AS DOUBLE) / area_lines >= {LOW.area_share}
 QUALIFY row_number() OVER (ORDER BY area_lines DESC, area, owned_lines DESC, identity_id) <= 20""")
def insights_area_key_person(t):
    rows = insights.area_key_person(t["area_ownership"].withColumn("area_lines", F.col("area_lines")), t["identities"], insights.Rules(area_lines=LOW.area_lines, area_share=LOW.area_share, top=1_000_000))
    # several people of one area tie by subject here; the larger share comes first
    lines = t["area_ownership"].groupBy("area").agg(F.max("area_lines").alias("n"))
    return rows.join(lines, F.col("subject") == F.col("area")).orderBy(F.desc("n"), "subject", F.desc("metric"), "detail").limit(20).select("kind", "severity", "subject", F.round("metric", 9).alias("metric"), "detail")


_CH = ", ch AS (SELECT file_id, count(*) AS changes FROM commit_files WHERE file_id NOT IN (SELECT file_id FROM na) GROUP BY 1)"
_DG = f", dg AS (SELECT to_file_id AS file_id, count(*) AS dependents FROM deps WHERE to_file_id NOT IN (SELECT file_id FROM na) GROUP BY 1 HAVING count(*) >= {LOW.hub})"


@query("commit_files files", _NA + _CH + f""" SELECT 'hotspot' AS kind, 'info' AS severity, path AS subject, CAST(changes AS DOUBLE) AS metric, path || ' was changed ' || changes || ' times' AS detail
 FROM ch JOIN files USING (file_id) WHERE changes >= {LOW.hotspot} ORDER BY changes DESC, path LIMIT 20""")
def insights_hotspot(t):
    return insights.hotspot(t["commit_files"], t["files"], t["non_authored"], LOW)


@query("commit_files files", _NA + _CO + f""", p AS (SELECT file_id, path, {_AREA} AS area FROM files WHERE file_id NOT IN (SELECT file_id FROM na))
 SELECT 'hidden_coupling' AS kind, 'info' AS severity, a.path || ' ↔ ' || b.path AS subject, CAST(co_changes AS DOUBLE) AS metric, a.path || ' and ' || b.path || ' were changed together ' || co_changes || ' times from different folders' AS detail
 FROM co JOIN p a ON file_a_id = a.file_id JOIN p b ON file_b_id = b.file_id WHERE a.area <> b.area AND co_changes >= {LOW.hidden} ORDER BY co_changes DESC, subject LIMIT 20""")
def insights_hidden_coupling(t):
    return insights.hidden_coupling(t["coupling"], t["files"], t["non_authored"], LOW)


@query("symbol_refs files", _NA + _DEPS + _DG + f""" SELECT 'architecture_hub' AS kind, CASE WHEN dependents >= {2 * LOW.hub} THEN 'warning' ELSE 'info' END AS severity, path AS subject, CAST(dependents AS DOUBLE) AS metric,
 dependents || ' files depend on ' || path AS detail FROM dg JOIN files USING (file_id) ORDER BY dependents DESC, path LIMIT 20""")
def insights_architecture_hub(t):
    return insights.architecture_hub(t["module_deps"], t["files"], t["non_authored"], LOW)


@query("symbol_refs commit_files files", _NA + _DEPS + _DG + _CH + f""" SELECT 'fragile_hub' AS kind, 'warning' AS severity, path AS subject, CAST(dependents * changes AS DOUBLE) AS metric,
 path || ' has ' || dependents || ' dependents and was changed ' || changes || ' times' AS detail FROM dg JOIN ch USING (file_id) JOIN files USING (file_id) WHERE changes >= {LOW.fragile} ORDER BY dependents * changes DESC, path LIMIT 20""")
def insights_fragile_hub(t):
    return insights.fragile_hub(t["module_deps"], t["commit_files"], t["files"], t["non_authored"], LOW)


def insights_all(t):
    """The union of all findings."""
    return t["insights"]


QUERIES["insights_all"] = lambda spark, folder: insights_all(Index(spark, folder))
#: Each part is another query's definition.
_ALL = " UNION ALL ".join(f"SELECT * FROM ({ORACLES[n]})" for n in list(ORACLES) if n.startswith("insights_"))
ORACLES["insights_all"] = _ALL


@query("symbols symbol_refs", """, s AS (SELECT *, row_number() OVER () AS rid FROM symbol_refs), h AS (SELECT s.*, y.name AS src_name, y.kind AS src_kind, y.start_line,
 row_number() OVER (PARTITION BY rid ORDER BY y.end_line - y.start_line, -y.start_line, y.name, y.kind) AS rk FROM s JOIN symbols y ON s.file_id = y.file_id AND s.line BETWEEN y.start_line AND y.end_line),
 u AS (SELECT file_id, name, min(start_line) AS dst FROM symbols GROUP BY 1, 2 HAVING count(*) = 1)
 SELECT h.file_id AS src_file_id, src_name, src_kind, h.start_line AS src_start_line, h.name AS dst_name, h.def_file_id AS dst_file_id, u.dst AS dst_start_line, ref_kind, line, lang
 FROM h LEFT JOIN u ON h.def_file_id = u.file_id AND h.name = u.name WHERE rk = 1""")
def symbol_edges(t):
    return t["symbol_edges"]


@query("symbols symbol_refs", """ SELECT file_id, name, kind, start_line FROM symbols s WHERE kind IN ('function', 'method') AND NOT EXISTS (SELECT 1 FROM symbol_refs r WHERE r.def_file_id = s.file_id AND r.name = s.name
 AND EXISTS (SELECT 1 FROM symbols y WHERE y.file_id = r.file_id AND r.line BETWEEN y.start_line AND y.end_line))""")
def dead_symbols(t):
    return code_graph.dead_symbols(t["symbols"], t["symbol_edges"]).select("file_id", "name", "kind", "start_line")


@query("symbols symbol_refs files", " SELECT df.path AS def_path, s.name, s.kind, s.start_line, count(r.name) AS resolved_refs FROM symbols s JOIN files df ON s.file_id = df.file_id LEFT JOIN symbol_refs r ON r.def_file_id = s.file_id AND r.name = s.name GROUP BY 1, 2, 3, 4")
def symbol_usage(t):
    return views.v_symbol_usage(t)


@query("symbols files", " SELECT path, name, kind, start_line, end_line, lang, blob_sha FROM symbols JOIN files USING (file_id)")
def symbols_view(t):
    return views.v_symbols(t)


@query("symbol_refs files", " SELECT a.path AS ref_path, line, name, ref_kind, b.path AS def_path, lang FROM symbol_refs r JOIN files a ON r.file_id = a.file_id LEFT JOIN files b ON r.def_file_id = b.file_id")
def references_view(t):
    return views.v_references(t)


_AUTH = ", au AS (SELECT author_id, min(name) AS name, min(email) AS email FROM observations GROUP BY 1)"
_COMP = _AUTH + r""", norm AS (SELECT DISTINCT author_id, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS k FROM observations), lg AS (SELECT author_id, nullif(regexp_extract(lower(email), '^(?:.*\+)?([^+]+)@users\.noreply\.github\.com$', 1), '') AS k FROM au),
 e AS (SELECT x.author_id AS a, y.author_id AS b, CAST(0.9 AS DOUBLE) AS c, 'name-exact' AS m FROM norm x JOIN norm y USING (k) WHERE x.author_id <> y.author_id UNION ALL SELECT x.author_id, y.author_id, CAST(0.95 AS DOUBLE), 'forge-noreply' FROM lg x JOIN lg y USING (k) WHERE x.author_id <> y.author_id),
 w AS (SELECT author_id AS a, author_id AS r FROM au UNION SELECT e.b, w.r FROM w JOIN e ON w.a = e.a), root AS (SELECT a AS author_id, min(r) AS root FROM w GROUP BY 1),
 cl AS (SELECT root, min(email) AS email, min(name) AS name, count(*) AS n, min(cf) AS cf FROM (SELECT au.*, root, coalesce((SELECT min(c) FROM e WHERE e.a = au.author_id), 1.0) AS cf FROM au JOIN root USING (author_id)) GROUP BY 1),
 ids AS (SELECT *, row_number() OVER (ORDER BY email, name, root) AS identity_id FROM cl)"""


@query("observations", _COMP + " SELECT identity_id, name, email, CAST(cf AS DOUBLE) AS confidence, CAST(n AS INT) AS alias_count FROM ids", recursive=True)
def identities_resolved(t):
    return identity.resolve(t["observations"])[1]


@query("observations", _COMP + """ SELECT identity_id, au.author_id, au.name, au.email, coalesce((SELECT max(m) FROM e WHERE e.a = au.author_id AND c = (SELECT max(c) FROM e WHERE e.a = au.author_id)), 'sole') AS method,
 CAST(coalesce((SELECT max(c) FROM e WHERE e.a = au.author_id), 1.0) AS DOUBLE) AS confidence FROM au JOIN root USING (author_id) JOIN ids USING (root)""", recursive=True)
def identity_aliases(t):
    return identity.resolve(t["observations"])[2]


_GENERIC = ", ".join(f"'{w}'" for w in identity.GENERIC_LOCALS)


@query("observations", _COMP + rf""", nm AS (SELECT identity_id, name, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS k FROM ids), bl AS (SELECT split_part(k, ' ', 1) AS f FROM nm WHERE k <> '' GROUP BY 1 HAVING count(*) BETWEEN 2 AND 60),
 ns AS (SELECT x.identity_id AS a, y.identity_id AS b, len(list_intersect(list_distinct(string_split(x.k, ' ')), list_distinct(string_split(y.k, ' ')))) / CAST(len(list_distinct(list_concat(string_split(x.k, ' '), string_split(y.k, ' ')))) AS DOUBLE) AS s
 FROM nm x JOIN nm y ON split_part(x.k, ' ', 1) = split_part(y.k, ' ', 1) AND x.identity_id < y.identity_id JOIN bl ON bl.f = split_part(x.k, ' ', 1)),
 lc AS (SELECT DISTINCT lower(split_part(au.email, '@', 1)) AS l, identity_id FROM au JOIN root USING (author_id) JOIN ids USING (root) WHERE au.email LIKE '%@%'),
 el AS (SELECT x.identity_id AS a, y.identity_id AS b FROM lc x JOIN lc y USING (l) WHERE x.identity_id < y.identity_id AND strlen(l) >= 3 AND l NOT IN ({_GENERIC})),
 rv AS (SELECT a, b, 'name-similar' AS reason, round(s, 3) AS similarity FROM ns WHERE s >= 0.5 AND s < 1 UNION ALL SELECT DISTINCT a, b, 'email-local', 0.7 FROM el WHERE (a, b) NOT IN (SELECT (a, b) FROM ns WHERE s >= 0.5 AND s < 1))
 SELECT a AS identity_a, b AS identity_b, x.name AS name_a, y.name AS name_b, reason, CAST(similarity AS DOUBLE) AS similarity FROM rv JOIN ids x ON a = x.identity_id JOIN ids y ON b = y.identity_id""", recursive=True)
def identity_reviews(t):
    _, people, aliases = identity.resolve(t["observations"])
    return identity.review_queue(people, aliases)


@query("commits", r""", h AS (SELECT *, CASE WHEN subject LIKE '%:%' THEN trim(split_part(subject, ':', 1), E' \t\r') END AS head FROM commits), b AS (SELECT *, coalesce(suffix(head, '!'), false) AS brk, CASE WHEN suffix(head, '!') THEN trim(left(head, length(head) - 1)) ELSE head END AS bare FROM h),
 k AS (SELECT *, bare LIKE '%(%)' AS scoped, lower(trim(CASE WHEN bare LIKE '%(%)' THEN split_part(bare, '(', 1) ELSE bare END)) AS ck, lower(regexp_extract(ltrim(subject), '^[A-Za-z]*')) AS w FROM b),
 c AS (SELECT *, coalesce(ck IN ('feat', 'fix', 'docs', 'style', 'refactor', 'perf', 'test', 'build', 'ci', 'chore', 'revert'), false) AS conv FROM k)
 SELECT commit_sha, CASE WHEN is_merge THEN 'merge' WHEN conv THEN ck WHEN w IN ('fix', 'fixed', 'fixes', 'bug', 'bugfix', 'hotfix') THEN 'fix' WHEN w IN ('add', 'added', 'feat', 'feature', 'implement', 'introduce', 'new') THEN 'feat'
 WHEN w IN ('doc', 'docs', 'documentation', 'readme') THEN 'docs' WHEN w IN ('test', 'tests', 'testing') THEN 'test' WHEN w IN ('refactor', 'refactored', 'cleanup', 'rename', 'move', 'reorganize') THEN 'refactor'
 WHEN w IN ('perf', 'optimize', 'optimise', 'speed') THEN 'perf' WHEN w = 'revert' THEN 'revert' WHEN w IN ('bump', 'chore', 'release', 'deps', 'dependency', 'dependencies') THEN 'chore' WHEN w = 'merge' THEN 'merge' ELSE 'other' END AS kind,
 CASE WHEN NOT is_merge AND conv AND scoped THEN trim(substr(bare, strpos(bare, '(') + 1, length(bare) - strpos(bare, '(') - 1)) ELSE '' END AS scope, NOT is_merge AND conv AS is_conventional, NOT is_merge AND conv AND brk AS is_breaking FROM c""")
def commit_classes(t):
    return t["commits"].select("commit_sha", fc.classify(F.col("subject"), F.col("is_merge")).alias("r")).select("commit_sha", "r.*")


@query("messages", r""", p AS (SELECT commit_sha, string_split(regexp_extract(message, '\n\n([^\n]+(\n[^\n]+)*)$', 1), chr(10)) AS ls FROM messages WHERE regexp_matches(message, '\n\n([^\n]+(\n[^\n]+)*)$')),
 l AS (SELECT commit_sha, unnest(ls) AS l, generate_subscripts(ls, 1) AS k FROM p), ok AS (SELECT commit_sha FROM l GROUP BY 1 HAVING bool_and(l LIKE '(cherry picked from%' OR l LIKE ' %' OR regexp_matches(l, '^[A-Za-z0-9-]+[:#]'))),
 c AS (SELECT *, sum(CASE WHEN regexp_matches(l, '^[A-Za-z0-9-]+[:#]') THEN 1 ELSE 0 END) OVER (PARTITION BY commit_sha ORDER BY k) AS g FROM l JOIN ok USING (commit_sha) WHERE l NOT LIKE '(cherry picked from%')
 SELECT commit_sha, CAST(g - 1 AS INT) AS seq, max(regexp_extract(l, '^([A-Za-z0-9-]+)[:#]', 1)) AS key, string_agg(CASE WHEN l LIKE ' %' THEN trim(l) ELSE trim(regexp_replace(l, '^[A-Za-z0-9-]+[:#]', '')) END, ' ' ORDER BY k) AS value FROM c GROUP BY 1, g""")
def commit_trailers(t):
    return t["messages"].select("commit_sha", F.posexplode(fc.parse_trailers("message")).alias("seq", "r")).select("commit_sha", "seq", "r.key", "r.value")


@query("messages", r""" SELECT commit_sha, regexp_replace(split_part(message, chr(10), 1), '^\s+|\s+$', '', 'g') AS subject, nullif(regexp_replace(substr(message, strpos(message || chr(10), chr(10)) + 1), '^\s+|\s+$', '', 'g'), '') AS body FROM messages""")
def commit_messages(t):
    return t["messages"].select("commit_sha", fc.subject_of(F.col("message")).alias("subject"), fc.body_of(F.col("message")).alias("body"))


@query("files", f" SELECT file_id, CASE WHEN {_GEN} = 'vendored-dir' THEN 'vendored' ELSE 'generated' END AS category, {_GEN} AS reason FROM files WHERE {_GEN} IS NOT NULL")
def generated_files(t):
    return t["files"].select("file_id", fp.generated_reason(F.col("path")).alias("r")).filter("r is not null").select("file_id", "r.*")


_TF = r""", b AS (SELECT file_id, path, regexp_extract(path, '[^/]*$') AS base, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM files),
 x AS (SELECT *, regexp_extract(base, '\.([^.]*)$', 1) AS ext, regexp_replace(base, '\.[^.]*$', '') AS stem FROM b), g AS (SELECT *, CASE WHEN ext IN ('ts', 'tsx', 'mts', 'cts') THEN 'ts' WHEN ext IN ('js', 'jsx', 'mjs', 'cjs') THEN 'js' WHEN ext = 'py' THEN 'py' WHEN ext = 'go' THEN 'go'
 WHEN ext = 'rs' THEN 'rust' WHEN ext = 'java' THEN 'java' WHEN ext IN ('kt', 'kts') THEN 'kotlin' WHEN ext = 'rb' THEN 'rb' WHEN ext = 'php' THEN 'php' WHEN ext = 'cs' THEN 'csharp' END AS lang FROM x),
 s AS (SELECT *, CASE WHEN lang IN ('ts', 'js') AND regexp_matches(stem, '\.(test|spec)$') THEN '*.test/spec.*' WHEN lang = 'py' AND regexp_matches(stem, '^test_|_test$|^test$|^conftest$') THEN 'test_*/_test.py' WHEN lang = 'go' AND stem LIKE '%\_test' ESCAPE '\' THEN '*_test.go'
 WHEN lang IN ('java', 'kotlin', 'csharp') AND regexp_matches(stem, '(Test|Tests|Spec)$') THEN '*Test/Tests/Spec' WHEN lang IS NOT NULL AND regexp_matches(dir, '(^|/)(__tests__|__test__|tests|test|spec|specs)(/|$)') THEN 'dir:test' END AS signal FROM g WHERE lang IS NOT NULL)"""


@query("files", _TF + " SELECT file_id, lang, signal FROM s WHERE signal IS NOT NULL")
def test_files(t):
    return code_graph.test_files(t["files"])


@query("files", _TF + r""", te AS (SELECT *, CASE WHEN regexp_matches(stem, '(\.test|\.spec|_test|_spec)$') THEN regexp_replace(stem, '(\.test|\.spec|_test|_spec)$', '') WHEN regexp_matches(stem, '.Tests$') THEN regexp_replace(stem, 'Tests$', '') WHEN regexp_matches(stem, '.Test$') THEN regexp_replace(stem, 'Test$', '')
 WHEN regexp_matches(stem, '.Spec$') THEN regexp_replace(stem, 'Spec$', '') ELSE regexp_replace(stem, '^test_', '') END AS target FROM s WHERE signal IS NOT NULL),
 m AS (SELECT te.file_id AS t, q.file_id AS q, te.dir = q.dir AS near FROM te JOIN s q ON q.signal IS NULL AND te.lang = q.lang AND te.target = q.stem), c AS (SELECT t, count(*) FILTER (near) AS n, count(*) AS w FROM m GROUP BY 1)
 SELECT t AS test_file_id, q AS source_file_id, CASE WHEN near THEN 'same_dir' ELSE 'unique_stem' END AS method FROM m JOIN c USING (t) WHERE (near AND n = 1) OR (n = 0 AND w = 1)""")
def test_coverage(t):
    return code_graph.test_coverage(t["files"])


@query("head_texts", r""", l AS (SELECT file_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM head_texts),
 h AS (SELECT file_id, line, m AS marker, s, unnest(range(1, length(s) + 1)) AS i FROM l CROSS JOIN (VALUES ('token'), ('the')) v(m) WHERE contains(s, m))
 SELECT file_id, CAST(line AS INT) AS line, marker, substr(regexp_replace(regexp_replace(substr(s, i + length(marker)), '^[: \t]+', ''), '\s+$', ''), 1, 200) AS text FROM h
 WHERE substr(s, i, length(marker)) = marker AND NOT regexp_matches(substr(s, i - 1, CASE WHEN i > 1 THEN 1 ELSE 0 END), '[A-Za-z0-9]') AND NOT regexp_matches(substr(s, i + length(marker), 1), '[A-Za-z0-9]')""")
def code_markers(t):
    return t["code_markers"]


@query("secret_texts", r""", l AS (SELECT file_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM secret_texts),
 k AS (SELECT * FROM (VALUES ('aws_access_key', '\b(?:AKIA|ASIA)[0-9A-Z]{16}\b', 4), ('github_token', '\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{50,})', 4), ('google_api_key', '\bAIza[0-9A-Za-z_-]{35}', 4), ('slack_token', '\bxox[abprs]-[0-9A-Za-z-]{10,}', 5),
 ('stripe_secret_key', '\b[sr]k_live_[0-9A-Za-z]{16,}', 8), ('private_key', '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----', 11), ('generic_token', '[tT][oO][kK][eE][nN] = "[0-9a-fA-F]{40}"', 5)) v(rule, p, n)),
 m AS (SELECT file_id, line, rule, n, unnest(regexp_extract_all(s, p)) AS m FROM l, k WHERE length(s) > 0) SELECT file_id, CAST(line AS INT) AS line, rule, substr(m, 1, n) || '…' AS preview FROM m""")
def secret_findings(t):
    return content.secrets(t["secret_texts"], ["file_id"], SECRET_RULES | {"generic_token": (r'[tT][oO][kK][eE][nN] = "[0-9a-fA-F]{40}"', 5)})


@query("head_texts", """, x AS (SELECT file_id, text || CASE WHEN file_id % 9 = 0 THEN chr(0) || 'x' ELSE '' END AS text, file_id % 9 = 0 AND strlen(text) < 8000 AS is_binary FROM head_texts)
 SELECT sha1(text) AS blob_sha, any_value(CAST(strlen(text) AS BIGINT)) AS size_bytes, any_value(CAST(CASE WHEN is_binary THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND text NOT LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS BIGINT)) AS line_count, any_value(is_binary) AS is_binary FROM x GROUP BY 1""")
def blob_facts(t):
    text = F.when(F.col("file_id") % 9 == 0, F.concat("text", F.lit("\0x"))).otherwise(F.col("text")).cast("binary")
    return content.blob_facts(t["head_texts"].select(F.sha1(text).alias("blob_sha"), text.alias("bytes")))


@query("head_texts", r""", l AS (SELECT file_id, path, text, unnest(list_slice(string_split(text, chr(10)), 1, 15)) AS s FROM (SELECT file_id, path, CASE file_id % 5 WHEN 0 THEN '// Code generated by x' || chr(10) WHEN 1 THEN '#!/bin/sh' || chr(10) || '# see: code generated by x' || chr(10) WHEN 2 THEN repeat(chr(10), 15) || '@generated' || chr(10) WHEN 3 THEN '<!-- AutoGenerated -->' || chr(10) ELSE '' END || text AS text FROM head_texts))
 SELECT DISTINCT file_id, 'generated' AS category, 'content-marker' AS reason FROM l WHERE regexp_matches(lower(regexp_replace(s, '^[ \t/*#!\-<>;%]+', '')), '^(@generated|code generated by|autogenerated|auto-generated|automatically generated)')""")
def generated_headers(t):
    head = F.element_at(F.array(*map(F.lit, ["// Code generated by x\n", "#!/bin/sh\n# see: code generated by x\n", "\n" * 15 + "@generated\n", "<!-- AutoGenerated -->\n", ""])), (F.col("file_id") % 5 + 1).cast("int"))
    return content.generated_by_header(t["head_texts"].withColumn("text", F.concat(head, "text")), ["file_id"])


def _blobs(t):
    return t["head_texts"].select(F.sha1(F.col("text").cast("binary")).alias("blob_sha"), F.col("text").cast("binary").alias("bytes"))


@query()
def blob_chunks(t):
    """Content-defined chunks of every distinct text (no SQL form)."""
    return content.blob_chunks(_blobs(t)).drop("bytes")


@query("head_texts", ", d AS (SELECT DISTINCT text FROM head_texts) SELECT sha1(text) AS blob_sha, CAST(strlen(text) AS BIGINT) AS size_bytes, sha1(text) AS rebuilt_sha FROM d WHERE text <> ''")
def chunk_rebuild(t):
    """Every distinct text again from its chunks."""
    parts = content.blob_chunks(_blobs(t))
    whole = content.rebuild(parts, content.chunk_store(parts))
    return whole.select("blob_sha", F.octet_length("bytes").cast("long").alias("size_bytes"), F.sha1("bytes").alias("rebuilt_sha"))


@query()
def chunk_dedup_ratio(t):
    parts = content.blob_chunks(_blobs(t), 1024)
    return content.dedup_ratio(parts, content.chunk_store(parts))


def _commit():
    return F.expr("concat(split(path, '/')[0], '-', CAST(file_id div 250 AS STRING))")


def _changes(t):
    """Even documents as deletions and odd ones as additions; a commit is a language and 250 neighbouring numbers, so commits grow in number and not in size."""
    sha = F.sha1(F.col("text").cast("binary"))
    gone = F.col("file_id") % 2 == 0
    return t["head_texts"].select(_commit().alias("commit_sha"), F.when(gone, "D").otherwise("A").alias("change_type"), "path", F.when(gone, sha).otherwise(F.lit("0" * 40)).alias("src_blob_sha"), F.when(gone, F.lit("0" * 40)).otherwise(sha).alias("dst_blob_sha"))


_CHG = ", g AS (SELECT split_part(path, '/', 1) || '-' || CAST(file_id // 250 AS VARCHAR) AS commit_sha, path, sha1(text) AS blob_sha, row_number() OVER (PARTITION BY split_part(path, '/', 1) || '-' || CAST(file_id // 250 AS VARCHAR), sha1(text), file_id % 2 ORDER BY path) AS k, file_id % 2 AS side FROM head_texts)"


@query("head_texts", _CHG + " SELECT d.commit_sha, d.blob_sha, d.path AS old_path, a.path FROM g d JOIN g a ON d.commit_sha = a.commit_sha AND d.blob_sha = a.blob_sha AND d.k = a.k AND d.side = 0 AND a.side = 1")
def exact_renames(t):
    return renames.exact_renames(_changes(t)).select("commit_sha", "blob_sha", "old_path", "path")


@query()
def inexact_renames(t):
    """Greedy one-to-one matching (no SQL form)."""
    blobs = t["head_texts"].select(F.sha1(F.col("text").cast("binary")).alias("blob_sha"), "text")
    return renames.inexact_renames(_changes(t), blobs)


@query("head_texts", r""", b AS (SELECT DISTINCT sha1(text) AS s, text FROM head_texts), l AS (SELECT s, x, count(*) AS n FROM (SELECT s, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+$')) AS x FROM b) GROUP BY 1, 2), z AS (SELECT s, sum(n) AS t FROM l GROUP BY 1),
 p AS (SELECT DISTINCT split_part(d.path, '/', 1) || '-' || CAST(d.file_id // 250 AS VARCHAR) AS commit_sha, sha1(d.text) AS x, sha1(a.text) AS y FROM head_texts d JOIN head_texts a ON split_part(d.path, '/', 1) || '-' || CAST(d.file_id // 250 AS VARCHAR) = split_part(a.path, '/', 1) || '-' || CAST(a.file_id // 250 AS VARCHAR) AND d.file_id % 2 = 0 AND a.file_id % 2 = 1 WHERE d.text <> a.text)
 SELECT commit_sha, p.x AS a_blob, p.y AS b_blob, round(CAST(sum(least(u.n, v.n)) AS DOUBLE) / greatest(any_value(zx.t), any_value(zy.t)), 6) AS similarity FROM p JOIN l u ON u.s = p.x JOIN l v ON v.s = p.y AND u.x = v.x JOIN z zx ON zx.s = p.x JOIN z zy ON zy.s = p.y GROUP BY 1, 2, 3""")
def rename_similarity(t):
    blobs = t["head_texts"].select(F.sha1(F.col("text").cast("binary")).alias("blob_sha"), "text")
    ch = _changes(t)
    gone = ch.filter("change_type = 'D'").select("commit_sha", F.col("src_blob_sha").alias("blob_sha"))
    new = ch.filter("change_type = 'A'").select("commit_sha", F.col("dst_blob_sha").alias("blob_sha"))
    return renames.similar_within(gone, new, renames.line_lists(blobs)).filter("a_blob <> b_blob").select("commit_sha", "a_blob", "b_blob", F.round("similarity", 6).alias("similarity"))


@query()
def lsh_candidates(t):
    """Pairs that share a MinHash band (hash-dependent, no SQL form)."""
    blobs = t["head_texts"].select(F.sha1(F.col("text").cast("binary")).alias("blob_sha"), "text")
    ch = _changes(t)
    gone = ch.filter("change_type = 'D'").select("commit_sha", F.col("path").alias("old_path"), F.col("src_blob_sha").alias("blob_sha"))
    new = ch.filter("change_type = 'A'").select("commit_sha", "path", F.col("dst_blob_sha").alias("blob_sha"))
    return renames.lsh_candidates(gone, new, renames.bands(renames.signatures(renames.line_profiles(renames.line_lists(blobs)))), ["commit_sha"])


@query("declared gitlinks", " SELECT coalesce(d.path, g.path) AS path, name, url, pinned_sha, d.path IS NOT NULL AS in_gitmodules, g.path IS NOT NULL AS in_tree FROM declared d FULL JOIN gitlinks g ON d.path = g.path")
def submodules_full_outer(t):
    d, g = t["declared"].withColumn("in_gitmodules", F.lit(True)), t["gitlinks"].withColumn("in_tree", F.lit(True))
    out = d.join(g, "path", "full_outer")
    return out.select("path", "name", "url", "pinned_sha", F.coalesce("in_gitmodules", F.lit(False)).alias("in_gitmodules"), F.coalesce("in_tree", F.lit(False)).alias("in_tree"))


@query("commit_parents", ", r AS (SELECT max(commit_sha) AS commit_sha FROM commit_parents GROUP BY split_part(commit_sha, '.', 1) UNION SELECT p.parent_sha FROM r JOIN commit_parents p USING (commit_sha)) SELECT commit_sha FROM r", recursive=True)
def ancestry(t):
    tips = t["commit_parents"].groupBy(F.substring_index("commit_sha", ".", 1)).agg(F.max("commit_sha").alias("commit_sha"))
    return code_graph.ancestors(t["commit_parents"], tips)


@query("refs", " SELECT name, tip_epoch, (SELECT max(tip_epoch) FROM refs) - tip_epoch <= 90 * 86400 AS is_active FROM refs")
def ref_selection(t):
    return code_graph.active_refs(t["refs"])


@query("", "SELECT page_id, p AS prefix FROM (SELECT page_id, p, row_number() OVER (PARTITION BY page_id ORDER BY length(p) DESC) AS k FROM pages JOIN (SELECT DISTINCT array_to_string(string_split(url, '/')[1:k], '/') AS p FROM pages, (VALUES (3), (4)) v(k)) ON url = p OR starts_with(url, p || '/')) WHERE k = 1")
def longest_prefix(t):
    pages = t.source("pages").select("page_id", "url")
    parts = F.split("url", "/")
    roots = pages.select(F.explode(F.array(*(F.array_join(F.slice(parts, 1, k), "/") for k in (3, 4)))).alias("prefix")).distinct()
    return code_graph.longest_prefix(pages, "url", roots, "prefix").select("page_id", "prefix")


# -- surfaces -------------------------------------------------------------------------------------

_VB = f", vb AS (SELECT f.path, b.commit_sha, {_PERSON}, c.committed_at_epoch FROM blame b JOIN files f USING (file_id) JOIN commits c ON b.commit_sha = c.commit_sha {_PEOPLE} WHERE f.path LIKE 'brand/1%')"
_VC = f", vc AS (SELECT cf.commit_sha, f.path, cf.added_lines, cf.removed_lines, {_PERSON}, c.committed_at_epoch FROM commit_files cf JOIN files f ON cf.file_id = f.file_id JOIN commits c ON cf.commit_sha = c.commit_sha {_PEOPLE})"
_AT = "(path = 'brand/11' OR path LIKE 'brand/11/%')"
_BASE = "blame files commits authors identities"
_CBASE = "commit_files files commits authors identities"


@query(_BASE, _VB + f" SELECT author_name, author_email, count(*) AS owned_lines, count(DISTINCT path) AS files, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM vb WHERE {_AT}), 3) AS share, max(committed_at_epoch) AS last_touch_epoch FROM vb WHERE {_AT} GROUP BY 1, 2")
def surface_ownership(t):
    return surfaces.ownership(t, "brand/11")


@query("blame " + _CBASE, _VB + _VC + f""", o AS (SELECT author_name, author_email, count(*) AS owned_lines FROM vb WHERE {_AT} GROUP BY 1, 2), r AS (SELECT author_name, author_email, count(*) AS n FROM vc WHERE {_AT} AND committed_at_epoch > (SELECT max(committed_at_epoch) FROM commits) - 180 * 86400 GROUP BY 1, 2),
 l AS (SELECT author_name, author_email, max(committed_at_epoch) AS last_touch_epoch FROM vc WHERE {_AT} GROUP BY 1, 2) SELECT coalesce(o.author_name, r.author_name) AS author_name, coalesce(o.author_email, r.author_email) AS author_email, coalesce(owned_lines, 0) AS owned_lines, coalesce(n, 0) AS recent_changes, last_touch_epoch
 FROM o FULL JOIN r ON o.author_name = r.author_name AND o.author_email = r.author_email LEFT JOIN l ON l.author_name = coalesce(o.author_name, r.author_name) AND l.author_email = coalesce(o.author_email, r.author_email)""")
def surface_reviewers(t):
    return surfaces.reviewers(t, "brand/11")


@query(_CBASE, _VC + f""", s AS (SELECT commit_sha FROM commit_files GROUP BY 1 HAVING count(*) <= 50), w AS (SELECT vc.* FROM vc JOIN s USING (commit_sha)) SELECT path, count(DISTINCT commit_sha) AS co_changes, max(committed_at_epoch) AS last_co_change_epoch FROM w WHERE NOT {_AT} AND commit_sha IN (SELECT commit_sha FROM w WHERE {_AT}) GROUP BY 1""")
def surface_blast_radius(t):
    return surfaces.blast_radius(t, "brand/11")


@query(_CBASE, _VC + f""", e AS (SELECT max(committed_at_epoch) AS e FROM commits) SELECT count(DISTINCT commit_sha) AS commits, count(*) AS file_changes, count(DISTINCT path) AS files, count(DISTINCT author_email) AS authors, CAST(coalesce(sum(added_lines), 0) AS BIGINT) AS lines_added,
 CAST(coalesce(sum(removed_lines), 0) AS BIGINT) AS lines_removed, any_value(e) - 365 * 86400 AS window_start_epoch, any_value(e) AS window_end_epoch FROM vc, e WHERE {_AT} AND committed_at_epoch > e - 365 * 86400""")
def surface_activity(t):
    return surfaces.activity(t, "brand/11", 365)


@query(_CBASE, _VC + f" SELECT author_name, author_email, count(DISTINCT commit_sha) AS commits, count(*) AS file_changes, count(DISTINCT path) AS files, min(committed_at_epoch) AS first_seen_epoch, max(committed_at_epoch) AS last_seen_epoch FROM vc WHERE {_AT} GROUP BY 1, 2")
def surface_contributors(t):
    return surfaces.contributors(t, "brand/11")


@query("symbols files commits authors identities", f""" SELECT 'symbol' AS type, name AS title, path, start_line AS line, CAST(NULL AS VARCHAR) AS sha, kind AS detail, CAST(CASE WHEN name = 'fn12' THEN 3 WHEN name LIKE 'fn12%' THEN 2 ELSE 1 END AS INT) AS rank FROM symbols JOIN files USING (file_id) WHERE name LIKE '%fn12%'
 UNION ALL SELECT 'path', path, path, NULL, NULL, NULL, 1 FROM files WHERE path LIKE '%fn12%' UNION ALL SELECT 'commit', subject, NULL, NULL, commit_sha, author_name, 1 FROM (SELECT c.subject, c.commit_sha, {_PERSON} FROM commits c {_PEOPLE}) WHERE lower(subject) LIKE '%fn12%'""")
def surface_search(t):
    return surfaces.search(t, "fn12")


@query("symbol_refs files", _DEPS + f" SELECT a.path AS from_path, b.path AS to_path, ref_count AS refs FROM deps JOIN files a ON from_file_id = a.file_id JOIN files b ON to_file_id = b.file_id WHERE a.{_AT[1:].replace('OR path', 'OR a.path')[:-1]} OR b.{_AT[1:].replace('OR path', 'OR b.path')[:-1]}")
def surface_graph(t):
    return surfaces.graph(t, "brand/11")


@query("", f"SELECT * FROM ({_ALL}) WHERE subject = 'brand' OR subject LIKE 'brand/%' OR split_part(subject, ' ↔ ', 2) LIKE 'brand/%'")
def surface_risks(t):
    return surfaces.risks(t, "brand")


@query("", _ALL)
def risks_view(t):
    return views.v_risks(t)


@query("dependencies", " SELECT ecosystem, name, version, scope, manifest_path FROM dependencies")
def dependencies_view(t):
    return views.v_dependencies(t)


@query("dependencies", " SELECT ecosystem, name, version, scope, manifest_path FROM dependencies WHERE lower(name) LIKE '%1%' OR ecosystem = '1'")
def surface_dependencies(t):
    return surfaces.dependencies(t, "1")


@query("semantic_refs files", " SELECT a.path AS ref_path, line, name, ref_kind, b.path AS def_path, def_line, lang FROM semantic_refs s JOIN files a ON s.file_id = a.file_id JOIN files b ON s.def_file_id = b.file_id")
def semantic_view(t):
    return views.v_semantic(t)


@query("head_texts", ORACLES["code_markers"].split("FROM documents)", 1)[1].replace(" SELECT file_id, CAST(line AS INT) AS line, marker,", " SELECT path, CAST(line AS INT) AS line, marker,").replace("SELECT file_id, unnest", "SELECT path, unnest").replace("SELECT file_id, line, m AS", "SELECT path, line, m AS").replace("FROM h", "FROM h") + " AND path LIKE 'en/src1/%'")
def surface_markers(t):
    files = t["head_texts"].select("file_id", "path")
    return surfaces.markers({"code_markers": t["code_markers"], "files": files}, "en/src1")


# -- scalar rules, joins and recipes --------------------------------------------------------------


@query("observations", r""" SELECT author_id, name, email, nullif(regexp_extract(lower(email), '^(?:.*\+)?([^+]+)@users\.noreply\.github\.com$', 1), '') AS login, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS norm,
 lower(name) LIKE '%[bot]%' OR lower(email) LIKE '%[bot]%' OR regexp_matches(lower(email), 'dependabot|renovate|github-actions') OR lower(name) IN ('dependabot', 'renovate', 'github-actions', 'github actions') AS is_bot FROM observations""")
def people_rules(t):
    return t["observations"].select("author_id", "name", "email", fc.forge_login(F.col("email")).alias("login"), fc.normal_name(F.col("name")).alias("norm"), fc.is_bot(F.col("name"), F.col("email")).alias("is_bot"))


@query("files", f""" SELECT file_id, {_AREA} AS area, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, regexp_extract(path, '[^/]*$') AS base, regexp_extract(path, '\\.([^./]*)$', 1) AS ext,
 CASE WHEN file_id % 5 = 0 THEN 'executable' WHEN file_id % 5 = 1 THEN 'symlink' WHEN file_id % 5 = 2 THEN 'submodule' WHEN file_id % 5 = 3 THEN 'tree' ELSE 'blob' END AS entry_type FROM files""")
def path_rules(t):
    mode = F.element_at(F.array(*(F.lit(m) for m in ("100755", "120000", "160000", "040000", "100644"))), (F.col("file_id") % 5 + 1).cast("int"))
    p = F.col("path")
    return t["files"].select("file_id", fp.area_of(p).alias("area"), fp.dir_of(p).alias("dir"), fp.base_of(p).alias("base"), fp.extension_of(p).alias("ext"), fp.entry_type(mode).alias("entry_type"))


@query("observations", r""", n AS (SELECT DISTINCT author_id, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS k FROM observations), e AS (SELECT k, lag(author_id) OVER (PARTITION BY k ORDER BY author_id) AS a, author_id AS b FROM n) SELECT a, b, CAST(0.9 AS DOUBLE) AS confidence FROM e WHERE a IS NOT NULL""")
def identity_edges(t):
    groups = identity.alias_groups(t["observations"], identity.authors_of(t["observations"])).filter("method = 'name-exact'")
    return identity.adjacent_edges(groups).select("a", "b", "confidence")


@query("symbols", " SELECT name, start_line, min(file_id) AS file_id FROM symbols GROUP BY 1, 2 HAVING count(DISTINCT file_id) = 1")
def unique_names(t):
    return code_graph.unique_by(t["symbols"], ["name", "start_line"], "file_id")


@query("", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey * 2) THEN o_custkey * 2 ELSE o_custkey END AS BIGINT) AS hit FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def first_existing(t):
    tries = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.col("o_custkey") * 2, F.col("o_custkey"))).otherwise(F.array("o_custkey"))
    rows = t.source("orders").select("o_orderkey", tries.alias("tries"))
    return code_graph.first_existing(rows, "o_orderkey", "tries", t.source("customer").select(F.col("c_custkey").alias("hit")), "hit")


@query("", "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start_epoch, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def windowed_activity(t):
    from orebody.streaming.activity import windowed_activity as windows

    return windows(t.source("events")).withColumn("total", F.round("total", 6))


def _sql(t, names: str, text: str):
    return views.sql(t.spark, {n: t[n] for n in names.split()}, text)


@query("commits authors", " SELECT a.name, count(*) AS c FROM commits JOIN authors a USING (author_id) GROUP BY 1 ORDER BY c DESC, name LIMIT 10")
def recipe_commits_per_author(t):
    return _sql(t, "commits authors", "SELECT a.name, count(*) AS c FROM commits JOIN authors a USING (author_id) GROUP BY 1 ORDER BY c DESC, name LIMIT 10")


@query("commit_files files", " SELECT path, count(*) AS n FROM commit_files JOIN files USING (file_id) WHERE change_type = 'R' GROUP BY 1 ORDER BY n DESC, path LIMIT 10")
def recipe_most_renamed(t):
    return _sql(t, "commit_files files", "SELECT path, count(*) AS n FROM commit_files JOIN files USING (file_id) WHERE change_type = 'R' GROUP BY 1 ORDER BY n DESC, path LIMIT 10")


@query("blame commits authors identities files", _FO + " SELECT path, i.name AS owner, owned_lines, round(CAST(owned_lines AS DOUBLE) / file_lines, 2) AS share FROM fo JOIN files USING (file_id) JOIN identities i USING (identity_id) QUALIFY row_number() OVER (PARTITION BY path ORDER BY owned_lines DESC, identity_id) = 1 ORDER BY owned_lines DESC, path LIMIT 10")
def recipe_dominant_owner(t):
    rows = t["file_ownership"].join(t["files"], "file_id").join(t["identities"].select("identity_id", F.col("name").alias("owner")), "identity_id")
    first = insights.dominant_owner(rows, ["path"], [F.desc("owned_lines"), F.col("identity_id")])
    return first.orderBy(F.desc("owned_lines"), "path").limit(10).select("path", "owner", "owned_lines", F.round("ownership_share", 2).alias("share"))


@query("symbols symbol_refs files", ORACLES["symbol_edges"].split("FROM lineitem)", 1)[1].replace(" SELECT h.file_id AS src_file_id", ", se AS (SELECT h.file_id AS src_file_id", 1) + ") SELECT path AS caller_file, src_name AS caller, line FROM se JOIN files ON src_file_id = file_id WHERE dst_name = 'fn12' AND ref_kind IN ('call', 'new')")
def recipe_callers(t):
    return _sql(t, "symbol_edges files", "SELECT path AS caller_file, src_name AS caller, line FROM symbol_edges JOIN files ON src_file_id = file_id WHERE dst_name = 'fn12' AND ref_kind IN ('call', 'new')")


@query("symbol_refs files", " SELECT a.path AS used_in, line, b.path AS defined_in FROM symbol_refs r JOIN files a ON r.file_id = a.file_id JOIN files b ON r.def_file_id = b.file_id WHERE name = 'fn12'")
def recipe_find_usages(t):
    return _sql(t, "symbol_refs files", "SELECT a.path AS used_in, line, b.path AS defined_in FROM symbol_refs r JOIN files a ON r.file_id = a.file_id JOIN files b ON r.def_file_id = b.file_id WHERE name = 'fn12'")

"""Code structure of a source tree: extraction once per (blob, language), resolution by gated joins.

Resolution of a reference, first hit counts: the owner of the receiver's type
when that is one file; then by language — Go: same file, own folder, the
qualifier's package, the whole repository; Java, C#, Rust, Python: same file,
whole repository, visible scopes; TypeScript: what the import binds to (a
module may be an alias of a tsconfig; an external import binds to nothing), same file; Ruby and C: same file. Every step
but "same file" needs exactly one candidate file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from orebody.functions.paths import dir_of
from orebody.operators.code_graph import first_existing, longest_prefix, unique_by
from orebody.storage import durable
from orebody.symbols import extract as ex

_FOUND = """symbols array<struct<name: string, kind: string, start_line: int, end_line: int>>, refs array<struct<name: string, ref_kind: string, line: int, receiver: string, qualifier: string>>,
 imports array<struct<local: string, module: string, name: string>>, reexports array<struct<exported: string, module: string, name: string>>, owners array<struct<type: string, method: string>>, scope string, visible array<string>"""
SCOPED = ("java", "csharp", "rust", "python")
TS = ("ts", "tsx")
TS_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
BARREL_DEPTH = 16


def parse(sources: DataFrame) -> DataFrame:
    """``sources``: path, blob_sha, bytes. One row per source file with what its text defines and uses."""
    schema = f"path string, blob_sha string, lang string, {_FOUND}"
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple[str, str], ex.Found] = {}
        for b in batches:
            rows = []
            for path, sha, raw in zip(*(b.column(c).to_pylist() for c in ("path", "blob_sha", "bytes")), strict=True):
                lang = ex.language(path)
                if lang is None or b"\0" in (raw or b"")[:8000]:
                    continue
                if (sha, lang) not in done:
                    if len(done) > 256:
                        done.clear()
                    done[sha, lang] = ex.extract(lang, (raw or b"").decode("utf-8", "replace"))
                f = done[sha, lang]
                scope, visible = ex.scopes_of(lang, path, f)
                named = lambda names, items: [dict(zip(names, x, strict=True)) for x in items]
                rows.append({
                    "path": path, "blob_sha": sha, "lang": lang, "symbols": named(("name", "kind", "start_line", "end_line"), f.symbols), "refs": named(("name", "ref_kind", "line", "receiver", "qualifier"), f.refs),
                    "imports": named(("local", "module", "name"), f.imports), "reexports": named(("exported", "module", "name"), f.reexports), "owners": named(("type", "method"), f.owners), "scope": scope, "visible": visible,
                })
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    # rows of one blob stand together, so a worker's small table serves its copies
    return sources.select("path", "blob_sha", "bytes").repartition("blob_sha").sortWithinPartitions("blob_sha").mapInArrow(run, schema)


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "blob_sha", F.inline("symbols"), "lang").select("path", "blob_sha", "name", "kind", "start_line", "end_line", "lang")


def references(parsed: DataFrame) -> DataFrame:
    """References to names that the repository defines or re-exports (in any language)."""
    names = parsed.select(F.explode("symbols.name").alias("name")).unionByName(parsed.select(F.explode("reexports.exported").alias("name"))).distinct()
    rows = parsed.select("path", "blob_sha", F.inline("refs"), "lang")
    return rows.join(names, "name", "left_semi").withColumn("ref_id", F.monotonically_increasing_id())


def module_candidates(at: DataFrame) -> DataFrame:
    """``at``: path, module (and more) plus ``tries``: paths that a relative module may stand for, in order."""
    parts = F.split(F.concat_ws("/", F.nullif(dir_of(F.col("path")), F.lit("")), "module"), "/")
    folded = F.aggregate(
        parts, F.expr("CAST(array() AS array<string>)"),
        lambda acc, x: F.when((x == ".") | (x == ""), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return at.withColumn("tries", tries_of(F.array_join(folded, "/")))


def tries_of(base: Column) -> Column:
    """Paths that a module at ``base`` may stand for, in order."""
    bare = F.regexp_replace(base, r"\.jsx?$", "")
    as_ts = F.when(base.rlike(r"\.jsx?$"), F.array(F.concat(bare, F.lit(".ts")), F.concat(bare, F.lit(".tsx")))).otherwise(F.expr("CAST(array() AS array<string>)"))
    exact = F.when(F.substring_index(base, "/", -1).contains("."), F.array(base)).otherwise(F.expr("CAST(array() AS array<string>)"))
    ends = F.array(*(F.concat(base, F.lit(e)) for e in TS_EXTENSIONS), *(F.concat(base, F.lit("/index" + e)) for e in TS_EXTENSIONS))
    return F.concat(exact, as_ts, ends)


_JSONC = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?(?:\*/|\Z)', re.DOTALL)
_LAST_COMMA = re.compile(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', re.DOTALL)


def read_jsonc(text: str):
    """JSON with comments and commas before a closing bracket; None where it is not."""
    for pattern in (_JSONC, _LAST_COMMA):
        text = pattern.sub(lambda m: m[1] or "", text)
    try:
        return json.loads(text)
    except ValueError:
        return None


def _folder(*parts: str) -> str:
    done: list[str] = []
    for part in "/".join(parts).split("/"):
        if part == "..":
            done = done[:-1]
        elif part not in ("", "."):
            done.append(part)
    return "/".join(done)


def alias_rules(path: str, text: str) -> list[dict]:
    """Path aliases that a tsconfig declares: folder it rules, prefix, whether a rest follows, targets in order."""
    options = found.get("compilerOptions") if isinstance(found := read_jsonc(text), dict) else None
    declared = options.get("paths") if isinstance(options, dict) else None
    if not isinstance(declared, dict):
        return []
    home, base = path.rpartition("/")[0], options.get("baseUrl")
    root = _folder(home, base if isinstance(base, str) else ".")
    rules = []
    for pattern, targets in declared.items():
        places = [_folder(root, t.rstrip("*")) for t in targets if isinstance(t, str)] if isinstance(targets, list) else []
        if places:
            rules.append({"folder": home, "prefix": pattern.rstrip("*"), "open": pattern.endswith("*"), "places": places})
    return rules


def path_aliases(blobs: DataFrame) -> DataFrame:
    """(folder, nth, prefix, open, places) of every tsconfig's own aliases; ``blobs``: path, bytes."""
    name = F.substring_index("path", "/", -1)
    files = blobs.filter((name == "tsconfig.json") | (name.startswith("tsconfig.") & name.endswith(".json"))).select("path", "bytes")
    schema = "folder string, nth int, config string, prefix string, open boolean, places array<string>"
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{**rule, "nth": k, "config": r["path"]} for r in b.to_pylist() for k, rule in enumerate(alias_rules(r["path"], (r["bytes"] or b"").decode("utf-8", "replace")))]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return files.mapInArrow(run, schema)


def alias_candidates(uses: DataFrame, aliases: DataFrame) -> DataFrame:
    """``uses`` (path, module, use) with ``tries``: paths that its aliases offer; rules of the deepest folder first, then in the order of the file."""
    parts = F.split(dir_of(F.col("path")), "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    ruled = uses.withColumn("folder", F.explode(F.array_distinct(above))).join(aliases, "folder")
    fits = F.when(F.col("open"), F.expr("startswith(module, prefix)")).otherwise(F.col("module") == F.col("prefix"))
    rest = F.when(F.col("open"), F.expr("substring(module, length(prefix) + 1)"))
    bases = F.transform("places", lambda p: F.concat_ws("/", F.nullif(p, F.lit("")), rest))
    rule = F.struct((-F.length("folder")).alias("depth"), "config", "nth", F.flatten(F.transform(bases, tries_of)).alias("tries"))
    found = ruled.filter(fits).groupBy("use").agg(F.sort_array(F.collect_list(rule)).alias("rules"))
    return found.select("use", F.flatten("rules.tries").alias("tries"))


def resolve_modules(uses: DataFrame, paths: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(path, module, target) of modules that exist: relative ones and, with ``aliases``, those that a tsconfig names; ``uses``: path, module."""
    found = _relative(uses, paths)
    if aliases is None:
        return found
    named = uses.filter(~F.col("module").startswith(".")).select("path", "module").distinct().withColumn("use", F.concat_ws("\u0001", "path", "module"))
    hit = first_existing(alias_candidates(named, aliases), "use", "tries", paths.select(F.col("path").alias("target")), "target")
    return found.unionByName(named.join(hit, "use").select("path", "module", "target"))


def _relative(uses: DataFrame, paths: DataFrame) -> DataFrame:
    rel = uses.filter(F.col("module").startswith(".")).select("path", "module").distinct().withColumn("use", F.concat_ws("\u0001", "path", "module"))
    hit = first_existing(module_candidates(rel), "use", "tries", paths.select(F.col("path").alias("target")), "target")
    return rel.join(hit, "use").select("path", "module", "target")


def definers(names: DataFrame, syms: DataFrame, reexports: DataFrame, rounds: int = BARREL_DEPTH) -> DataFrame:
    """Follow (key, file, name) through re-exports to a file that defines the name: (key, def_path)."""
    known = syms.select(F.col("path").alias("file"), "name").distinct().withColumn("has", F.lit(True))
    named = reexports.filter("exported <> '*'").select(F.col("path").alias("file"), F.col("exported").alias("name"), F.col("target").alias("to_file"), F.col("name").alias("to_name"))
    stars = reexports.filter("exported = '*'").select(F.col("path").alias("file"), F.col("target").alias("to_file"))
    open_, found = durable(names.select("key", "file", "name", F.lit(0).alias("depth")), "defs"), None
    for depth in range(rounds + 1):
        here = open_.join(known, ["file", "name"], "left")
        hit = here.filter("has").groupBy("key").agg(F.min("file").alias("def_path"), F.lit(depth).alias("depth"))
        found = durable(hit if found is None else found.unionByName(hit.join(found.select("key"), "key", "left_anti")), "defs")
        rest = here.filter("has is null").join(found.select("key"), "key", "left_anti").select("key", "file", "name")
        nxt = rest.join(named, ["file", "name"]).select("key", F.col("to_file").alias("file"), F.col("to_name").alias("name"))
        nxt = nxt.unionByName(rest.join(stars, "file").select("key", F.col("to_file").alias("file"), "name")).distinct()
        open_ = durable(nxt, "defs")
        if open_.isEmpty():
            break
    return found.select("key", "def_path")


def resolve(parsed: DataFrame, paths: DataFrame, go_modules: DataFrame | None = None, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(symbols, references with def_path). ``go_modules``: module (name), root (folder); ``aliases`` as ``path_aliases`` gives them."""
    parsed = durable(parsed, "parsed")
    syms = symbols(parsed)
    refs = durable(references(parsed), "refs")
    defs = syms.select("lang", "name", F.col("path").alias("def_path")).distinct()
    owners = parsed.select("lang", F.col("path").alias("def_path"), F.inline("owners"))
    by_type = unique_by(owners, ["lang", "type", "method"], "def_path").select("lang", F.col("type").alias("receiver"), F.col("method").alias("name"), F.col("def_path").alias("by_type"))
    out = refs.join(by_type, ["lang", "receiver", "name"], "left").withColumn("by_type", F.when(F.col("ref_kind") == "method", F.col("by_type")))
    here = defs.select("lang", "name", F.col("def_path").alias("path"), F.col("def_path").alias("here"))
    out = out.join(here, ["lang", "name", "path"], "left")
    alone = unique_by(defs, ["lang", "name"], "def_path").withColumnRenamed("def_path", "alone")
    out = out.join(alone, ["lang", "name"], "left")
    folder = unique_by(defs.withColumn("folder", dir_of(F.col("def_path"))), ["lang", "folder", "name"], "def_path").withColumnRenamed("def_path", "near")
    out = out.withColumn("folder", dir_of(F.col("path"))).join(folder, ["lang", "folder", "name"], "left")
    # scopes a file sees: one candidate file over all of them
    own = parsed.filter(F.col("lang").isin(*SCOPED)).select("lang", F.col("scope").alias("seen"), F.explode("symbols.name").alias("name"), F.col("path").alias("def_path")).distinct()
    sees = parsed.filter(F.col("lang").isin(*SCOPED)).select("lang", "path", F.explode(F.array_distinct("visible")).alias("seen"))
    wanted = refs.filter(F.col("lang").isin(*SCOPED)).select("lang", "path", "name").distinct()
    visible = unique_by(wanted.join(sees, ["lang", "path"]).join(own, ["lang", "seen", "name"]), ["lang", "path", "name"], "def_path").withColumnRenamed("def_path", "visible")
    out = out.join(visible, ["lang", "path", "name"], "left")
    out = _with_imports(out, parsed, refs, syms, paths, aliases)
    out = _with_go(out, parsed, folder, go_modules)
    scoped = F.coalesce("here", "alone", "visible")
    go = F.coalesce("here", "near", "package", "alone")
    ts = F.when(F.col("imported"), F.col("by_import")).otherwise(F.col("here"))
    target = F.when(F.col("lang") == "go", go).when(F.col("lang").isin(*SCOPED), scoped).when(F.col("lang").isin(*TS), ts).otherwise(F.col("here"))
    return syms, out.select("path", "blob_sha", "name", "ref_kind", "line", "lang", F.coalesce("by_type", target).alias("def_path"))


def _with_imports(out: DataFrame, parsed: DataFrame, refs: DataFrame, syms: DataFrame, paths: DataFrame, aliases: DataFrame | None) -> DataFrame:
    ts = parsed.filter(F.col("lang").isin(*TS))
    imports = ts.select("path", F.inline("imports")).groupBy("path", "local").agg(F.min(F.struct("module", "name")).alias("i")).select("path", "local", "i.module", F.col("i.name").alias("imported_name"))
    reexports = ts.select("path", F.inline("reexports"))
    modules = durable(resolve_modules(imports.select("path", "module").unionByName(reexports.select("path", "module")), paths, aliases), "modules")
    bound = refs.filter(F.col("lang").isin(*TS)).join(imports.withColumnRenamed("local", "name"), ["path", "name"]).join(modules, ["path", "module"], "left")
    star = refs.filter(F.col("lang").isin(*TS)).join(imports.filter("imported_name = '*'").withColumnRenamed("local", "qualifier"), ["path", "qualifier"]).join(modules, ["path", "module"], "left")
    asked = bound.select("ref_id", "target", F.when(F.col("imported_name").isin("*", "default"), F.col("name")).otherwise(F.col("imported_name")).alias("name")).unionByName(star.select("ref_id", "target", "name"))
    asked = durable(asked.groupBy("ref_id").agg(F.min(F.struct("target", "name")).alias("a")).select("ref_id", "a.*"), "asked")
    into = asked.filter("target is not null").select(F.col("ref_id").alias("key"), F.col("target").alias("file"), "name")
    found = definers(into, syms, reexports.join(modules, ["path", "module"]))
    by_import = asked.join(found.withColumnRenamed("key", "ref_id"), "ref_id", "left").select("ref_id", F.lit(True).alias("imported"), F.col("def_path").alias("by_import"))
    return out.join(by_import, "ref_id", "left").withColumn("imported", F.coalesce("imported", F.lit(False)))


def _with_go(out: DataFrame, parsed: DataFrame, folder: DataFrame, go_modules: DataFrame | None) -> DataFrame:
    """The folder of the qualifier's package: the import path behind its longest known module."""
    if go_modules is None:
        return out.withColumn("package", F.lit(None).cast("string"))
    imports = parsed.filter("lang = 'go'").select("path", F.inline("imports")).select("path", F.col("local").alias("qualifier"), F.col("module").alias("import_path")).distinct()
    rooted = longest_prefix(imports, "import_path", go_modules, "module")
    rest = F.regexp_replace(F.expr("substring(import_path, length(module) + 1)"), "^/", "")
    placed = rooted.select("path", "qualifier", F.concat_ws("/", F.nullif("root", F.lit("")), F.nullif(rest, F.lit(""))).alias("package_dir"))
    placed = placed.groupBy("path", "qualifier").agg(F.min("package_dir").alias("package_dir"))
    packages = folder.filter("lang = 'go'").select(F.col("folder").alias("package_dir"), "name", F.col("near").alias("package"))
    return out.join(placed, ["path", "qualifier"], "left").join(packages, ["package_dir", "name"], "left")


def go_modules(blobs: DataFrame) -> DataFrame:
    """(module, root) of every go.mod; ``blobs``: path, bytes."""
    rows = blobs.filter(F.substring_index("path", "/", -1) == "go.mod")
    name = F.regexp_extract(F.decode("bytes", "UTF-8"), r"(?m)^module\s+(\S+)", 1)
    return rows.select(name.alias("module"), dir_of(F.col("path")).alias("root")).filter("module <> ''")

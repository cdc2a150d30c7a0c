"""Joins of the code graph: innermost enclosing definition, gated and prefix joins, test coverage, ancestry."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orebody.functions.paths import target_stem, with_test_signal

LINE_BUCKET = 4096


def unique_by(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) of the keys that have exactly one distinct value."""
    return rows.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__m")).filter(F.col(value) == F.col("__m")).drop("__m")


def enclosing(points: DataFrame, spans: DataFrame, key: str, at: str, low: str, high: str, keep: list[str], bucket: int = LINE_BUCKET) -> DataFrame:
    """Each point with the innermost span that holds it (least length, then latest start, then ``keep``) as ``__s``; points without one are left out.

    Points and spans of a key and a bucket of lines are sorted by line and swept
    together with a heap of the spans begun so far, so the work is n log n and no
    pairs are made; a key of very many rows is split by its buckets.
    """
    own = points.columns
    held = spans.select(F.col(key).alias("__key"), F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))).alias("__b"), F.greatest(F.col(low), F.col("__b") * bucket).alias("__at"), F.lit(0).alias("__kind"), F.struct(F.col(low).alias("low"), F.col(high).alias("high"), *keep).alias("__span"), F.lit(None).cast(points.schema.simpleString()).alias("__point"))
    asked = points.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("__key"), F.floor(F.col(at) / bucket).alias("__b"), F.col(at).cast("long").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(held.schema["__span"].dataType).alias("__span"), F.struct(*own).alias("__point"))
    rows = held.withColumn("__at", F.col("__at").cast("long")).unionByName(asked).repartition("__key", "__b").sortWithinPartitions("__key", "__b", "__at", "__kind")
    out = T.StructType([*points.schema.fields, T.StructField("__s", T.StructType([*(spans.schema[c] for c in keep), T.StructField("start", T.LongType())]))])
    kind = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, []
        for b in batches:
            found = []
            points_, spans_ = b.column("__point"), b.column("__span")
            for group, line, is_point, span, k in zip(zip(b.column("__key").to_pylist(), b.column("__b").to_pylist(), strict=True), b.column("__at").to_pylist(), b.column("__kind").to_pylist(), spans_.to_pylist(), range(b.num_rows), strict=True):
                if group != now:
                    now, open_ = group, []
                if not is_point:
                    heapq.heappush(open_, (span["high"] - span["low"], -span["low"], tuple(span[c] for c in keep), span["high"]))
                    continue
                while open_ and open_[0][3] < line:
                    heapq.heappop(open_)
                if open_:
                    found.append((k, open_[0]))
            inner = [{**dict(zip(keep, best[2], strict=True)), "start": -best[1]} for _, best in found]
            if found:
                rows_ = points_.take(pa.array([k for k, _ in found]))
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(rows_.flatten(), kind, strict=False)), pa.array(inner, kind.field("__s").type)], schema=kind)

    return rows.mapInArrow(run, out)


def symbol_edges(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """References attributed to the innermost definition around them; the callee is pinned where its name is unique in its file."""
    sources = symbols.filter("start_line <= end_line").select("file_id", "start_line", "end_line", "name", "kind")
    held = enclosing(refs.select("file_id", "name", "ref_kind", "line", "lang", "def_file_id"), sources, "file_id", "line", "start_line", "end_line", ["name", "kind"])
    targets = symbols.groupBy("file_id", "name").agg(F.min("start_line").alias("dst_start_line"), F.count("*").alias("n")).filter("n = 1").select(F.col("file_id").alias("def_file_id"), "name", "dst_start_line")
    out = held.join(targets, ["def_file_id", "name"], "left")
    return out.select(
        F.col("file_id").alias("src_file_id"), F.col("__s.name").alias("src_name"), F.col("__s.kind").alias("src_kind"), F.col("__s.start").alias("src_start_line"),
        F.col("name").alias("dst_name"), F.col("def_file_id").alias("dst_file_id"), "dst_start_line", "ref_kind", "line", "lang",
    )


def dead_symbols(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and methods that no resolved edge points at."""
    used = edges.filter("dst_file_id is not null").select(F.col("dst_file_id").alias("file_id"), F.col("dst_name").alias("name")).distinct()
    return symbols.filter(F.col("kind").isin("function", "method")).join(used, ["file_id", "name"], "left_anti")


def longest_prefix(items: DataFrame, value: str, prefixes: DataFrame, prefix: str, sep: str = "/") -> DataFrame:
    """Each item with its longest prefix at a separator: an equi-join on the item's own prefixes, none of the pairs compared."""
    parts = F.split(F.col(value), sep)
    own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))
    cut = items.withColumn("__id", F.monotonically_increasing_id()).withColumn(prefix, F.explode(own))
    cols = items.columns
    rest = [c for c in prefixes.columns if c != prefix]
    best = cut.join(prefixes, prefix).groupBy("__id", *cols).agg(F.max(F.struct(F.length(prefix).alias("n"), F.col(prefix), *rest)).alias("__p"))
    return best.select(*cols, f"__p.{prefix}", *(f"__p.{c}" for c in rest))


def first_existing(candidates: DataFrame, key: str, array: str, known: DataFrame, value: str) -> DataFrame:
    """(key, value): the first entry of each candidate array that ``known`` has."""
    rows = candidates.select(key, F.posexplode(array).alias("__k", value)).join(known.select(value).distinct(), value)
    return rows.groupBy(key).agg(F.min_by(value, "__k").alias(value))


def tests_and_sources(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    from orebody.storage import durable

    rows = durable(with_test_signal(files.select("file_id", "path")), "paths")  # read three times
    return rows.filter("signal is not null").withColumn("target", target_stem(F.col("stem"))), rows.filter("signal is null")


def test_files(files: DataFrame) -> DataFrame:
    return with_test_signal(files.select("file_id", "path")).filter("signal is not null").select("file_id", "lang", "signal")


def test_coverage(files: DataFrame) -> DataFrame:
    """Test file -> the source it is about: the only one of its stem in the same folder, else the only one anywhere.

    Counts decide before the join, so each test meets at most one source in
    each of two gated joins.
    """
    tests, sources = tests_and_sources(files)
    near = sources.groupBy("lang", "stem", "dir").agg(F.count("*").alias("near_n"), F.min("file_id").alias("near_id"))
    wide = sources.groupBy("lang", "stem").agg(F.count("*").alias("wide_n"), F.min("file_id").alias("wide_id"))
    t = tests.select(F.col("file_id").alias("test_file_id"), "lang", F.col("target").alias("stem"), "dir")
    out = t.join(near, ["lang", "stem", "dir"], "left").join(wide, ["lang", "stem"], "left")
    same = F.col("near_n") == 1
    alone = F.col("near_n").isNull() & (F.col("wide_n") == 1)
    return out.filter(same | alone).select("test_file_id", F.when(same, F.col("near_id")).otherwise(F.col("wide_id")).alias("source_file_id"), F.when(same, "same_dir").otherwise("unique_stem").alias("method"))


def ancestors(parents: DataFrame, start: DataFrame, most: int = 100_000, steps: int = 8) -> DataFrame:
    """Distinct (commit_sha) reachable from ``start`` over parents, itself included, by frontier joins.

    A round goes ``steps`` generations further and writes only what it found
    new, so each commit is written once and a history of n generations takes
    n / ``steps`` rounds; neither plans nor lineage grow with the depth.
    """
    from orebody.storage import durable

    frontier = durable(start.select("commit_sha").distinct(), "reach")
    edges = durable(parents.select("commit_sha", "parent_sha").distinct(), "edges")
    known = frontier
    for _ in range(most):
        step, found = frontier, None
        for _ in range(steps):
            step = step.join(edges, "commit_sha").select(F.col("parent_sha").alias("commit_sha")).distinct()
            found = step if found is None else found.unionByName(step)
        frontier = durable(found.distinct().join(known, "commit_sha", "left_anti"), "front")
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
    raise RuntimeError("history deeper than the bound")


def active_refs(refs: DataFrame, days: int = 90) -> DataFrame:
    """Branch tips with a flag: within ``days`` of the newest tip (active) or not (deferred)."""
    newest = refs.agg(F.max("tip_epoch").alias("newest"))
    return refs.crossJoin(F.broadcast(newest)).withColumn("is_active", F.col("newest") - F.col("tip_epoch") <= days * 86400).drop("newest")


def paired_rank(left: DataFrame, right: DataFrame, keys: list[str], by_left: str, by_right: str) -> DataFrame:
    """Inner join of the k-th of one side with the k-th of the other inside each key."""
    a = left.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(by_left)))
    b = right.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(by_right)))
    return a.join(b, [*keys, "__k"]).drop("__k")

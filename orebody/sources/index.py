"""An index on storage: one Parquet dataset per table, a manifest and a self-describing card."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from orebody.schema import SCHEMA_VERSION, SCHEMAS, conform, empty

#: Tables that a run without their level leaves as they were.
KEEP_IF_EMPTY = ("chunks", "blob_chunks", "commit_trees", "tree_objects", "blame_snapshots", "snapshot_ownership")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, value: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(value.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """The index's manifest, or None where there is none of this version: then only a full run is possible."""
    raw = read_text(spark, f"{folder}/manifest.json")
    try:
        found = json.loads(raw) if raw else None
    except ValueError:
        return None
    return found if found and found.get("schema_version") == SCHEMA_VERSION else None


def write_table(df: DataFrame, folder: str, name: str) -> None:
    """Write beside the old dataset first, then swap, so a table may be computed from its own old rows."""
    spark = df.sparkSession
    target, fresh = f"{folder}/{name}.parquet", f"{folder}/.{name}.new"
    rows = conform(df, name)
    if name in KEEP_IF_EMPTY and exists(spark, target) and rows.isEmpty():
        return
    rows.write.mode("overwrite").parquet(fresh)
    fs, old = _fs(spark, target)
    _, new = _fs(spark, fresh)
    fs.delete(old, True)
    fs.rename(new, old)


def write_index(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], head: str, level: str) -> dict:
    """All 41 tables, missing ones empty; returns the card."""
    for name in SCHEMAS:
        write_table(tables[name] if name in tables else empty(spark, name), folder, name)
    card = {"schema_version": SCHEMA_VERSION, "head_sha": head, "level": level, "tables": []}
    for name in SCHEMAS:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        card["tables"].append({"name": name, "rows": df.count(), "columns": df.columns})
    card |= {"table_count": len(card["tables"]), "total_rows": sum(t["rows"] for t in card["tables"])}
    write_text(spark, f"{folder}/index.json", json.dumps(card, indent=1))
    write_text(spark, f"{folder}/manifest.json", json.dumps({"schema_version": SCHEMA_VERSION, "head_sha": head, "level": level}))
    return card


def read_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables by name; columns are bound by name."""
    found = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in SCHEMAS if exists(spark, f"{folder}/{n}.parquet")}
    for extra in ("semantic_refs", "observations"):
        if exists(spark, f"{folder}/{extra}.parquet"):
            found[extra] = spark.read.parquet(f"{folder}/{extra}.parquet")
    return found

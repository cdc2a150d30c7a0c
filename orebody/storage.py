"""Durable intermediates: Parquet below ``spark.checkpoint.dir``, so lost executors cost a reread only."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: list[str] = []


def work_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="orebody-core-"))
    return _LOCAL[0]


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` and return it as a scan; the write's shuffle files go with its end."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def ranked_ids(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with a 1-based rank by ``keys`` (distinct by assumption), without a single-partition sort.

    Rows are range-partitioned and numbered inside their partition; the few
    partition totals give the offsets.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id())
    from pyspark.sql import Window as W

    numbered = durable(ranged.withColumn("__n", F.row_number().over(W.partitionBy("__part").orderBy(*keys))), "ids")
    totals = sorted((r[0], r[1]) for r in numbered.groupBy("__part").count().collect())  # one number per partition
    offsets, before = [], 0
    for part, n in totals:
        offsets.append((part, before))
        before += n
    schema = T.StructType([T.StructField("__part", T.IntegerType()), T.StructField("__base", T.LongType())])
    base = spark.createDataFrame(offsets, schema)
    return numbered.join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + F.col("__n")).drop("__part", "__n", "__base")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): least node of each connected component, for nodes with an edge; columns ``a`` and ``b`` of any ordered type.

    Alternating large and small stars; every step is an equi-join on a per-node
    minimum that is aggregated before the shuffle.
    """
    cur = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    seen = None
    for _ in range(rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = durable(moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "cc")
        mark = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Shared plumbing of the corpus operators: table access, durable intermediates, components.

Nothing here uses executor-local or driver-local files on a cluster: every
intermediate is a Parquet table below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20
_TEST_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _TEST_DIR:
        _TEST_DIR.append(tempfile.mkdtemp(prefix="orebody-"))
    return _TEST_DIR[0]


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a scan, so that its lineage ends there.

    Shuffle files of the write are of no further use and go with its end. ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._orebody_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written intermediates that nothing reads any more."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, getattr(df, "_orebody_path", None)
        for name in [path] if isinstance(path, str) else path or []:
            at = jvm.org.apache.hadoop.fs.Path(name)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def portions(written: DataFrame, most: int) -> list[DataFrame]:
    """The rows of a written table as at most ``most`` tables, each of whole files that ``discard`` deletes by themselves."""
    files = sorted(written.inputFiles())
    out = []
    for own in filter(None, (files[i::most] for i in range(most))):
        out.append(written.sparkSession.read.schema(written.schema).parquet(*own))
        out[-1]._orebody_path = own
    return out or [written]


def trim() -> None:
    """Give memory that is free in this Python worker back to the machine; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` in batches that fit long texts, with the worker's free memory returned at a partition's end.

    The two limits of batches are settings of the session; as the plan may run later, they stay lowered.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        trim()

    return df.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without decoding; null counts as empty."""
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return raw_texts(batch.column(column))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``most`` bytes of text, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = before = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, before + most, "right")))
        yield batch.slice(at, end - at)
        at, before = end, int(size[end - 1])


def by_position(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: no name of a caller's column can meet one of an operator's own."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


#: A key of more rows than this, and than a thousandth of all, is dealt over tasks.
HOT_ROWS = 1000
HOT_WAYS = 64


def lookup(left: DataFrame, right: DataFrame, key: str, spread: list[str]) -> DataFrame:
    """``left`` joined with the one row that the written table ``right`` has for a key; ``right.n`` counts a key's rows in ``left``.

    Rows of a hot key are dealt by ``spread`` and meet copies of the key's row. At most a thousand keys are hot.
    """
    total = right.agg(F.sum("n")).first()[0] or 0
    hot = right.filter(F.col("n") > max(HOT_ROWS, total // 1000)).select(key, F.lit(True).alias("hot"))
    if hot.isEmpty():
        return left.hint("merge").join(right.drop("n"), key)
    hot = F.broadcast(hot)
    way = F.when(F.col("hot"), F.pmod(F.xxhash64(*spread), F.lit(HOT_WAYS)).cast("int")).otherwise(0)
    ways = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(HOT_WAYS - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.join(hot, key, "left").withColumn("way", way).drop("hot")
    copies = right.drop("n").join(hot, key, "left").withColumn("way", F.explode(ways)).drop("hot")
    return dealt.hint("merge").join(copies, [key, "way"]).drop("way")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: (node, root), root = least node id, for nodes that have an edge.

    Alternating large-star / small-star contraction. Each round is two joins on
    a per-node minimum that is pre-aggregated map-side; a hub's neighbours are
    spread by the join's skew handling and no neighbourhood is ever collected.
    ``edges`` has two long columns; self loops and repeats are harmless.
    """
    a, b = edges.columns[:2]
    cur = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        nxt = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        last, cur = cur, materialize(nxt, "cc")
        discard(last)
        mark = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

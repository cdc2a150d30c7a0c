"""Two-pass external shuffle into shards.

Pass 1 scatters whole records by a seeded hash of (doc_id, text checksum) into
buckets sized to memory; no other column decides, so no source can be hot. Pass 2 orders
each bucket canonically, Fisher-Yates shuffles it with a generator seeded by
(seed, bucket), and numbers it. Bucket offsets are prefix sums of bucket
counts, so position p of the whole permutation is known without a third pass;
shard k holds the k-th of n stretches of the permutation, which differ in length
by one at most, so a bucket is written to few shards. Law: ``rows``. A bucket far
above the mean, which only rows repeated very often can make, is dealt into
parts by the rows' numbers.

The permutation depends on the rows, the seed and the bucket count only (rows
equal in doc_id and text may change places with each other), so a bucket that is
recomputed after a lost executor comes out the same. Defined
results: null text has 0 bytes and the checksum of nothing; null doc_ids are
records like others; equal rows are all kept; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orebody.llm.common import by_position, map_batches, materialize, shared_dir

BUCKET_BYTES = 48 << 20
SHARDS = 16
#: Rows that a bucket may hold whatever the mean.
MIN_SPLIT = 4096


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A uniform permutation; each step swaps the last open place with a random one at or before it."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = list(range(n))
    picks = rng.integers(0, np.arange(n, 0, -1)).tolist() if n else []
    for i, k in zip(range(n - 1, 0, -1), picks, strict=False):
        order[i], order[k] = order[k], order[i]
    return np.array(order, dtype=np.int64)


def bucket_count(total_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(1, -(-total_bytes // bucket_bytes))


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` and ``slot``, which replace columns of these names; rows of a bucket stand in shuffled order."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    names = docs.columns
    plain = by_position(docs)
    kept = plain.columns
    doc_id, text = (F.col(kept[names.index(c)]) for c in ("doc_id", "text"))
    total = plain.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1)).first()[0] or 0
    buckets = bucket_count(total, bucket_bytes)
    check = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    keyed = plain.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), doc_id, check), F.lit(buckets)).cast("int")).withColumn("part", F.lit(0))
    rows = {r[0]: r[1] for r in keyed.groupBy("bucket").count().collect()}  # one number per bucket
    most = max(MIN_SPLIT, 4 * sum(rows.values()) // buckets)
    hot = [(b, -(-n // most)) for b, n in rows.items() if n > most]
    if hot:
        # only rows repeated very often make such a bucket; it is written with its rows dealt, since row numbers hold for one plan only
        parts = F.broadcast(spark.createDataFrame(hot, "bucket int, parts int"))
        dealt = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.col("parts")).cast("int")
        written = materialize(keyed.drop("part").join(parts, "bucket").withColumn("part", dealt).select(keyed.columns), "hot")
        keyed = keyed.join(parts, "bucket", "left_anti").select(keyed.columns).unionByName(written)
    counts = sorted((r[0], r[1], r[2]) for r in keyed.groupBy("bucket", "part").count().collect()) if hot else sorted((b, 0, n) for b, n in rows.items())
    base, number, before = {}, {}, 0
    for b, part, n in counts:
        base[b, part], number[b, part], before = before, len(number), before + n
    bases = spark.sparkContext.broadcast((base, before))
    place = F.broadcast(spark.createDataFrame([(*k, n) for k, n in number.items()], "bucket int, part int, number int"))
    scattered = keyed.join(place, ["bucket", "part"]).repartitionById(max(1, len(number)), "number").sortWithinPartitions("number", doc_id, text)
    scattered = scattered.select(*kept, "bucket", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, rows = bases.value
        least, more = divmod(rows, shards)

        def finish(key: tuple[int, int], parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(parts).select(kept)
            order = fisher_yates(whole.num_rows, (seed, *key))
            at = begin[key] + np.arange(whole.num_rows)
            # the first ``more`` shards hold one row more than the others
            late = at - more * (least + 1)
            shard = np.where(late < 0, at // (least + 1), more + late // max(1, least))
            slot = np.where(late < 0, at % (least + 1), late % max(1, least))
            for s in range(0, whole.num_rows, 512):
                moved = whole.take(pa.array(order[s : s + 512]))
                moved = moved.append_column("shard", pa.array(shard[s : s + 512], pa.int32())).append_column("slot", pa.array(slot[s : s + 512], pa.int64()))
                yield from moved.combine_chunks().to_batches()

        now, held = None, []
        for b in batches:
            keys = list(zip(b.column("bucket").to_pylist(), b.column("part").to_pylist(), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if s == e:
                    continue
                if held and keys[s] != now:
                    yield from finish(now, held)
                    held = []
                now = keys[s]
                held.append(b.slice(s, e - s))
        if held:
            yield from finish(now, held)

    schema = T.StructType([*plain.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return map_batches(scattered, run, schema).toDF(*names, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write one folder per shard and return the written rows; a bucket's rows lie in at most a few shards, by slot."""
    moved = shuffled(docs, shards, seed, bucket_bytes)
    moved.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(moved.schema).parquet(path).select(*moved.columns)


def digests(docs: DataFrame, shards: int = SHARDS, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the shards to the shared folder and read placements and checksums back from them."""
    path = f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    rows = write_shards(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), path, shards, seed, bucket_bytes)
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

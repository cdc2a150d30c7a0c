"""Tables from blob contents: markers, secrets, generated headers, facts, and content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.functions.content import MARKER_TEXT, MARKERS, SECRET_RULES, has_generated_header, is_binary, line_count, lines_of, marker_pattern


def _numbered(texts: DataFrame, keys: list[str]) -> DataFrame:
    return texts.select(*keys, F.posexplode(lines_of(F.col("text"))).alias("__k", "__line")).withColumn("line", F.col("__k") + 1)


def markers(texts: DataFrame, keys: list[str], words: list[str] = MARKERS) -> DataFrame:
    """(keys, line, marker, text): every marker of every line; ``texts``: keys and text. One pass over the texts for all words."""
    has = lambda c: reduce(lambda a, w: a | F.contains(c, F.lit(w)), words[1:], F.contains(c, F.lit(words[0])))
    rows = _numbered(texts.filter(has("text")), keys).filter(has("__line"))
    hits = F.concat(*(_rests(F.split("__line", marker_pattern([w])), w) for w in words))
    out = rows.select(*keys, "line", F.inline(hits))
    return out.select(*keys, "line", "marker", F.substring(F.regexp_replace(F.regexp_replace("rest", r"^[: \t]+", ""), r"\s+$", ""), 1, MARKER_TEXT).alias("text"))


def _rests(cut: Column, word: str) -> Column:
    """What follows each occurrence of ``word``, with the word, given the line cut at its occurrences."""
    one = lambda k: F.struct(F.lit(word).alias("marker"), F.array_join(F.slice(cut, k, F.size(cut)), word).alias("rest"))
    none = F.expr("CAST(array() AS array<struct<marker: string, rest: string>>)")
    return F.when(F.size(cut) > 1, F.transform(F.sequence(F.lit(2), F.size(cut)), one)).otherwise(none)


def _hits(line: Column, rule: str, pattern: str, shown: int) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(rule).alias("rule"), F.concat(F.substring(m, 1, shown), F.lit("…")).alias("preview")))


def secrets(texts: DataFrame, keys: list[str], rules: dict = SECRET_RULES) -> DataFrame:
    """(keys, line, rule, preview); a preview never shows more than the credential's type."""
    hits = [_hits(F.col("__line"), rule, *spec) for rule, spec in rules.items()]
    return _numbered(texts, keys).select(*keys, "line", F.inline(F.concat(*hits)))


def generated_by_header(texts: DataFrame, keys: list[str]) -> DataFrame:
    return texts.filter(has_generated_header(F.col("text"))).select(*keys, F.lit("generated").alias("category"), F.lit("content-marker").alias("reason"))


def blob_facts(blobs: DataFrame) -> DataFrame:
    """(blob_sha, size_bytes, line_count, is_binary) of distinct blobs; ``blobs``: blob_sha, bytes."""
    text: Column = F.decode("bytes", "ISO-8859-1")
    rows = blobs.dropDuplicates(["blob_sha"]).withColumn("__bin", is_binary(F.col("bytes")))
    return rows.select("blob_sha", F.octet_length("bytes").cast("long").alias("size_bytes"), F.when(F.col("__bin"), F.lit(0)).otherwise(line_count(text)).cast("long").alias("line_count"), F.col("__bin").alias("is_binary"))


# -- content-defined chunking ---------------------------------------------------------------------

_M64 = (1 << 64) - 1
SEED = 0x123456789ABCDEF0  # fixed value of the chunk format
AVERAGE = 8192


class Cutter:
    """Gear-hash chunking with normalised cut masks (FastCDC); sizes from average/4 to 8 averages."""

    def __init__(self, average: int = AVERAGE):
        self.average = 1 << max(6, (average - 1).bit_length())
        self.least, self.most = self.average // 4, self.average * 8
        state = SEED

        def draw() -> int:  # splitmix64
            nonlocal state
            state = (state + 0x9E3779B97F4A7C15) & _M64
            z = state
            z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M64
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M64
            return z ^ (z >> 31)

        self.gear = np.array([draw() for _ in range(256)], dtype=np.uint64)
        bits = self.average.bit_length() - 1

        def mask(n: int) -> int:
            m = 0
            while m.bit_count() < n:
                m |= 1 << (draw() & 63)
            return m

        self.strict, self.loose = np.uint64(mask(bits + 2)), np.uint64(mask(bits - 2))

    def prints(self, data: np.ndarray) -> np.ndarray:
        """Rolling print ending at each byte when it has rolled over the 64 bytes before it; older bytes have been shifted out."""
        g = self.gear[data]
        out = g.copy()
        with np.errstate(over="ignore"):
            width = 1
            while width < 64:  # doubling: the print of 2w bytes from two of w
                out[width:] += out[:-width].copy() << np.uint64(width)
                width *= 2
        return out

    def split(self, data: bytes) -> list[int]:
        """Chunk lengths of ``data``; scanning of a chunk starts at its least size with an empty print."""
        n = len(data)
        if n <= self.least:
            return [n] if n else []
        raw = np.frombuffer(data, np.uint8)
        full = self.prints(raw)
        strict = np.flatnonzero((full & self.strict) == 0)
        loose = np.flatnonzero((full & self.loose) == 0)
        sizes, at = [], 0
        while at < n:
            rest = n - at
            if rest <= self.least:
                sizes.append(rest)
                break
            begin = at + self.least
            end, centre = at + min(rest, self.most), at + min(rest, self.average)
            cut = self._fresh(raw, begin, min(begin + 63, end), centre)
            if cut is None:
                cut = self._next(strict, begin + 63, centre)
            if cut is None:
                cut = self._next(loose, max(begin + 63, centre), end)
            length = (cut + 1 if cut is not None else end) - at
            sizes.append(length)
            at += length
        return sizes

    def _fresh(self, raw: np.ndarray, begin: int, end: int, centre: int) -> int | None:
        """The first 63 bytes, where the print has not yet rolled over 64."""
        if begin >= end:
            return None
        with np.errstate(over="ignore"):
            p = self.prints(raw[begin:end])
        at = begin + np.arange(len(p))
        hit = np.flatnonzero((p & np.where(at < centre, self.strict, self.loose)) == 0)
        return int(at[hit[0]]) if len(hit) else None

    @staticmethod
    def _next(places: np.ndarray, begin: int, end: int) -> int | None:
        k = int(np.searchsorted(places, begin))
        return int(places[k]) if k < len(places) and places[k] < end else None


def blob_chunks(blobs: DataFrame, average: int = AVERAGE) -> DataFrame:
    """(blob_sha, seq, offset, size, chunk_hash, bytes) of distinct blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(average)
        for b in batches:
            for sha, data in zip(b.column("blob_sha").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                sizes = cutter.split(data or b"")
                if not sizes:
                    continue
                ends = np.cumsum(sizes).tolist()
                parts = [data[e - n : e] for e, n in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sha] * len(sizes)), pa.array(range(len(sizes)), pa.int32()), pa.array([e - n for e, n in zip(ends, sizes, strict=True)], pa.int64()), pa.array(sizes, pa.int32()), pa.array([xxhash.xxh3_128_hexdigest(p) for p in parts]), pa.array(parts, pa.binary())],
                    ["blob_sha", "seq", "offset", "size", "chunk_hash", "bytes"],
                )

    return blobs.select("blob_sha", "bytes").dropDuplicates(["blob_sha"]).mapInArrow(run, "blob_sha string, seq int, offset long, size int, chunk_hash string, bytes binary")


def chunk_store(parts: DataFrame) -> DataFrame:
    """(chunk_hash, bytes, size, ref_count) of distinct chunks."""
    return parts.groupBy("chunk_hash").agg(F.any_value("bytes").alias("bytes"), F.any_value("size").alias("size"), F.count("*").cast("int").alias("ref_count"))


def rebuild(parts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(blob_sha, bytes) from chunk references and the store."""
    rows = parts.select("blob_sha", "seq", "chunk_hash").join(chunks.select("chunk_hash", F.hex("bytes").alias("h")), "chunk_hash")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "h"))), lambda x: x["h"]), "")
    return rows.groupBy("blob_sha").agg(F.unhex(joined).alias("bytes"))


def dedup_ratio(parts: DataFrame, chunks: DataFrame) -> DataFrame:
    stored, unique = parts.agg(F.sum("size").cast("long").alias("stored")), chunks.agg(F.sum("size").cast("long").alias("unique_bytes"))
    return stored.crossJoin(unique).withColumn("dedup_x", F.round(F.col("stored") / F.col("unique_bytes"), 2))  # two one-row sides

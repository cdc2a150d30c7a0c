"""Rename detection over changes of a commit: exact by blob, then similar by line profile.

Similarity = sum of common line counts over the larger number of lines. When a
commit has more than ``limit`` deletions or additions, candidates come from
MinHash bands; else every pair of the commit is one. Line hashes go to a
commit's task once for each part of the other side, never once for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.operators.code_graph import paired_rank

PERMUTATIONS = 128
BANDS = 32
THRESHOLD = 0.5
LIMIT = 1000
#: Blobs of one side of a commit that meet in one task.
PART = 250


def exact_renames(changes: DataFrame) -> DataFrame:
    """(commit_sha, blob_sha, old_path, path): deletions and additions of one blob, paired in path order."""
    gone = changes.filter("change_type = 'D'").select("commit_sha", F.col("src_blob_sha").alias("blob_sha"), F.col("path").alias("old_path"))
    new = changes.filter("change_type = 'A'").select("commit_sha", F.col("dst_blob_sha").alias("blob_sha"), "path")
    return paired_rank(gone, new, ["commit_sha", "blob_sha"], "old_path", "path")


def line_lists(blobs: DataFrame) -> DataFrame:
    """(blob_sha, lines): sorted hashes of all lines, repeats and line ends kept; ``blobs``: blob_sha, text. Empty and binary texts have none."""
    usable = blobs.filter("text <> '' and instr(text, '\\u0000') = 0")
    lines = F.transform(F.regexp_extract_all("text", F.lit(r"(?s)[^\n]*\n|[^\n]+$"), F.lit(0)), lambda x: F.xxhash64(x))
    return usable.select("blob_sha", F.sort_array(lines).alias("lines")).dropDuplicates(["blob_sha"])


def line_profiles(lists: DataFrame) -> DataFrame:
    """(blob_sha, line, n) of the ``line_lists``."""
    return lists.select("blob_sha", F.explode("lines").alias("line")).groupBy("blob_sha", "line").agg(F.count("*").alias("n"))


def signatures(profiles: DataFrame, permutations: int = PERMUTATIONS) -> DataFrame:
    """(blob_sha, sig): array of MinHash values, all from one aggregation."""
    mins = [F.min(F.xxhash64(F.lit(i), "line")).alias(f"m{i}") for i in range(permutations)]
    wide = profiles.groupBy("blob_sha").agg(*mins)
    return wide.select("blob_sha", F.array(*(f"m{i}" for i in range(permutations))).alias("sig"))


def bands(sigs: DataFrame, count: int = BANDS) -> DataFrame:
    """(blob_sha, band, key)."""
    rows = F.size("sig") / count
    keys = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(F.slice("sig", (b * rows + 1).cast("int"), rows.cast("int"))).alias("key")))
    return sigs.select("blob_sha", F.inline(keys))


def lsh_candidates(left: DataFrame, right: DataFrame, banded: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of (left, right) rows with equal ``keys`` whose blobs share a band; rows carry blob_sha, a left and a right path."""
    a = left.withColumnRenamed("blob_sha", "a_blob").join(banded.withColumnRenamed("blob_sha", "a_blob"), "a_blob")
    b = right.withColumnRenamed("blob_sha", "b_blob").join(banded.withColumnRenamed("blob_sha", "b_blob"), "b_blob")
    return a.join(b, [*keys, "band", "key"]).select(*keys, "old_path", "path", "a_blob", "b_blob").distinct()


def _arrays(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


class _Lines:
    """The lines of some blobs, inverted: how many a further blob has in common with each."""

    def __init__(self, blobs: list[np.ndarray]):
        self.size = np.array([len(x) for x in blobs])
        kinds, counts = zip(*(np.unique(x, return_counts=True) for x in blobs), strict=True)
        flat, owner = np.concatenate(kinds), np.repeat(np.arange(len(blobs)), [len(x) for x in kinds])
        order = np.argsort(flat, kind="stable")
        self.line, self.owner, self.count = flat[order], owner[order], np.concatenate(counts)[order]

    def common(self, lines: np.ndarray) -> np.ndarray:
        kinds, counts = np.unique(lines, return_counts=True)
        low, high = np.searchsorted(self.line, kinds, "left"), np.searchsorted(self.line, kinds, "right")
        n = high - low
        at = np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], np.minimum(self.count[at], np.repeat(counts, n)), len(self.size))


def similar_within(gone: DataFrame, new: DataFrame, lists: DataFrame, part: int = PART) -> DataFrame:
    """(commit_sha, a_blob, b_blob, similarity) of all pairs of a commit's blobs that have a common line; ``gone``, ``new``: commit_sha, blob_sha.

    Each side of a commit is dealt into parts of about ``part`` blobs, and two
    parts that meet are a task of their own, which holds the lines of the first.
    """
    sides = [x.select("commit_sha", "blob_sha").distinct() for x in (gone, new)]
    parts = None
    for name, side in zip(("na", "nb"), sides, strict=True):
        n = side.groupBy("commit_sha").agg(F.ceil(F.count("*") / part).cast("int").alias(name))
        parts = n if parts is None else parts.join(n, "commit_sha")
    rows = []
    for k, side in enumerate(sides):
        own, other = (F.pmod(F.xxhash64("blob_sha"), n).cast("int") if k == i else F.explode(F.sequence(F.lit(0), n - 1)) for i, n in enumerate((F.col("na"), F.col("nb"))))
        dealt = side.join(parts, "commit_sha").select("commit_sha", "blob_sha", F.lit(k).alias("side"), own.alias("pa"), other.alias("pb"))
        rows.append(dealt)
    met = rows[0].unionByName(rows[1]).join(lists, "blob_sha").repartition("commit_sha", "pa", "pb").sortWithinPartitions("commit_sha", "pa", "pb", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for b in batches:
            out, scores = [], []
            keys = zip(*(b.column(c).to_pylist() for c in ("commit_sha", "pa", "pb")), strict=True)
            for key, side, blob, lines in zip(keys, b.column("side").to_pylist(), b.column("blob_sha").to_pylist(), _arrays(b.column("lines")), strict=True):
                if key != now:
                    now, held, index = key, [], None
                if not side:
                    held.append((blob, lines.copy()))
                elif held:
                    index = index or _Lines([x for _, x in held])
                    common = index.common(lines)
                    found = np.flatnonzero(common)
                    out += [(key[0], held[i][0], blob) for i in found.tolist()]
                    scores.append(common[found] / np.maximum(index.size[found], len(lines)))
            if out:
                cols = [pa.array(c, pa.string()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(scores), pa.float64())], ["commit_sha", "a_blob", "b_blob", "similarity"])

    return met.select("commit_sha", "pa", "pb", "side", "blob_sha", "lines").mapInArrow(run, "commit_sha string, a_blob string, b_blob string, similarity double")


def similarities(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """``pairs`` (a_blob, b_blob, ...) with ``similarity``; pairs without a common line are left out. For few chosen pairs: each gets the lines of both."""
    met = pairs.select("a_blob", "b_blob").distinct()
    for side in ("a", "b"):
        met = met.join(lists.select(F.col("blob_sha").alias(f"{side}_blob"), F.col("lines").alias(f"{side}_lines")), f"{side}_blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_lines, b_lines = _arrays(b.column("a_lines")), _arrays(b.column("b_lines"))
            score = [_Lines([x]).common(y)[0] / max(len(x), len(y)) for x, y in zip(a_lines, b_lines, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a_blob"), b.column("b_blob"), pa.array(score, pa.float64())], ["a_blob", "b_blob", "similarity"])

    scored = met.select("a_blob", "b_blob", "a_lines", "b_lines").mapInArrow(run, "a_blob string, b_blob string, similarity double")
    return pairs.join(scored.filter("similarity > 0"), ["a_blob", "b_blob"])


def greedy_match(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One-to-one renames per commit, most similar first, ties by (old_path, path).

    A greedy matching is sequential; it runs per commit over pairs above the
    threshold only, in one pass over rows sorted by Spark, holding no more than
    the commit's used paths.
    """
    ordered = scored.filter(F.col("similarity") >= threshold).repartition("commit_sha").sortWithinPartitions("commit_sha", F.desc("similarity"), "old_path", "path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, old, new = None, set(), set()
        for frame in frames:
            keep = []
            for commit, a, b in zip(frame["commit_sha"], frame["old_path"], frame["path"], strict=True):
                if commit != now:
                    now, old, new = commit, set(), set()
                free = a not in old and b not in new
                if free:
                    old.add(a)
                    new.add(b)
                keep.append(free)
            yield frame[keep]

    rows = ordered.select("commit_sha", "old_path", "path", "similarity").mapInPandas(run, "commit_sha string, old_path string, path string, similarity double")
    return rows.withColumn("similarity", F.round(F.col("similarity") * 100).cast("int"))


def inexact_renames(changes: DataFrame, blobs: DataFrame, limit: int = LIMIT, threshold: float = THRESHOLD) -> DataFrame:
    """(commit_sha, old_path, path, similarity) of the deletions and additions that no exact rename took."""
    taken = exact_renames(changes)
    gone = changes.filter("change_type = 'D'").select("commit_sha", F.col("path").alias("old_path"), F.col("src_blob_sha").alias("blob_sha")).join(taken.select("commit_sha", "old_path"), ["commit_sha", "old_path"], "left_anti")
    new = changes.filter("change_type = 'A'").select("commit_sha", "path", F.col("dst_blob_sha").alias("blob_sha")).join(taken.select("commit_sha", "path"), ["commit_sha", "path"], "left_anti")
    lists = line_lists(blobs)
    crowds = gone.groupBy("commit_sha").count().unionByName(new.groupBy("commit_sha").count()).groupBy("commit_sha").agg(F.max("count").alias("n"))
    few, many = crowds.filter(F.col("n") <= limit).select("commit_sha"), crowds.filter(F.col("n") > limit).select("commit_sha")
    (gone_few, gone_many), (new_few, new_many) = ([x.join(of, "commit_sha", "left_semi") for of in (few, many)] for x in (gone, new))
    near = similar_within(gone_few, new_few, lists).filter(F.col("similarity") >= threshold)
    plain = gone_few.withColumnRenamed("blob_sha", "a_blob").join(near, ["commit_sha", "a_blob"]).join(new_few.withColumnRenamed("blob_sha", "b_blob"), ["commit_sha", "b_blob"])
    crowded = lists.join(gone_many.select("blob_sha").unionByName(new_many.select("blob_sha")).distinct(), "blob_sha", "left_semi")
    banded = similarities(lsh_candidates(gone_many, new_many, bands(signatures(line_profiles(crowded))), ["commit_sha"]), crowded)
    return greedy_match(plain.unionByName(banded), threshold)

"""N-gram Jaccard self-join by T-occurrence search, and its components.

1. Every whole text becomes its set of k-word shingles (64-bit hashes). Equal
   sets are one class; from here on a class is represented by its least doc_id.
2. Blocks. Two linked sets differ in at most d = floor(2u(100-p)/(100+p))
   elements when neither is larger than u. Cut the hash range into
   k = d + 1 + SLACK equal segments: at least 1 + SLACK segments are the same
   in both sets. A set with at most SLACK empty segments leaves those out, any
   other set names them too, so every linked pair shares a key (length class,
   segment, sum of the segment's elements). Length classes overlap by the size
   bound of a link. Documents that only share a common line or passage share
   keys as well, so inside a key's sets a parity sketch decides: its bits differ
   in at most |A xor B| places, hence in at most d for a link (u: the larger of
   the two). Sets within d/4 of a leader are its followers, and everything within
   5/4 d of a leader is joined to it, which by the triangle inequality joins every
   linked pair. What is joined, directly or through others, is a block; no link
   crosses blocks. (With a wider bound, chains of sets that are far from being
   linked grow into one block as a table grows.) Keys of very many sets are dealt
   over tasks, whose leaders then meet once more.
   The keys are written once and shuffled slice after slice, to save disk.
3. T-occurrence inside a block: inverted lists over the block's shingles; for
   each set as query, T is the least overlap any partner needs. All but the T-1
   longest of its lists are merged by a heap (a counting merge when they are
   long); what turns up is then probed for in the long lists by binary search,
   shortest first, until it reaches its own required overlap or cannot
   (DivideSkip). Partners already in the query's component are not probed:
   that link can't change a component.
4. Blocks above ``block_postings`` shingles are dealt into parts, and every
   pair of parts is a task of its own, so a task is bounded whatever the size
   of a group of near copies. Nothing is capped, sampled or dropped.

Defined results: null and wordless texts have the empty set, are linked with
nothing and are their own component; fewer than k words make one shingle; rows
that share a doc_id are one node; rows with a null doc_id count for no
component but get that of their class, or null; equal rows get equal results;
an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.llm.common import by_position, connected_components, discard, map_batches, materialize, texts_of

SLACK = 2
CLASS_RATIO = 1.35
BLOCK_POSTINGS = 1_500_000
#: Parts of blocks are shuffled in waves of about this many shingles, repeats included.
WAVE_SHINGLES = 100_000_000
#: Sets within this share of a link's bound of a leader follow it.
FOLLOW = 0.25
#: Most keys of two or more sets, and most rows of copies, that are sent to every task; above it they are joined instead.
BROADCAST_KEYS = 2_000_000
#: Keys are shuffled in so many slices at most, one for this many shingles of the table.
KEY_SLICES = 8
SLICE_SHINGLES = 20_000_000
LEAST_SKETCH = 512
#: Sets of one key that one task takes; larger keys are dealt.
KEY_SETS = 4_000
COUNTING_FROM = 256
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; A-Z lower-cased, words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(k, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = (out ^ h[i : i + n]) * _A
            out ^= out >> np.uint64(29)
        out = _mix(out)
    return np.unique(out)


def overlap_needed(a: int, b: int, percent: int) -> int:
    """Least intersection with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def size_classes(percent: int, largest: int) -> list[int]:
    """Upper sizes of the length classes; within the first, only equal sets can link."""
    tops = [max(1, (100 + percent) // (2 * (100 - percent)) if percent < 100 else largest)]
    while tops[-1] < largest:
        tops.append(max(tops[-1] + 1, int(tops[-1] * CLASS_RATIO)))
    return tops


def block_keys(s: np.ndarray, percent: int, tops: list[int]) -> np.ndarray:
    """Keys of one set in its own length class and, if partners may be there, in the next."""
    n = len(s)
    if not n:
        return np.empty(0, dtype=np.int64)
    own = int(np.searchsorted(tops, n))
    classes = [own] if own else []
    if n * 100 // percent > tops[own]:
        classes.append(own + 1)
    out = []
    with np.errstate(over="ignore"):
        mixed = _mix(s * _A)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        for c in classes:
            most = 2 * tops[c] * (100 - percent) // (100 + percent)
            k = most + 1 + SLACK
            borders = ((np.arange(1, k, dtype=object) << 64) // k).astype(np.uint64)
            at = np.concatenate([[0], np.searchsorted(s, borders), [n]])
            seg = np.arange(k, dtype=np.uint64)
            total = sums[at[1:]] - sums[at[:-1]]
            full = at[1:] > at[:-1]
            keys = _mix(_mix(total + seg * _C) + np.uint64(c + 1) * _B)
            out.append(keys if int((~full).sum()) > SLACK else keys[full])
    return np.concatenate(out).view(np.int64) if out else np.empty(0, dtype=np.int64)


def parity_sketch(s: np.ndarray) -> bytes:
    """Parities of the numbers of elements in b classes, b the power of two from twice their number on.

    Sketches of two sets differ in at most |A xor B| bits; a longer one folds to
    a shorter by exclusive or of its halves.
    """
    bits = max(LEAST_SKETCH, 1 << (2 * len(s) - 1).bit_length()) if len(s) else LEAST_SKETCH
    slots = (s & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=bits) & 1, bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the shortest."""
    least = min(map(len, sketches))
    rows = np.empty((len(sketches), least // 8), dtype=np.uint64)
    for i, raw in enumerate(sketches):
        rows[i] = np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, least // 8), axis=0)
    return rows


def shingled(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, class_key, sketch, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = size_classes(percent, 64)
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                b = whole.slice(s, 512)
                sets = [shingle_set(t, k) for t in texts_of(b)]
                longest = max(map(len, sets), default=0) * 2
                if longest > tops[-1]:
                    tops = size_classes(percent, longest)
                keys = [block_keys(x, percent, tops) for x in sets]
                flat = pa.array(np.concatenate(keys) if keys else [], pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in keys])]), pa.int32()), flat)
                cols = [pa.array(map(len, sets), pa.int64()), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array(map(parity_sketch, sets), pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, lists], ["doc_id", "n_shingles", "class_key", "sketch", "keys"])

    return map_batches(docs, run, "doc_id long, n_shingles long, class_key binary, sketch binary, keys array<long>")


def near_leaders(ids: np.ndarray, sketches: np.ndarray, follow: int | np.ndarray, join: int | np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """(edges, leaders): greedy leaders so that each row is within ``follow`` bits of one; edges connect what is within ``join`` of a leader.

    Both are one bound or one for each row; those of rows may not descend.
    """
    follow, join = (np.broadcast_to(x, len(ids)) for x in (follow, join))
    lead = np.empty(len(ids), dtype=np.int64)
    marks = np.empty_like(sketches)
    group = np.empty(len(ids), dtype=np.int64)
    n, edges = 0, []
    for i in range(len(ids)):
        far = np.bitwise_count(marks[:n] ^ sketches[i]).sum(axis=1)
        close = np.flatnonzero(far <= join[i])
        if len(close):
            groups = np.unique(group[close])
            first = int(lead[close[0]])
            edges.append((int(ids[first]), int(ids[i])))
            if len(groups) > 1:
                edges += [(int(ids[lead[np.flatnonzero(group[:n] == g)[0]]]), int(ids[i])) for g in groups.tolist()]
                group[:n][np.isin(group[:n], groups)] = groups[0]
        if not len(close) or far[close].min() > follow[i]:
            lead[n], marks[n], group[n] = i, sketches[i], groups[0] if len(close) else i
            n += 1
    return edges, lead[:n].tolist()


def group_edges(rows: DataFrame, percent: int, spread: float = 1 + FOLLOW, leaders_too: bool = False) -> DataFrame:
    """(of, rep, other): edges inside each group (``of``, ``deal``); with ``leaders_too`` rows of rep = other name the leaders.

    ``rows``: of, deal, rep, n_shingles, sketch. ``spread``: what is within so
    many times the bound of a leader is joined to it. By default a set's bound is
    that of its own size, as no leader before it is larger. Another value is for
    leaders of dealt groups, 1 + 2 * FOLLOW at least; of these only equal sketches
    follow one another (what follows at a distance would be compared with its
    leader alone), and the bound is that of the largest ``n_shingles``, or
    ``largest`` where the rows have it: followers may be larger than their leader.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            ids = np.array([h[0] for h in held])
            most = 2 * np.array([h[3] for h in held]) * (100 - percent) // (100 + percent)
            follow, join = ((most * FOLLOW).astype(int), (most * spread).astype(int)) if spread == 1 + FOLLOW else (0, int(most.max() * spread))
            edges, leaders = near_leaders(ids, folded([h[2] for h in held]), follow, join)
            out = [(now[0], a, b) for a, b in edges if a != b] + [(now[0], held[i][0], held[i][0]) for i in leaders if leaders_too]
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["of", "rep", "other"])

        for b in batches:
            for of, deal, *item in zip(*(b.column(c).to_pylist() for c in ("of", "deal", "rep", "n_shingles", "sketch", "largest")), strict=True):
                if (of, deal) != now:
                    if held:
                        yield flush()
                    now, held = (of, deal), []
                held.append(item)
        if held:
            yield flush()

    if "largest" not in rows.columns:
        rows = rows.withColumn("largest", F.col("n_shingles"))
    ordered = rows.repartition("of", "deal").sortWithinPartitions("of", "deal", "n_shingles", "rep")
    return map_batches(ordered, run, "of long, rep long, other long")


def candidate_edges(found: DataFrame, copies: DataFrame, percent: int, slices: int) -> tuple[list[DataFrame], DataFrame]:
    """Written intermediates to discard in the end, and edges that connect all classes a link may join.

    ``found``: (row, rep, n_shingles, sketch, keys); rows named by the written table ``copies`` (row) are left out.
    Keys are dealt into ``slices`` that are shuffled one after another, and so are the groups made of them, so the
    shuffle files of one slice are all there are at a time; what a slice gives is written if there are more. Copies with
    the same companions under many keys make one group: equal member lists are kept once.
    """
    few = copies.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS

    def firsts(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(copies), "row", "left_anti") if few else rows.hint("merge").join(copies, "row", "left_anti")

    def kept(rows: DataFrame, tag: str) -> DataFrame:
        return materialize(rows, tag) if slices > 1 else rows

    lists, large, written = [], [], []
    for i in range(slices):
        flat = firsts(found.select("row", "rep", F.explode("keys").alias("key")).filter(F.pmod("key", F.lit(slices)) == i)).select("rep", "key")
        met = materialize(flat.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count("*").alias("n")).filter("a < b").select("key", "n"), "keys")
        if met.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
            shared = flat.join(F.broadcast(met), "key")
        else:
            shared = flat.hint("merge").join(met, "key")
        lists.append(kept(shared.filter(F.col("n") <= KEY_SETS).groupBy("key").agg(F.sort_array(F.collect_list("rep")).alias("m")).select("m").distinct(), "lists"))
        if not met.filter(F.col("n") > KEY_SETS).isEmpty():
            large.append(kept(shared.filter(F.col("n") > KEY_SETS), "large"))
        if slices > 1:
            discard(met)
        else:
            written.append(met)
    sketches = firsts(found.select("row", "rep", "n_shingles", "sketch")).drop("row")
    every = reduce(DataFrame.unionByName, lists).withColumn("of", F.xxhash64("m"))
    edges = []
    for i in range(slices):
        mine = every.filter(F.pmod("of", F.lit(slices)) == i).distinct() if slices > 1 else every
        groups = mine.select("of", F.lit(0).cast("long").alias("deal"), F.explode("m").alias("rep"))
        edges.append(kept(group_edges(groups.join(sketches, "rep"), percent).select("rep", "other"), "edges"))
    discard(*lists)
    written += [*large, *edges]
    if large:
        hot = reduce(DataFrame.unionByName, large)
        deal = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / KEY_SETS)).cast("long")
        dealt = hot.select(F.col("key").alias("of"), deal.alias("deal"), "rep")
        first = materialize(group_edges(dealt.join(sketches, "rep"), percent, leaders_too=True), "dealt")
        leaders = first.filter("rep = other").select("of", F.lit(0).cast("long").alias("deal"), "rep").join(sketches, "rep")
        leaders = leaders.join(dealt.join(sketches, "rep").groupBy("of").agg(F.max("n_shingles").alias("largest")), "of")
        edges += [first.filter("rep <> other").select("rep", "other"), group_edges(leaders, percent, 1 + 2 * FOLLOW).select("rep", "other")]
        written.append(first)
    return written, reduce(DataFrame.unionByName, edges).distinct()


class Sets:
    """Inverted lists over the sets of one task; sets ascend by size."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = [len(s) for s in sets]
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        new = np.concatenate([[True], np.diff(flat[order]) != 0]) if len(flat) else np.empty(0, bool)
        self.start = np.append(np.flatnonzero(new), len(flat))
        self.count = np.diff(self.start)
        self.token = np.empty(len(flat), dtype=np.int64)
        self.token[order] = np.cumsum(new) - 1
        self.at = np.concatenate([[0], np.cumsum(self.size)])

    def list_of(self, token: int) -> np.ndarray:
        return self.owner[self.start[token] : self.start[token + 1]]


def merge_short(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct entries of sorted lists with their numbers of occurrence."""
    if sum(map(len, lists)) < COUNTING_FROM:
        got = Counter(heapq.merge(*(x.tolist() for x in lists)))
        return np.fromiter(got, np.int64, len(got)), np.fromiter(got.values(), np.int64, len(got))
    return np.unique(np.concatenate(lists), return_counts=True)


def partners(index: Sets, q: int, percent: int, wanted: np.ndarray | None = None, skip=lambda c: c) -> list[int]:
    """Sets before ``q`` (no larger than it) whose overlap with it suffices; ``skip`` filters candidates."""
    n = index.size[q]
    least = overlap_needed(n, -(-percent * n // 100), percent)
    tokens = index.token[index.at[q] : index.at[q + 1]]
    lengths = index.count[tokens]
    tokens = tokens[lengths > 1]
    if len(tokens) < least:
        return []
    tokens = tokens[np.argsort(index.count[tokens], kind="stable")]
    long_n = least - 1
    short = [index.list_of(t) for t in tokens[: len(tokens) - long_n].tolist()]
    cand, seen = merge_short(short)
    fit = cand < q
    cand, seen = cand[fit], seen[fit]
    if len(cand):
        sizes = np.array([index.size[c] for c in cand.tolist()])
        fit = 100 * sizes >= percent * n
        if wanted is not None:
            fit &= wanted[cand]
        cand, seen, sizes = cand[fit], seen[fit], sizes[fit]
        keep = skip(cand)
        cand, seen, sizes = cand[keep], seen[keep], sizes[keep]
    if not len(cand):
        return []
    need = -(-percent * (n + sizes) // (100 + percent))
    if len(cand) <= 16:
        return [c for c, t in zip(cand.tolist(), need.tolist(), strict=True) if _probe_one(index, q, c) >= t]
    found: list[int] = []
    rest = tokens[len(tokens) - long_n :].tolist()
    for done, t in enumerate(rest):
        posting = index.list_of(t)
        at = np.minimum(np.searchsorted(posting, cand), len(posting) - 1)
        seen = seen + (posting[at] == cand)
        open_ = seen + (len(rest) - done - 1) >= need
        if not open_.all():
            cand, seen, need = cand[open_], seen[open_], need[open_]
            if not len(cand):
                break
    found += cand[seen >= need].tolist()
    return found


def _probe_one(index: Sets, q: int, c: int) -> int:
    """Occurrences of one candidate in all the query's lists: binary search for each of its shingles."""
    a, b = index.sets[c], index.sets[q]
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def forest(ids: list[int], sets: list[np.ndarray], percent: int, side: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between the given sets that connect them as all their links do. With ``side``, only links across sides."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    index = Sets([sets[i] for i in order])
    sides = None if side is None else np.array([side[i] for i in order])
    root = np.arange(len(order))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    links = []
    for q in range(len(order)):
        def unlike(cand: np.ndarray, q: int = q) -> np.ndarray:
            mine = top(q)
            return np.array([top(c) != mine for c in cand.tolist()], dtype=bool)

        for c in partners(index, q, percent, None if sides is None else sides != sides[q], unlike):
            a, b = top(q), top(c)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((ids[order[q]], ids[order[c]]))
    return links


def block_links(members: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): connecting links inside each task's sets. ``members``: (block, lo, hi, part, rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, parts = None, [], [], []

        def flush() -> list[tuple[int, int]]:
            return forest(ids, sets, percent, parts if now[1] != now[2] else None) if len(ids) > 1 else []

        for b in batches:
            out = []
            for block, lo, hi, part, rep, text in zip(*(b.column(c).to_pylist() for c in ("block", "lo", "hi", "part", "rep")), texts_of(b), strict=True):
                if (block, lo, hi) != now:
                    if now:
                        out += flush()
                    now, ids, sets, parts = (block, lo, hi), [], [], []
                ids.append(rep)
                sets.append(shingle_set(text, k))
                parts.append(part)
            if out:
                yield _pairs(out)
        if now:
            yield _pairs(flush())

    return map_batches(members, run, "a long, b long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(docs: DataFrame, k: int = 5, percent: int = 80, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = materialize(shingled(rows, k, percent).withColumn("row", F.monotonically_increasing_id()), "keyed")
    sets = materialize(keyed.select("doc_id", "n_shingles", "class_key", "row"), "sets")
    named = "n_shingles > 0 and doc_id is not null"
    reps = materialize(sets.filter(named).groupBy("class_key").agg(F.min(F.struct("doc_id", "row")).alias("r")).select("class_key", F.col("r.doc_id").alias("rep"), "r.row"), "reps")
    copies = materialize(sets.filter(named).select("row").join(reps.select("row"), "row", "left_anti"), "copies")
    slices = min(KEY_SLICES, 1 + (sets.agg(F.sum("n_shingles")).first()[0] or 0) // SLICE_SHINGLES)
    found = keyed.filter(named).select("row", F.col("doc_id").alias("rep"), "n_shingles", "sketch", "keys")
    written, edges = candidate_edges(found, copies, percent, slices)
    blocks = materialize(connected_components(edges), "cand")
    discard(keyed, copies, *written)
    sized = materialize(sets.select(F.col("doc_id").alias("node"), "n_shingles").join(blocks, "node").groupBy("root").agg(F.sum("n_shingles").alias("postings")), "sized")
    dealt = blocks.join(sized.select("root", F.ceil(F.col("postings") / block_postings).cast("int").alias("of")), "root")
    dealt = dealt.select(F.col("root").alias("block"), F.col("node").alias("rep"), "of", F.pmod(F.xxhash64("node"), F.col("of")).cast("int").alias("part"))
    repeated = sized.agg(F.sum(F.col("postings") * F.ceil(F.col("postings") / block_postings))).first()[0] or 0
    waves = 1 + int(repeated) // WAVE_SHINGLES
    texts = rows.join(dealt, rows.doc_id == dealt.rep).select("block", "rep", "of", "part", "text")
    if waves > 1:
        texts = materialize(texts, "texts")
    links = []
    for i in range(waves):
        tasks = texts.select("block", "rep", "part", "text", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other"))
        tasks = tasks.select("block", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "rep", "text")
        tasks = tasks.filter(F.pmod(F.xxhash64("block", "lo", "hi"), F.lit(waves)) == i) if waves > 1 else tasks
        links.append(materialize(block_links(tasks.repartition("block", "lo", "hi").sortWithinPartitions("block", "lo", "hi"), k, percent), "links"))
    if waves > 1:
        discard(texts)
    joined = connected_components(reduce(DataFrame.unionByName, links)).select(F.col("node").alias("rep"), F.col("root").alias("joined"))
    least = reps.select("class_key", "rep").join(joined, "rep", "left").select("class_key", F.coalesce("joined", "rep").alias("least"))
    return sets.select("doc_id", "n_shingles", "class_key").join(least, "class_key", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` without near copies: of each component the row of its least doc_id stays (of equal ids, one row each way they differ).

    Rows with a null doc_id, and such with an empty set, stay.
    """
    found = components(docs, k, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    plain = by_position(docs)
    doc_id = F.col(plain.columns[docs.columns.index("doc_id")])
    return plain.join(found, doc_id.cast("long") == F.col("gone"), "left_anti").toDF(*docs.columns)

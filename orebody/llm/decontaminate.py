"""Benchmark decontamination with a generalised suffix automaton over item words.

The automaton holds every word run of every item. A document streams through
it; after each word it knows the longest run, ending there, that some item
contains. A run of ``window`` words that ends there therefore occurs in an
item, and the automaton state tells in which. Items shorter than the window
count as one window of their own length.

Only stretches of words that items know at all are streamed: outside them the
automaton would be at its root. Defined results: null and wordless texts have
no words, hits or items; items without words take no part; repeated items keep
their own ids; an empty benchmark hits nothing. Item ids are compared as
strings; items without an id take no part; rows without a doc_id are rows like
others; an empty table gives no rows. Memory on an executor is one automaton
(at most two states per word of its items). Items of more than ``group_words``
words are dealt into groups with an automaton each, which scan one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.llm.common import by_position, map_batches, materialize, raw_texts, texts_of

WINDOW = 8
MIN_ITEMS = 2
#: Words of the items that one automaton holds: about 1 KB of memory a word in every Python worker.
GROUP_WORDS = 150_000
#: ASCII letters lower-cased, other ASCII but digits to spaces; bytes from 128 belong to words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class ItemAutomaton:
    """Generalised suffix automaton; per state the items whose windows end there."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names: list[str] = []
        runs = []
        for name, text in items:
            if words := words_of(text):
                self.names.append(name)
                runs.append([self.vocab.setdefault(w, len(self.vocab)) for w in words])
        for run in runs:
            last = 0
            for c in run:
                last = self._extend(last, c)
        self._mark(runs)

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _mark(self, runs: list[list[int]]) -> None:
        """owners[s]: items whose window of the full length has state s; short[s]: (length, item) of whole short items."""
        self.owners: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.least = self.window
        for item, run in enumerate(runs):
            s = 0
            if len(run) < self.window:
                for c in run:
                    s = self.next[s][c]
                self.short.setdefault(s, []).append((len(run), item))
                self.least = min(self.least, len(run))
                continue
            n = 0
            for c in run:
                s, n = self.next[s][c], n + 1
                while self.length[self.link[s]] >= self.window:
                    s = self.link[s]
                n = min(n, self.length[s])
                if n >= self.window:
                    self.owners.setdefault(s, set()).add(item)
        self.cover: list[int] = [0] * len(self.next)  # the longest short item that ends where a state ends
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = max((m for m, _ in self.short.get(s, ())), default=0)
            self.cover[s] = max(own, self.cover[self.link[s]])

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Mask of hit words, and the items with a window in ``words``."""
        known = np.array([*map(self.vocab.get, words, [-1] * len(words))], dtype=np.int64)
        hit, items = np.zeros(len(words), dtype=bool), set()
        edges = np.flatnonzero(np.diff(np.concatenate([[False], known >= 0, [False]])))
        starts, ends = edges[0::2], edges[1::2]
        keep = ends - starts >= self.least
        for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
            self._stream(known[a:b].tolist(), a, hit, items)
        return hit, items

    def _stream(self, run: list[int], base: int, hit: np.ndarray, items: set[int]) -> None:
        follow, link, length, window = self.next, self.link, self.length, self.window
        s = n = 0
        for i, c in enumerate(run, base + 1):
            while s and c not in follow[s]:
                s = link[s]
                n = length[s]
            s = follow[s].get(c, 0)
            n = n + 1 if s else 0
            if n >= window:
                u = s
                while length[link[u]] >= window:
                    u = link[u]
                hit[i - window : i] = True
                items.update(self.owners.get(u, ()))
            if self.cover[s]:
                u = s
                while u:
                    for m, item in self.short.get(u, ()):
                        if m <= n:
                            hit[i - m : i] = True
                            items.add(item)
                    u = link[u]


def grouped(benchmark: DataFrame, group_words: int = GROUP_WORDS) -> list[DataFrame]:
    """The items with words, dealt by a hash into groups of about ``group_words`` words; one group where they are few."""
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).filter("item_id is not null and text is not null")
    words = (items.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x80-\\uFFFF]+")).cast("long"))).first()[0]) or 0
    n = max(1, -(-words // group_words))
    return [items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def build(items: DataFrame, window: int = WINDOW) -> ItemAutomaton:
    """Collect one group of items, which is bounded, and build its automaton."""
    return ItemAutomaton([(r.item_id, r.text.encode()) for r in items.orderBy("item_id", "text").collect()], window)


def found_by(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(key, spans, items) of the rows of ``docs`` (key, text) that hold windows of a group of items."""
    shared = docs.sparkSession.sparkContext.broadcast(build(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for b in batches:
            rows = []
            for key, text in zip(b.column("key").to_pylist(), texts_of(b), strict=True):
                hit, items = auto.scan(words_of(text))
                if items:
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]))).tolist()
                    rows.append({"key": key, "spans": edges, "items": sorted({auto.names[i] for i in items})})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    kind = pa.schema([("key", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
    return map_batches(docs, run, "key long, spans array<long>, items array<string>")


def scanned(docs: DataFrame, benchmark: DataFrame, window: int, group_words: int, schema, each) -> DataFrame:
    """``docs`` through ``each(batch, found)``: per row the mask of hit words and the names of found items; ``each`` gives the out rows.

    With one group of items this is one pass. With more, each group scans the
    texts by itself (keyed by their hash) and what was found is joined back.
    """
    groups = grouped(benchmark, group_words)
    at = docs.columns.index("text")
    if len(groups) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(build(groups[0], window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = shared.value
            for b in batches:
                words = [words_of(t) for t in raw_texts(b.column(at))]
                hits = [auto.scan(w) for w in words]
                yield each(b, words, [h for h, _ in hits], [sorted({auto.names[i] for i in own}) for _, own in hits])

        return map_batches(docs, run, schema)
    plain = by_position(docs)
    keyed = plain.withColumn("key", F.xxhash64(F.col(plain.columns[at]).cast("string")))
    texts = keyed.select("key", F.col(plain.columns[at]).cast("string").alias("text")).filter("text is not null").dropDuplicates(["key"])
    parts = None
    for items in groups:
        one = materialize(found_by(texts, items, window), "found")
        parts = one if parts is None else parts.unionByName(one)
    all_found = parts.groupBy("key").agg(F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    names, n = docs.columns, len(docs.columns)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, hits = [words_of(t) for t in raw_texts(b.column(at))], []
            for own, spans in zip(words, b.column(n).to_pylist(), strict=True):
                hit = np.zeros(len(own), dtype=bool)
                for edges in spans or ():
                    for x, y in zip(edges[0::2], edges[1::2], strict=True):
                        hit[x:y] = True
                hits.append(hit)
            found = [sorted(x or ()) for x in b.column(n + 1).to_pylist()]
            yield each(pa.RecordBatch.from_arrays(b.columns[:n], names), words, hits, found)

    return map_batches(keyed.join(all_found, "key", "left").select(*plain.columns, "spans", "items"), run_joined, schema)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, group_words: int = GROUP_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def each(b: pa.RecordBatch, words: list, hits: list, found: list) -> pa.RecordBatch:
        rows = [(len(w), int(h.sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(names) >= min_items) for w, h, names in zip(words, hits, found, strict=True)]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return scanned(rows, benchmark, window, group_words, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean", each)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, group_words: int = GROUP_WORDS) -> DataFrame:
    """Rows of ``docs`` with hit spans cut out; rows of which more than ``max_coverage`` of the words is hit go.

    A span reaches from its first hit word to its last; the characters around
    it stay as they are, and ``n_chars`` follows the text if there is one. Texts
    without a hit are returned unchanged, null included.
    """
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def each(b: pa.RecordBatch, words: list, hits: list, found: list) -> pa.RecordBatch:
        keep, cols = [], list(b.columns)
        counts = [int(h.sum()) for h in hits]
        keep = [not n or n <= max_coverage * len(w) for n, w in zip(counts, words, strict=True)]
        rows = [i for i, n in enumerate(counts) if n and keep[i]]
        if rows:
            mask = np.zeros(b.num_rows, dtype=bool)
            mask[rows] = True
            raws = raw_texts(cols[at].take(pa.array(rows)))
            short = pa.array([cut(raw, raw.translate(WORD_BYTES), words[i], hits[i]) for i, raw in zip(rows, raws, strict=True)], cols[at].type)
            cols[at] = pc.replace_with_mask(cols[at], pa.array(mask), short)
            if chars is not None:
                cols[chars] = pc.replace_with_mask(cols[chars], pa.array(mask), pc.utf8_length(short).cast(cols[chars].type))
        return pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    return scanned(docs, benchmark, window, group_words, docs.schema, each)


def cut(raw: bytes, mapped: bytes, words: list[bytes], hit: np.ndarray) -> str:
    places, pos = [], 0
    for w in words:
        pos = mapped.index(w, pos)
        places.append((pos, pos + len(w)))
        pos += len(w)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    out, last = [], 0
    for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(raw[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()

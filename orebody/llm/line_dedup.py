"""Removal of repeated runs of words by winnowing over line hashes.

Line breaks and sentence ends move between copies, so texts are re-flowed: a
line is any ``LINE_WORDS`` consecutive words. A run counts as repeated when it
has at least ``min_words`` words; the result is exact: a word goes if and only
if it lies in a run of ``min_words`` words that also stands at an earlier place
(of a document with less (doc_id, version), or at least ``min_words`` words
before in the same one). The first place of a run always stays.

1. Winnowing. Of the ``min_words - LINE_WORDS + 1`` line hashes inside each run
   of ``min_words`` words the least is its fingerprint, so two equal runs have
   the same one. Consecutive runs with one fingerprint form a stretch; each
   stretch is a row with its place and a hash of all its words.
2. Positions are joined: only fingerprints that two stretches have go on, and of
   these the first place of each whole stretch is found. A stretch that stands
   at an earlier place is covered; this settles nearly all text of copies.
3. Extension. The remaining stretches share a fingerprint but not all words
   around it. A match is extended to both sides by comparing every run of
   ``min_words`` words through the fingerprint with that run's own first place,
   whichever document holds it; the union of the equal ones is the whole match.
   A run's first place always lies in a stretch that is the first of its kind,
   so nothing is missed by leaving covered stretches out here. The first place
   of a stretch is left out as well where all stretches with its fingerprint
   are equal to it and stand in other documents: runs equal to its runs have its
   fingerprint, so they lie in its copies, which are covered.
4. What is covered is cut out, from the first word of it to the next word that
   stays.

Words are what stands between ASCII white space, A-Z in lower case. Defined
results: null and empty texts have no words and stay as they are; rows of equal
doc_id and text are one document (each is kept, neither repeats the other);
null doc_ids come first; a text that wholly repeats earlier ones becomes empty
and its row stays; texts shorter than ``min_words`` words never change; an
empty table gives no rows; all columns of ``docs`` are kept whatever their
names, and ``n_chars`` follows the text if there is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orebody.llm.common import by_position, discard, lookup, map_batches, materialize, raw_texts, slices

LINE_WORDS = 8
MIN_WORDS = 32
#: Most bytes of fingerprints with two places or more that are sent to every task, with as many of their counts; above it they are joined instead.
BROADCAST_BYTES = 16 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 256
NULL_DOC = -(2**63)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.array([c in b" \t\n\v\f\r" for c in range(256)])
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x ^= x >> np.uint64(27)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text."""
    space = np.ones(len(raw) + 2, dtype=bool)
    space[1:-1] = _SPACE[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word from its bytes, eight at a time over all words at once."""
    size = ends - starts
    padded = raw + bytes(8)
    eights = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))
    h = _mix((eights[starts] & _LOW_BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * _A)
    at, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(at):
        h[at] = _mix((h[at] * _A) ^ (eights[starts[at] + done] & _LOW_BYTES[np.minimum(size[at] - done, 8)]))
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return h


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every ``length`` consecutive words; wider runs come from two that overlap."""
    h, span = words, 1
    while span < length:
        step = min(span, length - span)
        h, span = _mix(h[:-step] * _A + h[step:] * _C + np.uint64(span + step)), span + step
    return h


def window_minima(h: np.ndarray, window: int) -> np.ndarray:
    """The least of every ``window`` consecutive hashes."""
    span = 1
    while span < window:
        step = min(span, window - span)
        h, span = np.minimum(h[:-step], h[step:]), span + step
    return h


def stretches(texts: list[bytes], min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """(fingerprint, hash of all words, text, first run, number of further runs) of every stretch of the texts."""
    empty = np.empty(0, dtype=np.int64)
    raw = b"\n".join(texts).lower()
    starts, ends = word_places(raw)
    if len(starts) < min_words:
        return (empty,) * 5
    borders = np.cumsum([len(t) + 1 for t in texts])
    until = np.searchsorted(starts, borders)  # the words before each text's end
    with np.errstate(over="ignore"):
        words = word_hashes(raw, starts, ends)
        lines = run_hashes(words, min(LINE_WORDS, min_words))
        runs = run_hashes(words, min_words)
        least = window_minima(lines, max(1, min_words - LINE_WORDS + 1))
        stop = np.repeat(until, np.diff(np.concatenate([[0], until])))[: len(runs)]
        inside = np.flatnonzero(np.arange(len(runs)) + min_words <= stop)  # runs within one text
        if not len(inside):
            return (empty,) * 5
        key = least[inside]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (np.diff(inside) != 1)])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(inside)))
        window = max(1, min_words - LINE_WORDS + 1)
        pieces = -(-size // window)  # only of repetitive text; pieces of a stretch may repeat each other
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(first, pieces) + nth * window
        more = np.minimum(np.repeat(first + size, pieces) - begin, window) - 1
        at = inside[begin]
        whole = _mix(runs[at] * _A + runs[at + more] * _C + more.astype(np.uint64))
    text = np.searchsorted(until, at, "right")
    return key[begin].view(np.int64), whole.view(np.int64), text, at - np.concatenate([[0], until[:-1]])[text], more


def repeated(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a (text, key) stands more than once."""
    order = np.lexsort((key, text))
    same = np.concatenate([[False], (np.diff(text[order]) == 0) & (key[order][1:] == key[order][:-1]), [False]])
    out = np.empty(len(key), dtype=bool)
    out[order] = (same[1:] | same[:-1])[: len(key)]
    return out


def fingerprints(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(print, whole, doc, version, place, more, again): one row per stretch of each row of ``docs`` (doc, version, text).

    ``again``: the text has another stretch with this fingerprint.
    """
    names = ["print", "whole", "doc", "version", "place", "more", "again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                key, all_words, text, place, more = stretches(raw_texts(b.column("text")), min_words)
                doc, version = (b.column(c).to_numpy()[text] for c in ("doc", "version"))
                cols = [pa.array(x, pa.int64()) for x in (key, all_words, doc, version)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(place, pa.int32()), pa.array(more, pa.int32()), pa.array(repeated(text, key))], names)

    return map_batches(docs, run, "print long, whole long, doc long, version long, place int, more int, again boolean")


def listed(column: pa.ListArray, *fields: str) -> list[np.ndarray]:
    """Of a column of lists of records: where each row's begin, and the fields of all of them in order."""
    offsets = column.offsets.to_numpy()
    inner = column.flatten()
    return [offsets - offsets[0], *(inner.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields)]


def covered(low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    """Mask of the places 0 to ``size`` that lie in any of the spans [low, high)."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    return np.cumsum(edge)[:-1] > 0


def open_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(run, doc, version, place): every run of the stretches named by ``open`` (place, more) in ``docs`` (doc, version, text, open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, place, more = listed(b.column("open"), "place", "more")
            for i, (doc, version, raw) in enumerate(zip(b.column("doc").to_pylist(), b.column("version").to_pylist(), raw_texts(b.column("text")), strict=True)):
                raw = raw.lower()
                with np.errstate(over="ignore"):
                    hashes = run_hashes(word_hashes(raw, *word_places(raw)), min_words)
                own = slice(begin[i], begin[i + 1])
                at = np.flatnonzero(covered(place[own], place[own] + more[own] + 1, len(hashes)))
                cols = [pa.array(x, pa.int64()) for x in (hashes[at].view(np.int64), np.full(len(at), doc), np.full(len(at), version))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(at, pa.int32())], ["run", "doc", "version", "place"])

    return map_batches(docs, run, "run long, doc long, version long, place int")


def first_places(places: DataFrame, key: str) -> DataFrame:
    """(key, first, last, n): the first and the last place of each key and the number of its rows."""
    at = F.struct("doc", "version", "place")
    return places.groupBy(key).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, version, text): a null doc_id is the least number, the version tells texts of one doc_id apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_DOC)).alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("version"), F.col("text").cast("string").alias("text"))


def removal_plan(docs: DataFrame, min_words: int = MIN_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc, version, spans): per document with repeats, the (first word, end) of what is covered; spans may overlap. ``docs``: (doc, version, text)."""
    apart = (F.col("doc") != F.col("first.doc")) | (F.col("version") != F.col("first.version")) | (F.col("place") >= F.col("first.place") + min_words)
    span = F.struct(F.col("place").alias("low"), (F.col("place") + F.col("more") + min_words).alias("high"))
    prints = materialize(fingerprints(docs.filter(F.col("text").isNotNull()), min_words), "stretches")
    shared = materialize(prints.groupBy("print").agg(F.count("*").alias("alike")).filter("alike > 1"), "shared")
    most = broadcast_bytes // 8
    known = F.broadcast(shared) if shared.limit(most + 1).count() <= most else shared.hint("merge")
    met = materialize(prints.join(known, "print").drop("print"), "met")
    discard(prints, shared)
    firsts = materialize(first_places(met, "whole").drop("last").withColumn("equal", F.col("n")), "firsts")
    settled = (F.col("equal") == F.col("alike")) & ~F.col("again")
    told = lookup(met, firsts, "whole", ["doc", "version", "place"])
    groups = told.groupBy("doc", "version").agg(F.collect_set(F.when(apart, span)).alias("covered"), F.collect_set(F.when(~apart & ~settled, F.struct("place", "more"))).alias("open"))
    groups = materialize(groups, "groups")
    opened = docs.join(groups.filter(F.size("open") > 0).select("doc", "version", "open"), ["doc", "version"])
    runs = materialize(open_runs(opened, min_words), "runs")
    begun = materialize(first_places(runs, "run").filter("first < last").drop("last"), "begun")
    extended = lookup(runs, begun, "run", ["doc", "version", "place"]).filter(apart).withColumn("more", F.lit(0)).groupBy("doc", "version").agg(F.collect_set(span).alias("extended"))
    none = F.array().cast("array<struct<low:int,high:int>>")
    both = groups.select("doc", "version", "covered").join(extended, ["doc", "version"], "left")
    spans = F.concat("covered", F.coalesce("extended", none))
    plan = materialize(both.select("doc", "version", spans.alias("spans")).filter(F.size("spans") > 0), "plan")
    discard(met, firsts, groups, runs, begun)
    return plan


def cut_spans(raw: bytes, low: np.ndarray, high: np.ndarray) -> tuple[bytes, int, int]:
    """The text without the words in the spans [low, high); numbers of runs and words that went."""
    starts, _ = word_places(raw)
    gone = covered(low, high, len(starts))
    borders = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    out, last = [], 0
    for a, b in zip(borders[0::2].tolist(), borders[1::2].tolist(), strict=True):
        out.append(raw[last : starts[a]])
        last = int(starts[b]) if b < len(starts) else len(raw)
    words = int(gone.sum())
    return b"" if words == len(starts) else b"".join([*out, raw[last:]]), len(borders) // 2, words


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, told: tuple[str, str] | None = ("removed_runs", "removed_words"), broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All columns of ``docs`` with the shortened text and, under the names of ``told``, the numbers of runs and words cut out."""
    names = docs.columns
    plain = by_position(docs)
    places = plain.columns
    text, chars = (places[names.index(c)] if c in names else None for c in ("text", "n_chars"))
    keys = keyed(docs.select("doc_id", "text"))
    plan = removal_plan(keys, min_words, broadcast_bytes)
    own = plain.withColumns({"doc": F.coalesce(F.col(places[names.index("doc_id")]).cast("long"), F.lit(NULL_DOC)), "version": F.xxhash64(F.col(text).cast("string"))})
    joined = own.join(plan, ["doc", "version"], "left").select(*places, "spans")
    schema = T.StructType([*plain.schema.fields, T.StructField("runs", T.LongType()), T.StructField("words", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("spans")
            cols = {c: b.column(c) for c in places}
            cut_runs, cut_words = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            at = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            if len(at):
                begin, low, high = listed(spans.take(pa.array(at)), "low", "high")
                done = [cut_spans(raw, low[s:e], high[s:e]) for raw, s, e in zip(raw_texts(cols[text].take(pa.array(at))), begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                cut_runs[at], cut_words[at] = [d[1] for d in done], [d[2] for d in done]
                mask = np.zeros(b.num_rows, dtype=bool)
                mask[at] = True
                short = pa.array([d[0].decode() for d in done], cols[text].type)
                cols[text] = pc.replace_with_mask(cols[text], pa.array(mask), short)
                if chars:
                    cols[chars] = pc.replace_with_mask(cols[chars], pa.array(mask), pc.utf8_length(short).cast(cols[chars].type))
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(cut_runs), pa.array(cut_words)], [*places, "runs", "words"])

    out = map_batches(joined, run, schema)
    return out.toDF(*names, *told) if told else out.select(*places).toDF(*names)


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs cut out of ``text``; ``n_chars`` follows the text."""
    return deduplicated(docs, min_words, None)

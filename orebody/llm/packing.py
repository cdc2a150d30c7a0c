"""Order-preserving packing by dynamic programming over allowed cuts.

Documents keep their order (doc_id). Cuts may fall at document ends, sentence
ends and, inside a sentence longer than ``hard_step`` ids, at every
``hard_step``-th id. A window of b - a ids costs its padding (window - (b - a))
plus the penalty of its end cut; as every term but f(a) = cost(a) + a is fixed
by the end, the best start is a sliding minimum, kept by a monotone queue.

The ids are written once and put in order by ranges. There are as many range
partitions as groups of ``group_tokens`` ids (or the session's number of
shuffle partitions, if that is less, each then cut into such groups), and each
group is packed by itself: memory is bounded by a group or by the longest
document, and at most about one sequence in ``group_tokens / window`` is the
open end of a group, whatever the session's settings. Equal doc_ids are ordered
by a hash of their texts and may stand in several tasks. Defined results: null text is empty and still has the
end id; null doc_ids sort first and are packed as well; repeated rows are packed
each; an empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.llm.common import map_batches, materialize
from orebody.llm.tokens import default_vocabulary, ending_ids, id_type, in_order, tokenized

WINDOW = 4096
SENTENCE_PENALTY = 4
HARD_PENALTY = 64
HARD_STEP = 256
GROUP_TOKENS = 1 << 21
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_windows(ends: list[int], penalties: list[int], window: int = WINDOW) -> list[int]:
    """The chosen cuts among ascending positions ``ends`` (the last is always cut); gaps must not exceed ``window``."""
    b = [0, *ends]
    cost, came = [0] * len(b), [0] * len(b)
    queue: deque[int] = deque()
    f = [0] * len(b)
    for j in range(1, len(b)):
        i = j - 1
        f[i] = cost[i] + b[i]
        while queue and f[queue[-1]] >= f[i]:
            queue.pop()
        queue.append(i)
        floor = b[j] - window
        while b[queue[0]] < floor:
            queue.popleft()
        i = queue[0]
        cost[j], came[j] = f[i] + window - b[j] + penalties[j - 1], i
    cuts, j = [], len(b) - 1
    while j:
        cuts.append(b[j])
        j = came[j]
    return cuts[::-1]


def allowed_cuts(ids: np.ndarray, doc_ends: np.ndarray, is_end: np.ndarray, hard_step: int, sentence: int, hard: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cut positions with penalties; no gap exceeds ``hard_step``."""
    stops = np.flatnonzero(is_end[ids]) + 1
    at = np.union1d(stops, doc_ends)
    before = np.concatenate([[0], at[:-1]])
    gaps = at - before
    wide = np.flatnonzero(gaps > hard_step)
    extra = [np.arange(before[k] + hard_step, at[k], hard_step) for k in wide.tolist()]
    every = np.union1d(at, np.concatenate(extra)) if extra else at
    penalty = np.full(len(every), hard)
    penalty[np.isin(every, stops, assume_unique=True)] = sentence
    penalty[np.isin(every, doc_ends, assume_unique=True)] = 0
    return every, penalty


def pack_group(doc_tokens: np.ndarray, ids: np.ndarray, is_end: np.ndarray, window: int = WINDOW, sentence: int = SENTENCE_PENALTY, hard: int = HARD_PENALTY, hard_step: int = HARD_STEP) -> tuple[np.ndarray, ...]:
    """Pieces of a run of documents: (document index, start in it, length, sequence index, offset in it)."""
    doc_ends = np.cumsum(doc_tokens)
    every, penalty = allowed_cuts(ids, doc_ends, is_end, min(hard_step, window), sentence, hard)
    cuts = np.array(cut_windows(every.tolist(), penalty.tolist(), window))
    edges = np.union1d(cuts, doc_ends)
    begins = np.concatenate([[0], edges[:-1]])
    doc = np.searchsorted(doc_ends, begins, "right")
    seq = np.searchsorted(cuts, begins, "right")
    return doc, begins - (doc_ends - doc_tokens)[doc], edges - begins, seq, begins - np.concatenate([[0], cuts[:-1]])[seq]


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, window: int = WINDOW, sentence_penalty: int = SENTENCE_PENALTY, hard_penalty: int = HARD_PENALTY, group_tokens: int = GROUP_TOKENS, keep_ids: bool = True) -> DataFrame:
    """One row per piece (columns of PIECES, and its ids); ``sequence_id`` ascends with the order and is unique, not gapless."""
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    tokens = materialize(tokenized(docs, vocabulary, end_id), "ids")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    partitions = max(1, min(total // group_tokens, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ordered = in_order(tokens, partitions).select("doc_id", "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        is_end = ending_ids(vocabulary)
        kind = id_type(len(is_end), end_id)
        first, names, sizes, held = TaskContext.get().partitionId() << 32, [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal first
            ids, counts = np.frombuffer(b"".join(held), kind), np.array(sizes)
            doc, start, length, seq, offset = pack_group(counts, ids, is_end, window, sentence_penalty, hard_penalty)
            edges = 4 * np.cumsum(length)
            view = memoryview(ids.astype("<u4").tobytes())
            cut = [view[e - 4 * n : e] for e, n in zip(edges.tolist(), length.tolist(), strict=True)]
            own = [names[d] for d in doc.tolist()]
            for x in (names, sizes, held):
                x.clear()
            at, first = first + seq, first + int(seq[-1]) + 1
            cols = [pa.array(x, pa.int64()) for x in (own, start, length, [zlib.crc32(c) for c in cut], counts[doc], at, offset)]
            if keep_ids:
                cols.append(pa.array([bytes(c) for c in cut], pa.binary()))
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(cols)])

        size = 0
        for b in batches:
            for doc_id, n, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True):
                if held and size + n > group_tokens:
                    yield flush()
                    size = 0
                names.append(doc_id)
                sizes.append(n)
                held.append(raw)
                size += n
        if held:
            yield flush()

    return map_batches(ordered, run, PIECES + ", ids binary" * keep_ids)

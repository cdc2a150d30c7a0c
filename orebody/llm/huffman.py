"""Token-id files: canonical length-limited Huffman code, independent blocks, bit-offset checkpoints.

A block is one binary value: a fixed header, per-document ids and lengths, the
bit offset of every ``interval``-th symbol, and the bit stream (big-endian bit
order). A block needs only the code lengths to be decoded, and its checkpoints
are decoded side by side by table look-up.

Defined results: null text counts as empty (it still has the end id); null
doc_ids come first in the file order and keep every row, as equal doc_ids do,
ordered by a hash of their texts; an empty table gives no blocks. Other columns
of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.llm.common import discard, map_batches, materialize
from orebody.llm.tokens import default_vocabulary, id_type, in_order, tokenized

MAX_BITS = 20
INTERVAL = 256
BLOCK_TOKENS = 1 << 19
HEADER = struct.Struct("<4sIIIQQ")  # magic, documents, documents without an id (they come first), interval, symbols, bits
MAGIC = b"HUB2"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge); 0 for symbols that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError("more symbols than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, below = [], np.empty(0, dtype=np.int64)
    for _ in range(max_bits):
        pool = np.concatenate([leaves, below])
        rank = np.argsort(pool, kind="stable")
        levels.append(rank < len(leaves))
        merged = pool[rank]
        even = len(merged) // 2 * 2
        below = merged[0:even:2] + merged[1:even:2]
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), dtype=np.uint8)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words by ascending (length, symbol)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for s in order.tolist():
        n = int(lengths[s])
        code <<= n - last
        codes[s], last = code, n
        code += 1
    return codes


def decode_tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every value of the next ``width`` bits: the symbol they start with and its length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    width = int(lengths.max(initial=1))
    span = (1 << (width - lengths[order].astype(np.int64))).astype(np.int64)
    symbols = np.zeros(1 << width, dtype=np.uint32)
    bits = np.ones(1 << width, dtype=np.int64)
    filled = int(span.sum())
    symbols[:filled] = np.repeat(order, span)
    bits[:filled] = np.repeat(lengths[order], span)
    return symbols, bits, width


def encode_block(doc_ids: list[int | None], doc_tokens: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, interval: int = INTERVAL) -> bytes:
    unnamed = sum(d is None for d in doc_ids)
    named = np.array([d or 0 for d in doc_ids], dtype="<i8")
    n = lengths[ids].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    total, at = int(at[-1]), at[:-1]
    shifted = codes[ids] << (64 - n - (at & 31)).astype(np.uint64)
    words = np.zeros(total // 32 + 2, dtype=np.float64)
    word = at >> 5
    words += np.bincount(word, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=len(words))
    words += np.bincount(word + 1, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=len(words))
    head = HEADER.pack(MAGIC, len(doc_ids), unnamed, interval, len(ids), total)
    return b"".join([head, named.tobytes(), doc_tokens.astype("<i8").tobytes(), at[::interval].astype("<u8").tobytes(), words.astype(np.uint64).astype(">u4").tobytes()])


def decode_block(block: bytes, tables: tuple[np.ndarray, np.ndarray, int]) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, tokens of each, and all ids in order."""
    magic, docs, unnamed, interval, total, _ = HEADER.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    pos = HEADER.size
    doc_ids = [None] * unnamed + np.frombuffer(block, "<i8", docs, pos)[unnamed:].tolist()
    doc_tokens = np.frombuffer(block, "<i8", docs, pos + 8 * docs)
    marks = -(-total // interval)
    at = np.frombuffer(block, "<u8", marks, pos + 16 * docs).astype(np.int64)
    words = np.frombuffer(block, ">u4", offset=pos + 16 * docs + 8 * marks).astype(np.uint64)
    pairs = np.append((words[:-1] << np.uint64(32)) | words[1:], np.uint64(0))
    symbols, bits, width = tables
    out = np.zeros((interval, marks), dtype=np.uint32)
    low = np.uint64((1 << width) - 1)
    last = total - (marks - 1) * interval if marks else 0
    for k in range(interval if marks else 0):
        live = marks if k < last else marks - 1  # only the last run may be short
        if not live:
            break
        here = at[:live]
        window = (pairs[here >> 5] >> (64 - width - (here & 31)).astype(np.uint64)) & low
        out[k, :live] = symbols[window]
        here += bits[window]
    return doc_ids, doc_tokens, out.T.reshape(-1)[:total]


def flat_values(column: pa.Array, dtype: str) -> np.ndarray:
    """All values of a binary column as one array, without a copy."""
    if not len(column):
        return np.empty(0, dtype)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(dtype) if data is not None else np.empty(0, dtype)


def id_counts(tokens: DataFrame, size: int, dtype: str) -> np.ndarray:
    """Global counts: one row per id and task, summed by Spark; at most one number per id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            part = np.bincount(flat_values(b.column("ids"), dtype))
            total[: len(part)] += part
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = np.zeros(size, dtype=np.int64)
    for r in map_batches(tokens.select("ids"), run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    return counts


def write_token_files(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, max_bits: int = MAX_BITS, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, np.ndarray]:
    """Encode all documents; returns the written blocks as (start, block) and the code lengths.

    ``start`` is the number of ids before the block. The driver holds the counts
    of the vocabulary's ids and one total per partition, nothing per document.
    """
    from tokenizers import Tokenizer

    vocabulary = vocabulary or default_vocabulary()
    size = max([end_id, *Tokenizer.from_file(vocabulary).get_vocab().values()]) + 1
    dtype = id_type(size, end_id)
    tokens = materialize(tokenized(docs, vocabulary, end_id), "ids")
    lengths = code_lengths(id_counts(tokens, size, dtype), max_bits)
    sc = docs.sparkSession.sparkContext
    book = sc.broadcast((lengths, canonical_codes(lengths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lens, codes = book.value
        part, names, held, at, size = TaskContext.get().partitionId(), [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal at, size
            block = encode_block(names, np.array([len(h) for h in held]) // int(dtype[-1]), np.frombuffer(b"".join(held), dtype), lens, codes)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([size], pa.int64()), pa.array([block], pa.binary())], ["part", "at", "n", "block"])
            names.clear()
            held.clear()
            at, size = at + size, 0
            return row

        for b in batches:
            for doc, n, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True):
                names.append(doc)
                held.append(raw)
                size += n
                if size >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    blocks = materialize(map_batches(in_order(tokens).select("doc_id", "n", "ids"), run, "part int, at long, n long, block binary"), "blocks")
    discard(tokens)
    base, before = [], 0
    for part, n in sorted(map(tuple, blocks.groupBy("part").agg(F.sum("n")).collect())):  # one number per partition
        base.append((part, before))
        before += n
    bases = F.broadcast(docs.sparkSession.createDataFrame(base, "part int, base long"))
    return blocks.join(bases, "part").select((F.col("base") + F.col("at")).alias("start"), "block"), lengths


def read_token_files(blocks: DataFrame, lengths: np.ndarray, keep_ids: bool = True) -> DataFrame:
    """Decode every block: (doc_id, start, n_tokens, ids_crc32, ids); without ``keep_ids`` the ids stay in Python."""
    tables = blocks.sparkSession.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = decode_tables(tables.value)
        for b in batches:
            for start, block in zip(b.column("start").to_pylist(), b.column("block").to_pylist(), strict=True):
                docs, n, ids = decode_block(block, look)
                ends = np.cumsum(n)
                raw = memoryview(ids.astype("<u4").tobytes())
                cut = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                cols = [pa.array(docs, pa.int64()), pa.array(start + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(c) for c in cut], pa.int64())]
                if keep_ids:
                    cols.append(pa.array([bytes(c) for c in cut], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return map_batches(blocks.select("start", "block"), run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)

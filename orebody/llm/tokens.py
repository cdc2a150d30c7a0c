"""Exact, cached use of the ``tokenizers`` library on whole texts.

The tokenizer drops white space and never joins characters across a space or
a line feed (its normaliser composes nothing with them, its splitter stops at
them), so the ids of a text are the ids of its pieces between these two
characters, one after another. Pieces repeat; each Python worker keeps a
two-generation table of their ids, bounded in entries and in piece length.

A piece of letters below U+0130 needs no normaliser and no splitter: lower-cased
it is one word of the library's model and goes there directly; every other
piece goes through the whole tokenizer. In texts of such characters alone,
case and the place between a word and the mark behind it don't matter either,
so they are evened out before pieces are looked up. Both shortcuts are taken
only for tokenizers built of exactly these parts.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.llm.common import map_batches, slices

CACHE_PIECES = 120_000
CACHED_LENGTH = 48


#: Below it, letters are composed already and have a lower case of one letter.
FIRST_ODD = "\u0130"
#: Texts with other characters, or with what may be a special token, are only split.
ODD = r"[^\x00-\x{12F}]|<\|"
#: What the model puts at the end of a word's last piece.
WORD_END = "</w>"
#: The splitter that the shortcut is valid for.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TextEncoder:
    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.young, self.old = cache_pieces, {"": b""}, {}
        self.letters = byte_letters()
        parts = json.loads(self.tokenizer.to_str())
        kinds = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        pre = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.direct = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [p.get("type") for p in pre] == ["Split", "ByteLevel"]
            and pre[0]["pattern"] == {"Regex": SPLITTER}
            and not pre[1]["add_prefix_space"]
            and not pre[1]["use_regex"]
            and parts["post_processor"] is None
            and parts["model"]["type"] == "BPE"
            and parts["model"]["end_of_word_suffix"] == WORD_END
        )
        if self.direct:
            from tokenizers.pre_tokenizers import WhitespaceSplit

            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = WhitespaceSplit()
            self.last = np.zeros(self.model.get_vocab_size() + 1, dtype=bool)
            self.last[[i for piece, i in self.model.get_vocab().items() if piece.endswith(WORD_END)]] = True

    def _whole(self, pieces: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in done]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of the byte-level alphabet: one text of all of them, split at its spaces only, goes to the model.

        Only a word's last piece can have the mark of a word's end; if any has none, words go one by one.
        """
        if not words:
            return []
        ids = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
        if len(ends) != len(words):
            return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        if not self.direct:
            return self._whole(pieces)
        out: list[bytes] = [b""] * len(pieces)
        rest, plain, words = [], [], []
        letters = self.letters
        for i, piece in enumerate(pieces):
            if piece.isalpha() and (piece.isascii() or max(piece) < FIRST_ODD):
                word = piece.lower()
                plain.append(i)
                words.append(word if word.isascii() else word.encode().decode("latin-1").translate(letters))
            else:
                rest.append(i)
        for i, ids in zip(plain, self._words(words), strict=True):
            out[i] = ids
        for i, ids in zip(rest, self._whole([pieces[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _cut(self, texts: pa.Array) -> pa.Array:
        """Texts with their pieces between single spaces; where nothing can change, in lower case and with marks apart from words."""
        plain = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        if not self.direct:
            return plain
        odd = pc.match_substring_regex(plain, ODD)
        usual = pc.replace_substring_regex(pc.utf8_lower(plain), r"([\p{L}\p{N}])([.,;:!?])", r"\1 \2")
        return pc.if_else(odd, plain, usual)

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array (null is empty) in order, and the end of each text in them.

        Splitting, counting and gathering are Arrow and numpy work; Python sees each different piece once.
        """
        split = pc.split_pattern(self._cut(texts), " ")
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {"": b""}
        young, old = self.young, self.old
        found = list(map(young.get, pieces))
        missing = [i for i, x in enumerate(found) if x is None]
        fresh = []
        for i in missing:
            piece = pieces[i]
            if (known := old.get(piece)) is None:
                fresh.append(i)
            else:
                found[i] = young[piece] = known
        names = [pieces[i] for i in fresh]
        for i, piece, ids in zip(fresh, names, self._ids(names), strict=True):
            found[i] = ids
            if len(piece) <= CACHED_LENGTH:
                young[piece] = ids
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) >> 2
        begin = np.cumsum(size) - size
        at = coded.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n)
        out = flat[np.repeat(begin[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py() if len(split) else np.zeros(1, np.int64)
        return out, np.concatenate([[0], ends])[offsets[1:]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, ends = self.encode_flat(pa.array(texts, pa.large_string()))
        raw, at = ids.tobytes(), 0
        out = []
        for end in ends.tolist():
            out.append(raw[4 * at : 4 * end])
            at = end
        return out


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def ending_ids(path: str) -> np.ndarray:
    """Mask over ids: true where the piece is made of sentence-ending marks only."""
    vocab = encoder(path).tokenizer.get_vocab()
    mask = np.zeros(max(vocab.values()) + 1, dtype=bool)
    for piece, i in vocab.items():
        bare = piece.removesuffix("</w>")
        mask[i] = bool(bare) and not bare.strip(".!?")
    return mask


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenized(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, version, row, n, ids): each document's ids with the end id, of 2 bytes where the vocabulary allows it.

    ``version`` is a hash of the text, ``row`` a number of the row: with doc_id they order all rows, and repeated
    rows are told apart, so one doc_id (or none) of very many rows can be split over tasks.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("version"), F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        kind = id_type(enc.tokenizer.get_vocab_size(), end_id)
        end = np.array([end_id], dtype=kind).tobytes()
        width = len(end)
        for b in batches:
            for c in slices(b):
                ids, cuts = enc.encode_flat(c.column("text"))
                raw, cuts = memoryview(ids.astype(kind).tobytes()), np.concatenate([[0], cuts])
                own = [bytes(raw[width * x : width * y]) + end for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("version"), c.column("row"), pa.array(np.diff(cuts) + 1, pa.int64()), pa.array(own, pa.binary())], ["doc_id", "version", "row", "n", "ids"])

    return map_batches(rows, run, "doc_id long, version long, row long, n long, ids binary")


def id_type(size: int, end_id: int) -> str:
    """Little-endian type of the ids of a vocabulary of ``size`` pieces."""
    return "<u4" if max(size, end_id + 1) > 1 << 16 else "<u2"


def in_order(tokens: DataFrame, partitions: int | None = None) -> DataFrame:
    """Written tokens by ascending doc_id (nulls first), in range partitions."""
    keys = ["doc_id", "version", "row"]
    ranged = tokens.repartitionByRange(partitions, *keys) if partitions else tokens.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)

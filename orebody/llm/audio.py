"""Telephony audio columns: mu-law, A-law and 4-bit ADPCM in RIFF/WAVE, kept losslessly, expanded with numpy.

The stored form is a WAVE file whose data chunk is the payload itself: for the
two companded formats one byte is one 8-bit sample; for ADPCM 64 bytes are one
block (a 4-byte header of predictor and step index, 120 nibbles). Reading it
back and expanding it gives 16-bit PCM, which is resampled and stored in a
second table; both tables lie below the shared folder.

Defined results: null text is the empty payload, padded to 64 zero bytes;
equal payloads give equal values whatever the row; an ADPCM header with a step
index above 88 is clamped to 88; null doc_ids are rows like others; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.llm.common import discard, map_batches, materialize, portions, slices, texts_of

UNIT = 64
RATE = 8000
OUT_RATE = 4000
#: Both tables of samples are written in a denser form than usual; audio of text packs badly.
STORAGE = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}
#: Audio files are read back in so many portions at most, each deleted when its samples are written.
PORTIONS = 3
FORMATS = {"mulaw": 7, "alaw": 6, "adpcm": 17}


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = ((((u & 0x0F) << 3) + 0x84) << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    exponent, low = (a & 0x70) >> 4, (a & 0x0F) << 4
    size = np.where(exponent == 0, low + 8, (low + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


# The 89 quantiser steps and the 16 index moves of IMA ADPCM (public standard).
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the predictor and next step index, by step index * 16 + nibble."""
    index, nibble = np.divmod(np.arange(89 * 16), 16)
    step = STEPS[index]
    size = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    return np.where(nibble & 8, -size, size).astype(np.int32), np.clip(index + MOVES[nibble], 0, 88).astype(np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, 64) bytes to (n, 121) samples; the loop runs over the places in a block, numpy over all blocks."""
    change, move = adpcm_tables()
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * body.shape[0] + 1, len(blocks)), dtype=np.int16)
    out[0] = value = head
    for k, byte in enumerate(body):
        for half, nibble in enumerate((byte & 15, byte >> 4)):
            at = index * 16 + nibble
            value = np.clip(value + change[at], -32768, 32767)
            index = move[at]
            out[2 * k + half + 1] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation on the output grid; integer input and output."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    if rate == 2 * to:
        even = pcm[: len(pcm) // 2 * 2].reshape(-1, 2).astype(np.int32)
        return (even.sum(axis=1) >> 1).astype(np.int16)
    at = np.arange(int(len(pcm) * to / rate)) * (rate / to)
    return np.rint(np.interp(at, np.arange(len(pcm)), pcm)).astype(np.int16)


def wrap(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    align = UNIT if codec == "adpcm" else 1
    bits = 4 if codec == "adpcm" else 8
    extra = struct.pack("<HH", 2, 2 * (UNIT - 4) + 1) if codec == "adpcm" else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", FORMATS[codec], 1, rate, rate * align if align == 1 else rate * UNIT // 121, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwrap(media: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and payload, from the file's own chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    pos, codec, rate, data = 12, "", 0, b""
    while pos + 8 <= len(media):
        size = int.from_bytes(media[pos + 4 : pos + 8], "little")
        part = media[pos + 8 : pos + 8 + size]
        if media[pos : pos + 4] == b"fmt ":
            code, _, rate = struct.unpack_from("<HHI", part)
            codec = {v: k for k, v in FORMATS.items()}[code]
        elif media[pos : pos + 4] == b"data":
            data = part
        pos += 8 + size + (size & 1)
    return codec, rate, data


def expand(payloads: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """PCM of each payload; all ADPCM blocks of the list are decoded together."""
    tables = {"mulaw": mulaw_table(), "alaw": alaw_table()}
    packed = [p for c, p in payloads if c == "adpcm"]
    pcm = decode_adpcm(np.frombuffer(b"".join(packed), np.uint8).reshape(-1, UNIT)) if packed else None
    out, at = [], 0
    for codec, p in payloads:
        if codec == "adpcm":
            n = len(p) // UNIT
            out.append(pcm[at : at + n].reshape(-1))
            at += n
        else:
            out.append(tables[codec][np.frombuffer(p, np.uint8)])
    return out


def feature(low: np.ndarray, codec: str) -> str:
    """Codec, samples, mean power, zero crossings and checksum of the resampled PCM."""
    x = low.astype(np.int64)
    power = int((x * x).sum()) // max(1, len(x))
    crossings = int(np.count_nonzero((low[1:] < 0) != (low[:-1] < 0)))
    return f"{codec} samples={len(low)} power={power} crossings={crossings} pcm={zlib.crc32(low.astype('<i2').tobytes()):08x}"


def pick_codec(payload: bytes) -> str:
    return list(FORMATS)[zlib.crc32(payload) % 3]


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes, zero-padded to a positive multiple of 64, as a WAVE file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = texts_of(b, text)
            padded = [x + bytes(-len(x) % UNIT or (UNIT if not x else 0)) for x in raw]
            media = [wrap(p, pick_codec(p)) for p in padded]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")), run, "doc_id long, n_bytes long, media binary")


def expanded(stored: DataFrame, out_rate: int = OUT_RATE) -> DataFrame:
    """What the stored files hold, read back: digests and, as ``pcm``, the expanded and resampled 16-bit little-endian samples at ``rate``."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "rate", "pcm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "media", 1 << 20):
                media = b.column("media").to_pylist()
                read = [unwrap(m) for m in media]
                pcm = expand([(c, p) for c, _, p in read])
                low = [resample(x, r, out_rate).astype("<i2") for x, (_, r, _) in zip(pcm, read, strict=True)]
                cols = [
                    pa.array([len(p) for _, _, p in read], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for _, _, p in read]),
                    pa.array([zlib.crc32(p[-UNIT:]) for _, _, p in read], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array([feature(x, c) for x, (c, _, _) in zip(low, read, strict=True)]),
                    pa.array([out_rate] * len(low), pa.int32()),
                    pa.array([x.tobytes() for x in low], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *cols], names)

    return map_batches(stored, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, rate int, pcm binary")


def convert(docs: DataFrame, out_rate: int = OUT_RATE) -> DataFrame:
    """Store all texts as audio files, read these back, and store what ``expanded`` makes of them."""
    stored = materialize(store(docs), "media", **STORAGE)
    out = []
    for part in portions(stored, PORTIONS):
        out.append(materialize(expanded(part, out_rate), "pcm", **STORAGE))
        discard(part)
    discard(stored)
    return reduce(DataFrame.unionByName, out)


def digests(docs: DataFrame) -> DataFrame:
    """The rows of ``convert`` without the samples."""
    return convert(docs).drop("rate", "pcm")

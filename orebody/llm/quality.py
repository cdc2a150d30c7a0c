"""Quality classifier by co-training of a text view and a metadata view.

Text view: shape statistics and hashed words of the whole text. Metadata view: source, language
and recorded length, hashed. Each view is a logistic regression; over a few
rounds each labels the rows of a pool it is most sure of for the other. The
two views' scores are calibrated on labelled rows kept out of training and
combined there.

Training reads a bounded sample: at most ``max_labelled`` labelled and
``max_pool`` other rows of at most ``max_train_bytes`` bytes, the first by a
hash of doc_id. Scoring reads every row and every whole text.

Defined results: null and empty texts have all-zero text features and are
scored like any text; rows that share a doc_id are learned from once, from the
least text; null metadata hashes as an own value; of repeated labels
of a doc_id the highest counts; with labels of one class or none, all scores
are 0.5 and every row stays; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.llm import linear
from orebody.llm.common import map_batches, slices, texts_of
from orebody.llm.line_dedup import word_hashes, word_places

MAX_LABELLED = 3000
MAX_POOL = 2000
MAX_TRAIN_BYTES = 16_000
ROUNDS = 4
PER_ROUND = 100
SURE = 0.95
REJECT_BELOW = 0.5
META_SLOTS = 32
SHAPES = 12
WORD_SLOTS = 128
#: Divides the standardised word slots, which are many and tell little each, so that the fit leans on them less.
WORD_CAUTION = np.concatenate([np.ones(SHAPES), np.full(WORD_SLOTS, 6.0)])

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_SIGNS = b"*#$%&@^~=<>\\{}[]|_+`"
_STOPS = b".,;:!?"


def text_features(raw: bytes) -> list[float]:
    """Shares of character kinds, repetition of words and lines, and lengths."""
    n = len(raw)
    words = raw.split()
    if not words:
        return [0.0] * 12
    m = len(words)
    lines = raw.split(b"\n")
    cuts = [len(raw.translate(None, drop)) for drop in (_UPPER, _LOWER, _SIGNS, _STOPS, b"0123456789", b"!")]
    return [
        *((n - c) / n for c in cuts),
        sum(map(bytes.__eq__, words[1:], words[:-1])) / m,
        len(set(words)) / m**0.9,
        1 - len(set(lines)) / len(lines),
        min(n / m, 40.0) / 10,
        np.log1p(m) / 10,
        1.0,
    ]


def text_view(texts: list[bytes]) -> np.ndarray:
    """Shapes and, for each slot of hashed lower-case words, the root of its share of the words; one row per text."""
    shapes = np.array([text_features(t) for t in texts], dtype=float).reshape(len(texts), SHAPES)
    raw = b"\n".join(texts).lower()
    starts, ends = word_places(raw)
    slots = np.zeros((len(texts), WORD_SLOTS))
    if len(starts):
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
        with np.errstate(over="ignore"):
            slot = (word_hashes(raw, starts, ends) % np.uint64(WORD_SLOTS)).astype(np.int64)
        slots = np.bincount(text * WORD_SLOTS + slot, minlength=slots.size).reshape(slots.shape).astype(float)
        slots = np.sqrt(slots / np.maximum(1, slots.sum(axis=1, keepdims=True)))
    return np.column_stack([shapes, slots])


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    row = [0.0] * (META_SLOTS + 2)
    row[xxhash.xxh32_intdigest(f"s{source}") % META_SLOTS] += 1.0
    row[xxhash.xxh32_intdigest(f"l{lang}") % META_SLOTS] += 1.0
    row[-2] = float(np.log1p(max(0, n_chars or 0))) / 10
    row[-1] = float(n_chars is None)
    return row


class View:
    """Standardised logistic regression with a calibration of its log-odds."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), (x.std(axis=0) + 1e-6) * (WORD_CAUTION if x.shape[1] == SHAPES + WORD_SLOTS else 1)
        self.w = linear.fit((x - self.mean) / self.scale, y)
        self.cal = np.array([1.0, 0.0])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return linear.predict(np.clip((x - self.mean) / self.scale, -8, 8), self.w)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.cal = linear.fit(linear.logit(self.raw(x))[:, None], y, l2=0.1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return linear.predict(linear.logit(self.raw(x))[:, None], self.cal)


class Model:
    """The two trained views and the weights that combine them."""

    def __init__(self, text: View, meta: View, mix: np.ndarray):
        self.text, self.meta, self.mix = text, meta, mix

    def score(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.score(xt), self.meta.score(xm)
        return a, b, linear.predict(np.column_stack([linear.logit(a), linear.logit(b)]), self.mix)


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, pool_t: np.ndarray, pool_m: np.ndarray, rounds: int = ROUNDS, per_round: int = PER_ROUND, sure: float = SURE) -> Model | None:
    """None unless both classes are in the training and the calibration part (every fourth row)."""
    keep = np.arange(len(y)) % 4 == 3
    if any(len(set(part.tolist())) < 2 for part in (y[keep], y[~keep])):
        return None
    views = [xt[~keep], xm[~keep]]
    labels = [y[~keep].astype(float)] * 2
    pool = [pool_t, pool_m]
    free = np.ones(len(pool_t), dtype=bool)
    trained = [View(views[k], labels[k]) for k in (0, 1)]
    for _ in range(rounds):
        given = []
        for k in (0, 1):
            rest = np.flatnonzero(free)
            if not len(rest):
                break
            p = trained[k].raw(pool[k][rest])
            order = np.argsort(p)
            picks = np.concatenate([order[:per_round][p[order[:per_round]] <= 1 - sure], order[-per_round:][p[order[-per_round:]] >= sure]])
            given.append((1 - k, rest[np.unique(picks)], (p[np.unique(picks)] >= 0.5).astype(float)))
        for to, rows, said in given:
            views[to] = np.concatenate([views[to], pool[to][rows]])
            labels[to] = np.concatenate([labels[to], said])
            free[rows] = False
        if not any(len(rows) for _, rows, _ in given):
            break
        trained = [View(views[k], labels[k]) for k in (0, 1)]
    for k, x in enumerate((xt, xm)):
        trained[k].calibrate(x[keep], y[keep])
    both = np.column_stack([linear.logit(v.score(x[keep])) for v, x in zip(trained, (xt, xm), strict=True)])
    return Model(*trained, linear.fit(both, y[keep], l2=0.3))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL, max_train_bytes: int = MAX_TRAIN_BYTES) -> Model | None:
    """Fit on the bounded sample; the driver holds its features and one text at a time per task."""
    said = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("__q"))
    short = docs.filter(F.octet_length(F.coalesce("text", F.lit(""))) <= max_train_bytes).select("doc_id", "text", "source", "lang", "n_chars")
    by_hash = F.xxhash64(F.lit("quality"), "doc_id")
    # ids first, so that texts travel for the sampled rows only
    some = short.select("doc_id").join(said, "doc_id").groupBy("doc_id").agg(F.max("__q").alias("__q")).orderBy(by_hash).limit(max_labelled)
    pool = short.select("doc_id").distinct().join(said, "doc_id", "left_anti").orderBy(by_hash).limit(max_pool).withColumn("__q", F.lit(None).cast("int"))
    ids = [(r[0], r[1]) for r in some.unionByName(pool.select("doc_id", F.col("__q").cast(some.schema["__q"].dataType))).collect()]
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, __q int")
    least = F.min(F.struct("text", "source", "lang", "n_chars")).alias("r")  # of rows that share a doc_id, whatever the order they come in
    some = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(least, F.max("__q").alias("__q")).select("doc_id", "r.*", "__q")
    rows = _features(some, ["__q"]).collect()
    rows = sorted(rows, key=lambda r: xxhash.xxh32_intdigest(str(r.doc_id)))
    known = [r for r in rows if r["__q"] is not None]
    pooled = [r for r in rows if r["__q"] is None]
    if not known:
        return None
    mat = lambda part, c, n: np.array([r[c] for r in part], dtype=float).reshape(len(part), n)
    return co_train(mat(known, "xt", SHAPES + WORD_SLOTS), mat(known, "xm", META_SLOTS + 2), np.array([float(r["__q"] > 0) for r in known]), mat(pooled, "xt", SHAPES + WORD_SLOTS), mat(pooled, "xm", META_SLOTS + 2))


def _features(rows: DataFrame, more: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xt = text_view(texts_of(b)).tolist()
            xm = [meta_features(*r) for r in zip(*(b.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(c) for c in more), pa.array(xt, pa.list_(pa.float64())), pa.array(xm, pa.list_(pa.float64()))], ["doc_id", *more, "xt", "xm"])

    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in more)
    return map_batches(rows, run, f"doc_id long{kinds}, xt array<double>, xm array<double>")


def _typed(docs: DataFrame) -> dict:
    kinds = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return {c: (F.col(c) if c in docs.columns else F.lit(None)).cast(k) for c, k in kinds.items()}


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_score, meta_score, score, keep."""
    rows = docs.select(*(e.alias(c) for c, e in _typed(docs).items()))
    model = docs.sparkSession.sparkContext.broadcast(train(rows, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (c for whole in batches for c in slices(whole, "text", 1 << 20)):
            a, m, s = _score_batch(model.value, b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(a), pa.array(m), pa.array(s), pa.array(s >= REJECT_BELOW)], ["doc_id", "text_score", "meta_score", "score", "keep"])

    return map_batches(rows, run, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def _score_batch(model: Model | None, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if model is None or not b.num_rows:
        return (np.full(b.num_rows, 0.5),) * 3
    xt = text_view(texts_of(b))
    xm = np.array([meta_features(*r) for r in zip(*(b.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)])
    return model.score(xt, xm)


def keep_good(docs: DataFrame, labels: DataFrame, below: float = REJECT_BELOW) -> DataFrame:
    """Rows of ``docs``, unchanged, but those scored below ``below``; no shuffle of the documents."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs.select(*(e.alias(c) for c, e in _typed(docs).items())), labels))
    names = docs.columns
    kinds = {"text": pa.string(), "source": pa.string(), "lang": pa.string(), "n_chars": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (c for whole in batches for c in slices(whole, "text", 1 << 20)):
            own = [b.column(c).cast(k) if c in names else pa.nulls(b.num_rows, k) for c, k in kinds.items()]
            _, _, s = _score_batch(model.value, pa.RecordBatch.from_arrays(own, list(kinds)))
            yield b.filter(pa.array(s >= below))

    return map_batches(docs, run, docs.schema)

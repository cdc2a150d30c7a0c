"""Toxic spans by a linear-chain conditional random field over words.

Chains are sentences, however long, with two states per word (only for fitting
are they cut, after ``FIT_CHAIN`` words).
A word's state score is the sum of the weights of its own form, its prefixes
and suffixes; neighbours interact through the transition weights. Labelled
tokens come from document labels: among the sampled texts (near copies left
out), a form, prefix or suffix that toxic documents have and clean ones don't,
more often than chance explains at the given rate of false discoveries, marks
its words in toxic documents. After a first fit the field's own marginals
relabel the words of toxic documents, and it is fitted again.

Forward-backward gives every word's marginal. A document's score is a
calibrated function of its largest marginal and of its expected number of toxic
words; the words, each at its own place, whose marginal is at least
``SPAN_FROM`` give the offending spans (character offsets).

Training reads a bounded sample: at most ``max_docs`` toxic texts and ``CLEAN_PER_TOXIC`` times as many clean ones, of
at most ``max_train_chars`` characters, the first by a hash of doc_id; rows
that ``held_out`` names are never read for it. Scoring reads every whole text.
Defined results: null and empty texts score what no toxic word at all scores;
equal texts score equally; of repeated labels of a doc_id the highest counts;
without labels of both classes every score is 0; rows without a doc_id are
scored and never learned from; ties of the sampling hash don't occur between
different ids; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.llm.common import map_batches, slices
from orebody.llm import linear

MAX_DOCS = 1500
CLEAN_PER_TOXIC = 2
MAX_TRAIN_CHARS = 6000
FIT_CHAIN = 128
FALSE_DISCOVERIES = 0.1
NEARLY = 0.8
SPAN_FROM = 0.5
TOXIC_FROM = 0.7
CACHE_WORDS = 400_000
#: Sentence ends become a word of their own; other ASCII that is no letter, digit or apostrophe becomes a space.
_BYTES = bytes(1 if c in b".!?\n\x01" else c if c >= 128 or chr(c).isalnum() or c == 39 else 32 for c in range(256))
STOP = b"\x01"


def words_of(text: str) -> list[bytes]:
    """Lower-cased words of the whole text with STOP between sentences."""
    return text.lower().encode("utf-8", "replace").translate(_BYTES).replace(STOP, b" \x01 ").split()


def features(word: bytes) -> list[bytes]:
    """The word's form, its prefixes of 3 to 10 bytes and suffixes of 3 to 5; marks keep the kinds apart."""
    n = len(word)
    return [b"=" + word, *(b"<" + word[:k] for k in range(3, min(n, 11))), *(b">" + word[-k:] for k in range(3, min(n, 6)))]


class Field:
    """Weights of state 1 against state 0 by feature, a bias, and a 2 x 2 table of transition weights."""

    def __init__(self, weights: dict[bytes, float], bias: float, moves: np.ndarray, doc: np.ndarray):
        self.weights, self.bias, self.moves, self.doc = weights, bias, moves, doc
        self.cache: dict[bytes, float] = {STOP: -60.0}

    def __getstate__(self) -> tuple:
        return self.weights, self.bias, self.moves, self.doc

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def emissions(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        new = set(words).difference(cache)
        if len(cache) + len(new) > CACHE_WORDS:
            self.cache = cache = {STOP: -60.0}
            new = set(words).difference(cache)
        get, bias = self.weights.get, self.bias
        for w in new:
            cache[w] = bias + sum([get(f, 0.0) for f in features(w)])
        return np.fromiter(map(cache.__getitem__, words), dtype=np.float64, count=len(words))

    def marginals(self, emission: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return marginals(emission, stop, self.moves, count=False)[0]

    def score(self, largest: np.ndarray, expected: np.ndarray) -> np.ndarray:
        x = np.column_stack([linear.logit(largest) / 5, np.log1p(expected)])
        return linear.predict(x, self.doc)


def chains(stop: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs without a stop; with ``most``, cut to that many words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], stop, [True]]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    if most is None:
        return starts, ends - starts
    pieces = -(-(ends - starts) // most)
    first = np.repeat(starts, pieces) + most * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return first, np.minimum(first + most, np.repeat(ends, pieces)) - first


def marginals(emission: np.ndarray, stop: np.ndarray, moves: np.ndarray, longest: int | None = None, count: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of every word by forward-backward over all chains at once, and the expected transitions (2 x 2; left out without ``count``)."""
    out, pairs = np.zeros(len(emission)), np.zeros((2, 2))
    starts, lengths = chains(stop, longest)
    order = np.argsort(lengths, kind="stable")
    e = np.exp(moves)
    at = 0
    while at < len(order):
        # chains of like length share a block, so little of it is filling
        most = int(lengths[order[at]])
        end = int(np.searchsorted(lengths[order], max(most + 4, int(most * 1.25)), "right"))
        end = min(end, at + max(64, 2_000_000 // max(1, 2 * most)))
        rows = order[at:end]
        at = end
        n, size = lengths[rows], int(lengths[rows].max())
        place = starts[rows] + np.arange(size)[:, None]
        live = np.arange(size)[:, None] < n
        r = np.exp(np.clip(emission[np.where(live, place, 0)], -30, 30))
        fwd = np.empty((size, len(rows)))
        fwd[0] = r[0] / (1 + r[0])
        for t in range(1, size):
            f = fwd[t - 1]
            one = ((1 - f) * e[0, 1] + f * e[1, 1]) * r[t]
            fwd[t] = one / (one + (1 - f) * e[0, 0] + f * e[1, 0])
        back = np.full(len(rows), 0.5)  # share of state 1 in the backward message
        post = np.empty_like(fwd)
        for t in range(size - 1, -1, -1):
            last = n - 1 == t
            back = np.where(last, 0.5, back)
            a, b = fwd[t] * back, (1 - fwd[t]) * (1 - back)
            post[t] = a / (a + b)
            if t:
                w1, w0 = r[t] * back, 1 - back
                if count:
                    on = live[t]
                    prev = fwd[t - 1]
                    cells = [(1 - prev) * e[0, 0] * w0, (1 - prev) * e[0, 1] * w1, prev * e[1, 0] * w0, prev * e[1, 1] * w1]
                    total = sum(cells)
                    pairs += np.array([np.sum((c / total)[on]) for c in cells]).reshape(2, 2)
                one, zero = e[1, 0] * w0 + e[1, 1] * w1, e[0, 0] * w0 + e[0, 1] * w1
                back = one / (one + zero)
        out[place[live]] = post[live]
    return out, pairs


def marked_features(docs: list[set[bytes]], toxic: list[bool], rate: float = FALSE_DISCOVERIES) -> set[bytes]:
    """Features of toxic documents that chance does not explain.

    Those that only toxic documents have, at frequencies where chance makes at
    most ``rate`` of such features; and those of which nearly all bearers are
    toxic, so often that chance (by Chernoff's bound) makes less than one.
    """
    seen, bad = Counter(), Counter()
    for words, label in zip(docs, toxic, strict=True):
        own = {f for w in words for f in features(w)}
        seen.update(own)
        if label:
            bad.update(own)
    share = sum(toxic) / max(1, len(toxic))
    levels, pure = Counter(seen.values()), defaultdict(list)
    for f, n in bad.items():
        if seen[f] == n:
            pure[n].append(f)
    only = {f for n, found in pure.items() if n >= 2 and levels[n] * share**n <= rate * len(found) for f in found}
    gain = NEARLY * math.log(NEARLY / share) + (1 - NEARLY) * math.log((1 - NEARLY) / (1 - share)) if 0 < share < NEARLY else 0.0
    return only | {f for f, n in bad.items() if n >= NEARLY * seen[f] and seen[f] * gain >= math.log(len(seen)) + 2}


def unlike(texts: list[str]) -> list[int]:
    """Indices of texts, without those that share most of the eight least shingle hashes with one before."""
    kept, owners = [], defaultdict(list)
    for i, text in enumerate(texts):
        words = text.lower().split()
        least = sorted({xxhash.xxh3_64_intdigest(" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))})[:8]
        votes = Counter(o for h in least for o in owners[h])
        if votes and votes.most_common(1)[0][1] >= max(1, len(least) // 3):
            continue
        kept.append(i)
        for h in least:
            owners[h].append(i)
    return kept


def fit_field(sequences: list[list[bytes]], labels: list[np.ndarray], forced: np.ndarray | None = None, steps: int = 45, l2: float = 2e-3) -> Field:
    """Maximum likelihood with Adam; one pass over all sampled chains a step. The document function is left open."""
    flat = [w for s in sequences for w in [*s, STOP]]
    y = np.concatenate([np.append(x, 0) for x in labels]).astype(float)
    stop = np.array([w == STOP for w in flat])
    vocab = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.array([vocab[w] for w in flat])
    useful = {f for w in {w for w, t in zip(flat, y.tolist(), strict=True) if t} for f in features(w)}
    names = sorted(useful)
    index = {f: i for i, f in enumerate(names)}
    hits = [(i, index[f]) for w, i in vocab.items() if w != STOP for f in features(w) if f in index]
    word, feat = (np.array(x) for x in zip(*hits, strict=True)) if hits else (np.empty(0, int), np.empty(0, int))
    theta = np.zeros(len(names) + 5)
    theta[len(names)] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    starts, lengths = chains(stop, FIT_CHAIN)
    inner = np.ones(len(flat), bool)
    inner[starts] = False
    inner &= ~stop
    told = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            told[a, b] = np.sum((y[:-1] == a) & (y[1:] == b) & inner[1:])
    total = max(1.0, y.sum())
    for k in range(1, steps + 1):
        emission = np.bincount(word, weights=theta[feat], minlength=len(vocab)) + theta[len(names)]
        p, pairs = marginals(emission[ids], stop, theta[-4:].reshape(2, 2), FIT_CHAIN)
        miss = np.where(stop, 0.0, p - y)
        by_word = np.bincount(ids, weights=miss, minlength=len(vocab))
        g = np.concatenate([np.bincount(feat, weights=by_word[word], minlength=len(names)), [by_word.sum()], (pairs - told).ravel()])
        g = g / total + l2 * theta * np.append(np.ones(len(names)), [0, 0.1, 0.1, 0.1, 0.1])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.3 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    weights = {f: float(x) for f, x in zip(names, theta, strict=False) if abs(x) > 1e-3}
    return Field(weights, float(theta[len(names)]), theta[-4:].reshape(2, 2), np.array([0.0, 0.0, -40.0]))


def document_values(field: Field, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Largest marginal and expected toxic words per document; all marginals and the documents' ends in them."""
    flat: list[bytes] = []
    for d in docs:
        flat += d
        flat.append(STOP)
    ends = np.cumsum([len(d) + 1 for d in docs])
    emission = field.emissions(flat)
    p = field.marginals(emission, emission <= -60.0)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    if not len(docs):
        return np.zeros(0), np.zeros(0), p, ends
    sure = np.where(p >= 0.1, p, 0.0)
    return np.maximum.reduceat(p, begins), np.add.reduceat(sure, begins), p, ends


def train_rows(texts: list[str], toxic: list[bool]) -> Field | None:
    if len(set(toxic)) < 2:
        return None
    keep = unlike(texts)
    docs, labels = [words_of(texts[i]) for i in keep], [toxic[i] for i in keep]
    if len(set(labels)) < 2:
        return None
    marked = marked_features([set(d) for d in docs], labels)
    bad_word = {w: any(f in marked for f in features(w)) for w in {w for d, t in zip(docs, labels, strict=True) if t for w in d} if w != STOP}
    tags = [np.array([t and bad_word.get(w, False) for w in d], dtype=bool) for d, t in zip(docs, labels, strict=True)]
    if not any(t.any() for t in tags):
        return None
    field = fit_field(docs, tags)
    _, _, p, ends = document_values(field, docs)
    again = [(p[e - len(d) - 1 : e - 1] >= 0.5) & t for d, e, t in zip(docs, ends.tolist(), labels, strict=True)]
    if any(t.any() for t in again):
        field = fit_field(docs, again)
    largest, expected, _, _ = document_values(field, docs)
    x = np.column_stack([linear.logit(largest) / 5, np.log1p(expected)])
    field.doc = linear.fit(x, np.array(labels, dtype=float), l2=0.01)
    return field


def train(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, max_docs: int = MAX_DOCS, max_train_chars: int = MAX_TRAIN_CHARS) -> Field | None:
    """Fit on the bounded sample, which is all that the driver holds."""
    said = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("__t"))
    if held_out is not None:
        said = said.filter(~held_out)
    fit = docs.filter(F.length("text").between(1, max_train_chars)).select("doc_id").join(said, "doc_id").groupBy("doc_id").agg(F.max("__t").alias("__t"))
    ids = []
    for label, most in ((1, max_docs), (0, CLEAN_PER_TOXIC * max_docs)):
        ids += fit.filter(F.col("__t") == label).orderBy(F.xxhash64(F.lit("toxicity"), "doc_id")).limit(most).collect()
    chosen = docs.sparkSession.createDataFrame([(r[0], int(r[1])) for r in ids], "doc_id long, __t int")
    rows = docs.filter(F.length("text").between(1, max_train_chars)).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("__t").alias("t")).orderBy("doc_id").collect()
    return train_rows([r.text for r in rows], [r.t == 1 for r in rows])


_WORD = re.compile(r"[^\x00-\x26\x28-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def spans_of(text: str, marked: set[int]) -> list[tuple[int, int]]:
    """Character offsets of the words of ``text`` whose numbers (stops don't count) are in ``marked``, adjoining ones as one span."""
    found: list[list[int]] = []
    for k, m in enumerate(_WORD.finditer(text)):
        if k in marked:
            if found and not text[found[-1][1] : m.start()].strip():
                found[-1][1] = m.end()
            else:
                found.append([m.start(), m.end()])
    return [(a, b) for a, b in found]


def tag(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, score, predicted, spans (array of start, end) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        # long chains of many texts share their steps, so whole batches are taken
        for whole in batches:
            for b in slices(whole):
                if model is None:
                    score, spans = np.zeros(b.num_rows), [[]] * b.num_rows
                else:
                    texts = [t or "" for t in b.column("text").to_pylist()]
                    words = [words_of(t) for t in texts]
                    largest, expected, p, ends = document_values(model, words)
                    score = model.score(largest, expected)
                    spans = [[]] * b.num_rows
                    for i in np.flatnonzero(largest >= SPAN_FROM).tolist():
                        own = p[ends[i] - len(words[i]) - 1 : ends[i] - 1]
                        real = [k for k, w in enumerate(words[i]) if w != STOP]
                        spans[i] = [{"start": x, "end": y} for x, y in spans_of(texts[i], set(np.flatnonzero(own[real] >= SPAN_FROM).tolist()))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= TOXIC_FROM).astype(np.int32)), pa.array(spans, kind)], ["doc_id", "score", "predicted", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, run, "doc_id long, score double, predicted int, spans array<struct<start: int, end: int>>")

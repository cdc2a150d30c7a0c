import random
import re

import numpy as np
import pytest

import corpus_pipeline
from orebody.llm import line_dedup
from tests.llm.fixtures import documents
from tests.llm.test_learned import prose

WORD = re.compile(r"[^ \t\n\v\f\r]+")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def brute(rows, least):
    """Text of every (doc_id, text) without the words of runs of ``least`` words that stand at any earlier place: all pairs of runs."""
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    places, out = {}, {}
    for n, (i, t) in enumerate(docs):
        words = [lower(m[0]) for m in WORD.finditer(t)]
        gone = [False] * len(words)
        for k in range(len(words) - least + 1):
            run = tuple(words[k : k + least])
            before = places.setdefault(run, [])
            if any(a < n or b + least <= k for a, b in before):
                gone[k : k + least] = [True] * least
            before.append((n, k))
        text, last = [], 0
        matches = list(WORD.finditer(t))
        for k, m in enumerate(matches):
            if gone[k]:
                if not k or not gone[k - 1]:
                    text.append(t[last : m.start()])
                last = matches[k + 1].start() if k + 1 < len(matches) else len(t)
        out[i, t] = "" if words and all(gone) else "".join([*text, t[last:]])
    return out


def mixed_rows(rng):
    """Texts with repeats whose parts also stand, alone, in other texts."""
    pool = [prose(rng, rng.randrange(5, 60)) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else prose(rng, 9) for _ in range(rng.randrange(1, 9)))) for i in range(70)]
    rows += [(200 + i, " ".join((rows[i][1] * 3).split()[rng.randrange(9) :])) for i in range(12)]
    rows += [(300, "ha " * 100), (301, "ha he " * 70), (302, "Ha He " * 33 + "end"), (303, " " + rows[4][1] + "\n\n")]
    return rows


@pytest.mark.parametrize("least", [10, line_dedup.MIN_WORDS, 40])
@pytest.mark.parametrize("sent", [line_dedup.BROADCAST_BYTES, 8])
def test_against_all_pairs_of_runs(spark, least, sent):
    rows = mixed_rows(random.Random(least))
    want = brute(rows, least)
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), least, broadcast_bytes=sent).collect()
    assert len(got) == len(rows) and sum(want[r] != r[1] for r in rows) > 30
    texts = dict(rows)
    for r in got:
        assert r.text == want[r.doc_id, texts[r.doc_id]], r.doc_id
        assert r.removed_words == len(WORD.findall(texts[r.doc_id])) - len(WORD.findall(r.text))
        assert (r.removed_runs > 0) == (r.removed_words > 0)


def test_against_all_pairs_of_runs_in_periodic_texts(spark):
    rng = random.Random(7)
    parts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(6)]
    texts = [" ".join([rng.choice(parts)] * rng.randrange(1, 14) + [rng.choice("abc") for _ in range(rng.randrange(6))] + [rng.choice(parts)] * rng.randrange(9)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts + rng.choices(texts, k=20))] + [(0, texts[0])]
    want = brute(rows, 12)
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 12).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.doc_id, dict(rows)[r.doc_id]], r.doc_id


def test_repeated_marks_every_place_of_a_key_in_a_text():
    assert line_dedup.repeated(np.array([0, 0, 0, 1, 1]), np.array([5, 3, 5, 5, 3])).tolist() == [True, False, True, False, False]
    assert line_dedup.repeated(np.array([], int), np.array([], int)).tolist() == []


def test_fixture_rows_and_clashing_columns(spark):
    rows = [(i, t) for i, t, *_ in documents() if t is None or len(t) < 5000]
    names = "doc_id long, text string, doc long, version string, spans string, c0 int, Words int, n_chars long"
    docs = spark.createDataFrame([(i, t, 1, "v", "s", 0, 0, len(t or "")) for i, t in rows], names).repartition(3)
    want = brute(rows, line_dedup.MIN_WORDS)
    out = line_dedup.drop_repeats(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows) and all((r.doc, r.version, r.spans, r.c0, r.Words) == (1, "v", "s", 0, 0) for r in got)
    allowed = {}
    for i, t in rows:
        allowed.setdefault(i, set()).add(t if t is None else want[i, t])
    assert all(r.text in allowed[r.doc_id] for r in got)
    assert all(r.n_chars == len(r.text or "") for r in got)


def test_long_texts_and_empty_tables(spark):
    text = "long " * 30000 + "w1 w2 w3. " * 500
    docs = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "x" * 5000), (5, "y" * 9 + " ")], "doc_id long, text string")
    got = dict(line_dedup.drop_repeats(docs).collect())
    assert got[2] == "" and got[3] is None and got[4] == "x" * 5000
    assert got[1].split() == brute([(1, text)], line_dedup.MIN_WORDS)[1, text].split()
    assert line_dedup.drop_repeats(docs.limit(0)).count() == 0
    assert line_dedup.drop_repeats(docs.filter("doc_id > 3")).count() == 2


def test_a_run_whose_parts_stand_apart_before(spark):
    """The first places of a run's fingerprints lie apart, each in other words; the run's own earlier copy still counts."""
    rng = random.Random(8)
    lines = [prose(rng, 8) for _ in range(30)]
    first = "\n".join(x for line in lines for x in (prose(rng, 11), line))
    copy = "\n".join(lines)
    rows = [(1, first), (2, copy), (3, copy + "\n" + prose(rng, 12))]
    got = dict(line_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[1] == first and got[2] == copy
    assert got[3].split() == rows[2][1].split()[-12:]


def test_passages_inside_sentences_go_and_clean_documents_stay(spark):
    rng = random.Random(15)
    fresh = iter(range(10**6))
    own = lambda n: " ".join(f"own{next(fresh)}" for _ in range(n))
    rows, cases = [(1000 + i, prose(rng, 200)) for i in range(40)], []
    for i in range(60):
        words = [f"p{i}x{k}" for k in range(rng.randrange(51, 65))]
        words[rng.randrange(10, 40)] += "."
        cases.append(words)
        rows += [(2 * i, f"{own(9)} {' '.join(words)} {own(9)}. {own(20)}"), (2 * i + 1, f"{own(30)}. {own(5)} {' '.join(words)} {own(7)}")]
    got = dict(corpus_pipeline.line_deduplication(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect())
    texts = dict(rows)
    assert all(got[i] == texts[i] for i in texts if i >= 1000 or i % 2 == 0)
    for i, words in enumerate(cases):
        assert got[2 * i + 1].split() == [w for w in texts[2 * i + 1].split() if w not in words]


def test_hashes_tell_words_and_runs_apart():
    raw = b" a aa aaaaaaaa aaaaaaaaa aaaaaaaaaaaaaaaaa b \t\nab ba \xc3\xa9 " + b"z" * 300 + b" " + b"z" * 301
    starts, ends = line_dedup.word_places(raw)
    assert [raw[a:b] for a, b in zip(starts, ends, strict=True)] == raw.split()
    h = line_dedup.word_hashes(raw, starts, ends)
    assert len(set(h.tolist())) == len(raw.split())
    again = line_dedup.word_hashes(raw[2:], *line_dedup.word_places(raw[2:]))
    assert (again == h[1:]).all()
    words = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64)
    for n in (1, 2, 7, 8, 13):
        runs = line_dedup.run_hashes(words, n).tolist()
        said = [tuple(words[k : k + n].tolist()) for k in range(400 - n + 1)]
        assert len(runs) == len(said) and len(set(zip(runs, said, strict=True))) == len(set(runs)) == len(set(said))
        assert line_dedup.window_minima(words, n).tolist() == [min(words[k : k + n]) for k in range(400 - n + 1)]


def test_hot_keys_are_dealt_and_lose_no_row(spark, monkeypatch):
    from pyspark.sql import functions as F

    from orebody.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    left = spark.createDataFrame([(k % 7 if k < 300 else k, k) for k in range(400)], "key long, x long")
    right = common.materialize(left.groupBy("key").agg(F.min("x").alias("least"), F.count("*").alias("n")).filter("key <> 399"), "right")
    got = common.lookup(left, right, "key", ["x"])
    assert got.columns == ["key", "x", "least"]
    assert sorted(map(tuple, got.collect())) == sorted((k, x, k) for k, x in left.collect() if k != 399)

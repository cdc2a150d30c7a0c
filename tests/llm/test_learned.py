import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orebody.llm import linear, ngram_join, packing, quality, toxicity
from tests.llm.fixtures import SCHEMA, documents
from tests.llm.test_operators import brute_components

SYLLABLES = ["ka", "lo", "mi", "ren", "tas", "u", "vel", "zon", "pra", "shi", "dor", "en"]


def prose(rng, n):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    for i in range(6, n, 9):
        words[i] += "."
    return " ".join(words)


@pytest.fixture(scope="module")
def toxic_tables(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        text, bad = prose(rng, rng.randrange(10, 120)), i % 5 == 0
        if bad:
            words = text.split()
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["grubnik", "Fletwort", "snarfo" + rng.choice(SYLLABLES)]))
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, 1, int(bad)))
    rows += [(2000, None), (2001, ""), (2002, rows[5][1]), (None, "no id")]
    labels += [(5, 1, 1), (99999, 1, 1), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(toxic_tables):
    docs, labels = toxic_tables
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    field = toxicity.train(docs, labels, held)
    got = {r.doc_id: r for r in toxicity.tag(docs, field).collect()}
    assert len(got) == docs.count()
    out = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i].score >= 0.7) == (i % 5 == 0) for i in out)
    assert right / len(out) > 0.97
    assert all((r.score >= 0.7) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got.values())
    assert got[2000].score == got[2001].score < 0.1 and got[2002].score == got[5].score
    texts = dict(docs.collect())
    for i in range(0, 900, 5):
        for s in got[i].spans if got[i].predicted else []:
            assert any(w in texts[i][s.start : s.end].lower() for w in ("grubnik", "fletwort", "snarfo"))


def test_toxicity_without_labels(spark, toxic_tables):
    docs, labels = toxic_tables
    field = toxicity.train(docs, labels.filter("toxic = 0"))
    assert field is None and {r.score for r in toxicity.tag(docs, field).collect()} == {0.0}


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    moves = rng.normal(size=(2, 2))
    e = rng.normal(size=13)
    stop = np.zeros(13, bool)
    stop[[0, 4, 5, 12]] = True
    got, pairs = toxicity.marginals(e, stop, moves)
    want, told = np.zeros(13), np.zeros((2, 2))
    for a, b in ((1, 4), (6, 12)):
        n, total, one, two = b - a, 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(e[a + k] for k in range(n) if y[k]) + sum(moves[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            one += w * np.array(y)
            for k in range(n - 1):
                two[y[k], y[k + 1]] += w
        want[a:b] = one / total
        told += two / total
    assert np.allclose(got[~stop], want[~stop]) and np.allclose(pairs, told)


def test_long_chains_are_whole_but_for_fitting():
    stop = np.zeros(300, bool)
    assert [x.tolist() for x in toxicity.chains(stop)] == [[0], [300]]
    assert [x.tolist() for x in toxicity.chains(stop, 128)] == [[0, 128, 256], [128, 128, 44]]
    rng = np.random.default_rng(2)
    e, moves = rng.normal(size=300), rng.normal(size=(2, 2))
    other = e.copy()
    other[127] += 5  # a cut at 128 would hide it from the words behind
    a, b = toxicity.marginals(e, stop, moves)[0], toxicity.marginals(other, stop, moves)[0]
    assert abs(a[128] - b[128]) > 1e-3


def test_spans_are_of_the_places_that_passed(spark):
    text = "Bad one here. x Y. bad two, BAD bad. \u0130\u2126 don't bad\nbad"
    words = [w for w in toxicity.words_of(text) if w != toxicity.STOP]
    assert words.count(b"bad") == 6
    for k in range(len(words)):
        ((a, b),) = toxicity.spans_of(text, {k})
        assert text[a:b].lower().encode() == words[k]
    assert [text[a:b] for a, b in toxicity.spans_of(text, {0, 7, 8})] == ["Bad", "BAD bad"]
    # one form, toxic behind "go" only: the moves decide
    field = toxicity.Field({b"=go": 6.0, b"=bad": 2.0}, -3.0, np.array([[2.0, -2.0], [-1.0, 3.0]]), np.array([3.0, 1.0, 0.0]))
    docs = spark.createDataFrame([(1, "bad x y. go bad"), (2, ""), (3, None), (None, "bad " * 5000)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.tag(docs, field).collect()}
    assert [(s.start, s.end) for s in got[1].spans] == [(9, 15)]
    assert got[2].spans == got[3].spans == [] and len(got) == 4
    assert toxicity.tag(docs.limit(0), field).count() == 0


@pytest.fixture(scope="module")
def quality_tables(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        text, junk = prose(rng, rng.randrange(30, 150)), i % 4 == 0
        if junk:
            text = text.upper().replace(" ", "!! ") if i % 8 else " ".join(w + "***" for w in text.split())
        rows.append((i, text, "en", f"src{i % 7}", len(text), "s", "b", "k"))
        if i % 3:
            labels.append((i, int(not junk), 0))
    rows += [(700, None, None, None, None, None, None, None), (701, "", "en", "src1", 0, "", "", ""), (None, prose(rng, 50), "en", "src1", 300, "", "", "")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_unlabelled_rows(quality_tables):
    docs, labels = quality_tables
    got = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    assert len(got) == docs.count()
    out = [i for i in range(600) if i % 3 == 0]
    assert sum(got[i].keep == bool(i % 4) for i in out) / len(out) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    before = {(r.doc_id, r.text) for r in docs.collect()}
    rows = kept.collect()
    assert {(r.doc_id, r.text) for r in rows} <= before and {r.doc_id for r in rows} == {i for i, r in got.items() if r.keep}


def test_quality_of_repeated_ids_does_not_depend_on_their_order(spark, quality_tables):
    docs, labels = quality_tables
    more = docs.unionByName(docs.filter("doc_id % 5 = 0").withColumn("text", F.concat("text", F.lit(" !!! *** more"))))
    one, two = (sorted((str(r.doc_id), r.score) for r in quality.scores(more.repartition(n), labels).collect()) for n in (3, 7))
    assert [a for a, _ in one] == [a for a, _ in two] and np.allclose([x for _, x in one], [x for _, x in two])


def test_text_view_of_a_batch_is_that_of_each_text():
    texts = [b"", b"one Two two\nthree", b"  ", "n\u00e9 ONE".encode(), b"x" * 400 + b" y"]
    assert np.allclose(quality.text_view(texts), np.concatenate([quality.text_view([t]) for t in texts]))
    assert quality.text_view([]).shape == (0, quality.SHAPES + quality.WORD_SLOTS)
    assert np.isclose((quality.text_view(texts[1:2])[0, quality.SHAPES :] ** 2).sum(), 1)


def test_quality_without_labels(quality_tables):
    docs, labels = quality_tables
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_co_training_uses_the_pool():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 60).astype(float)
    make = lambda t: (t[:, None] * 2 - 1 + rng.normal(size=(len(t), 2)), t[:, None] * 2 - 1 + rng.normal(size=(len(t), 2)))
    xt, xm = make(y)
    hidden = rng.integers(0, 2, 500).astype(float)
    pt, pm = make(hidden)
    model = quality.co_train(xt, xm, y, pt, pm)
    a, b, both = model.score(pt, pm)
    acc = lambda s: ((s >= 0.5) == hidden).mean()
    assert acc(both) > 0.93 and acc(both) >= max(acc(a), acc(b)) - 0.02


def test_logistic_regression_meets_its_gradient():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=200) > 0).astype(float)
    w = linear.fit(x, y, l2=0.5)
    g = np.column_stack([x, np.ones(200)]).T @ (linear.predict(x, w) - y) + np.array([0.5, 0.5, 0.5, 1e-3]) * w
    assert np.abs(g).max() < 1e-4


# -- pipeline -------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rng = random.Random(20)
    passage = " ".join(f"bench{k}" for k in range(30))
    rows = []
    for i in range(300):
        text = prose(rng, rng.randrange(60, 160))
        if i % 6 == 0:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text, "en", f"src{i % 5}", len(text)))
    base = rows[1][1].split()
    for i in range(300, 306):
        words = list(base)
        words[i % len(words)] = "changed"
        rows.append((i, " ".join(words), "en", "src1", 1))
    rows.append((310, rows[2][1] + " " + passage, "en", "src2", 1))
    rows.append((311, prose(rng, 50) + " " + passage + " " + prose(rng, 30), "en", "src2", 1))
    rows += [(320, None, None, None, None), (None, prose(rng, 40), "en", "src0", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == before.columns
        seen[name] = docs.collect()
    left = {r.doc_id for r in seen["quality_classifier"]}
    assert {i for i in range(300) if i % 6} <= left and sum(i % 6 == 0 for i in left if i is not None and i < 300) <= 3
    texts = [(r.doc_id, r.text) for r in seen["line_deduplication"]]
    want, _ = brute_components([t for t in texts if t[0] is not None], 5, 80)
    assert {r.doc_id for r in seen["near_duplicates"]} - {None} == set(want.values())
    assert not any("bench3 bench4" in (r.text or "") for r in seen["benchmark_decontamination"])
    total = corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0]
    assert total == sum(r.length for r in seen["packing"]) == sum(r.length for r in packing.pack(spark.createDataFrame([(r.doc_id, r.text) for r in seen["benchmark_decontamination"]], "doc_id long, text string")).collect())


def test_stages_take_empty_and_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame(documents(), SCHEMA)
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            n = out.count()
            if name not in ("packing", "near_duplicates"):
                assert n == rows.count() and out.columns == rows.columns
    assert ngram_join.keep_one(docs.limit(0)).count() == 0

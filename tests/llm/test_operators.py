import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebody.llm import audio, chat, decontaminate, huffman, ngram_join, packing, shuffle
from orebody.llm.common import materialize
from orebody.llm.tokens import default_vocabulary
from tests.llm.fixtures import SCHEMA, documents


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def plain_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(docs, plain_ids):
    blocks, lengths = huffman.write_token_files(docs, block_tokens=3000)
    got = huffman.read_token_files(blocks, lengths).orderBy("start").collect()
    assert Counter((r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == Counter((i, crc(plain_ids(t)), len(plain_ids(t))) for i, t, *_ in documents())
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((i is not None, i or 0) for i, *_ in documents())
    start = 0
    for r in got:
        assert r.start == start and crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32
        start += r.n_tokens


def test_token_files_of_rows_without_ids(spark, plain_ids):
    rows = [(None, f"text {i}") for i in range(40)] + [(5, "five")] * 30
    got = huffman.read_token_files(*huffman.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), block_tokens=50)).collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((i, crc(plain_ids(t))) for i, t in rows)


@pytest.mark.parametrize("n,limit", [(1, 4), (2, 4), (16, 4), (300, 9), (300, 20)])
def test_code_lengths_are_optimal_and_limited(n, limit):
    rng = random.Random(n)
    counts = np.array([int(rng.paretovariate(0.4)) % 10**9 + 1 for _ in range(n)] + [0, 0])
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max() <= limit and (lengths[-2:] == 0).all()
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    if limit == 20 and n > 1:  # far from the limit: plain Huffman cost
        import heapq

        heap, cost = [int(c) for c in counts if c], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            cost += s
            heapq.heappush(heap, s)
        assert lengths.max() < limit and int((lengths * counts).sum()) == cost
    ids = np.array(rng.choices(range(n), k=1000))
    block = huffman.encode_block([5], np.array([1000]), ids, lengths, huffman.canonical_codes(lengths), 64)
    assert (huffman.decode_block(block, huffman.decode_tables(lengths))[2] == ids).all()


def test_empty_tables(empty, spark):
    assert huffman.read_token_files(*huffman.write_token_files(empty)).count() == 0
    assert packing.pack(empty).count() == 0
    assert shuffle.digests(empty).count() == 0
    assert audio.digests(empty).count() == 0
    assert ngram_join.components(empty).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(empty, none).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_chats(turns)).count() == 0


def test_packing_covers_every_id_once(docs, plain_ids):
    window = 64
    pieces = packing.pack(docs, window=window, group_tokens=2000).collect()
    want = Counter(tuple(plain_ids(t)) for i, t, *_ in documents())
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert crc(np.frombuffer(p.ids, "<u4")) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_seq[p.sequence_id].append(p)
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    order = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    got, run = Counter(), []
    for p in order:
        assert p.start == len(run)
        run += np.frombuffer(p.ids, "<u4").tolist()
        if len(run) == p.doc_tokens:
            got[tuple(run)] += 1
            run = []
    assert got == want and not run


def test_cut_windows_is_optimal():
    rng = random.Random(1)
    for _ in range(60):
        ends = sorted(rng.sample(range(1, 60), rng.randrange(2, 12)))
        window = max(b - a for a, b in zip([0, *ends], ends)) + rng.randrange(12)
        pens = [rng.choice([0, 3, 9]) for _ in ends]
        best = {0: 0}
        for j, e in enumerate(ends):
            best[e] = min(best[a] + window - (e - a) + pens[j] for a in [0, *ends[:j]] if e - a <= window)
        cuts = packing.cut_windows(ends, pens, window)
        cost = sum(window - (b - a) + pens[ends.index(b)] for a, b in zip([0, *cuts], cuts))
        assert cost == best[ends[-1]] and cuts[-1] == ends[-1]


def test_shuffle_is_a_balanced_permutation(docs):
    kept = shuffle.shuffled(docs, shards=5, bucket_bytes=4000)
    assert kept.columns == [*(c for c in docs.columns if c != "shard"), "shard", "slot"]
    rows = kept.collect()
    assert Counter((r.doc_id, r.text, r.keys) for r in rows) == Counter((i, t, "k") for i, t, *_ in documents())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[k]) for k in range(5)]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(sizes) - min(sizes) <= 1


def test_shuffle_of_repeated_rows_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(shuffle, "MIN_SPLIT", 50)
    rows = [(7, "same", k, k) for k in range(900)] + [(k, f"t{k}", k, k) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int, part int").repartition(3)
    out = shuffle.shuffled(docs, shards=7, bucket_bytes=900)
    assert out.columns == ["doc_id", "text", "bucket", "part", "shard", "slot"]
    got = out.withColumn("task", F.spark_partition_id()).collect()
    assert Counter((r.doc_id, r.text, r.bucket, r.part) for r in got) == Counter(rows)
    assert Counter(r.shard for r in got).most_common()[0][1] - Counter(r.shard for r in got).most_common()[-1][1] <= 1
    assert Counter(r.task for r in got if r.text == "same").most_common(1)[0][1] < 600
    few = shuffle.digests(docs.limit(3), shards=16).collect()
    assert sorted(r.shard for r in few) == [0, 1, 2] and all(r.slot == 0 for r in few)


def test_packing_leaves_little_padding_whatever_the_settings(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["a", "bc", "de."]) for _ in range(300))) for i in range(400)], "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        pieces = packing.pack(docs, window=512, group_tokens=60_000).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ids = sum(p.length for p in pieces)
    assert 1 - ids / (512 * len({p.sequence_id for p in pieces})) < 0.02


def test_shuffle_digests(docs):
    got = shuffle.digests(docs, shards=5).collect()
    rows = documents()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(5)]
    assert max(sizes) - min(sizes) <= 1
    again = {(r.doc_id, r.shard, r.slot) for r in shuffle.digests(docs.repartition(9), shards=5).collect() if r.doc_id != 7}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got if r.doc_id != 7}


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(shuffle.fisher_yates(3, (s, 1))) for s in range(6000))
    assert len(seen) == 6 and all(abs(n - 1000) < 150 for n in seen.values())


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    vocab = list("abcdefg")
    for trial in range(6):
        items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 7, 8, 9, 15, 30]) if trial else 12))) for i in range(6)]
        items = [(i, t) for i, t in items if len(t.split()) != 1] + [(50, items[2][1]), (51, "Ab, c")]
        texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(60))) for _ in range(30)]
        texts += [f"x {t} y" for _, t in items] + [items[0][1] + "!" + items[1][1].upper()]
        auto = decontaminate.ItemAutomaton([(str(i), t.encode()) for i, t in items])
        for text in texts:
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
            hit, found = [False] * len(words), set()
            for i, t in items:
                own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
                size = min(8, len(own))
                for a in range(len(own) - size + 1 if own else 0):
                    for b in range(len(words) - size + 1):
                        if words[b : b + size] == own[a : a + size]:
                            hit[b : b + size] = [True] * size
                            found.add(str(i))
            mask, got = auto.scan(decontaminate.words_of(text.encode()))
            assert mask.tolist() == hit and {auto.names[k] for k in got} == found


def test_decontamination_report_and_removal(spark, docs):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, passage), (2, passage + " lambda"), (3, None), (4, "!!")], "item_id long, text string")
    rows = spark.createDataFrame([(1, f"keep this, {passage.upper()} and this too, with the rest of the words that are here"), (2, passage), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(rows, bench).collect()}
    assert got[1].n_hit == 10 and got[1].n_items == 2 and got[1].contaminated
    assert got[1].items_sha256 == hashlib.sha256(b"1,2").hexdigest()
    assert (got[3].n_words, got[3].n_items, got[3].contaminated) == (0, 0, False)
    left = {r.doc_id: r.text for r in decontaminate.remove(rows, bench).collect()}
    assert left == {1: "keep this,  and this too, with the rest of the words that are here", 3: None, 4: ""}
    for few in (1, 12):
        assert {r.doc_id: r for r in decontaminate.report(rows, bench, group_words=few).collect()} == got
        assert {r.doc_id: r.text for r in decontaminate.remove(rows, bench, group_words=few).collect()} == left
    counted = rows.withColumns({"n_chars": F.length("text").cast("long"), "spans": F.lit("s"), "key": F.lit(1)})
    for few in (1, decontaminate.GROUP_WORDS):
        out = decontaminate.remove(counted, bench, group_words=few)
        assert out.columns == counted.columns and all(r.n_chars == (None if r.text is None else len(r.text)) and (r.spans, r.key) == ("s", 1) for r in out.collect())
    assert decontaminate.report(rows.limit(0), bench, group_words=1).count() == decontaminate.remove(rows.limit(0), bench).count() == 0
    same = decontaminate.remove(docs, bench)
    assert same.columns == docs.columns and same.count() == docs.count()


def test_audio_is_lossless(docs):
    stored = audio.convert(docs)
    got = stored.collect()
    want = Counter()
    for i, t, *_ in documents():
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 if raw else 64)
        want[(i, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    for r in got:
        low = np.frombuffer(r.pcm, "<i2")
        assert r.feature == audio.feature(low, r.feature.split()[0]) and r.rate == audio.OUT_RATE
    texts = {i: t for i, t, *_ in documents() if i is not None}
    for r in got[:20]:
        raw = (texts.get(r.doc_id) or "").encode()
        if r.doc_id is not None and r.feature.startswith("mulaw"):
            pad = np.frombuffer(raw + bytes(-len(raw) % 64 if raw else 64), np.uint8)
            pcm = audio.mulaw_table()[pad].astype(int)
            assert np.frombuffer(r.pcm, "<i2").tolist() == ((pcm[0::2] + pcm[1::2]) >> 1).tolist()


def test_audio_files_go_with_their_samples(spark, monkeypatch):
    """All files of the first table never stand beside all of the second; every row is in the result once."""
    rows = spark.createDataFrame([(i, f"text {i % 40} " * 30) for i in range(120)], "doc_id long, text string").repartition(6)
    paths, held = [], []

    def kept(df, tag, **options):
        out = materialize(df, tag, **options)
        paths.append((tag, Path(out._orebody_path.removeprefix("file:"))))
        held.append(Counter(name for name, p in paths for _ in p.rglob("*.parquet")))
        return out

    monkeypatch.setattr(audio, "materialize", kept)
    got = audio.convert(rows).collect()
    assert sorted(r.doc_id for r in got) == list(range(120)) and held[0]["media"] == 6
    assert [(h["media"], h["pcm"] > 0) for h in held[1:]] == [(6, True), (4, True), (2, True)]
    assert not any(p.exists() for name, p in paths if name == "media")


def test_audio_tables_and_adpcm():
    mu, a = audio.mulaw_table().astype(int), audio.alaw_table().astype(int)
    assert mu[0] == -32124 and mu[0x80] == 32124 and mu[0xFF] == 0 and mu[0x7F] == 0
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (7, 64), dtype=np.uint8)
    for block, got in zip(blocks, audio.decode_adpcm(blocks), strict=True):
        value, index = int(block[:2].view("<i2")[0]), min(int(block[2]), 88)
        want = [value]
        for byte in block[4:].tolist():
            for n in (byte & 15, byte >> 4):
                step = int(audio.STEPS[index])
                diff = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
                value = max(-32768, min(32767, value - diff if n & 8 else value + diff))
                index = max(0, min(88, index + int(audio.MOVES[n])))
                want.append(value)
        assert got.tolist() == want


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\b <s>\\</s> \\\\", "<<s>> [[INST]] <<SYS>>\n<</SYS>>", None, "", "<\\s> <<ROLE>>x<</ROLE>><</TURN>>", "é\U0001f600\\"]
    rng = random.Random(2)
    turns = [(c, t, rng.choice(["user", "assistant", "system", "tool<<SYS>>", None]), rng.choice(nasty), "x", "y") for c in range(40) for t in range(rng.randrange(1, 7))]
    turns += [(100, 0, "system", "s", "", ""), (100, 1, "user", "q", "", ""), (100, 2, "assistant", "r", "", ""), (None, 0, "user", "n", "", "")]
    rng.shuffle(turns)
    segments = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, loss string, state string"))
    got = {r.conv_id: r for r in chat.digests(segments).collect()}
    by = defaultdict(list)
    for c, t, role, text, *_ in turns:
        by[c].append((t, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, own in by.items():
        own.sort()
        learned = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(own), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert got[100].valid and got[None].valid
    pattern = chat.escaper(chat.CHAT)
    for text in [x for x in nasty if x]:
        assert chat.unescape(chat.escape(text, pattern)) == text
        assert not any(control in chat.escape(text, pattern) for control in chat.CHAT.controls())


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) if t else []
        s = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    ids = list(sets)
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b] if x and y):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}, sets


@pytest.mark.parametrize("k,percent,postings,key_sets", [(3, 90, 4_000_000, 20_000), (5, 80, 1500, 3), (1, 80, 4_000_000, 20_000)])
def test_join_against_brute_force(docs, k, percent, postings, key_sets, monkeypatch):
    monkeypatch.setattr(ngram_join, "KEY_SETS", key_sets)
    rows = [(i, t) for i, t, *_ in documents() if i is not None and i != 904]
    want, sets = brute_components(rows, k, percent)
    got = ngram_join.components(docs.filter("doc_id is not null and doc_id <> 904"), k, percent, postings).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want[r.doc_id], r
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


@pytest.mark.parametrize("key_sets,broadcast", [(4_000, 2_000_000), (4_000, 0), (3, 0)])
def test_join_in_slices(docs, key_sets, broadcast, monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE_SHINGLES", 500)
    monkeypatch.setattr(ngram_join, "KEY_SETS", key_sets)
    monkeypatch.setattr(ngram_join, "BROADCAST_KEYS", broadcast)
    rows = [(i, t) for i, t, *_ in documents() if i is not None and i != 904]
    want, _ = brute_components(rows, 5, 80)
    got = ngram_join.components(docs.filter("doc_id is not null and doc_id <> 904"), 5, 80).collect()
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] for r in got)


def test_join_writes_keys_once(spark, monkeypatch):
    """Intermediates never hold the sets' keys twice, nor at all in the end, and a slice is a small part of them."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(200)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:20])], "doc_id long, text string").repartition(2)
    written, held, parts = {}, [], []

    def kept(df, tag):
        out = materialize(df, tag)
        written[out._orebody_path] = sum(p.stat().st_size for p in Path(out._orebody_path.removeprefix("file:")).rglob("*.parquet"))
        held.append(sum(n for p, n in written.items() if Path(p.removeprefix("file:")).exists()))
        parts.append(tag)
        return out

    monkeypatch.setattr(ngram_join, "materialize", kept)
    monkeypatch.setattr(ngram_join, "SLICE_SHINGLES", 10_000, raising=False)
    assert ngram_join.components(rows, 5, 80).filter("component_id <> doc_id").count() == 20
    assert max(held) < 1.5 * held[0] and held[-1] < 0.2 * held[0]
    assert parts.count("keys") == 7


def test_join_keys_lose_no_link():
    """Random pairs at the threshold share a key, whatever their sizes."""
    rng = random.Random(9)
    for percent in (80, 90):
        tops = ngram_join.size_classes(percent, 4000)
        for _ in range(400):
            n = rng.choice([1, 5, 9, 10, 11, 20, 60, 300, 900])
            common = [rng.getrandbits(64) for _ in range(n)]
            d = int(n * (100 / percent - 1))
            left = rng.randrange(d + 1)
            a = np.unique(np.array(common + [rng.getrandbits(64) for _ in range(left)], dtype=np.uint64))
            b = np.unique(np.array(common + [rng.getrandbits(64) for _ in range(d - left)], dtype=np.uint64))
            if len(a) == len(b) and (a == b).all():
                continue
            assert set(ngram_join.block_keys(a, percent, tops).tolist()) & set(ngram_join.block_keys(b, percent, tops).tolist()), (n, d, left)


def test_leaders_connect_all_near_sketches():
    rng = np.random.default_rng(2)
    for trial in range(20):
        base = rng.integers(0, 2, (4, 512))
        bits = np.array([b ^ (rng.random(512) < rng.choice([0, 0.01, 0.03])) for b in base[rng.integers(0, 4, 60)]])
        marks = np.packbits(bits, axis=1).view(np.uint64)
        ids, d = np.arange(100, 160), 12
        edges, leaders = ngram_join.near_leaders(ids, marks, d, 2 * d)
        root = list(range(60))

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[top(a - 100)] = top(b - 100)
        gap = (bits[:, None] ^ bits[None]).sum(axis=2)
        assert all(top(i) == top(j) for i, j in zip(*np.nonzero(gap <= d), strict=True))
        assert (gap[:, leaders].min(axis=1) <= d).all()


@pytest.mark.parametrize("size,largest,marks", [(90, 90, [0, 20, 80]), (45, 90, [0, 60])])
def test_leaders_of_dealt_groups_meet(spark, size, largest, marks):
    """Leaders three bounds apart are joined, though the first of them is near a third, and by the bound of the key's largest set."""
    sketch = lambda n: np.packbits(np.arange(512) < n, bitorder="little").tobytes()
    rows = [(1, 0, i, size, bytearray(sketch(n)), largest) for i, n in enumerate(marks)]
    table = spark.createDataFrame(rows, "of long, deal long, rep long, n_shingles long, sketch binary, largest long")
    edges = {(r.rep, r.other) for r in ngram_join.group_edges(table, 80, 3).collect()}
    last = len(marks) - 1
    assert edges & {(last - 1, last), (last, last - 1)}


def test_keep_one(docs):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    want, _ = brute_components([(i, t) for i, t, *_ in documents() if i is not None], 5, 80)
    assert set(ids) - {None} == set(want.values()) and ids.count(7) == 3 and ids.count(None) == 1


def test_encoder_of_many_words_equals_the_tokenizer():
    from tokenizers import Tokenizer

    from orebody.llm import tokens

    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCZäöüßéñÉāį"
    texts = [None, "", " \n ", "a", "ª º", "<|endoftext|> x", "İstanbul ı ﬁ", "x" * 5000]
    texts += [" ".join("".join(rng.choices(letters, k=rng.randint(1, 14))) + rng.choice(["", "", ".", "###", "'s", "7"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    path = tokens.default_vocabulary()
    plain, own, single = Tokenizer.from_file(path), *(tokens.TextEncoder(path, cache_pieces=50) for _ in range(2))
    wanted = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.direct
    assert own.encode(texts) == wanted
    single.last[:] = False  # no piece ends a word: words go one by one
    assert single.encode(texts) == wanted


def test_join_chains_are_no_block(spark, monkeypatch):
    """Sets that share keys and differ by more than a link allows stay apart, so chains of them make no growing block."""
    rng = random.Random(5)
    words = [f"w{rng.getrandbits(40)}" for _ in range(2300)]
    rows = spark.createDataFrame([(i, " ".join(words[50 * i : 50 * i + 300])) for i in range(40)], "doc_id long, text string")
    blocks = []

    def kept(df, tag):
        out = materialize(df, tag)
        if tag == "cand":
            blocks.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", kept)
    assert ngram_join.components(rows, 5, 80).filter("component_id <> doc_id").count() == 0
    assert blocks and blocks[0] <= 4


def test_join_deals_blocks_in_waves(spark, monkeypatch):
    """Parts of large blocks are shuffled wave after wave, with the same result."""
    rng, links = random.Random(8), []
    texts = [[f"w{rng.getrandbits(40)}" for _ in range(300)] for _ in range(4)]
    for i in range(1, 6):
        texts.append([f"edit{i}" if n % 50 == 7 and n < 50 * i else w for n, w in enumerate(texts[0])])
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")

    def kept(df, tag):
        links.extend([tag] if tag == "links" else [])
        return materialize(df, tag)

    monkeypatch.setattr(ngram_join, "materialize", kept)
    monkeypatch.setattr(ngram_join, "WAVE_SHINGLES", 2000, raising=False)
    got = {r.doc_id: r.component_id for r in ngram_join.components(rows, 5, 80, 500).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3} | dict.fromkeys(range(4, 9), 0)
    assert len(links) > 1

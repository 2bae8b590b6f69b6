"""Token counts, packing, chat formatting, sharding, quality."""

import platform
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from speechframe.llm import chat_format, common, packing, quality, sharding, token_counts

from . import cases

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


ODD = st.lists(st.sampled_from(["a", "b", " ", "  ", "'s", "'", "ll", "é", "1", "٣", "!!", "\n", "<|endoftext|>", "<|", "日本", "the", "\t", "\xa0", "=====", "aaaaaaa", " the", "\x1c", "İ", "Σ", "ſ", "\u0301"]), max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_counts_like_the_library(libraries, text):
    counter = byte_counter()
    want = len(libraries[0].encode(text, add_special_tokens=False).ids)
    assert counter([text, "", text + text[:3]])[:2] == [want, 0]
    whole = token_counts.CHUNK, token_counts.LOOK_BACK
    try:
        for token_counts.CHUNK, token_counts.LOOK_BACK in ((5, 64), (3, 1), (7, 0)):
            assert counter([text]) == [want]
    finally:
        token_counts.CHUNK, token_counts.LOOK_BACK = whole


def byte_counter():
    if 0 not in COUNTER:
        COUNTER[0] = token_counts.Counter(BYTES)
    return COUNTER[0]


COUNTER: dict = {}


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_ids_like_the_library(libraries, text):
    encode = COUNTER.setdefault(1, packing.WordTokenizer(WORDS))
    assert encode([text])[0] == np.array(libraries[1].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("text", ["one two three x y     !! four's z", "averylongwordwithoutanyspaceinit" * 4, "日本語の長い文章です" * 9])
def test_maps_compose_in_any_grouping(libraries, monkeypatch, text):
    monkeypatch.setattr(token_counts, "CHUNK", 6)
    monkeypatch.setattr(token_counts, "LOOK_BACK", 3)
    c = byte_counter()
    maps, _, chunks = c.maps([text])
    join = lambda a, b: (c.compose(a[0], b[0], c.over(chunks, b[1], b[2])), a[1], b[2])
    each = [(m, k, k) for k, m in enumerate(maps)]
    left = each[0]
    for m in each[1:]:
        left = join(left, m)
    right = each[-1]
    for m in reversed(each[:-1]):
        right = join(m, right)
    half = len(each) // 2
    first, second = each[0], each[half]
    for m in each[1:half]:
        first = join(first, m)
    for m in each[half + 1 :]:
        second = join(second, m)
    assert left[0][None] == right[0][None] == join(first, second)[0][None]
    assert left[0][None][1] == len(libraries[0].encode(text).ids)


def test_words_start_where_the_split_says():
    import regex

    rng, split = random.Random(8), regex.compile(token_counts.SPLIT)
    kinds = token_counts.character_kinds()
    marks = ["'", "s", "r", "e", "l", "v", "a", "É", "1", "٣", " ", "  ", "\n", "\t", "\xa0", "!", "-", "\u0301", "日", "\x1c", "\x85", "\u2028"]
    for _ in range(3000):
        text = "".join(rng.choices(marks, k=rng.randint(1, 14)))
        points = np.array([0x110000, *map(ord, text), 0x110000], np.uint32)
        got = np.flatnonzero(token_counts.word_starts(points, kinds)[1:-1]).tolist()
        assert got == [m.start() for m in split.finditer(text)], text


def test_states_are_dropped_when_too_many(libraries, monkeypatch):
    monkeypatch.setattr(token_counts, "_MAX_STATES", 50)
    monkeypatch.setattr(token_counts, "_MAX_PAIRS", 50)
    monkeypatch.setattr(token_counts, "_WIDTH", 20)
    c = token_counts.Counter(BYTES)
    texts = [cases.prose(random.Random(k), 200) for k in range(5)] + ["日本語 été"] * 2
    assert c(texts) == [len(libraries[0].encode(t).ids) for t in texts] == c(texts)


def test_token_counts(spark, libraries):
    rows = cases.odd_rows()
    got = token_counts.token_counts(cases.documents(spark, rows), BYTES).collect()
    want = Counter()
    for r in rows:
        n = len(libraries[0].encode(r[1] or "", add_special_tokens=False).ids)
        want[cases.least(r[0]), len((r[1] or "").encode()), n, n > 512] += 1
    assert Counter(tuple(r) for r in got) == want
    assert token_counts.token_counts(cases.documents(spark, []), BYTES).count() == 0


@pytest.mark.parametrize("block", [100_000, 7])
def test_packing(spark, libraries, block):
    rows = cases.odd_rows()
    got = packing.pack(packing.tokenised(cases.documents(spark, rows), WORDS, 64), 64, block=block).collect()
    want = Counter()
    for r in rows:
        ids = np.array([*libraries[1].encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[cases.least(r[0]), k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["d"], r["piece"], r["start"], r["length"], r["crc"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in got)
    assert len(bins) <= 1.02 * total / 64 + 2
    assert packing.pack(packing.tokenised(cases.documents(spark, []), WORDS)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(sizes):
    bins = packing.best_fit(np.array(sizes, int), 50)
    load = np.bincount(bins, sizes) if sizes else np.zeros(0)
    assert (load <= 50).all() and len(load) <= 11 / 9 * -(-sum(sizes) // 50) * 1.3 + 1


def test_chats(spark):
    rows = [(1, 1, "assistant", "a"), (1, 0, "user", "q </turn>\n### User: \\h \\b\\ ####"), (2, 0, "system", ""), (2, 1, "user", None), (2, 2, "assistant", "x<"), (2, 2, "assistant", "x<"), (3, 0, None, "t"), (3, None, "to:ol: ###", "u"), (None, 0, "user", "z"), (4, 0, "assistant", "</turn"), (4, 0, "User", ">")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    chats = chat_format.format_chats(turns).withColumn("back", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("segments")))
    got = {r["conv_id"]: r for r in chats.collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        own = sorted(((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == conv))
        assert [(x["role"], x["text"]) for x in r["back"]] == [x[1:] for x in own]
        assert r["loss"] == "".join(x[2] for x in own if x[1] == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"]) and r["formatted"].count("</turn>\n") == len(own)
    assert [got[k]["valid"] for k in (1, 2, 3, 4, None)] == [True, False, False, False, False]
    assert chat_format.format_chats(turns.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="\\#</turn>hlbc: \n", max_size=12), min_size=1, max_size=4))
def test_escapes_come_back(spark, texts):
    turns = spark.createDataFrame([(0, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    back = chat_format.format_chats(turns).select(chat_format.read_back(F.col("formatted")).alias("b")).first()["b"]
    assert [x["text"] for x in back] == texts


def least_capacity(sizes, shards):
    def needs(c):
        n, room = 1, c
        for s in sizes:
            if s > room:
                n, room = n + 1, c
            room -= s
        return n

    c = max([*sizes, -(-sum(sizes) // shards)])
    while needs(c) > shards:
        c += 1
    return c


def test_minimax_like_plain_search():
    rng = random.Random(5)
    for _ in range(200):
        hashes = sorted({rng.randrange(-(2**63), 2**63) for _ in range(rng.randint(1, 80))})
        sizes = [rng.choice([rng.randint(1, 30), rng.randint(1, 400)]) for _ in hashes]
        shards = rng.randint(1, 12)
        bits = 2

        def cells(bits, within=None, hashes=hashes, sizes=sizes):
            out = defaultdict(list)
            for h, s in zip(hashes, sizes, strict=True):
                if within is None or any(a <= h <= b for a, b, _ in within):
                    out[h >> (64 - bits)].append((h, s))
            return [(min(x)[0], max(x)[0], sum(s for _, s in x)) for x in out.values()]

        def zoom(open_):
            nonlocal bits
            bits = min(64, bits + 3)
            return cells(bits, open_)

        capacity, firsts = sharding.minimax(cells(bits), shards, zoom)
        assert capacity == least_capacity(sizes, shards)
        load = Counter()
        for h, s in zip(hashes, sizes, strict=True):
            load[sum(h >= f for f in firsts)] += s
        assert max(load.values()) <= capacity and len(firsts) < shards


def balanced(sizes, shards):
    """The least possible largest shard when groups over an equal share of the rest have shards of their own."""
    sizes, alone = list(sizes), []
    while len(alone) < shards - 1 and sizes and max(sizes) * (shards - len(alone)) > sum(sizes):
        alone.append(max(sizes))
        sizes.remove(max(sizes))
    return alone, sizes


def test_shards_are_even_beside_large_groups():
    rng = random.Random(6)
    for _ in range(200):
        shards = rng.randint(2, 24)
        groups = {rng.randrange(-(2**63), 2**63): rng.randint(1, 30) for _ in range(rng.randint(shards * 4, 600))}
        for _ in range(rng.randint(0, 2)):  # a text of a third of all rows, or more of them
            groups[rng.randrange(-(2**63), 2**63)] = sum(groups.values()) // 2
        at = defaultdict(list)
        for h, n in groups.items():
            at[h >> 52].append((h, n))
        cell = lambda x: (min(x)[0], max(x)[0], sum(n for _, n in x))

        def zoom(open_, groups=groups, cell=cell):
            out = []
            for a, b, _ in open_:
                parts = defaultdict(list)
                for h, n in groups.items():
                    if a <= h <= b:
                        parts[(h - a) // (((b - a) >> 8) + 1)].append((h, n))
                out += [cell(x) for x in parts.values()]
            return out

        alone, rest = sharding.large_groups([cell(x) for x in at.values()], shards, zoom)
        big, others = balanced(groups.values(), shards)
        assert [x[2] for x in alone] == big and sum(x[2] for x in rest) == sum(others)
        capacity, firsts = sharding.minimax(rest, shards - len(alone), zoom)
        left = sorted((h, n) for h, n in groups.items() if h not in {x[0] for x in alone})
        load = Counter({k: 0 for k in range(shards - len(alone))})
        for h, n in left:
            load[sum(h >= f for f in firsts)] += n
        share = sum(others) / len(load)
        assert capacity == least_capacity([n for _, n in left], len(load)) >= max(load.values())
        assert min(load.values()) >= share - max(others), (load, share)


def test_sharding(spark):
    rows = cases.odd_rows()
    got = sharding.shard_by_bytes(cases.documents(spark, rows), 4).collect()
    assert Counter((r["d"], r["size"], r["text_crc32"]) for r in got) == Counter((cases.least(r[0]), len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(4))
    shards = defaultdict(set)
    for r in got:
        shards[r["text_crc32"]].add(r["shard"])
    assert all(len(x) == 1 for x in shards.values())
    assert sharding.shard_by_bytes(cases.documents(spark, [])).count() == 0


def test_no_shard_is_empty_beside_a_hot_text(spark):
    rows = [(i, "the same text " * 20 if i % 3 == 0 else f"text {i} " * (2 + i % 5)) for i in range(1200)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    load, slots, hot = Counter(), defaultdict(list), set()
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        if r["d"] % 3 == 0:
            hot.add(r["shard"])
    assert set(load) == set(range(24)) and len(hot) == 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    rest = [load[k] for k in load if k not in hot]
    assert max(rest) - min(rest) < 150


def test_quality(spark, sf_dir):
    """Held-out accuracy, on the smallest tables with some hundred labels."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    train, held = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    got = quality.score(docs, quality.fit(docs, train)).select(F.col("d").alias("doc_id"), "score", "toxic_score", "accepted").join(held, "doc_id").collect()
    assert len(got) > 100 and np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in got]) > 0.95
    assert all(r["accepted"] == (r["score"] >= 0.5 and r["toxic_score"] < 0.5) for r in got)


def test_quality_finds_toxic_documents(spark, sf_dir):
    """Held out, on the largest tables, as few documents are toxic: most are found, hardly any other is taken for one."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    train, held = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    got = quality.score(docs, quality.fit(docs, train)).select(F.col("d").alias("doc_id"), "toxic_score").join(held, "doc_id").collect()
    found = {k: np.mean([r["toxic_score"] >= 0.5 for r in got if r["toxic"] == k]) for k in (0, 1)}
    assert found[1] > 0.8 and found[0] < 0.01


def test_beginnings_of_words():
    texts = [b"", b"Trashy trash", "réeux, ab".encode(), b"xx scum"]
    h, owner = quality.beginnings(texts)
    plain = [(i, w.lower()[:k]) for i, t in enumerate(texts) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", t) for k in (4, 6, 8) if len(w) >= k]
    assert sorted(owner.tolist()) == sorted(i for i, _ in plain)
    assert len(set(h.tolist())) == len({w for _, w in plain})
    telling = np.sort(np.unique(h[owner == 1]))
    assert quality.telling_features(texts, telling).sum(1).tolist() == [0, len(telling), 0, 0]
    assert quality.telling_features([], telling).shape == (0, len(telling)) and quality.telling_features(texts, telling[:0]).shape == (4, 0)


def test_quality_of_one_label_only(spark):
    """Either label may be missing, or hold one class: then its model doesn't judge."""
    docs = spark.createDataFrame([(i, f"word{i % 7} trash scum" if i % 5 == 0 else f"word{i % 7} good text") for i in range(200)], "doc_id long, text string")
    toxic = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, toxic)
    assert model.good is None and {r["d"] for r in quality.score(docs, model).where("not accepted").collect()} == set(range(0, 200, 5))
    assert quality.fit(docs, toxic.drop("toxic")) is None and quality.fit(docs, toxic.drop("quality")).toxic is not None


def test_quality_stands_odd_rows(spark):
    rows = cases.odd_rows()
    docs = cases.documents(spark, rows)
    labels = spark.createDataFrame([(r[0], i % 2, None) for i, r in enumerate(rows)] + [(None, None, 1), (12345, 1, 1)], "doc_id long, quality int, text string")
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    kept = quality.score(docs, model, keep=True)
    assert kept.columns == docs.columns and kept.count() == sum(r["accepted"] for r in scored)
    for none in (labels.limit(0), labels.withColumn("quality", F.lit(1))):
        assert quality.fit(docs, none) is None
        assert quality.score(docs, None, keep=True).count() == len(rows)
    empty = cases.documents(spark, [])
    assert quality.fit(empty, labels) is None and quality.score(empty, model).count() == 0
    assert quality.score(docs.select("doc_id", "text"), model).count() == len(rows)


def test_words_met_once_are_not_forgotten_early(libraries, monkeypatch):
    monkeypatch.setattr(packing, "_CACHE_BYTES", 16_000)  # room for a hundred strings of 10 to 20 bytes with their ids, by what they take
    encode = packing.WordTokenizer(WORDS)
    learnt, learn = [], encode.learn
    monkeypatch.setattr(encode, "learn", lambda strings: (learnt.append(len(strings)), learn(strings)))
    common = " ".join("word" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(70))
    texts = [common, "einmal\x7f é\x00 ça", common, "noch, eines.", common]
    got = [encode([t])[0] for t in texts]
    assert got == [np.array(libraries[1].encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert learnt == [70, 3, 2]


def test_quality_is_fitted_off_the_driver(spark, monkeypatch):
    """The driver, whose memory is small, gets the models alone: neither rows nor matrices."""

    def here(*_, **__):
        raise AssertionError("fitted in the driver's process")

    docs = spark.createDataFrame([(i, f"word{i % 7} trash scum" if i % 5 == 0 else f"word{i % 7} good text") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(200)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "co_train", here)
    monkeypatch.setattr(type(docs), "toArrow", here)
    model = quality.fit(docs, labels)
    assert {r["d"] for r in quality.score(docs, model).where("not accepted").collect()} == set(range(0, 200, 5))


def test_the_driver_gives_back_memory(spark, monkeypatch):
    """A table that is cut makes a driver whose heap has grown collect; what is freed outside the heap goes back too."""
    freed = []
    monkeypatch.setattr(common, "release", freed.append)
    for share, times in ((1.0, 0), (0.0, 1)):
        monkeypatch.setattr(common, "LARGE_HEAP", share)
        assert common.cut(spark.range(3), "some").count() == 3 and len(freed) == times
    assert common.trim(spark) or "glibc" not in platform.libc_ver()

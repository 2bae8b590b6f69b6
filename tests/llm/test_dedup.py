"""Exact and near dedup, components, decontamination."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from speechframe.llm import common as C
from speechframe.llm import components, decontamination, exact_dedup, near_dedup

from . import cases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact(spark):
    rows = cases.odd_rows()
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(UPPER)].append(cases.least(r[0]))
    got = exact_dedup.exact_groups(cases.documents(spark, rows), bucket_bytes=200).collect()
    want = Counter((i, max(ids), len(ids), cases.sha(t.encode())) for t, ids in groups.items() for i in ids)
    assert Counter((r["d"], r["keep"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups) and all(r["d"] == r["keep"] for r in got if r["kept"])
    docs = cases.documents(spark, rows)
    stays = exact_dedup.keep_exact(docs)
    assert stays.columns == docs.columns and Counter((r["text"] or "").translate(UPPER) for r in stays.collect()) == Counter(groups.keys())
    assert exact_dedup.exact_groups(cases.documents(spark, [])).count() == 0 == exact_dedup.keep_exact(cases.documents(spark, [])).count()


def test_exact_repeats_in_either_case(spark):
    docs = cases.documents(spark, [(1, t, *[None] * (len(cases.documents(spark, []).columns) - 2)) for t in ("Hello", "hello", "hello", None, "", "other")])
    assert sorted((r["text"] or "").lower() for r in exact_dedup.keep_exact(docs).collect()) == ["", "hello", "other"]
    assert near_dedup.keep_one(docs).count() == 3


def test_exact_pages_are_compared_as_bytes():
    """One hash for different texts, and pages of one text deflated in two ways."""
    import pyarrow as pa
    import zstandard

    page = lambda t, summed: zstandard.ZstdCompressor(level=1, write_checksum=summed).compress(t)
    text = b"some words " * 400 + bytes(range(256))
    assert page(text, True) != page(text, False)
    rows = [(7, 1, 1, 10, 1, page(text, True)), (7, 2, 2, 30, 2, page(text, False)), (7, 3, 1, 20, 3, page(b"other", True)), (8, 4, 1, 5, 4, page(text, True))]
    batch = pa.record_batch([pa.array(x) for x in zip(*rows, strict=True)], names=list(exact_dedup._OWNED))
    got = {r["entry"]: (r["keep"], r["size"], r["keep_row"]) for b in exact_dedup._own([batch]) for r in b.to_pylist()}
    assert got == {1: (30, 3, 2), 2: (30, 3, 2), 3: (20, 1, 3), 4: (5, 1, 4)}


def test_directory_splits_only_what_can_be_split():
    rng = random.Random(0)
    counts = {rng.getrandbits(10): rng.randint(1, 50) for _ in range(300)} | {5: 10_000}
    buckets = exact_dedup.directory(counts, 10, 100)
    assert sum(2 ** (10 - depth) for _, depth in buckets) == 1024
    for prefix, depth in buckets:
        n = sum(x for p, x in counts.items() if p >> (10 - depth) == prefix)
        assert n <= 100 or depth == 10


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=16), st.lists(st.integers(0, 4), max_size=16), st.integers(0, 17))
def test_banded_alignment(a, b, limit):
    assert near_dedup.banded_distance(a, b, limit) == min(levenshtein(a, b), limit + 1)


def numbered(words):
    import numpy as np

    return np.array([hash(x) for x in words], np.int64)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(0, 4), max_size=20), st.sampled_from([0.5, 0.8, 0.9]))
def test_similar_like_plain_distance(a, b, similarity):
    most = max(len(a), len(b))
    assert near_dedup.edit_similar(numbered(a), numbered(b), similarity) == (levenshtein(a, b) <= int((1 - similarity) * most + 1e-9))


def edited(rng, words, similarity, evenly):
    """A copy at just this similarity: words changed, each for a new one, evenly spread or at random places."""
    n = int((1 - similarity) * len(words) + 1e-9)
    at = [int((i + 1) * len(words) / n) - 1 for i in range(n)] if evenly else rng.sample(range(len(words)), n)
    out = list(words)
    for i in at:
        out[i] = f"new{rng.randint(0, 10**9)}"
    return out


def test_near_recall_on_planted_pairs(spark):
    """At least nine in ten of the pairs of each similarity from 0.8 on, for edits evenly spread and at random places."""
    rng, rows, kinds = random.Random(9), [], []
    for similarity in (0.8, 0.82, 0.85, 0.9, 0.95):
        for evenly in (True, False):
            for k in range(60):
                words = [f"w{rng.randint(0, 30_000)}" for _ in range((20, 40, 100, 300)[k % 4])]
                kinds.append((similarity, evenly))
                rows += [(2 * len(kinds), " ".join(words)), (2 * len(kinds) + 1, " ".join(edited(rng, words, similarity, evenly)))]
    got = {r["d"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d] in (d, d - d % 2) for d in got)
    found = defaultdict(list)
    for i, kind in enumerate(kinds, 1):
        found[kind].append(got[2 * i + 1] == 2 * i)
    assert min(sum(x) / len(x) for x in found.values()) >= 0.9, {k: sum(x) / len(x) for k, x in found.items()}


def near_classes_plainly(rows):
    import regex

    texts = [regex.findall(r"[a-z0-9\x80-\U0010ffff]+", (r[1] or "").lower()) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for j in range(i):
            b = texts[j]
            most = max(len(a), len(b))
            if min(len(a), len(b)) >= 0.8 * most and (a == b or (most and near_dedup.edit_similar(numbered(a), numbered(b), 0.8))):
                root[find(i)] = find(j)
    classes = defaultdict(list)
    for i, r in enumerate(rows):
        classes[find(i)].append(cases.least(r[0]))
    near_classes_plainly.classes = len(classes)
    return Counter((i, min(ids), len(ids)) for ids in classes.values() for i in ids)


def test_near_like_all_pairs(spark):
    rows = cases.odd_rows()
    got = near_dedup.near_classes(cases.documents(spark, rows)).collect()
    assert Counter((r["d"], r["class_id"], r["class_size"]) for r in got) == near_classes_plainly(rows)
    docs = cases.documents(spark, rows)
    stays = near_dedup.keep_one(docs)
    assert stays.columns == docs.columns and stays.count() == near_classes_plainly.classes == len({(r["class_id"], r["class_v"]) for r in got})
    assert near_dedup.near_classes(cases.documents(spark, [])).count() == 0


def test_near_short_texts_like_all_pairs(spark):
    rng = random.Random(3)
    texts = ["a b c d e", "a b c d e f", "a b x d e f", "k l m n", "k l m n o", "0 1 2 3 4 5 6 7 8 9", "0 1 2 3 x 5 6 7 8 9"]
    for n in [*range(1, 15)] * 3:
        texts.append(" ".join(f"t{len(texts)}w{rng.randint(0, 30)}" for _ in range(n)))
        for _ in range(2):
            w = texts[-1].split()
            for _ in range(rng.randint(1, 2)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randint(0, 1)] = [f"new{rng.randint(0, 9)}"] * rng.randint(0, 1)
            texts.append(" ".join(w[:14]))
    rows = [(i, t) for i, t in enumerate(texts)]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["d"], r["class_id"], r["class_size"]) for r in got) == near_classes_plainly(rows)


def test_near_recall_on_documents(spark, sf_dir):
    """Every pair of texts that all-pairs comparison links is in one class."""
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    got = near_dedup.near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert Counter((r["d"], r["class_id"], r["class_size"]) for r in got) == near_classes_plainly(rows)


def test_a_large_group_stays_one(spark):
    rng = random.Random(4)
    base = cases.prose(rng, 120).split()
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 99)}"
        rows.append((i, " ".join(w), *[None] * 9))
    got = near_dedup.near_classes(cases.documents(spark, rows)).collect()
    assert {(r["class_id"], r["class_size"]) for r in got} == {(0, 400)}
    assert sum(r["links"] for r in got) < 400 * 60  # no group's pairs


@pytest.mark.parametrize("dense", [1, 16, 10**6])
def test_a_large_bucket_loses_no_link(spark, monkeypatch, dense):
    """Texts that share one passage, and so their sketches, but are similar only in a few pairs far apart by length."""
    rng = random.Random(7)
    head = [f"h{i}" for i in range(40)]
    texts, rows = [], []
    for i in range(60):
        texts.append(head[:38] + [f"t{i}a{j}" for j in range(12 + i % 9)])
    for i in range(0, 60, 7):
        w = list(texts[i])
        w[-1:] = [f"z{i}", f"z{i}b"]
        texts.append(w)
    rng.shuffle(texts)
    rows = [(i, " ".join(w), *[None] * 9) for i, w in enumerate(texts)]
    monkeypatch.setattr(near_dedup, "BLOCK", 10)
    monkeypatch.setattr(near_dedup, "PAIRED", 3)
    monkeypatch.setattr(near_dedup, "DENSE", dense)
    got = near_dedup.near_classes(cases.documents(spark, rows)).collect()
    assert sum(r["links"] for r in got) < 2 * 8 * len(rows)
    assert Counter((r["d"], r["class_id"], r["class_size"]) for r in got) == near_classes_plainly(rows)


def test_word_bags_bound_the_distance():
    import numpy as np

    rng = random.Random(3)
    texts = [[f"w{rng.randint(0, 40)}" for _ in range(rng.randint(1, 40))] for _ in range(40)]
    bags = [near_dedup.word_bags(C.word_hashes([" ".join(t).encode()], C.PUNCT)[0]) for t in texts]
    _, flat = np.unique(np.concatenate(bags), return_inverse=True)
    first = np.cumsum([0, *map(len, bags)])
    for i, t in enumerate(texts):
        got = near_dedup.least_distances(flat[first[i] : first[i + 1]], flat, first, len(flat))
        want = [max(len(t), len(x)) - (Counter(t) & Counter(x)).total() for x in texts]
        assert got.tolist() == want and all(g <= levenshtein(t, x) for g, x in zip(got, texts, strict=True))


def test_order_matters_to_sketches():
    import numpy as np

    words = np.arange(60, dtype=np.uint64) * np.uint64(977)
    turned = np.concatenate([words[30:], words[:30]])
    a, b = (near_dedup.order_min_hash(w, 200, 2, 5) for w in (words, turned))
    assert 0.2 < (a == b).mean() < 0.75  # most k-mers are shared, half of their pairs in order


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(200, 200 + i) for i in range(1, 50)] + [(300, 300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or find(x) != x or x in got}


def test_decontamination(spark):
    rng = random.Random(2)
    items = [cases.prose(rng, n) for n in (5, 8, 20, 60)]
    inside = lambda t: cases.prose(rng, 300) + "\n" + t.upper() + "! " + cases.prose(rng, 3000)
    part = items[3].split()
    rows = [(1, inside(items[0])), (2, inside(items[2])), (3, " ".join(part[:53])), (4, " ".join(part[:40])), (5, None), (6, "a b"), (None, inside(items[1])), (8, items[2] + " " + items[3]), (8, items[2] + " " + items[3])]
    docs = cases.documents(spark, [(i, t, *[None] * 9) for i, t in rows])
    bench = spark.createDataFrame([*enumerate(items), (None, items[0]), (9, None), (10, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 0), (1, None), (2, 2), (3, 3), (None, 1), (8, 2), (8, 3)}
    assert got[3, 3]["shared_shingles"] == 49 and got[3, 3]["item_shingles"] == 56
    for d, b in ((cases.documents(spark, []), bench), (docs, bench.limit(0))):
        assert decontamination.contaminated(d, b).count() == 0
    shuffled = C.BROADCAST_BYTES
    try:
        C.BROADCAST_BYTES = 16
        assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()} == set(got)
    finally:
        C.BROADCAST_BYTES = shuffled


def test_decontamination_finds_by_sketches_only(spark, monkeypatch):
    """Without an item's sketch its copies aren't found; a sketch is as long as its size partition asks."""
    whole = decontamination.sketches
    item = [f"w{i}" for i in range(24)]
    docs = spark.createDataFrame([(1, " ".join(item)), (2, "x y z"), (3, " ".join(item[:21]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in decontamination.contaminated(docs, bench).collect()} == {1, 3}
    monkeypatch.setattr(decontamination, "sketches", lambda items, t: whole(items, t).limit(0))
    assert decontamination.contaminated(docs, bench).count() == 0
    table = spark.createDataFrame([(n, h, n) for n in (1, 4, 5, 9, 10, 20) for h in range(n)], "item_id long, shingle long, item_shingles long")
    sizes = Counter(r["item_id"] for r in whole(table, 0.8).collect())
    assert sizes == {1: 1, 4: 1, 5: 2, 9: 2, 10: 3, 20: 5}


def test_long_text_is_one_document(spark):
    assert C.keyed(cases.documents(spark)).columns == ["d", "v", "text"]

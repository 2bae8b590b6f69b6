"""Suffix-array and substring dedup against plain versions."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from speechframe.llm import common as C
from speechframe.llm import passages, repeats, suffix_dedup

from . import cases


def shown(frame, columns):
    return Counter((cases.least(r["d"]), *(r[c] for c in columns)) for r in frame.collect())


@pytest.mark.parametrize("seed", [7, 8])
def test_suffixes(spark, seed):
    rows = cases.odd_rows(seed)
    want = cases.suffixes(rows)
    got = suffix_dedup.remove_repeats(cases.documents(spark, rows), digest=True)
    assert shown(got, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]) == Counter((cases.least(r[0]), *want[cases.least(r[0]), (r[1] or "").encode()]) for r in rows)


@pytest.mark.parametrize("seed", [7, 8])
def test_passages(spark, seed):
    rows = cases.odd_rows(seed)
    want = cases.passages(rows)
    got = passages.remove_passages(cases.documents(spark, rows), digest=True)
    assert shown(got, ["n_words", "n_removed", "kept_sha256"]) == Counter((cases.least(r[0]), *want[cases.least(r[0]), r[1] or ""]) for r in rows)


def test_crowded_grams_take_the_way_by_windows(spark):
    rows = cases.odd_rows(9)
    docs = C.keyed(cases.documents(spark, rows))
    for kind, settle in ((repeats.Kind("byte", 100, 24, True), suffix_dedup._settle), (repeats.Kind("word", 50, 8, False), passages._extend)):

        def covered(hot, kind=kind, settle=settle):
            out = set()
            for r in repeats.covered_spans(docs, kind, settle(kind), hot).collect():
                out |= {(r["d"], r["v"], p) for p in range(r["a"], r["b"])}
            return out

        assert covered(2) == covered(repeats.HOT) != set()


def test_many_documents_share_a_seed():
    kind = repeats.Kind("word", 50, 8, False)
    rng = np.random.default_rng(0)
    words = [[f"{x}".encode() for x in rng.integers(0, 3, 92)] for _ in range(60)]
    for w in words:
        w[42:50] = [b"seed"] * 8
        w[20:42] = words[0][20:42]
        k = int(rng.integers(0, 40))
        w[50 : 50 + k] = words[0][50 : 50 + k]
    n = len(words)
    x = repeats.Contexts(np.zeros(n), np.arange(n), np.zeros(n), np.full(n, 42), np.full(n, 42), np.full(n, 50), [b" ".join(w) for w in words])
    for a, b in zip(passages._extend(kind, 2)(x), passages._extend(kind, 1000)(x), strict=True):
        assert a.tolist() == b.tolist()


def test_long_text_in_ranges(spark, monkeypatch):
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 5000)).decode()
    text = text + "#" + text[:3000] + "#" + text[1000:4000]
    kind = repeats.Kind("byte", 100, 24, True)
    whole = repeats.anchors(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), kind)
    monkeypatch.setattr(repeats, "CHUNK", 700)
    found = set()
    for _, shift, units, first, low, high in repeats._pieces([text.encode()], kind):
        _, pos, a, c, left, right = repeats.anchors(units, first, kind)
        own = (pos >= low) & (pos < high)
        found |= set(zip((pos + shift)[own].tolist(), a[own].tolist(), c[own].tolist(), left[own].tolist(), right[own].tolist(), strict=True))
    assert found == set(zip(*(x.tolist() for x in whole[1:]), strict=True))


@pytest.mark.parametrize("kind", [repeats.Kind("byte", 100, 24, True), repeats.Kind("word", 50, 8, False)])
def test_long_texts_after_empty_ones(monkeypatch, kind):
    rng = np.random.default_rng(2)
    texts = ["", *(" ".join(f"{x}" for x in rng.integers(0, 9, 3000)) for _ in range(2)), "", "", "short", "", " ".join(["x"] * 3000)]

    def found():
        out = set()
        for i, shift, units, first, low, high in repeats._pieces([t.encode() for t in texts], kind):
            text, pos, a, c, left, right = repeats.anchors(units, first, kind)
            own = (pos >= low) & (pos < high) if shift or high < len(units) else np.ones(len(pos), bool)
            out |= set(zip(*(x[own].tolist() for x in (i + text, pos + shift, a, c, left, right)), strict=True))
        return out

    whole = found()
    assert {row[0] for row in whole} == {1, 2, 7}
    monkeypatch.setattr(repeats, "CHUNK", 700)
    assert found() == whole


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text(alphabet="ab\0", max_size=60)), min_size=1, max_size=25))
def test_deep_shallow(rows):
    texts = [t.encode() for _, t in rows]
    group, sizes = np.array([g for g, _ in rows]), np.array([len(t) for t in texts])
    matrix = np.frombuffer(b"".join(t + bytes(64 - len(t)) for t in texts), np.uint8).reshape(len(rows), 64)
    order = suffix_dedup.deep_shallow_order(group, matrix, sizes, 8)
    assert [(group[i], texts[i]) for i in order] == sorted(zip(group, texts, strict=True))
    lcp = suffix_dedup.neighbours_prefix(matrix, sizes, order, group)
    for k in range(1, len(order)):
        a, b = order[k - 1], order[k]
        assert lcp[k] == (suffix_dedup.common_prefix(texts[a], texts[b]) if group[a] == group[b] else 0)


def test_empty(spark):
    docs = cases.documents(spark, [])
    assert suffix_dedup.remove_repeats(docs).count() == 0 and passages.remove_passages(docs).count() == 0

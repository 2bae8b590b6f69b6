"""Removal of repeated byte strings by sparse suffix arrays, sorted deep-shallow.

Equal strings of `window` bytes share an anchor at the same place in them (see repeats.py), so only suffixes that
start at an anchor are sorted, and only against those of the same gram. They are ordered to a shallow depth level
by level, by np.lexsort on symbols of eight bytes, where buckets are still tied; blind tries order what shares more than that.
From the suffix array and its common prefixes, every string around an anchor finds those equal to it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C
from . import repeats as R

SHALLOW = 40


class _Node:
    __slots__ = ("depth", "rows", "text", "under")

    def __init__(self, depth: int, text: bytes, rows: list[int] | None):
        self.depth, self.text, self.rows, self.under = depth, text, rows, {}


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1
    while low < high:  # the first difference is in [low, high]
        mid = (low + high) // 2
        if a[low : mid + 1] == b[low : mid + 1]:
            low = mid + 1
        else:
            high = mid
    return low


def blind_trie_order(rows: list[int], text: dict[int, bytes] | list[bytes]) -> list[int]:
    """rows in the order of their texts. The trie keeps one byte per branch; a text is compared with one leaf only."""
    root = _Node(0, text[rows[0]], [rows[0]])
    root.depth = len(root.text)
    for row in rows[1:]:
        s = text[row]
        node = root
        while node.rows is None:
            node = node.under.get(s[node.depth] if node.depth < len(s) else -1) or next(iter(node.under.values()))
        n = common_prefix(s, node.text)
        if n == len(s) == len(node.text):
            node.rows.append(row)
            continue
        up, node = None, root
        while node.rows is None and node.depth <= n:
            if node.depth == n:
                break
            up, node = node, node.under[s[node.depth]]
        if node.rows is None and node.depth == n:
            node.under[s[n] if n < len(s) else -1] = _leaf(s, row)
            continue
        branch = _Node(n, s, None)
        branch.under = {(s[n] if n < len(s) else -1): _leaf(s, row), (node.text[n] if n < len(node.text) else -1): node}
        if up is None:
            root = branch
        else:
            up.under[s[up.depth] if up.depth < len(s) else -1] = branch
    out, open_ = [], [root]
    while open_:
        node = open_.pop()
        if node.rows is not None:
            out += node.rows
        else:
            open_ += [x for _, x in sorted(node.under.items(), key=lambda kv: -kv[0])]
    return out


def _leaf(s: bytes, row: int) -> _Node:
    return _Node(len(s), s, [row])


def deep_shallow_order(group: np.ndarray, text: np.ndarray, lengths: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """The order of rows by (group, text). text: a matrix of bytes, zero after each row's length."""
    symbols = np.ascontiguousarray(text[:, :shallow]).view(">u8").astype(np.uint64) if shallow else np.zeros((len(text), 0), np.uint64)
    order = np.argsort(group, kind="stable")
    bucket = np.cumsum(np.r_[True, group[order][1:] != group[order][:-1]]) if len(order) else np.zeros(0, int)
    tied = np.arange(len(order))
    for k in range(symbols.shape[1]):
        size = np.bincount(bucket)
        tied = tied[size[bucket[tied]] > 1]
        if not len(tied):
            return order
        rows = order[tied]
        inner = np.lexsort((symbols[rows, k], bucket[tied]))
        order[tied] = rows[inner]
        key = symbols[order[tied], k]
        split = np.zeros(len(order) + 1, bool)
        at = np.flatnonzero((bucket[tied][1:] == bucket[tied][:-1]) & (key[1:] != key[:-1])) + 1
        split[tied[at]] = True
        bucket = bucket + np.cumsum(split[:-1])
    # Rows that still share a bucket are equal so far, but for zeros that may be padding; the tries see true lengths.
    size = np.bincount(bucket)
    tied = tied[size[bucket[tied]] > 1]
    if len(tied):
        starts = np.flatnonzero(np.r_[True, bucket[tied][1:] != bucket[tied][:-1]])
        ends = np.r_[starts[1:], len(tied)]
        raw, width = text.tobytes(), text.shape[1]
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            rows = order[tied[a:b]].tolist()
            suffix = {r: raw[r * width : r * width + int(lengths[r])] for r in rows}
            if len(rows) == 2:
                if suffix[rows[1]] < suffix[rows[0]]:
                    order[tied[a:b]] = rows[::-1]
            else:
                order[tied[a:b]] = blind_trie_order(rows, suffix)
    return order


def neighbours_prefix(text: np.ndarray, lengths: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The common prefix of each row in `order` with the one before; 0 where the group begins."""
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 50_000):
        x, y = order[a : a + 50_000], order[a - 1 : a - 1 + len(order[a : a + 50_000])]
        differ = text[x] != text[y]
        first = np.where(differ.any(1), differ.argmax(1), text.shape[1])
        out[a : a + len(x)] = np.where(group[x] == group[y], np.minimum(first, np.minimum(lengths[x], lengths[y])), 0)
    return out


def _settle(kind: R.Kind):
    def settle(x: R.Contexts):
        before, window = kind.before, kind.window
        width = -(-window // 8) * 8
        rows = b"".join([bytes(before - a) + c + bytes(width - b) for a, b, c in zip(x.left.tolist(), x.right.tolist(), x.context, strict=True)])
        matrix = np.frombuffer(rows, np.uint8).reshape(len(x.d), before + width)
        right = matrix[:, before:]
        order = deep_shallow_order(x.gram, right, x.right)
        lcp = neighbours_prefix(right, x.right, order, x.gram)
        # Places in order of the documents; rows that repeat a place have the same.
        o = np.lexsort((x.pos, x.v, x.d))
        rank = np.empty(len(o), np.int64)
        rank[o] = np.cumsum(R._new(x.d[o], x.v[o], x.pos[o]))
        left, rank_in = x.left[order], rank[order]
        hashes = np.zeros(len(order), np.uint64)
        low, high = np.full(len(order), -1), np.full(len(order), -1)
        for e in range(before + 1):  # strings that start e bytes before the anchor
            if e:
                hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + matrix[order, before - e] + np.uint64(1)
            near = lcp >= window - e
            sel = np.flatnonzero((near | np.r_[near[1:], False]) & (left >= e))
            if len(sel) < 2:
                continue
            run, h = np.cumsum(~near)[sel], C.mix(hashes[sel])
            o = np.lexsort((rank_in[sel], h, run))
            at = sel[o]
            first = np.maximum.accumulate(np.where(R._new(run[o], h[o]), np.arange(len(o)), 0))
            again = at[rank_in[at] > rank_in[at[first]]]
            low[again[low[again] < 0]] = e
            high[again] = e
        hit = np.flatnonzero(low >= 0)
        row = order[hit]
        return row, x.pos[row] - high[hit], x.pos[row] - low[hit] + window

    return settle


_KEPT_DDL = "d long, n_bytes long, n_removed long, n_spans long, kept binary"
_KEPT = pa.schema([("d", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, window: int = 100, gram: int = 24, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """A row per row of docs: d, n_bytes, n_removed, n_spans and kept, the bytes that stay (digest: kept_sha256).

    A byte goes if a string of `window` bytes covers it that also starts earlier: in a smaller id, or before in the
    same document. Strings are judged on the input. A null text is empty; texts under `window` bytes stay whole. Rows
    that repeat an id and text are one document, with that result each; other rows with one id are ordered by a
    checksum. A null id is the smallest.
    """
    kind = R.Kind("byte", window, gram, True)
    rows = C.keyed(docs, id_col, text_col)

    def keep(batches):
        for batch in C.slices(batches):
            out: list[list] = [[], [], [], [], []]
            for d, text, spans in zip(batch["d"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["spans"], strict=True):
                spans = R.merged(spans.values)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                for column, v in zip(out, (d, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest().encode() if digest else kept), strict=True):
                    column.append(v)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _KEPT, strict=True)], schema=_KEPT)

    kept = R.with_spans(rows, R.covered_spans(rows, kind, _settle(kind))).mapInArrow(keep, _KEPT_DDL)
    return kept.withColumn("kept", kept.kept.cast("string")).withColumnRenamed("kept", "kept_sha256") if digest else kept


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return found.select(C.id_back().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")

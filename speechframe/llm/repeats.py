"""Repeated windows across documents, found through content-chosen anchors. Used by the suffix-array and substring dedup.

A window is `window` consecutive units (bytes or words) of one document. Among the `gram`-unit strings inside a window
the one with the smallest hash (the leftmost of equals) is its anchor, so equal windows have equal anchors at equal
places; about 2 in (window - gram + 2) positions are anchors. An anchor's context is what any of its windows can hold:
window - gram units before it, window units from it on, as far as the document goes.

1. Scan: each document gives its anchors, with hashes of gram and context. Inside a batch, all but the first of equal
   (gram, context) are settled at once: their whole context stands earlier.
2. Anchors meet by gram, as a sorted stream that is never held: again all but the first of equal contexts are settled.
   Grams with one context are dropped. The first of each context goes on, where its gram has others. Grams that a look
   at some documents shows to be common are dealt out by context as well, and taken to have several: that costs a few
   comparisons where it's wrong, and keeps a gram of a third of all documents from one task. No result hangs on it.
3. Contexts of one gram are compared in full by the operator (`settle`); a gram with very many contexts has its windows
   hashed to 128 bits and dealt out by that instead.
4. The covered spans of each document are joined with its text.

Order: by id, checksum of the text, position; rows that repeat an id and a text are one document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CHUNK = 1 << 20
#: Contexts of one gram that are compared in one task; grams with more take the way by windows.
HOT = 20_000
BROADCAST_GRAMS = 100_000

_FOUND_DDL = "kind byte, a long, c long, d long, v long, pos long, l int, r int"
_FOUND = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("c", pa.int64()), ("d", pa.int64()), ("v", pa.int64()), ("pos", pa.int64()), ("l", pa.int32()), ("r", pa.int32())])
_SPAN_DDL = "d long, v long, a long, b long"
_SPAN = pa.schema([("d", pa.int64()), ("v", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
COVERED, ANCHOR, COMMON = 0, 1, 2
#: Documents looked at for common grams, and the share of them that makes a gram common; that bounds their list.
LOOKED_AT, COMMON_SHARE = 5_000, 0.01


@dataclass(frozen=True)
class Kind:
    """units: 'byte' or 'word'. inside: whether an earlier place in the same document counts."""

    units: str
    window: int
    gram: int
    inside: bool

    @property
    def before(self) -> int:
        return self.window - self.gram


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the place of the smallest (leftmost) of values[i:i+width]; for all full windows."""
    n = len(values)
    shift = np.uint64(max(1, int(n).bit_length()))
    packed = ((values >> shift) << shift) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    blocks = np.concatenate([packed, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    to_right = np.minimum.accumulate(blocks, 1).ravel()
    to_left = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    best = np.minimum(to_left[: n - width + 1], to_right[width - 1 : n])
    return (best & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)


def units_of(texts: list[bytes], kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """The units of texts in a row, and where each text's begin."""
    if kind.units == "byte":
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    return C.word_hashes(texts, C.SPACE)


def anchors(units: np.ndarray, first: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """(text, place in its text, gram hash, context hash, units before, units from it on) of each anchor."""
    sums = C.prefix_sums(units)
    n = len(units) - kind.gram + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 6
    at = np.arange(n)
    grams = C.range_hash(sums, at, at + kind.gram)
    width = kind.before + 1
    lengths = np.diff(first)
    starts = first[:-1]
    full = lengths >= kind.window
    if not full.any():
        return (np.zeros(0, np.int64),) * 6
    valid = np.zeros(len(units) + 1, np.int32)  # windows that stay within a text
    np.add.at(valid, starts[full], 1)
    np.add.at(valid, (starts + lengths - kind.window + 1)[full], -1)
    best = leftmost_minima(grams, width)
    place = np.unique(best[np.cumsum(valid)[: len(best)] > 0])
    text = np.searchsorted(first, place, side="right") - 1
    left = np.minimum(place - first[text], kind.before)
    right = np.minimum(first[text + 1] - place, kind.window)
    context = C.mix(C.range_hash(sums, place - left, place + right) ^ (left.astype(np.uint64) << np.uint64(32)) ^ right.astype(np.uint64))
    return text, place - first[text], grams[place].view(np.int64), context.view(np.int64), left, right


def _pieces(texts: list[bytes], kind: Kind):
    """(index of the first text, units, first) for texts in groups of about CHUNK bytes; long texts' windows by ranges."""
    for i, j in C.groups_of(texts, CHUNK):
        units, first = units_of(texts[i:j], kind)
        if len(units) <= 2 * CHUNK:
            yield i, 0, units, first, 0, len(units)
            continue
        for s in range(0, len(units), CHUNK):  # one long text: windows that start in [s, s + CHUNK)
            a, b = max(0, s - kind.window), min(len(units), s + CHUNK + 2 * kind.window)
            yield i, a, units[a:b], np.array([0, b - a]), (s - a if s else 0), (s + CHUNK + kind.before - a if b < len(units) else b - a)


def _order(*keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys[::-1])


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _settled(kind: Kind, a, c, d, v, pos) -> np.ndarray:
    """Of rows sorted by (a, c, d, v, pos): whether an earlier row has the same gram and context."""
    start = np.maximum.accumulate(np.where(_new(a, c), np.arange(len(a)), 0))
    later = d != d[start]
    return later | (v != v[start]) | (pos != pos[start]) if kind.inside else later


def _found(what: int, a, c, d, v, pos, left, right) -> pa.RecordBatch:
    columns = (np.full(len(a), what, np.int8), a, c, d, v, pos, left.astype(np.int32), right.astype(np.int32))
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


def _joined(d, v, a, b) -> tuple:
    """Spans as rows of _FOUND, those that overlap in a document as one; dealt out by their place, as no gram needs them."""
    o = _order(d, v, a)
    d, v, a, b = d[o], v[o], a[o], b[o]
    document = np.cumsum(_new(d, v)) * (int(b.max()) + 1)
    reach = np.maximum.accumulate(document + b)
    first = np.flatnonzero(np.r_[True, (document + a)[1:] > reach[:-1]])
    end = (reach - document)[np.r_[first[1:] - 1, len(a) - 1]]
    d, v, a = d[first], v[first], a[first]
    key = C.mix(d.view(np.uint64) ^ C.mix(a.astype(np.uint64))).view(np.int64)
    return key, key, d, v, a, np.zeros(len(a)), end - a


def _scan(kind: Kind, common: np.ndarray):
    def scan(batches):
        C.only_kept(())
        for batch in C.slices(batches):
            ids, checks, texts = batch["d"].to_numpy(), batch["v"].to_numpy(), batch["text"].cast(pa.binary()).to_pylist()
            for i, shift, units, first, low, high in _pieces(texts, kind):
                text, pos, a, c, left, right = anchors(units, first, kind)
                if shift or high < len(units):
                    own = (pos >= low) & (pos < high)
                    text, pos, a, c, left, right = (x[own] for x in (text, pos, a, c, left, right))
                if not len(a):
                    continue
                d, v, pos = ids[i + text], checks[i + text], pos + shift
                o = _order(a, c, d, v, pos)
                a, c, d, v, pos, left, right = (x[o] for x in (a, c, d, v, pos, left, right))
                same = _settled(kind, a, c, d, v, pos)
                often = np.isin(a, common)
                for what, go in ((ANCHOR, ~same & ~often), (COMMON, ~same & often)):
                    if go.any():
                        gram, context = a[go], c[go]
                        if what == COMMON:  # the key that deals rows out, and the gram
                            gram, context = C.mix(gram.view(np.uint64) ^ C.mix(context.view(np.uint64))).view(np.int64), gram
                        yield _found(what, gram, context, d[go], v[go], pos[go], left[go], right[go])
                if same.any():
                    yield _found(COVERED, *_joined(d[same], v[same], pos[same] - left[same], pos[same] + right[same]))

    return scan


def _meet(kind: Kind):
    """Rows sorted by (a, c, d, v, pos): settles copies of a context, and passes on contexts whose gram has others."""

    def meet(batches):
        last = None  # (a, c, d, v, pos) of the first row of the context
        waiting: list[pa.RecordBatch] = []  # the first context's rows of the gram that the last batch ended in
        several = False
        for batch in batches:
            table = pa.Table.from_batches([batch])
            through = table.filter(pa.array(batch["kind"].to_numpy() == COVERED))
            if len(through):
                yield from through.combine_chunks().to_batches()
            rows = table.filter(pa.array(batch["kind"].to_numpy() != COVERED)).combine_chunks()
            if not len(rows):
                continue
            a, c, d, v, pos = (rows[x].to_numpy() for x in ("a", "c", "d", "v", "pos"))
            new_gram, new_context = _new(a), _new(a, c)
            if last and a[0] == last[0]:
                new_gram[0] = False
                new_context[0] = c[0] != last[1]
            start = np.maximum.accumulate(np.where(new_context, np.arange(len(a)), -1))
            first_d, first_v, first_pos = (np.where(start >= 0, x[np.maximum(start, 0)], last[k] if last else 0) for k, x in ((2, d), (3, v), (4, pos)))
            same = d != first_d
            if kind.inside:
                same |= (v != first_v) | (pos != first_pos)
            # Whether the row's gram has several contexts: any context that begins without a gram beginning.
            gram = np.cumsum(new_gram)  # 0: the one that goes on
            more = np.bincount(gram, new_context & ~new_gram, minlength=gram[-1] + 1) > 0
            often = rows["kind"].to_numpy() == COMMON
            more |= np.bincount(gram, often, minlength=gram[-1] + 1) > 0
            if not new_gram[0]:
                more[0] |= several
                if more[0]:
                    yield from waiting
                    waiting = []
            else:
                waiting, several = [], False
            out_kind = np.where(same, COVERED, ANCHOR).astype(np.int8)
            rows = rows.set_column(0, "kind", pa.array(out_kind)).set_column(1, "a", pa.array(np.where(often, c, a)))
            ends = gram == gram[-1]
            go = same | more[gram]
            held = ends & ~go
            yield from rows.filter(pa.array(go)).combine_chunks().to_batches()
            if new_gram.any():
                waiting = []
                several = False
            if gram[-1] or new_gram[0]:
                several = bool(more[-1])
            else:
                several = bool(several or more[0])
            if held.any():
                waiting += rows.filter(pa.array(held)).combine_chunks().to_batches()
            last = (a[-1], c[-1], first_d[-1], first_v[-1], first_pos[-1])

    return meet


def _contexts(kind: Kind):
    """Rows (d, v, text, asks): the contexts that were asked for, as bytes; of words, joined by one space."""

    def contexts(batches):
        for batch in C.slices(batches):
            out: list[list] = [[], [], [], [], [], [], []]
            for d, v, text, asks in zip(batch["d"].to_pylist(), batch["v"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["asks"], strict=True):
                asks = asks.values
                grams, pos, left, right = (asks.field(k).to_pylist() for k in range(4))
                if kind.units == "word":
                    start, end = C.words_of(np.frombuffer(text, np.uint8), C.SPACE)
                    words = [text[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]
                    found = [b" ".join(words[p - x : p + y]) for p, x, y in zip(pos, left, right, strict=True)]
                else:
                    found = [text[p - x : p + y] for p, x, y in zip(pos, left, right, strict=True)]
                for column, x in zip(out, (grams, [d] * len(pos), [v] * len(pos), pos, left, right, found), strict=True):
                    column += x
                if len(out[0]) > 20_000:
                    yield _context_batch(out)
                    out = [[], [], [], [], [], [], []]
            if out[0]:
                yield _context_batch(out)

    return contexts


_CONTEXT_DDL = "a long, d long, v long, pos long, l int, r int, context binary"


def _context_batch(out: list[list]) -> pa.RecordBatch:
    return pa.record_batch([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.int32()), pa.array(out[5], pa.int32()), pa.array(out[6], pa.binary())], names=["a", "d", "v", "pos", "l", "r", "context"])


@dataclass
class Contexts:
    """Contexts sorted by (gram, d, v, pos); whole grams only."""

    gram: np.ndarray
    d: np.ndarray
    v: np.ndarray
    pos: np.ndarray
    left: np.ndarray
    right: np.ndarray
    context: list[bytes]


def _spans(d, v, a, b) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in (d, v, a, b)], schema=_SPAN)


def _settler(settle: Callable[[Contexts], tuple], limit: int = 20_000):
    """Feeds whole grams to `settle`, about `limit` contexts at a time; it returns covered (row, start, end)."""

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            if len(held) < limit:
                continue
            a = held["a"].to_numpy()
            cut = int(np.flatnonzero(a != a[-1])[-1]) + 1 if a[0] != a[-1] else 0
            if cut:
                yield from of(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield from of(held)

    def of(table):
        x = Contexts(*(table[c].to_numpy() for c in ("a", "d", "v", "pos", "l", "r")), table["context"].to_pylist())
        row, start, end = settle(x)
        if len(row):
            yield _spans(x.d[row], x.v[row], start, end)

    return run


def _windows(kind: Kind):
    """Every window of a context, by a 128-bit digest of its bytes."""
    import hashlib

    def windows(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for d, v, pos, left, right, context in zip(*(batch[x].to_pylist() for x in ("d", "v", "pos", "l", "r", "context")), strict=True):
                units = context.split(b" ") if kind.units == "word" else context
                for i in range(left + right - kind.window + 1):
                    w = units[i : i + kind.window]
                    out[0].append(hashlib.blake2b(b" ".join(w) if kind.units == "word" else w, digest_size=16).digest())
                    out[1].append(d)
                    out[2].append(v)
                    out[3].append(pos - left + i)
            yield pa.record_batch([pa.array(out[0], pa.binary()), *(pa.array(x, pa.int64()) for x in out[1:])], names=["w", "d", "v", "pos"])

    return windows


def common_grams(docs: DataFrame, kind: Kind) -> np.ndarray:
    """Grams that at least COMMON_SHARE of about LOOKED_AT documents, drawn by a hash of the id, hold as anchors."""
    n = docs.count()
    chance = F.pmod(F.xxhash64("d", "v"), F.lit(1_000_000)) < int(1e6 * min(1.0, LOOKED_AT / max(1, n)))
    some = docs.where(chance).mapInArrow(_scan(kind, np.zeros(0, np.int64)), _FOUND_DDL).where(F.col("kind") == ANCHOR)
    often = some.groupBy("a").count().where(F.col("count") >= max(20, int(COMMON_SHARE * min(n, LOOKED_AT)))).select("a")
    return np.sort(np.array([r[0] for r in often.toLocalIterator()], np.int64))


def covered_spans(docs: DataFrame, kind: Kind, settle: Callable[[Contexts], tuple], hot: int = HOT) -> DataFrame:
    """(d, v, a, b): spans of documents covered by windows that also start earlier. docs: (d, v, text)."""
    C.ship(docs.sparkSession)
    scanned = docs.mapInArrow(_scan(kind, common_grams(docs, kind)), _FOUND_DDL)
    met = scanned.repartition("a").sortWithinPartitions("a", "c", "d", "v", "pos").mapInArrow(_meet(kind), _FOUND_DDL)
    met = C.cut(met, "anchors")
    asked = met.where(F.col("kind") == ANCHOR)
    asks = asked.groupBy("d", "v").agg(F.collect_list(F.struct("a", "pos", "l", "r")).alias("asks"))
    contexts = docs.join(asks, ["d", "v"]).mapInArrow(_contexts(kind), _CONTEXT_DDL)
    # At most one row for `hot` asked contexts; beyond BROADCAST_GRAMS of them the joins shuffle.
    crowded = C.cut(asked.groupBy("a").count().where(F.col("count") > hot).select("a"), "crowded")
    grams = crowded.count()
    out = met.where(F.col("kind") == COVERED).select("d", "v", (F.col("pos") - F.col("l")).alias("a"), (F.col("pos") + F.col("r")).alias("b"))
    if grams:
        crowded = F.broadcast(crowded) if grams <= BROADCAST_GRAMS else crowded
        contexts = C.cut(contexts, "contexts")
        windows = C.cut(contexts.join(crowded, "a", "left_semi").mapInArrow(_windows(kind), "w binary, d long, v long, pos long").distinct(), "windows")
        first = windows.groupBy("w").agg(F.min(F.struct("d", "v", "pos") if kind.inside else F.struct("d")).alias("first"))
        later = F.struct("d", "v", "pos") > F.col("first") if kind.inside else F.col("d") > F.col("first.d")
        out = out.unionByName(windows.join(first, "w").where(later).select("d", "v", F.col("pos").alias("a"), (F.col("pos") + kind.window).alias("b")))
        contexts = contexts.join(crowded, "a", "left_anti")
    compared = contexts.repartition("a").sortWithinPartitions("a", "d", "v", "pos").mapInArrow(_settler(settle), _SPAN_DDL)
    return out.unionByName(compared)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(d, v, text, spans): each document with its covered spans, unmerged; null where none."""
    spans = C.cut(spans, "spans").groupBy("d", "v").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return docs.join(spans, ["d", "v"], "left").select("d", "text", "spans")


def merged(spans) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    if spans is None:
        return []
    a, b = spans.field(0).to_numpy(), spans.field(1).to_numpy()
    o = np.argsort(a, kind="stable")
    a, b = a[o], np.maximum.accumulate(b[o])
    new = np.r_[True, a[1:] > b[:-1]]
    at = np.flatnonzero(new)
    return list(zip(a[at].tolist(), b[np.r_[at[1:] - 1, len(b) - 1]].tolist(), strict=True))

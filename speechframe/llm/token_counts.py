"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE vocabulary compiles, state by state as texts need them, into a deterministic transducer over bytes.
After each byte the tokens of what was read so far are settled up to the next byte, and the transition is annotated
with the change of their number. A state is what later bytes can depend on: the longest suffix that some token starts
with, and for each cut inside it the last token of the text before that cut. That is finite, so states repeat. Where a
word of the vocabulary's split begins, the transducer starts anew. Transitions are a table of integers.

Text is cut into chunks of CHUNK bytes, wherever that falls. A chunk's map says for a state that comes in which state
goes out and how many tokens are emitted. Maps are tabulated for all chunks of a batch at once, a byte of each in a
step, for the state that the bytes just before the chunk lead to: back to the last start of a word, or LOOK_BACK bytes. Maps
compose associatively, so those of a text are joined by a tree of pairwise compositions, as in a parallel prefix scan. Should
a state come in that a map doesn't have, as may be in a word of over LOOK_BACK bytes, the chunk is run for it then.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common as C

_MAX_STATES, _MAX_PAIRS = 300_000, 500_000
"""States and pairs of tokens that a Python worker keeps at most: about 750 and 150 bytes each, or twice that for texts of
over _WIDTH different bytes. A step of all chunks is made before the number is looked at."""
_WIDTH = 128
CHUNK, LOOK_BACK = 1 << 10, 64
_BATCH = 1 << 21

#: Fixed value: the split of byte-level vocabularies of this family.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_OTHER, _LETTER, _NUMBER, _SPACE, _EDGE = range(5)


def character_kinds() -> np.ndarray:
    """Letter, number, white space or other, for each code point; _EDGE after the last, for what lies between texts."""
    import regex

    out = np.full(0x110001, _OTHER, np.uint8)
    out[-1] = _EDGE
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[[ord(c) for c in m[0]]] = kind
    return out


def word_starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where SPLIT begins a word, for code points of texts with one of 0x110000 before, between and after them.

    All but the abbreviations follows from a character and its neighbours: runs of one kind, a space before them, and
    the last of several spaces apart unless the text ends there.
    """
    kind = kinds[points]
    before, after = np.r_[_EDGE, kind[:-1]], np.r_[kind[1:], _EDGE]
    space = np.r_[False, points[:-1] == 0x20]  # a space before
    starts = (kind != before) & ~(space & (kind != _SPACE) & (kind != _EDGE))
    starts |= (kind == _SPACE) & (before == _SPACE) & (after != _SPACE) & (after != _EDGE)
    # Abbreviations begin where a run of other characters does, without a space before.
    at = np.flatnonzero((points == 0x27) & (before != _OTHER) & ~space)
    if len(at):
        one = points[np.minimum(at + 1, len(points) - 1)]
        two = points[np.minimum(at + 2, len(points) - 1)]
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        short = np.isin(one, [ord(c) for c in "stmd"])
        for found, size in ((at[short], 2), (at[pair & ~short], 3)):
            for k in range(1, size):
                starts[found + k] = False
            starts[found + size] = True
    return starts


def byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself where printable, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Transducer:
    """The number of BPE tokens of a byte string, by transitions that are made when first taken and then kept."""

    def __init__(self, vocabulary: list[bytes], ranks: dict[tuple[int, int], tuple[int, int]]):
        self.tokens, self.ranks = vocabulary, ranks
        self.number = {t: i for i, t in enumerate(vocabulary)}
        self.prefixes = {t[:k] for t in vocabulary for k in range(1, len(t) + 1)}
        self.pairs: dict[int, bool] = {}
        self.width, self.column, self.byte = _WIDTH, np.full(256, -1, np.int32), []
        self.split_of = {merged: pair for pair, (_, merged) in sorted(ranks.items(), key=lambda x: -x[1][0])}
        self.reset()

    def reset(self, held: np.ndarray | None = None) -> np.ndarray:
        """Only the start is left, and the states held, which get new numbers; what else is needed is made again."""
        kept = [self.states[i] for i in held.tolist()] if held is not None else []
        self.states: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.same: dict = {}
        self.table = np.zeros(self.width * (_MAX_STATES + 4096), np.int32)  # pages of states not made take no memory
        self.state((b"", ((-1, 0),)))
        if len(self.pairs) > _MAX_PAIRS:
            self.pairs.clear()
        return np.array([self.state(s) for s in kept], np.int32)

    def state(self, state: tuple) -> int:
        if (known := self.index.get(state)) is None:
            known = self.index[state] = len(self.states)
            self.states.append(state)
            if len(self.states) * self.width > len(self.table):
                self.table = np.concatenate([self.table, np.zeros(len(self.table), np.int32)])
        return known

    def columns(self, data: np.ndarray) -> np.ndarray:
        """The table's columns of bytes."""
        new = np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0))
        if len(self.byte) + len(new) > self.width:
            self.width = 256
            self.reset()
        self.column[new] = np.arange(len(self.byte), len(self.byte) + len(new))
        self.byte += new.tolist()
        return self.column.take(data)

    def together(self, a: int, b: int) -> bool:
        """Whether a text of these two tokens' bytes is tokenised as just these two."""
        if (known := self.pairs.get(a << 32 | b)) is None:
            known = self.pairs[a << 32 | b] = self.plain(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def plain(self, text: bytes) -> list[int]:
        """Tokens by the rule of merges: the lowest rank first, the leftmost of equals."""
        parts = [self.number[bytes([x])] for x in text]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((x, y), (1 << 60, 0))[0], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [self.ranks[parts[at], parts[at + 1]][1]]
        return parts

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the change of the number of tokens.

        A state holds the suffix, and for the cuts from its start to its end (last token before it, count less the
        count at the end).
        """
        suffix, cuts = self.states[state]
        text = suffix + bytes([byte])
        for size in range(len(text), 0, -1):
            token = self.number.get(text[-size:])
            if token is None:
                continue
            before, count = cuts[len(text) - size]  # text[-size:] is a token, so the cut matters
            if before == -1 or self.together(before, token):
                break
        last, change = token, count + 1
        cuts = (*(cut and (cut[0], cut[1] - change) for cut in cuts), (last, 0))
        while text and text not in self.prefixes:
            text, cuts = text[1:], cuts[1:]
        # Cuts from which no token goes on don't matter any more.
        same = self.same.setdefault
        cuts = (*(same(cut, cut) if cut and text[i:] in self.prefixes else None for i, cut in enumerate(cuts[:-1])), same(cuts[-1], cuts[-1]))
        to = self.state((same(text, text), cuts))
        if not -128 < change < 128:
            raise ValueError("a token of over 128 bytes")
        self.table[state * self.width + self.column[byte]] = to << 8 | change + 128
        return to, change

    def run(self, data: np.ndarray, at: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the bytes data[at:end] of each lane, from its state: the state after them, and the tokens emitted.

        data holds columns, and 256 more where a word starts. All lanes go a byte in each step.
        """
        order = np.argsort(at - end, kind="stable")  # the longest first, so that those still going are the first ones
        place, length, count = at[order].copy(), (end - at)[order], np.zeros(len(at), np.int64)
        move = state[order].astype(np.int32) << 8
        busy = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left").tolist()
        for going in busy:
            read = data.take(place[:going])
            key = (move[:going] >> 8) * (read < 256) * self.width + (read & 255)  # the start is state 0
            new = self.table.take(key)
            if not new.all():
                if len(self.states) > _MAX_STATES:
                    held, back = np.unique(move >> 8, return_inverse=True)
                    move = self.reset(held)[back] << 8 | (move & 255)
                    key = (move[:going] >> 8) * (read < 256) * self.width + (read & 255)
                    new = self.table.take(key)
                for k in np.unique(key[new == 0]).tolist():
                    self.step(k // self.width, self.byte[k % self.width])
                new = self.table.take(key)
            move[:going] = new
            count[:going] += (new & 255) - 128
            place[:going] += 1
        out, total = np.empty(len(at), np.int32), np.empty(len(at), np.int64)
        out[order], total[order] = move >> 8, count
        return out, total


#: A chunk's map: the states after it and the tokens emitted, by the states before.
Map = dict[tuple | None, tuple[tuple, int]]


class Counter:
    """Counts of whole texts as the library of a byte-level vocabulary gives them."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: not a byte-level BPE vocabulary without a normaliser")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ids = spec["model"]["vocab"]
        vocabulary = [b""] * (max(ids.values()) + 1)
        for text, i in ids.items():
            vocabulary[i] = bytes(byte_of[c] for c in text)
        ranks = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])}
        self.transducer = Transducer(vocabulary, ranks)
        self.kinds = character_kinds()
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, self.marks))) if self.marks else None

    def parts(self, texts: list[str]) -> tuple[list[str], list[int], list[int]]:
        """What lies between special strings, whose text each is, and the number of special strings of each text."""
        parts, owner, special = [], [], [0] * len(texts)
        for i, t in enumerate(texts):
            cut = self.special.split(t) if any(m in t for m in self.marks) else [t]
            special[i] = len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        return parts, owner, special

    def maps(self, parts: list[str]) -> tuple[list[Map], np.ndarray, tuple]:
        """The maps of all chunks, the part each belongs to, and what run() needs to go over them again.

        A map's states are given as what they stand for, as numbers change when the table is made anew.
        """
        points = np.full(sum(map(len, parts)) + len(parts) + 1, 0x110000, np.uint32)
        at, edges = 1, [0]
        for p in parts:
            points[at : at + len(p)] = np.frombuffer(p.encode("utf-32-le"), "<u4")
            at += len(p) + 1
            edges.append(at - 1)
        starts = word_starts(points, self.kinds)
        raw = [p.encode() for p in parts]
        data = np.frombuffer(b"\xff".join([b"", *raw, b""]), np.uint8)  # 0xff stands for an edge
        leads = (data & 0xC0) != 0x80
        data = self.transducer.columns(data)
        data[leads] |= np.where(starts, 256, 0)
        last = np.maximum.accumulate(np.where(data >= 256, np.arange(len(data)), 0))
        sizes = np.array([len(r) for r in raw], np.int64)
        first = np.cumsum(np.r_[1, sizes + 1])[:-1]
        n = -(-sizes // CHUNK)
        part = np.repeat(np.arange(len(raw)), n)
        place = np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n)
        begin = first[part] + place * CHUNK
        end = np.minimum(begin + CHUNK, (first + sizes)[part])
        run, none = self.transducer.run, np.zeros(len(begin), np.int32)
        # A chunk that starts with a word does so from any state; others from the one that the bytes before lead to.
        back = np.where(data[begin] >= 256, begin, np.maximum(last[begin], begin - LOOK_BACK)) if len(begin) else begin
        came, _ = run(data, back, begin, none)
        states = self.transducer.states
        came = [states[i] for i in came.tolist()]
        number = np.array([self.transducer.state(s) for s in came], np.int32)
        out, count = run(data, begin, end, number)
        states = self.transducer.states
        found = [{came[k]: (states[o], c)} for k, (o, c) in enumerate(zip(out.tolist(), count.tolist(), strict=True))]
        # Any state may come in where a word starts: the start stands for it.
        for k in np.flatnonzero(data[begin] >= 256).tolist():
            (value,) = found[k].values()
            found[k] = {None: value}
        return found, part, (data, begin, end)

    def apply(self, m: Map, state: tuple, again) -> tuple[tuple, int]:
        """What a map makes of a state; again(state) tabulates one that it doesn't have."""
        if (value := m.get(None) or m.get(state)) is None:
            value = m[state] = again(state)
        return value

    def compose(self, a: Map, b: Map, again) -> Map:
        """The map of two neighbouring runs of chunks. Associative."""
        out = {}
        for came, (between, n) in a.items():
            state, more = self.apply(b, between, again)
            out[came] = state, n + more
        return out

    def over(self, chunks: tuple, first: int, last: int):
        """again() for the run of chunks from first to last, one after another."""
        data, begin, end = chunks

        def again(state: tuple) -> tuple[tuple, int]:
            i = np.array([self.transducer.state(state)], np.int32)
            out, n = self.transducer.run(data, begin[first : first + 1], end[last : last + 1], i)
            return self.transducer.states[out[0]], int(n[0])

        return again

    def __call__(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        parts, owner, total = self.parts(texts)
        maps, part, chunks = self.maps(parts)
        runs = [(m, k, k, p) for k, (m, p) in enumerate(zip(maps, part.tolist(), strict=True))]  # map, chunks, part
        while True:
            joined, i = [], 0
            while i < len(runs):
                a = runs[i]
                if i + 1 < len(runs) and runs[i + 1][3] == a[3]:
                    b = runs[i + 1]
                    joined.append((self.compose(a[0], b[0], self.over(chunks, b[1], b[2])), a[1], b[2], a[3]))
                    i += 1
                else:
                    joined.append(a)
                i += 1
            if len(joined) == len(runs):
                break
            runs = joined
        for m, _, _, p in runs:
            total[owner[p]] += m[None][1]  # a part begins with a word
        return total


_COUNT = pa.schema([("d", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: d, n_bytes, n_tokens, over_limit. A null text counts as empty: no bytes, no tokens.

    Rows that repeat an id, and rows without one, are counted each; other columns are not read. No shuffle.
    """
    C.ship(docs.sparkSession)

    def count(batches):
        counter = C.only_kept(("bytes", tokenizer), lambda: Counter(tokenizer))
        for batch in C.slices(batches, 4000):
            sizes = pc.binary_length(batch["text"].cast(pa.binary())).to_numpy()
            texts, n, i = batch["text"].to_pylist(), [], 0
            while i < len(texts):  # as many as hold about _BATCH bytes, one at least
                j = max(i + 1, int(np.searchsorted(np.cumsum(sizes[i:]), _BATCH)) + i)
                n += counter(texts[i:j])
                i = j
            yield pa.record_batch([batch["d"], pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=_COUNT)

    return C.keyed(docs, id_col, text_col).select("d", "text").mapInArrow(count, "d long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(C.id_back().alias("doc_id"), "n_bytes", "n_tokens", "over_limit")

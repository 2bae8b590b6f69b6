"""Best-fit packing of tokenised documents by hierarchical residual packing.

Partitions pack their pieces best-fit into bins and emit the nearly full ones. Underfull bins go on as items: each
round merges the leftovers of several partitions and packs them best-fit again, until one partition is left or a
round no longer saves anything. A row is a bin with its pieces (ids and lengths, no text), so that what moves is small.
"""

from __future__ import annotations

import gc
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of strings and their ids that a Python worker keeps at most, with _ENTRY_BYTES for what Python adds to each; what
#: one call needs comes on top.
_CACHE_BYTES, _ENTRY_BYTES = 75_000_000, 125
#: As in the tokenizer's own split; special strings are cut out before.
_WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


class _Spelling(dict):
    """Of a character, by the library's byte level: a character for each byte, as in the vocabulary."""

    def __init__(self):
        from tokenizers import pre_tokenizers

        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, x: str) -> str:
        self[x] = out = self.byte_level(x)[0][0]
        return out


class WordTokenizer:
    """Ids of whole texts as the library gives them, with a bounded memory of strings met before.

    The library normalises a text, drops white space and tokenises each word by itself. So equal strings between
    spaces always get equal ids, and so do equal words. Texts that hold a special string go to the library whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.normalise = self.model.normalizer.normalize_str
        self.words_in = regex.compile(_WORD_PATTERN).findall
        self.special = regex.compile("|".join(regex.escape(t.content) for t in self.model.get_added_tokens_decoder().values())).search
        self.odd = re.compile(r"[\x1c-\x1f\x85\xa0]").search  # white space that not all take for it
        # For words, normalised already: the library's byte level and its model, without a pipeline around them.
        self.merge = self.model.model.tokenize
        self.spelling = _Spelling()
        self.codes = [i.to_bytes(4, "little") for i in range(max(self.model.get_vocab().values()) + 1)]
        self.strings: dict[str, bytes] = {}  # and words, as a word alone is a string of the same ids
        self.held = 0

    def split(self, text: str) -> list[str]:
        """The normalised text's strings between spaces."""
        if not self.odd(text):
            try:
                text.encode("latin-1")  # of these characters none composes with another
                return text.lower().split()
            except UnicodeEncodeError:
                pass
        return [x for x in self.normalise(text).split(" ") if x]

    def parts(self, x: str) -> list[str]:
        """The words of a string without spaces."""
        if x.isalpha():
            return [x]
        if x[-1] in ",." and x[:-1].isalpha():
            return [x[:-1], x[-1]]
        return self.words_in(x)

    def learn(self, strings: set[str]) -> None:
        """Afterwards self.strings has the ids of all of these, of which it has none yet."""
        known, merge, spelt, codes = self.strings, self.merge, self.spelling.__getitem__, self.codes
        words, several, before, held = {}, [], len(known), 0
        for x in strings:
            if x.isalpha():
                words[x] = None
            else:
                several.append((x, ws := self.parts(x)))
                for w in ws:
                    if w not in known:
                        words[w] = None
        for w in words:
            known[w] = ids = b"".join([codes[t.id] for t in merge(w if w.isascii() and w.isprintable() else "".join(map(spelt, w)))])
            held += len(w) + len(ids)
        for x, ws in several:
            if len(ws) != 1:
                known[x] = ids = b"".join([known[w] for w in ws])
                held += len(x) + len(ids)
        self.held += held + _ENTRY_BYTES * (len(known) - before)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        collects = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and looking for that in so many lists takes a sixth of the time
        try:
            return self.encoded(texts)
        finally:
            if collects:
                gc.enable()

    def encoded(self, texts: list[str]) -> list[bytes]:
        split = [None if "<|" in x and self.special(x) else self.split(x) for x in texts]
        known = self.strings
        found = [[] if s is None else list(map(known.get, s)) for s in split]
        gaps = [(k, [i for i, x in enumerate(f) if x is None]) for k, f in enumerate(found) if None in f]
        if gaps:
            new = {split[k][i] for k, at in gaps for i in at}
            if self.held > _CACHE_BYTES:
                known.clear()
                C.give_back()
                self.held = 0
            self.learn(new)
            for k, at in gaps:
                f, s = found[k], split[k]
                for i in at:
                    f[i] = known[s[i]]
        return [np.array(self.model.encode(x, add_special_tokens=False).ids, "<u4").tobytes() if s is None else b"".join(f) for x, s, f in zip(texts, split, found, strict=True)]


_PIECE = pa.schema([("d", pa.int64()), ("v", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("crc", pa.int64())])
_PIECE_DDL = "d long, v long, piece int, start long, length int, crc long"


def _cutter(path: str, limit: int, end_id: int):
    def cut_up(batches):
        encode, end = C.only_kept(("words", path), lambda: WordTokenizer(path)), np.array([end_id], "<u4").tobytes()
        for batch in C.slices(batches):
            out: list[list] = [[] for _ in _PIECE]
            texts = batch["text"].to_pylist()
            coded = (x for i, j in C.groups_of(texts) for x in encode(texts[i:j]))
            for d, v, ids in zip(batch["d"].to_pylist(), batch["v"].to_pylist(), coded, strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    for column, x in zip(out, (d, v, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(out, _PIECE, strict=True)], schema=_PIECE)

    return cut_up


def best_fit(sizes: np.ndarray, limit: int) -> np.ndarray:
    """The bin of each item: largest first, each into the fullest bin that still takes it, else into a new one."""
    room: list[int] = []  # the different amounts of room among open bins, ascending
    open_: dict[int, list[int]] = {}
    out, bins = np.zeros(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = bisect_left(room, size)
        if k == len(room):
            left, b = limit, bins
            bins += 1
        else:
            left = room[k]
            b = open_[left].pop()
            if not open_[left]:
                del open_[left], room[k]
        out[i] = b
        if left := left - size:
            if left not in open_:
                insort(room, left)
            open_.setdefault(left, []).append(b)
    return out


_BIN_DDL = "size int, pieces array<struct<d:long,v:long,piece:int,start:long,length:int,crc:long>>"


def _packer(limit: int, block: int):
    """Packs the bins of a partition, `block` at a time, into fewer bins."""

    def pack(batches):
        def blocks():
            held, n = [], 0
            for b in batches:
                held.append(b)
                n += len(b)
                if n >= block:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
            if held:
                yield pa.Table.from_batches(held)

        for table in blocks():
            table = table.combine_chunks()
            sizes = table["size"].to_numpy()
            if not len(sizes):
                continue
            bins = best_fit(sizes, limit)
            order = np.argsort(bins, kind="stable")
            pieces = table["pieces"].chunk(0) if table["pieces"].num_chunks else table["pieces"].combine_chunks()
            pieces = pieces.take(pa.array(order))
            flat, n = pieces.flatten(), pieces.value_lengths().to_numpy()
            first = np.flatnonzero(np.r_[True, bins[order][1:] != bins[order][:-1]])
            total = np.add.reduceat(sizes[order], first).astype(np.int32)
            offsets = np.r_[np.r_[0, np.cumsum(n)][first], n.sum()].astype(np.int32)
            for batch in pa.table({"size": pa.array(total), "pieces": pa.ListArray.from_arrays(pa.array(offsets), flat)}).to_batches(max_chunksize=20_000):
                yield batch
    return pack


def _place(batches):
    """A row per piece, with its place in its bin: the lengths of the pieces before."""
    for batch in batches:
        pieces, n = batch["pieces"], batch["pieces"].value_lengths().to_numpy()
        flat = pieces.flatten()
        length = flat.field("length").cast(pa.int64())
        before = np.r_[0, np.cumsum(length.to_numpy())]
        offset = before[:-1] - np.repeat(before[np.cumsum(n) - n], n)
        columns = [flat.field(c) for c in ("d", "v", "piece", "start")] + [length, flat.field("crc"), pa.array(np.repeat(batch["sequence_id"].to_numpy(), n)), pa.array(offset)]
        yield pa.record_batch(columns, names=["d", "v", "piece", "start", "length", "crc", "sequence_id", "offset"])


def tokenised(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: d, v, piece, start, length, crc. Documents over `limit` ids are cut, others are one piece.

    A null or empty text is the end id alone. Rows that repeat, or have no id, give pieces each. No rows: no pieces.
    """
    C.ship(docs.sparkSession)
    return C.keyed(docs, id_col, text_col).mapInArrow(_cutter(tokenizer, limit, end_id), _PIECE_DDL)


def pack(pieces: DataFrame, limit: int = 2048, full: float = 0.995, block: int = 100_000, rounds: int = 12) -> DataFrame:
    """Bins for all pieces: sequence_id, offset and the piece's columns.

    full: a bin filled to this share is emitted in the round that fills it. block: bins that a task packs together,
    whatever the partition holds, which bounds its memory. rounds: a bound that input of any size stays under, since
    each round merges eight partitions into one, down to blocks of `block`; where leftovers can't be merged any more
    (all over half of `limit`, say) the rounds end sooner. No pieces: no bins. Ties are broken by order in the block;
    any numbering of the bins is valid.
    """
    pieces = C.cut(pieces, "pieces")
    bins = pieces.select(F.col("length").alias("size"), F.array(F.struct("d", "v", "piece", "start", "length", "crc")).alias("pieces"))
    whole = bins.where(F.col("size") >= limit)
    done, bins = [whole], bins.where(F.col("size") < limit)
    parts = max(1, bins.rdd.getNumPartitions())
    before = None
    for _ in range(rounds):
        packed = C.cut(bins.mapInArrow(_packer(limit, block), _BIN_DDL), "bins")
        left = packed.where(F.col("size") < full * limit)
        n = left.count()
        if parts == 1 or n == 0 or (before is not None and n > 0.98 * before):
            done.append(packed)
            break
        done.append(packed.where(F.col("size") >= full * limit))
        before = n
        parts = max(-(-n // block), min(parts // 8, 8 * -(-n // block)), 1)
        bins = left.repartition(parts)
    else:
        done.append(bins)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    out = out.withColumn("sequence_id", F.monotonically_increasing_id())
    return out.select("sequence_id", "pieces").mapInArrow(_place, "d long, v long, piece int, start long, length long, crc long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack(tokenised(docs, default_tokenizer()))
    return packed.select(C.id_back().alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")

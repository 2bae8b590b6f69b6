"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document's k-mers (three words) are labelled with their occurrence number, so that repeats count. Each sketch takes
the `picks` labelled k-mers with the smallest hashes under its own hash function and keeps them in text order: two
documents agree on a sketch with a chance that follows their edit similarity, as reordered text changes it. Documents
that agree on one of `sketches` and are of like length are candidates; word-level edit distance in a band of the
allowed distance decides. Classes are connected components of the links found.

k-mers of five words would not do: where every fifth word is changed, a similarity of 0.8, none is left unchanged. Two
in five of three words are, so that two such texts agree on one of 64 sketches of two k-mers with a chance of 0.98.

Short texts hold too few k-mers for that. Two texts within t edits are equal after up to t deletions from each, so texts
of up to SHORT words also go by all that up to t deletions leave of them: no similar pair of such texts is missed.

Equal texts are one node. In a bucket of up to PAIRED nodes all pairs are candidates. Larger ones are parted by length;
each node goes with the first of two of its buckets, a pair or two a node whatever the group's size. What such buckets
then still hold in different classes is compared in full, in blocks: the words that two texts share bound their
distance from below, what this bound allows and the block hasn't joined yet is aligned, and only links are written, at
most one for each node of a block. Texts that share many buckets make up a family, which takes the place of these
buckets, so that each text is sent and compared once; buckets then serve for pairs of different families, and for the
texts of none. So no link between classes that a bucket holds is lost, and no group's pairs are written.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import components as G

SHORT, DELETED = 14, 2
"""Words of a text, and deletions allowed it, up to which what deletions leave is tried: 106 keys at most."""
PAIRED = 6
"""Nodes of a bucket up to which all pairs are candidates."""
BLOCK, BLOCK_WORDS = 1000, 500_000
"""Nodes and words along a side of a block, about."""
DENSE = 16
"""Unsettled buckets from which a node belongs to a family."""
_SEEDS = C.mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SEEDS32 = (_SEEDS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def occurrences(h: np.ndarray) -> np.ndarray:
    """How often each entry occurred before."""
    order = np.argsort(h, kind="stable")
    x = h[order]
    at = np.arange(len(h))
    start = np.maximum.accumulate(np.where(np.r_[True, x[1:] != x[:-1]], at, 0)) if len(h) else at
    out = np.empty(len(h), np.int64)
    out[order] = at - start
    return out


def order_min_hash(words: np.ndarray, sketches: int, picks: int, k: int) -> np.ndarray:
    """The sketches of a text given by its words' hashes. Texts under k words have one k-mer: all their words."""
    sums = C.prefix_sums(words)
    n = max(1, len(words) - k + 1)
    at = np.arange(n)
    grams = C.range_hash(sums, at, np.minimum(at + k, len(words)))
    labelled = (C.mix(grams + occurrences(grams).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty(sketches, np.uint64)
    m = min(picks, n)
    some = max(1, 2_000_000 // n)  # sketches at a time, which bounds the table for long texts
    for j in range(0, sketches, some):
        last = min(j + some, sketches)
        values = labelled ^ _SEEDS32[j:last, None]
        values *= _SEEDS32[j + 1 : last + 1, None]
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        each, chosen = np.arange(last - j), np.empty((last - j, m), np.int64)
        for i in range(m):
            chosen[:, i] = values.argmin(1)
            values[each, chosen[:, i]] = np.uint32(0xFFFFFFFF)
        chosen.sort(1)
        folded = np.arange(j, last, dtype=np.uint64)
        for i in range(m):
            folded = C.mix(folded * _SEEDS[-1] + grams[chosen[:, i]])
        out[j:last] = folded
    return out


def deletions(words: np.ndarray, gone: int) -> np.ndarray:
    """Hashes of all that up to `gone` deletions leave of a text's words, each once."""
    n, out = len(words), []
    for left in range(n, max(0, n - gone) - 1, -1):
        stays = np.array(list(combinations(range(n), left)), np.int64).reshape(comb(n, left), left)
        folded = np.full(len(stays), left, np.uint64)
        for k in range(left):
            folded = C.mix(folded * _SEEDS[-2] + words[stays[:, k]])
        out.append(folded)
    return np.unique(np.concatenate(out))


def normalised(text: str) -> bytes:
    return text.lower().encode()


_SKETCH_DDL = "d long, v long, n int, same long, sketches array<long>"


def _sketcher(sketches: int, picks: int, k: int, similarity: float):
    def sketch(batches):
        C.only_kept(())
        for batch in C.slices(batches):
            texts = [normalised(t) for t in batch["text"].to_pylist()]
            sizes, same, found = [], [], []
            for i, j in C.groups_of(texts, 1 << 21):
                words, first = C.word_hashes(texts[i:j], C.PUNCT)
                sums = C.prefix_sums(words)
                same.append(C.range_hash(sums, first[:-1], first[1:]).view(np.int64))
                sizes.append(np.diff(first))
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    keys, gone = order_min_hash(words[a:b], sketches, picks, k), int((1 - similarity) * (b - a) + 1e-9)
                    if 0 < b - a <= SHORT and gone <= DELETED:
                        keys = np.concatenate([keys, deletions(words[a:b], gone)])
                    found.append(keys.view(np.int64))
            arrays = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate(found)) if found else pa.array([], pa.int64()))
            yield pa.record_batch([batch["d"], batch["v"], pa.array(np.concatenate(sizes).astype(np.int32) if sizes else [], pa.int32()), pa.array(np.concatenate(same) if same else [], pa.int64()), arrays], names=["d", "v", "n", "same", "sketches"])

    return sketch


def banded_distance(a: list[int], b: list[int], limit: int) -> int:
    """The edit distance of a and b, or limit + 1 if it is larger.

    Rows of a bit-parallel alignment, held to the band of diagonals within `limit` of the main one.
    """
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[len(a) - 1 - j] == b[len(b) - 1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > limit:
        return limit + 1
    if not m:
        return n
    places: dict[int, int] = {}
    for at, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << at
    # Column j of b; bit t of the words below is row (base + t) of a, where the band of this column is [base, base + size).
    base, size = 0, min(n, limit + 1)  # the band's rows
    positive, negative = (1 << size) - 1, 0
    score = size  # the distance at the band's lowest row
    for j in range(m):
        top = max(0, j - limit)
        if top > base:  # the band's first row leaves it
            positive >>= 1
            negative >>= 1
            size -= 1
            base = top
        low = min(n, j + limit + 1)
        while base + size < low:  # a row joins below; in the column before it stood one further at best
            positive |= 1 << size
            size += 1
            score += 1
        mask = (1 << size) - 1
        eq = (places.get(b[j], 0) >> base) & mask
        x = eq | negative
        d0 = ((((eq & positive) + positive) ^ positive) | x) & mask
        hp = (negative | ~(d0 | positive)) & mask
        hn = d0 & positive
        last = 1 << (size - 1)
        if hp & last:
            score += 1
        elif hn & last:
            score -= 1
        hp = (hp << 1 | 1) & mask
        hn = (hn << 1) & mask
        positive = (hn | ~(d0 | hp)) & mask
        negative = hp & d0
    return score if score <= limit else limit + 1


def least_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: the words of the longer text without a partner in the other."""
    entries, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    return max(len(a), len(b)) - int(np.minimum(np.bincount(flat[: len(a)], minlength=len(entries)), np.bincount(flat[len(a) :], minlength=len(entries))).sum())


def edit_similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two texts, as numbers of their words, are similar; they are aligned only where the words shared allow it."""
    most, least = max(len(a), len(b)), min(len(a), len(b))
    limit = int((1 - similarity) * most + 1e-9)
    if most - least > limit:
        return False
    differ = np.flatnonzero(a[:least] != b[:least])
    i = int(differ[0]) if len(differ) else least
    differ = np.flatnonzero(a[len(a) - least + i :][::-1] != b[len(b) - least + i :][::-1])
    j = int(differ[0]) if len(differ) else least - i
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if max(len(a), len(b)) <= limit:
        return True
    return least_distance(a, b) <= limit and banded_distance(a.tolist(), b.tolist(), limit) <= limit


def _verify(similarity: float):
    def words(text: str) -> np.ndarray:
        return C.word_hashes([normalised(text)], C.PUNCT)[0]

    def verify(batches):
        C.only_kept(())
        known: list = [None] * 4
        for batch in C.slices(batches, 250):
            good = []
            for u, v, a, b in zip(*(batch[x].to_pylist() for x in ("u", "v", "left", "right")), strict=True):
                if known[0] != u:
                    known[:2] = u, words(a)
                if known[2] != v:
                    known[2:] = v, words(b)
                good.append(edit_similar(known[1], known[3], similarity))
            yield pa.Table.from_batches([batch]).select(["u", "v"]).filter(pa.array(good)).combine_chunks().to_batches()[0] if any(good) else pa.record_batch([pa.array([], pa.int64())] * 2, names=["u", "v"])

    return verify


def word_bags(words: np.ndarray) -> np.ndarray:
    """A text's words, numbered by occurrence, as 32-bit hashes: two texts share at most as many words as entries."""
    return np.sort((C.mix(words + occurrences(words).astype(np.uint64) * _SEEDS[0]) >> np.uint64(32)).astype("<u4"))


def _word_rows(batches):
    C.only_kept(())
    for batch in C.slices(batches):
        texts, found = [normalised(t) for t in batch["text"].to_pylist()], []
        for i, j in C.groups_of(texts, 1 << 21):
            words, first = C.word_hashes(texts[i:j], C.PUNCT)
            words = (words >> np.uint64(32)).astype("<u4")
            found += [words[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.record_batch([batch["same"], pa.array(found, pa.binary())], names=["same", "words"])


def least_distances(bag: np.ndarray, bags: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Lower bounds of the edit distances of one text to others: the words of the longer without a partner.

    Entries are numbers under `size`; text k has bags[first[k]:first[k + 1]], which isn't empty.
    """
    here = np.bincount(bag, minlength=size)
    # An entry that stands twice in a bag, by a clash of hashes, is matched as often: the bound stays one.
    shared = np.add.reduceat(here[bags], first[:-1])
    return np.maximum(np.diff(first), len(bag)) - shared


def _linker(similarity: float):
    """Links (u, v) between nodes of a block of different classes, one where several would join the same classes.

    A pair is compared in the first bucket that holds both, by number, and not again by others; nor is one of a unit.
    """

    def link(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        same, root, unit, row, column, outside = (block[c].to_numpy() for c in ("same", "root", "unit", "row", "column", "outside"))
        texts = [np.frombuffer(x, "<u4") for x in block["words"].to_pylist()]
        n = np.array([len(x) for x in texts])
        mine, bucket = block["mine"].chunk(0), block["bucket"][0].as_py()
        sizes, none = mine.value_lengths().to_numpy(), np.iinfo(np.int64).max
        buckets = np.full((len(sizes), sizes.max()), none)
        buckets[np.arange(sizes.max()) < sizes[:, None]] = mine.flatten().to_numpy()
        entries, flat = np.unique(np.concatenate([word_bags(x.astype(np.uint64)) for x in texts]), return_inverse=True)
        ends, others = np.r_[0, np.cumsum(n)], np.flatnonzero(column)
        us, vs, top = [], [], {r: r for r in root.tolist()}

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        if len(others):
            theirs, first = flat[np.repeat(column, n)], np.r_[0, np.cumsum(n[others])]
            for i in np.flatnonzero(row):
                least = least_distances(flat[ends[i] : ends[i + 1]], theirs, first, len(entries))
                limit = ((1 - similarity) * np.maximum(n[others], n[i]) + 1e-9).astype(np.int64)
                # Two nodes outside the largest class meet both ways round; one of them counts.
                at = others[(least <= limit) & (root[others] != root[i]) & (unit[others] != unit[i]) & ~(outside[others] & (same[others] < same[i]))]
                at = at[np.where(np.isin(buckets[at], buckets[i, : sizes[i]]), buckets[at], none).min(1) == bucket]
                for k in at.tolist():
                    a, b = find(int(root[i])), find(int(root[k]))
                    if a != b and edit_similar(texts[i], texts[k], similarity):
                        top[max(a, b)] = min(a, b)
                        us.append(min(same[i], same[k]))
                        vs.append(max(same[i], same[k]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return link


def _with_roots(held: DataFrame, roots: DataFrame) -> DataFrame:
    return held.join(roots, "same", "left").withColumn("root", F.coalesce("root", "same"))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(same, root) once links, of any nodes, join the classes of roots."""
    ends = links.join(roots.toDF("u", "ru"), "u", "left").join(roots.toDF("v", "rv"), "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    tops = G.components(ends).toDF("root", "top")
    new = tops.select(F.col("root").alias("same"), F.col("top").alias("root")).join(roots, "same", "left_anti")
    return C.cut(roots.join(tops, "root", "left").select("same", F.coalesce("top", "root").alias("root")).unionByName(new), "roots")


def _candidates(groups: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, w) of like length of the buckets (bucket, same, n, size, leader).

    All pairs of buckets up to PAIRED; of larger ones each node with the first and the last of its buckets' leaders.
    """
    like = lambda a, b: F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9
    pairs = groups.where(F.col("size") <= PAIRED).groupBy("bucket").agg(F.collect_list(F.struct("n", "same")).alias("m"))
    later = lambda u: F.filter("m", lambda w: (w["same"] > u["same"]) & like(u["n"], w["n"]))
    pairs = pairs.select(F.explode(F.flatten(F.transform("m", lambda u: F.transform(later(u), lambda w: F.struct(u["same"].alias("u"), w["same"].alias("w")))))))
    star = groups.where((F.col("size") > PAIRED) & (F.col("same") != F.col("leader.same"))).where(like(F.col("n"), F.col("leader.n")))
    star = star.groupBy("same").agg(F.min("leader").alias("a"), F.max("leader").alias("b"))
    star = star.select("same", F.explode(F.array_distinct(F.array("a.same", "b.same"))).alias("leader"))
    return pairs.select("col.*").unionByName(star.select(F.least("same", "leader").alias("u"), F.greatest("same", "leader").alias("w"))).distinct()


def _work(held: DataFrame) -> DataFrame:
    """For each bucket of several kinds: (main, size, out, words, words_out) of its largest kind, all its nodes, and those outside it."""
    kinds = held.groupBy("bucket", "kind").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    kinds = kinds.groupBy("bucket").agg(F.max(F.struct("c", "kind", "w")).alias("main"), F.sum("c").alias("size"), F.sum("w").alias("words"))
    return kinds.where("main.c < size").select("bucket", F.col("main.kind").alias("main"), "size", (F.col("size") - F.col("main.c")).alias("out"), "words", (F.col("words") - F.col("main.w")).alias("words_out"))


def _families(unsettled: DataFrame) -> DataFrame:
    """(same, unit): the families among the nodes of unsettled buckets (bucket, same, n, root, size, leader).

    Nodes that sit in DENSE buckets or more are much alike. Those that share leaders are a family, where comparing it in
    full takes no more than comparing each of its buckets.
    """
    per = unsettled.groupBy("same").agg(F.count("*").alias("buckets"), F.sum("size").alias("each"))
    edges = unsettled.join(per.where(F.col("buckets") >= DENSE), "same", "left_semi").select(F.col("leader.same").alias("u"), F.col("same").alias("v")).distinct()
    family = G.components(edges).toDF("same", "unit")
    whole = family.join(per, "same").groupBy("unit").agg(F.count("*").alias("n"), F.sum("each").alias("each")).where(F.col("n") * F.col("n") <= F.col("each"))
    return family.join(whole, "unit", "left_semi").select("same", "unit")


def _in_blocks(held: DataFrame, texts: DataFrame, similarity: float) -> DataFrame | None:
    """Links between nodes of a bucket (bucket, same, n, root, unit, family) that differ in class and unit. None where there are no such nodes.
    family: the bucket is a family, whose members are units of their own in it.

    Nodes outside a bucket's largest class or unit, in rows of blocks, meet all of its nodes, in columns of blocks.
    """
    held = C.cut(held.withColumn("kind", F.when(F.col("unit") != F.col("same"), F.col("unit")).otherwise(F.col("root"))), "held")
    blocks = lambda nodes, words: F.ceil(F.greatest(F.col(nodes) / BLOCK, F.col(words) / BLOCK_WORDS)).cast("int")
    placed = C.cut(held.join(_work(held).select("bucket", "main", blocks("out", "words_out").alias("high"), blocks("size", "words").alias("wide")), "bucket"), "unsettled")
    if placed.isEmpty():
        return None
    words = texts.join(placed.select("same").distinct(), "same", "left_semi").mapInArrow(_word_rows, "same long, words binary")
    mine = placed.groupBy("same").agg(F.collect_list(F.when(~F.col("family"), F.col("bucket"))).alias("mine"))  # two a sketch, or key of a short text, at most
    placed = placed.join(words.join(mine, "same"), "same").withColumn("mine", F.when(F.col("family"), F.array("bucket")).otherwise(F.col("mine"))).withColumn("outside", F.col("kind") != F.col("main"))
    place = lambda k, blocks: F.pmod(F.xxhash64("same", F.lit(k)), blocks).cast("int")
    every = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    at = lambda i, j, row, column: F.struct(i.alias("i"), j.alias("j"), F.lit(row).alias("row"), F.lit(column).alias("column"))
    i, j = place(0, F.col("high")), place(1, F.col("wide"))
    # A node's blocks: its row of them if it is outside, its column, and the one where they meet only once.
    own = F.array(at(i, j, True, True))
    row = F.filter(F.transform(every("wide"), lambda x: at(i, x, True, False)), lambda x: x["j"] != j)
    column = F.filter(F.transform(every("high"), lambda x: at(x, j, False, True)), lambda x: x["i"] != i)
    spread = F.when(F.col("outside"), F.concat(own, row, column)).otherwise(F.transform(every("high"), lambda x: at(x, j, False, True)))
    placed = placed.select("bucket", "same", "root", "unit", "words", "mine", "outside", F.explode(spread).alias("at")).select("*", "at.*").drop("at")
    return placed.groupBy("bucket", "i", "j").applyInArrow(_linker(similarity), "u long, v long").distinct()


def near_classes(docs: DataFrame, similarity: float = 0.8, sketches: int = 64, picks: int = 2, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: d, v, class_id (the smallest id of the class), class_size (rows), links (of its text), class_v
    (the checksum v of the smallest id's text, as several classes may hold one id).

    Similarity is 1 - edit distance / words of the longer text, over words in lower case without punctuation. A null
    text is empty; texts without words are one class. Rows that repeat an id and text are in one class. A null id is
    the smallest. No other columns are read. links counts the links that were verified: of a bucket of over PAIRED
    texts only as many as its classes need.
    """
    spark = docs.sparkSession
    C.ship(spark)
    rows = C.keyed(docs, id_col, text_col)
    with C.scratch(spark):  # sketches are the largest table, and go once they are dealt out
        table = C.cut(rows.mapInArrow(_sketcher(sketches, picks, k, similarity), _SKETCH_DDL), "sketches")
        members = C.cut(table.select("d", "v", "same"), "members", lasting=True)
        # One node for texts of equal words: the smallest id, with its checksum; other copies are members only.
        whole = C.cut(table.groupBy("same").agg(F.min(F.struct("d", "v", "n", "sketches")).alias("x"), F.count("*").alias("rows")).select("same", "x.*", "rows"), "whole")
        nodes = C.cut(whole.drop("sketches"), "nodes", lasting=True)
        keys = whole.where("n > 0").select("same", "n", F.explode("sketches").alias("bucket"))
        keys = C.cut(keys.join(keys.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket"), "buckets", lasting=True)
    C.release(spark)
    # Texts of like length share one of two neighbouring classes of length, by which large buckets are parted.
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(-float(np.log(similarity))) + F.lit(1e-9))
    parted = keys.where(F.col("size") > PAIRED).select("same", "n", F.explode(F.array(F.xxhash64("bucket", step), F.xxhash64("bucket", step + 1))).alias("bucket"))
    sizes = parted.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("n", "same")).alias("leader")).where("size > 1")
    parted = C.cut(parted.join(sizes, "bucket"), "parted")
    large = parted.where(F.col("size") > PAIRED)
    small = keys.where(F.col("size") <= PAIRED).withColumn("leader", F.lit(None).cast(parted.schema["leader"].dataType))
    pairs = C.cut(_candidates(small.unionByName(parted), similarity), "pairs")
    wanted = pairs.select(F.explode(F.array("u", "w")).alias("same")).unionByName(large.select("same")).distinct()
    wanted = C.cut(nodes.join(wanted, "same", "left_semi").select("same", "d", "v"), "wanted")
    texts = C.cut(rows.join(C.small(wanted, 24), ["d", "v"]).dropDuplicates(["same"]).select("same", "text"), "texts")
    C.release(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        sided = pairs.join(texts.toDF("u", "left"), "u").join(texts.toDF("w", "right"), "w").select("u", F.col("w").alias("v"), "left", "right")
        return C.cut(sided.mapInArrow(_verify(similarity), "u long, v long"), "links")

    links = verified(pairs)
    roots = G.components(links).toDF("same", "root")
    held = _with_roots(large.select("bucket", "same", "n", "size", "leader"), roots)
    open_ = C.cut(held.join(held.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high"), "bucket", "left_semi"), "open")
    if not open_.isEmpty():
        some = C.cut(texts.join(open_.select("same").distinct(), "same", "left_semi"), "some")
        units = C.cut(_families(open_), "units")
        families = open_.select("same", "n").distinct().join(units, "same").select(F.col("unit").alias("bucket"), "same", "n", F.col("same").alias("unit"), F.lit(True).alias("family"))
        buckets = open_.select("bucket", "same", "n").join(units, "same", "left").select("bucket", "same", "n", F.coalesce("unit", "same").alias("unit"), F.lit(False).alias("family"))
        more = _in_blocks(_with_roots(families.unionByName(buckets), roots), some, similarity)
        # Blocks hold 32 bits of each word's hash; what they find is looked at once more.
        if more is not None and not (more := verified(more.toDF("u", "w"))).isEmpty():
            links, roots = links.unionByName(more), _joined(roots, more)
    degree = links.select(F.explode(F.array("u", "v")).alias("same")).groupBy("same").agg(F.count("*").alias("links"))
    labelled = _with_roots(nodes.select("same", "d", "v", "rows"), roots)
    classes = labelled.groupBy("root").agg(F.min(F.struct("d", "v")).alias("first"), F.sum("rows").alias("class_size"))
    labelled = labelled.select("same", "root").join(classes, "root").join(degree, "same", "left").select("same", F.col("first.d").alias("class_id"), F.col("first.v").alias("class_v"), "class_size", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(labelled, "same").select("d", "v", "class_id", "class_size", "links", "class_v")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class: the one with the smallest id; all columns kept, whatever their names.

    Of rows that repeat that id and text (null is the empty text) one stays; of different texts under that id in one
    class, the smallest checksum's. An empty table stays empty.
    """
    with C.scratch(docs.sparkSession):
        classes = near_classes(docs, id_col=id_col, text_col=text_col, **options)
        found = C.cut(classes.select("d", "v", (F.col("d").eqNullSafe(F.col("class_id")) & (F.col("v") == F.col("class_v"))).alias("first")), "classes", lasting=True)
    C.release(docs.sparkSession)
    wide, column = C.by_position(docs)
    own = C.keyed_columns(column[id_col], column[text_col])
    wide = wide.withColumns({"d": own["d"], "v": own["v"]})
    if found.where("first").groupBy("d", "v").count().where("count > 1").limit(1).count():
        out = wide.join(found.where("first").select("d", "v"), ["d", "v"], "left_semi").dropDuplicates(["d", "v"])
    else:
        out = wide.join(C.small(found.where("not first").select("d", "v")), ["d", "v"], "left_anti")
    return out.drop("d", "v").toDF(*docs.columns)


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(C.id_back().alias("doc_id"), C.id_back("class_id").alias("class_id"), "class_size", "links", (F.col("d") == F.col("class_id")).alias("kept"))

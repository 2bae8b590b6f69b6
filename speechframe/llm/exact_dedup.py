"""Exact dedup through an extendible-hash index on shared files.

1. Scan: every row's normalised text is hashed (xxh64) and digested (SHA-256). Within a batch equal texts collapse
   into one entry, so a group that holds a third of all rows sends one entry per batch, not one per row.
   Entries go to the shared folder as the pages of the index; their text is stored deflated, once per entry.
2. Directory: from the histogram of hash prefixes (a bounded number of counters), the directory doubles until no
   bucket that can be split holds more than `bucket_bytes`.
3. Owners: each task owns a range of keys, buckets that follow each other, reads their entries in hash order, and chains entries of equal hash, comparing
   bytes. A chain holds the different texts of one hash value only, and of a group's entries just the ids.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MAX_DEPTH = 20
_ENTRY = pa.schema([("d", pa.int64()), ("row", pa.int64()), ("h", pa.int64()), ("entry", pa.int64()), ("sha", pa.string()), ("rows", pa.int64()), ("top", pa.int64()), ("top_row", pa.int64()), ("page", pa.binary())])
_ENTRY_DDL = "d long, row long, h long, entry long, sha string, rows long, top long, top_row long, page binary"


def _scan(batches):
    C.only_kept(())
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        ids, rows, texts = batch["d"].to_pylist(), batch["row"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()
        same: dict[bytes, list[int]] = defaultdict(list)
        for i, t in enumerate(texts):
            same[t.lower()].append(i)  # bytes.lower() changes A-Z only
        out: list[list] = [[] for _ in _ENTRY]
        for text, members in same.items():
            h = xxhash.xxh64_intdigest(text) - 2**63
            sha, best = hashlib.sha256(text).hexdigest(), max(members, key=lambda i: (ids[i], -i))
            for k, i in enumerate(members):
                row = (ids[i], rows[i], h, rows[members[0]], sha, 0 if k else len(members), ids[best], rows[best], None if k else squeeze(text))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(out, _ENTRY, strict=True)], schema=_ENTRY)


def directory(counts: dict[int, int], depth: int, limit: int) -> list[tuple[int, int]]:
    """(prefix, local depth) of each bucket, in key order: buckets over `limit` split until `depth` bits are used.

    counts: by the first `depth` bits of the hash. The global depth is the largest local depth that results.
    """
    levels = [dict(counts)]
    for _ in range(depth):
        up: dict[int, int] = defaultdict(int)
        for prefix, n in levels[-1].items():
            up[prefix >> 1] += n
        levels.append(dict(up))
    levels.reverse()
    out, open_ = [], [(0, 0)]
    while open_:
        prefix, local = open_.pop()
        if local < depth and levels[local].get(prefix, 0) > limit:
            open_ += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
        else:
            out.append((prefix, local))
    return out


_OWNED = ("h", "entry", "rows", "top", "top_row", "page")
_GROUP = pa.schema([("entry", pa.int64()), ("keep", pa.int64()), ("size", pa.int64()), ("keep_row", pa.int64())])


def _own(batches):
    """Entries in order of hash: chain those of one hash, and give each entry its group's result."""
    now, chain, inflate = None, [], zstandard.ZstdDecompressor().decompress

    def results():
        rows = [(e, top, size, top_row) for _, entries, top, top_row, size in chain for e in entries]
        return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=_GROUP)

    for batch in batches:
        done = []
        for h, entry, rows, top, top_row, page in zip(*(batch[x].to_pylist() for x in _OWNED), strict=True):
            if h != now:
                if chain:
                    done.append(results())
                now, chain = h, []
            for link in chain:
                if link[0] == page or inflate(link[0]) == inflate(page):  # by bytes; pages may be deflated unlike
                    link[1].append(entry)
                    link[2], link[3] = max((link[2], link[3]), (top, top_row), key=lambda x: (x[0], -x[1]))
                    link[4] += rows
                    break
            else:
                chain.append([page, [entry], top, top_row, rows])
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
    if chain:
        yield results()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 1 << 20) -> DataFrame:
    """One row per row of docs: d, keep (the id that stays), group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when identical after lower-casing A-Z; a null text is the empty text, which is a text like any
    other. Of equal texts the row with the largest id stays (a null id is the smallest); of rows that repeat that
    id as well, exactly one stays. An empty table gives an empty result; other columns are not read.
    """
    C.ship(docs.sparkSession)
    rows = C.keyed(docs, id_col, text_col).select("d", "text", F.monotonically_increasing_id().alias("row"))
    pages = C.cut(rows.mapInArrow(_scan, _ENTRY_DDL), "pages")
    entries = pages.where(F.col("rows") > 0)

    prefix = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(2**63))), 64 - MAX_DEPTH)
    sizes = entries.select("h", F.octet_length("page").alias("b"))
    total = sizes.agg(F.sum("b")).first()[0] or 0
    # At most 2**16 buckets, and 16 counters for each: the most that the driver ever holds.
    bucket_bytes = max(bucket_bytes, total >> 16)
    depth = min(MAX_DEPTH, max(1, (8 * total // bucket_bytes).bit_length()))
    at = F.shiftright(prefix, MAX_DEPTH - depth)
    counts = dict(zip(*sizes.groupBy(at.alias("p")).agg(F.sum("b").alias("b")).toArrow().to_pydict().values(), strict=True))
    buckets = directory(counts, depth, bucket_bytes)

    spark = docs.sparkSession
    # The directory: each prefix of `depth` bits that occurs, and its bucket. Bounded by 2**MAX_DEPTH rows.
    where, k = [], 0
    for p in sorted(counts):
        while k + 1 < len(buckets) and (buckets[k + 1][0] << (depth - buckets[k + 1][1])) <= p:
            k += 1
        where.append((p, k))
    table = spark.createDataFrame(where or [(0, 0)], "p long, bucket int")
    # Buckets are numbered in order of their keys: each owner gets a range of keys.
    owners = min(len(buckets), int(spark.conf.get("spark.sql.shuffle.partitions")))
    owned = (
        entries.select(*_OWNED, at.alias("p"))
        .join(F.broadcast(table), "p")
        .repartitionById(owners, F.floor(F.col("bucket") * F.lit(owners) / F.lit(len(buckets))).cast("int"))
        .sortWithinPartitions("bucket", "h", "entry")
        .select(*_OWNED)
    )
    groups = owned.mapInArrow(_own, "entry long, keep long, size long, keep_row long")
    found = pages.select("d", "row", "entry", "sha").join(groups, "entry")
    return found.select("d", "keep", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text a row that stays has; all columns kept, whatever their names.

    Of rows that repeat the largest id and the text, in either case of A-Z (null is the empty text), one comes out.
    An empty table stays empty.
    """
    with C.scratch(docs.sparkSession):
        groups = exact_groups(docs, id_col, text_col).select("d", F.unhex("text_sha256").alias("sha"), "kept", (F.col("d") == F.col("keep")).alias("same_id"))
        found = C.cut(groups, "groups", lasting=True)
    C.release(docs.sparkSession)
    wide, column = C.by_position(docs)
    own = C.keyed_columns(column[id_col], column[text_col])
    lower = F.translate(own["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wide = wide.withColumns({"d": own["d"], "sha": F.unhex(F.sha2(lower.cast("binary"), 256))})
    if found.where("same_id and not kept").limit(1).count():
        out = wide.join(found.where("kept").select("d", "sha"), ["d", "sha"], "left_semi").dropDuplicates(["d", "sha"])
    else:
        out = wide.join(C.small(found.where("not kept").select("d", "sha"), 100), ["d", "sha"], "left_anti")
    return out.drop("d", "sha").toDF(*docs.columns)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(C.id_back().alias("doc_id"), C.id_back("keep").alias("keep_id"), "group_size", "kept", "text_sha256")

"""Shards of near equal bytes by a minimax contiguous partition.

Documents of equal text are an atomic group. Groups larger than an equal share of what the others leave come first, the
largest before, each in a shard of its own; the others are ordered by a hash of the text. The smallest capacity for
which the ordered groups fit into the shards is found by binary search, checked by filling shards greedily. Of the cuts
that keep to it, each is the one nearest to an equal share of the rest. The search runs on a summary: hash ranges with their
bytes. Ranges in which a cut may fall, or a large group, are split further until each is one group, so the result is
exact while the driver holds a bounded number of ranges.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

_BLOCK_BITS, _ZOOM_BITS = 12, 8
_SLOT_BITS, _SLOT_CELLS = 10, 4096
"""Rows are numbered within 2**10 ranges of hashes, dealt out further by their rows: so many cells in all, and the cuts."""


def _fill(cells: list[tuple[int, int, int]], capacity: int, shards: int, fluid: bool) -> list[int] | None:
    """Greedy ends, as bytes before each cut; None where more shards are needed. cells: (first hash, last hash, bytes).

    fluid: cells of several groups may be cut anywhere.
    """
    ends, at, room = [], 0, capacity
    for first, last, size in cells:
        if fluid and first != last:
            at += size
            while size > room:
                size -= room
                room = capacity
                ends.append(at - size)
            room -= size
            continue
        if size > capacity:
            return None
        if size > room:
            ends.append(at)
            room = capacity
        room -= size
        at += size
    return ends if len(ends) < shards else None


def _least(cells, shards: int, low: int, high: int, fluid: bool) -> int:
    while low < high:
        mid = (low + high) // 2
        if _fill(cells, mid, shards, fluid) is None:
            low = mid + 1
        else:
            high = mid
    return low


def minimax(cells: list[tuple[int, int, int]], shards: int, zoom) -> tuple[int, list[int]]:
    """The smallest capacity, and the first hash of each shard but the first.

    zoom: gets the cells to split, and returns for each the cells it holds, in order.
    """
    cells = sorted(cells)
    total = sum(x[2] for x in cells)
    while True:
        high = _least(cells, shards, -(-total // shards) if cells else 0, total, False)
        low = _least(cells, shards, -(-total // shards) if cells else 0, high, True)
        early, late = _fill(cells, high, shards, False) or [], _fill(cells, high, shards, True) or []
        least, at = [], 0
        room = low
        for _, _, size in cells:  # as _fill() without the limit on shards
            if size > room:
                least.append(at)
                room = low
            room -= size
            at += size
        spans = [(least[k] if k < len(least) else early[k], max(early[k], late[k] if k < len(late) else total)) for k in range(len(early))]
        open_, at, k = [], 0, 0
        for cell in cells:
            first, last, size = cell
            if first != last and any(a < at + size and at <= b for a, b in spans):
                open_.append(cell)
            at += size
        if not open_ or low == high == 0:
            break
        finer = zoom(open_)
        cells = sorted([x for x in cells if x not in set(open_)] + finer)
    return high, level(cells, shards, high, zoom)


def level(cells: list[tuple[int, int, int]], shards: int, capacity: int, zoom) -> list[int]:
    """The first hash of each shard but the first, where shards keep to the capacity and are as even as that allows.

    A cut goes to the group's edge that is nearest to an equal share of what is left, if the rest fits behind it.
    """
    cells, total = sorted(cells), sum(x[2] for x in cells)
    while cells:
        edges = [0]
        for _, _, size in cells:
            edges.append(edges[-1] + size)
        # From behind: where the last shards begin at the earliest, and the ranges that may hold an earlier group's edge.
        earliest, open_, room = [], set(), capacity
        for k in range(len(cells) - 1, -1, -1):
            if cells[k][2] > room:
                earliest.append(edges[k + 1])
                open_.add(k)
                room = capacity
            room -= cells[k][2]
        cuts, done = [], 0
        for left in range(shards - 1, 0, -1):
            low = earliest[left - 1] if left <= len(earliest) else 0
            aim = min(max(done + (total - done) / (left + 1), low), done + capacity)
            k = bisect_right(edges, aim) - 1
            open_ |= {k, bisect_right(edges, done + capacity) - 1}
            fits = [e for e in edges[k : k + 2] if max(done, low) <= e <= done + capacity]
            done = min(fits, key=lambda e: (abs(e - aim), e), default=edges[k])
            cuts.append(done)
        finer = [cells[k] for k in sorted(open_) if k < len(cells) and cells[k][0] != cells[k][1]]
        if not finer:
            return [cells[bisect_left(edges, e)][0] for e in cuts if 0 < e < total]
        cells = sorted([x for x in cells if x not in set(finer)] + zoom(finer))
    return []


def large_groups(cells: list[tuple[int, int, int]], shards: int, zoom) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The groups that get a shard of their own, the largest first, and the other cells, among `shards` less as many."""
    alone: list[tuple[int, int, int]] = []
    cells = sorted(cells)
    while cells and len(alone) < shards - 1:
        share = sum(x[2] for x in cells) / (shards - len(alone))
        if open_ := [x for x in cells if x[2] > share and x[0] != x[1]]:
            finer = zoom(open_)
            cells = sorted([x for x in cells if x not in set(open_)] + finer)
            continue
        most = max(cells, key=lambda x: x[2])
        if most[2] <= share or len(cells) == 1:
            break
        alone.append(most)
        cells.remove(most)
    return alone, cells


def shard_by_bytes(docs: DataFrame, shards: int = 24, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: d, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    size: UTF-8 bytes of the text plus `overhead`; a null text has none and groups with the empty text. Slots are
    gapless from 0 in each shard; rows that repeat an id get a slot each. With fewer groups than shards, some shards
    stay empty; an empty table gives an empty result. A group larger than an equal share gets a shard of its own,
    as groups aren't cut, and the other shards share the rest evenly.
    """
    text = C.text_or_empty(text_col)
    rows = C.cut(
        docs.select(
            F.coalesce(F.col(id_col).cast("long"), F.lit(C.NO_ID)).alias("d"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "sizes",
    )

    def found(grouped) -> list[tuple[int, int, int]]:
        cells = grouped.agg(F.min("h").alias("first"), F.max("h").alias("last"), F.sum("size").alias("size")).toArrow()
        return list(zip(*(cells[c].to_pylist() for c in ("first", "last", "size")), strict=True))

    def zoom(open_):
        """The cells within ranges of hashes, each of which lies in one block: up to 2**_ZOOM_BITS for each."""
        within = [(a >> (64 - _BLOCK_BITS), a, b, ((b - a) >> _ZOOM_BITS) + 1) for a, b, _ in open_]
        within = F.broadcast(rows.sparkSession.createDataFrame(within, "block long, low long, high long, width long"))
        part = rows.join(within, (F.shiftright("h", 64 - _BLOCK_BITS) == F.col("block")) & F.col("h").between(F.col("low"), F.col("high")))
        return found(part.groupBy("low", F.expr("(h - low) div width")))

    cells = found(rows.groupBy(F.shiftright("h", 64 - _BLOCK_BITS)))
    alone, rest = large_groups(cells, shards, zoom)
    _, firsts = minimax(rest, shards - len(alone), zoom)
    shard: Column = F.lit(len(alone))
    for first in firsts:
        shard = shard + (F.col("h") >= F.lit(first)).cast("int")
    for k, (h, _, _) in enumerate(alone):
        shard = F.when(F.col("h") == F.lit(h), F.lit(k)).otherwise(shard)
    # A range of hashes is dealt out by its share of all rows, so that a text of a third of them goes to a third of the cells.
    n = max(1, rows.count())
    blocks = rows.groupBy(F.shiftright("h", 64 - _SLOT_BITS).alias("block")).agg(F.ceil(F.count("*") * _SLOT_CELLS / n).cast("int").alias("salts"))
    place = ["shard", "block", "salt"]
    rows = rows.withColumn("block", F.shiftright("h", 64 - _SLOT_BITS)).join(F.broadcast(blocks), "block")
    rows = rows.select("*", shard.alias("shard"), F.pmod(F.xxhash64("d"), F.col("salts")).cast("int").alias("salt"))
    # At most cells + blocks + shards rows, whatever the input.
    counts = rows.groupBy(*place).count()
    before = Window.partitionBy("shard").orderBy("block", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*place, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy(*place).orderBy("h", "d", "text_crc32")
    return (
        rows.withColumn("n", F.row_number().over(own) - 1)
        .join(F.broadcast(offsets), place)
        .select("d", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("n")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    found = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(C.id_back().alias("doc_id"), "size", "text_crc32", "law", "shard", "slot", "grown_shard")

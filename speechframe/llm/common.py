"""What the corpus operators share: tables cut to the shared folder, document columns, token hashes."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import package

NO_ID = -(2**63)
"""Stands for a null doc_id inside an operator, so that such rows still join and sort first."""


_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """What Python workers need: the package, and batches of 8 MB, as rows may hold very long texts. A size that the session
    sets itself stays."""
    package(spark)
    if spark.conf.get(_ARROW_BYTES, None) is None:
        spark.conf.set(_ARROW_BYTES, str(8 << 20))


# ------------------------------------------------------------------ tables on the shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. One of our own only where none is named and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="speechframe-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_open: list[list[str]] = []  # the tables of each scratch() that is open


def cut(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: later steps neither repeat its work nor hang on its shuffles.

    lasting: the table stays when the scratch() around it ends, and goes with the next one outside, if any.
    """
    path = f"{shared_dir(df.sparkSession)}/speechframe/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    if (level := len(_open) - lasting) > 0:
        _open[level - 1].append(path)
    if grown(df.sparkSession):
        release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables cut inside, but lasting ones, at the end.

    What leaves must have been cut as lasting, as it can't be made again from tables that are gone.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Share of the heap that the driver's JVM may have, from which it is made to collect.
LARGE_HEAP = 0.6


def grown(spark: SparkSession) -> bool:
    """Whether the driver's JVM has taken that much; by itself it takes all before it looks for what a step left."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    return runtime.totalMemory() > LARGE_HEAP * runtime.maxMemory()


def trim(spark: SparkSession) -> bool:
    """What the driver's JVM freed outside its heap, as its compilers do, goes back to the system. False where the JVM
    offers no such thing."""
    jvm, arguments = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        call = arguments(jvm.java.lang.Object, 4)  # no arguments of the command's own
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        return "Trim" in str(invoke.invoke(beans, call))
    except Py4JError:
        return False


def release(spark: SparkSession) -> None:
    """Files of shuffles go when the driver finds that nothing refers to them; else that may be half an hour later. So
    does memory that the driver no longer needs."""
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


#: Bytes up to which a table is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32_000_000


def small(df: DataFrame, row_bytes: int = 16) -> DataFrame:
    """df, to be broadcast if its rows are few enough."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


# ------------------------------------------------------------------ columns


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def keyed_columns(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """d, v, text: the id (null: NO_ID), a checksum that tells apart rows sharing an id, the text (null: empty)."""
    text = text_or_empty(text_col)
    return {"d": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "v": F.crc32(text.cast("binary")).cast("long"), "text": text}


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """keyed_columns() alone, so further columns of any name do no harm."""
    return docs.select(*(column.alias(name) for name, column in keyed_columns(id_col, text_col).items()))


def by_position(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named c0, c1 and so on, and these names by the old ones: none clashes with what is joined."""
    new = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*new), dict(zip(docs.columns, new, strict=True))


def id_back(name: str = "d") -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name))


# ------------------------------------------------------------------ rolling hashes

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n, at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, p in enumerate((_P, _P_INV)):
            steps = np.full(size, p, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(tokens: np.ndarray) -> np.ndarray:
    """S with S[0] = 0 and S[i+1] - S[i] = (tokens[i] + 1) * P**i; see range_hash()."""
    out = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum((tokens.astype(np.uint64) + np.uint64(1)) * powers(len(tokens) + 1)[0][: len(tokens)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of tokens[start:end], wherever it stands."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


#: Separators of words: space, tab, newline, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators where punctuation doesn't count: all of ASCII but letters and digits.
PUNCT = np.ones(256, bool)
PUNCT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def words_of(buf: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte buffer."""
    gap = np.ones(len(buf) + 2, bool)
    gap[1:-1] = separators[buf]
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    return turn[::2], turn[1::2]


def word_hashes(texts: list[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text, and where each text's words begin (one more entry than texts)."""
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    start, end = words_of(buf, separators)
    return range_hash(prefix_sums(buf), start, end), np.searchsorted(start, first)


def groups_of(texts: list[bytes], limit: int = 2_000_000):
    """Slices of a batch whose texts hold about `limit` bytes together; a longer text stands alone, also after empty ones."""
    begin = total = 0
    for i, t in enumerate(texts):
        if i > begin and total + len(t) > limit:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)


# ------------------------------------------------------------------ inside Python workers


def slices(batches, rows: int = 1000):
    """The rows of record batches, `rows` at a time, so that what is made of them stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


_kept: dict[tuple, object] = {}


def give_back() -> None:
    """What was freed goes back to the system, where the C library can do that: a worker's next task shares its
    machine, as do the driver's next steps."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def only_kept(key: tuple, make=None):
    """What a worker keeps from task to task: one thing at a time, as workers go from one operator to the next."""
    if key not in _kept:
        _kept.clear()
        give_back()
        if make:
            _kept[key] = make()
    return _kept.get(key)

"""Removal of passages that stand in an earlier document, by seed and extend.

Seeds are winnowed anchors: equal passages of `window` words share one at the same place (see repeats.py). Documents
that share a seed are extended from it in both directions, word by word, and matches of at least `window` words stay;
each is maximal for its pair. Where very many documents share a seed, the windows around it are looked up instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C
from . import repeats as R

#: Documents that share a seed up to which each pair is extended.
PAIRED = 48


def _extend(kind: R.Kind, paired: int = PAIRED):
    def settle(x: R.Contexts):
        before, window = kind.before, kind.window
        n = len(x.d)
        number: dict[bytes, int] = {}
        words = np.full((n, before + window), -1, np.int32)
        for i, (a, b, c) in enumerate(zip(x.left.tolist(), x.right.tolist(), x.context, strict=True)):
            words[i, before - a : before + b] = [number.setdefault(w, len(number)) for w in c.split(b" ")]
        start, end = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        first = np.flatnonzero(R._new(x.gram))
        size = np.diff(np.r_[first, n])
        left_of, right_of = [], []
        for a, m in zip(first.tolist(), size.tolist(), strict=True):
            if m > paired:
                least: dict[bytes, int] = {}
                for e in range(before + 1):
                    for i in range(a, a + m):  # in order of documents
                        if x.left[i] >= e and x.right[i] >= window - e:
                            key = words[i, before - e : before - e + window].tobytes()
                            if x.d[i] > least.setdefault(key, x.d[i]):
                                start[i] = min(start[i], x.pos[i] - e)
                                end[i] = max(end[i], x.pos[i] - e + window)
                    least.clear()
            elif m > 1:
                i, j = np.triu_indices(m, 1)
                left_of.append(a + i)
                right_of.append(a + j)
        if left_of:
            i, j = np.concatenate(left_of), np.concatenate(right_of)
            earlier = x.d[i] < x.d[j]
            i, j = i[earlier], j[earlier]
            for k in range(0, len(i), 50_000):
                p, q = i[k : k + 50_000], j[k : k + 50_000]
                differ = words[p] != words[q]
                back, ahead = differ[:, :before][:, ::-1], differ[:, before:]
                l = np.minimum(np.where(back.any(1), back.argmax(1), before), np.minimum(x.left[p], x.left[q]))  # noqa: E741
                r = np.minimum(np.where(ahead.any(1), ahead.argmax(1), window), np.minimum(x.right[p], x.right[q]))
                long = l + r >= window
                np.minimum.at(start, q[long], (x.pos[q] - l)[long])
                np.maximum.at(end, q[long], (x.pos[q] + r)[long])
        row = np.flatnonzero(end >= 0)
        return row, start[row], end[row]

    return settle


_KEPT_DDL = "d long, n_words long, n_removed long, kept binary"
_KEPT = pa.schema([("d", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def remove_passages(docs: DataFrame, window: int = 50, gram: int = 8, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """A row per row of docs: d, n_words, n_removed and kept, the words that stay joined by a space (digest: kept_sha256).

    Words are runs of anything but ASCII white space, unchanged. A word goes if `window` consecutive words cover it
    whose sequence also starts in a document with a smaller id; windows are judged on the input. A null text has no
    words; a null id is the smallest. Rows that share an id don't count as earlier for each other.
    """
    kind = R.Kind("word", window, gram, False)
    rows = C.keyed(docs, id_col, text_col)

    def keep(batches):
        for batch in C.slices(batches):
            out: list[list] = [[], [], [], []]
            for d, text, spans in zip(batch["d"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["spans"], strict=True):
                start, end = C.words_of(np.frombuffer(text, np.uint8), C.SPACE)
                words = [text[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]
                kept, at = [], 0
                for a, b in R.merged(spans.values):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                joined = b" ".join(kept)
                for column, v in zip(out, (d, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest().encode() if digest else joined), strict=True):
                    column.append(v)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _KEPT, strict=True)], schema=_KEPT)

    kept = R.with_spans(rows, R.covered_spans(rows, kind, _extend(kind))).mapInArrow(keep, _KEPT_DDL)
    return kept.withColumn("kept", kept.kept.cast("string")).withColumnRenamed("kept", "kept_sha256") if digest else kept


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return found.select(C.id_back().alias("doc_id"), "n_words", "n_removed", "kept_sha256")

"""Quality classifier by co-training two views of a document: its text, and its page's metadata.

Each view has a logistic model. Over some rounds each labels the documents of an unlabelled pool that it is most sure
of, for the other's training set. Then both are calibrated on labelled rows held out from training, combined on the
same rows, and every document is scored. Fitting uses bounded samples; scoring covers all rows in one pass, no shuffle.

This is done for two labels, quality and toxicity, as toxic documents are mostly of good quality otherwise. A document is
accepted if its quality is good and it isn't toxic. For toxicity the text view also sees which beginnings of words
that tell toxic labelled documents from others occur in a text.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_LANGS, _SOURCES = 16, 128
_TEXT_WIDTH, _META_WIDTH = 256 + 8, _LANGS + _SOURCES + 4
_LENGTHS = (4, 6, 8)  # bytes of a word's beginning


def _repeated(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The share of entries of each text that occurred before in it."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, owner))
    again = np.zeros(len(h), bool)
    if len(h) > 1:
        o, x = owner[order], h[order]
        again[1:] = (o[1:] == o[:-1]) & (x[1:] == x[:-1])
    return np.bincount(owner[order], again, minlength=len(first) - 1) / np.maximum(1, np.diff(first))


_LINE = np.zeros(256, bool)
_LINE[0x0A] = True


def text_features(texts: list[bytes]) -> np.ndarray:
    """Shares of each byte, repeated words and lines, words after themselves, lengths of words and lines."""
    out = np.zeros((len(texts), _TEXT_WIDTH), np.float32)
    for a, b in C.groups_of(texts):
        part = texts[a:b]
        sizes = np.array([len(t) for t in part])
        for i, t in enumerate(part):
            out[a + i, :256] = np.sqrt(np.bincount(np.frombuffer(t, np.uint8), minlength=256) / max(1, len(t)))
        words, w = C.word_hashes(part, C.SPACE)
        lines, x = C.word_hashes([t.replace(b"\n", b"\r\n") for t in part], _LINE)
        n, m = np.diff(w), np.diff(x)
        same = np.zeros(len(words))
        if len(words) > 1:
            same[1:] = words[1:] == words[:-1]
        same[w[:-1][n > 0]] = 0
        runs = np.bincount(np.repeat(np.arange(b - a), n), same, minlength=b - a)
        out[a:b, 256:] = np.stack([_repeated(words, w), _repeated(lines, x), runs / np.maximum(1, n), np.log1p(sizes / np.maximum(1, n)), np.log1p(n / np.maximum(1, m)), np.log1p(n), n == 0, np.log1p(m)], 1)
    return out


def beginnings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the beginnings, 4, 6 and 8 bytes long, of all words in lower case (A-Z), and the index of each one's text."""
    buf = np.frombuffer(b"\n".join(t.lower() for t in texts), np.uint8)
    start, end = C.words_of(buf, C.PUNCT)
    sums = C.prefix_sums(buf)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    long = [end - start >= k for k in _LENGTHS]
    hashes = [C.range_hash(sums, start[ok], start[ok] + k) for k, ok in zip(_LENGTHS, long, strict=True)]
    return np.concatenate(hashes), np.concatenate([owner[ok] for ok in long])


def telling_features(texts: list[bytes], telling: np.ndarray) -> np.ndarray:
    """1 where a text holds a word with that beginning, one column for each hash of `telling`, which is sorted."""
    out = np.zeros((len(texts), len(telling)), np.uint8)
    if not len(telling):
        return out
    low = np.zeros(1 << 16, bool)
    low[telling & np.uint64(0xFFFF)] = True
    for a, b in C.groups_of(texts):
        h, owner = beginnings(texts[a:b])
        likely = low[h & np.uint64(0xFFFF)]
        h, owner = h[likely], owner[likely]
        at = np.searchsorted(telling, h).clip(max=len(telling) - 1)
        hit = telling[at] == h
        out[a + owner[hit], at[hit]] = 1
    return out


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Buckets of language and source, the length as the page states it; nulls have features of their own."""
    import xxhash

    out = np.zeros((len(lang), _META_WIDTH), np.float32)
    for column, at, width in ((lang, 0, _LANGS), (source, _LANGS, _SOURCES)):
        place = {x: at + (0 if x is None else 1 + xxhash.xxh32_intdigest(x) % (width - 1)) for x in set(column)}
        out[np.arange(len(column)), [place[x] for x in column]] = 1
    size = np.array([x or 0 for x in n_chars], float).clip(0)
    out[:, -4:] = np.stack([np.log1p(size), np.log1p(size) ** 2 / 10, [x is None for x in n_chars], size == 0], 1)
    return out


@dataclass
class Logistic:
    """A logistic model on standardised features, ridge-penalised, fitted by Newton's method."""

    mean: np.ndarray
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> Logistic:
        mean, spread = x.mean(0, dtype=float), x.std(0, dtype=float)
        scale = np.where(spread > 1e-6, 1 / np.maximum(spread, 1e-6), 0)
        w, penalty = np.zeros(x.shape[1] + 1), np.r_[np.full(x.shape[1], ridge), 1e-6]
        for _ in range(steps):
            gradient, curve = -penalty * w, np.diag(penalty)
            for at in range(0, len(x), 2000):  # rows are widened to doubles some at a time, which bounds the memory
                z = np.c_[(x[at : at + 2000] - mean) * scale, np.ones(len(x[at : at + 2000]))]
                p = 1 / (1 + np.exp(-(z @ w).clip(-30, 30)))
                gradient += z.T @ (y[at : at + 2000] - p)
                curve += (z * (p * (1 - p) + 1e-6)[:, None]).T @ z
            change = np.linalg.solve(curve, gradient)
            w = w + change.clip(-4, 4)
            if np.abs(change).max() < 1e-4:
                break
        return cls(mean, w[:-1] * scale, float(w[-1]))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weights + (self.bias - self.mean @ self.weights)).clip(-30, 30)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    calibrate_text: Logistic
    calibrate_meta: Logistic
    combine: Logistic

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of label 1: combined, by text, by metadata."""
        a = self.calibrate_text.logit(self.text.logit(text)[:, None])
        b = self.calibrate_meta.logit(self.meta.logit(meta)[:, None])
        return _sigmoid(self.combine.logit(np.c_[a, b])), _sigmoid(a), _sigmoid(b)


@dataclass
class Judge:
    """Models of good quality and of toxicity, either None if its labels don't serve, and the beginnings that tell."""

    good: CoTrained | None
    toxic: CoTrained | None
    telling: np.ndarray

    def score(self, texts: list[bytes], meta: np.ndarray) -> tuple[np.ndarray, ...]:
        """Probabilities of good quality (combined, by text, by metadata) and of toxicity; 1 and 0 without a model."""
        text, n = text_features(texts), len(texts)
        good = self.good.score(text, meta) if self.good else (np.ones(n),) * 3
        toxic = self.toxic.score(toxic_view(text, telling_features(texts, self.telling)), meta)[0] if self.toxic else np.zeros(n)
        return *good, toxic


def toxic_view(text: np.ndarray, told: np.ndarray) -> np.ndarray:
    return np.c_[text[:, 256:], told.astype(np.float32)]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = 4, sure: float = 0.95, share: float = 0.05, held: np.ndarray | None = None) -> CoTrained | None:
    """y: 0 or 1. In each round each view hands the other its surest pool documents, at most `share` of the pool and in
    the classes' proportions. Rows that are `held`, else every fourth, calibrate and don't train. None where the labels
    hold one class only."""
    held = np.arange(len(y)) % 4 == 3 if held is None else held
    for part in (held, ~held):
        if part.sum() < 2 or len(set(y[part].tolist())) < 2:
            held = np.zeros(len(y), bool)
    if len(set(y.tolist())) < 2:
        return None
    check = held if held.any() else ~held
    train = ~held
    views = [(text, pool_text), (meta, pool_meta)]
    given: list[dict[int, int]] = [{}, {}]
    models = [Logistic.fit(v[train], y[train]) for v, _ in views]
    good = y[train].mean()
    for _ in range(rounds):
        new: list[dict[int, int]] = [{}, {}]
        for k, (_, pool) in enumerate(views):
            p = _sigmoid(models[k].logit(pool)) if len(pool) else np.zeros(0)
            for label, prob, part in ((1, p, good), (0, 1 - p, 1 - good)):
                most = max(1, int(share * part * len(pool)))
                for i in np.argsort(-prob, kind="stable")[:most].tolist():
                    if prob[i] >= sure and i not in given[1 - k]:
                        new[1 - k][i] = label
        if not (new[0] or new[1]):
            break
        for k, (own, pool) in enumerate(views):
            given[k] |= new[k]
            at = np.array(list(given[k]), int)
            models[k] = Logistic.fit(np.r_[own[train], pool[at]], np.r_[y[train], list(given[k].values())])
    calibrated = [Logistic.fit(m.logit(v[check])[:, None], y[check], ridge=0.1) for m, (v, _) in zip(models, views, strict=True)]
    both = np.stack([c.logit(m.logit(v[check])[:, None]) for c, m, (v, _) in zip(calibrated, models, views, strict=True)], 1)
    return CoTrained(*models, *calibrated, Logistic.fit(both, y[check], ridge=0.1))


def _view_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    has = set(docs.columns)
    column = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind).alias(c)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(C.NO_ID)).alias("d"), C.text_or_empty(text_col).alias("text"), column("lang", "string"), column("source", "string"), column("n_chars", "double"))


def _telling(sample: DataFrame, most: int) -> np.ndarray:
    """Hashes of the `most` beginnings of words that go most with toxic documents, by chi-squared, among the rows that train."""
    known = sample.where("toxic is not null and not held")
    n, bad = known.agg(F.count("toxic"), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    if not 0 < bad < n:
        return np.zeros(0, np.uint64)

    def counted(batches):
        C.only_kept(())
        for rows in C.slices(batches):
            texts, toxic = rows["text"].cast(pa.binary()).to_pylist(), np.array(rows["toxic"].to_pylist())
            for a, b in C.groups_of(texts):
                h, owner = beginnings(texts[a:b])
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])][: len(h)]
                h, owner = h[new], owner[new]
                found, place = np.unique(h, return_inverse=True)
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(np.bincount(place, minlength=len(found))), pa.array(np.bincount(place, toxic[a:b][owner], minlength=len(found)))], names=["h", "n", "bad"])

    of, with_it, both = F.lit(float(n)), F.col("n"), F.col("bad")
    excess = both * of - with_it * F.lit(float(bad))
    chi = excess * excess / (with_it * (of - with_it + 1))
    counts = known.select("text", "toxic").mapInArrow(counted, "h long, n long, bad double").groupBy("h").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = counts.where((excess > 0) & (both >= 3)).orderBy(chi.desc(), "h").limit(most).select("h").collect()
    return np.sort(np.array([r["h"] for r in top], np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", toxic_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 10_000, max_pool: int = 10_000, max_telling: int = 256, rounds: int = 4) -> Judge | None:
    """Fits on about `max_labelled` labelled rows, drawn by a hash of the id, and `max_pool` unlabelled ones, by a hash
    of id and text; twice as many together at most, where many rows repeat an id.

    Labels that are null, or of ids that no document has, don't count; a label column may be missing. Where labels of an
    id differ, it is of bad quality, and toxic. A model is None where no label, or one class, is left, and so is the
    result where both are.
    """
    spark = docs.sparkSession
    C.release(spark)
    C.ship(spark)
    chance = F.pmod(F.xxhash64("d"), F.lit(1_000_000))
    pool_chance = F.pmod(F.xxhash64("d", "text"), F.lit(1_000_000))
    given = lambda c: (F.col(c) >= 0.5 if c in labels.columns else F.lit(None)).cast("double")
    labels = labels.select(F.coalesce(F.col(id_col).cast("long"), F.lit(C.NO_ID)).alias("d"), given(label_col).alias("y"), given(toxic_col).alias("toxic")).where("y is not null or toxic is not null")
    labels = labels.groupBy("d").agg(F.min("y").alias("y"), F.max("toxic").alias("toxic"), F.lit(True).alias("labelled"))
    few = lambda most, n: F.lit(int(1e6 * min(1.0, most / max(1, n))))
    labels = labels.where(chance < few(max_labelled, labels.count()))  # about max_labelled rows of 32 bytes
    views = _view_columns(docs, id_col, text_col).withColumn("chance", pool_chance)
    sample = views.join(F.broadcast(labels), "d", "left").where(F.col("labelled") | (F.col("chance") < few(max_pool, docs.count())))
    sample = sample.withColumn("held", F.pmod(F.xxhash64("text", "d"), F.lit(4)) == 3).drop("chance", "labelled")
    with C.scratch(spark):
        sample = C.cut(sample, "quality-sample")
        telling = _telling(sample, max_telling)

        def features(batches):
            C.only_kept(())
            for b in C.slices(batches):
                texts = b["text"].cast(pa.binary()).to_pylist()
                m = meta_features(b["lang"].to_pylist(), b["source"].to_pylist(), b["n_chars"].to_pylist())
                pack = lambda z: pa.array([row.tobytes() for row in z], pa.binary())
                yield pa.record_batch([b["d"], b["y"], b["toxic"], b["held"], pack(text_features(texts)), pack(telling_features(texts, telling)), pack(m)], names=["d", "y", "toxic", "held", "text", "told", "meta"])

        got = sample.select("d", "y", "toxic", "held", "text", "lang", "source", "n_chars").mapInArrow(features, "d long, y double, toxic double, held boolean, text binary, told binary, meta binary")
        got = got.orderBy(F.xxhash64("d", "text"), "d", "text", "meta").limit(2 * (max_labelled + max_pool))

        def fitted(batches):
            C.only_kept(())
            if held := [b for b in batches if b.num_rows]:
                judge = pickle.dumps(learned(held, telling, rounds))
                C.give_back()
                yield pa.record_batch([pa.array([judge], pa.binary())], names=["judge"])

        # In one task, as the rows are bounded: the driver gets the models alone.
        found = got.mapInArrow(fitted, "judge binary").collect()
    return pickle.loads(found[0]["judge"]) if found else None


def learned(rows: list[pa.RecordBatch], telling: np.ndarray, rounds: int = 4) -> Judge | None:
    """The models by rows (y, toxic, held, text, told, meta), where those without either label are the pool. Empties rows."""
    column = lambda name: [x for b in rows for x in b[name].to_pylist()]
    y, toxic = (np.array([np.nan if v is None else v for v in column(c)]) for c in ("y", "toxic"))
    held = np.array(column("held"), bool)

    def matrix(name: str, kind: type, width: int) -> np.ndarray:
        out, at = np.empty((len(y), width), kind), 0
        for b in rows:
            out[at : at + len(b)] = np.frombuffer(b"".join(b[name].to_pylist()), kind).reshape(len(b), width)
            at += len(b)
        return out

    text, told, meta = matrix("text", np.float32, _TEXT_WIDTH), matrix("told", np.uint8, len(telling)), matrix("meta", np.float32, _META_WIDTH)
    rows.clear()
    pool = np.isnan(y) & np.isnan(toxic)

    def model(view: np.ndarray, label: np.ndarray) -> CoTrained | None:
        known = ~np.isnan(label)
        return co_train(view[known], meta[known], label[known], view[pool], meta[pool], rounds, held=held[known]) if known.any() else None

    good = model(text, y)
    text = toxic_view(text, told)
    bad = model(text, toxic)
    return Judge(good, bad, telling) if good or bad else None


def score(docs: DataFrame, model: Judge | None, cutoff: float = 0.5, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """d, score, text_score, meta_score (of good quality), toxic_score, accepted for every row; with keep, the accepted
    rows of docs instead. Accepted are those of a score of `cutoff` or more and a toxic score below it.

    A null text is empty and null metadata are a value of their own. Without a model every row scores 1, toxic 0. Rows
    that repeat get the same score; columns missing from docs count as null. An empty table gives an empty one.
    """
    C.ship(docs.sparkSession)

    def scored(b):
        s = (model or Judge(None, None, np.zeros(0, np.uint64))).score(b["text"].cast(pa.binary()).to_pylist(), meta_features(b["lang"].to_pylist(), b["source"].to_pylist(), b["n_chars"].to_pylist()))
        return *s, (s[0] >= cutoff) & (s[3] < cutoff)

    if not keep:

        def run(batches):
            C.only_kept(())
            for b in C.slices(batches):
                yield pa.record_batch([b["d"], *map(pa.array, scored(b))], names=["d", "score", "text_score", "meta_score", "toxic_score", "accepted"])

        return _view_columns(docs, id_col, text_col).mapInArrow(run, "d long, score double, text_score double, meta_score double, toxic_score double, accepted boolean")

    names = list(docs.columns)
    wide = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names may clash, be odd or be missing

    def filtered(batches):
        C.only_kept(())
        for b in C.slices(batches):
            column = lambda c, kind: b.column(names.index(c)).cast(kind) if c in names else pa.nulls(b.num_rows, kind)  # noqa: B023, E731
            s = scored({"text": column(text_col, pa.string()).fill_null(""), "lang": column("lang", pa.string()), "source": column("source", pa.string()), "n_chars": column("n_chars", pa.float64())})
            yield from pa.Table.from_batches([b]).filter(pa.array(s[-1])).to_batches()

    return wide.mapInArrow(filtered, wide.schema).toDF(*names)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select(C.id_back().alias("doc_id"), "score", "text_score", "meta_score", "toxic_score", "accepted")

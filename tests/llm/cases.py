"""Documents with all that an operator must stand, and plain versions of the operators."""

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, v string, a long, size int, same int, row int, class_id long, __v long, __d long, __sha string, __id long, __row long, sha string, h long, c0 long, root long, first long"
"""The columns of documents, and some whose names operators use inside."""


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def odd_rows(seed=7, base=40):
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([3, 30, 80, 200])) for _ in range(base)]
    passage = prose(rng, 70)
    texts += [texts[i] for i in (5, 5, 6)] + [texts[5].upper(), texts[6].title()]
    for _ in range(12):  # passages in other surroundings
        texts.append(prose(rng, rng.randint(0, 90)) + " " + passage + "\n" + prose(rng, rng.randint(0, 90)))
    long = texts[-1].split()
    for _ in range(6):  # near copies
        w = list(long)
        for _ in range(max(1, len(w) // 40)):
            w[rng.randrange(len(w))] = "new"
        texts.append(" ".join(w))
    texts += ["", "", " \n\t ", "a", "é" * 130 + "日本語" * 60, "ab" * 400, "x " * 300, passage + " " + passage, "\\ <|endoftext|> ### ’s it's", prose(rng, 30_000, 50_000)]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [(500, None), (501, None), (None, texts[5]), (None, "nobody"), (700, texts[7]), (700, texts[7]), (701, "one id, a text"), (701, "one id, another text")]
    rng.shuffle(rows)
    return [(i, t, rng.choice(["en", None, "de"]), rng.choice(["s", None]), rng.choice([None, 5, -1]), "d", "v", 1, 2, 3, 4) for i, t in rows]


def documents(spark, rows=None):
    """Rows as far as they go; the other columns, whose names clash with those that operators use, are 7."""
    width = SCHEMA.count(",") + 1
    odd = [(*r, *["7" if c.strip().endswith("string") else 7 for c in SCHEMA.split(",")[len(r) : width]]) for r in (odd_rows() if rows is None else rows)]
    return spark.createDataFrame(odd, SCHEMA)


def least(i):
    return -(2**63) if i is None else i


def sha(b):
    return hashlib.sha256(b).hexdigest()


def order_key(i, b):
    import zlib

    return least(i), zlib.crc32(b)


def suffixes(rows, window=100):
    """doc key -> (n_bytes, n_removed, n_spans, sha); rows that repeat an id and text are one document."""
    first, out = {}, {}
    docs = sorted({(*order_key(r[0], (r[1] or "").encode()), (r[1] or "").encode()) for r in rows})
    for i, v, b in docs:
        m = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if first.setdefault(b[p : p + window], (i, v, p)) != (i, v, p):
                m[p : p + window] = b"\1" * window
        spans = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        out[i, b] = (len(b), sum(m), spans, sha(bytes(x for x, y in zip(b, m, strict=True) if not y)))
    return out


def passages(rows, window=50):
    first, out = {}, {}
    for i, t in sorted({(least(r[0]), r[1] or "") for r in rows}):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        m = [0] * len(w)
        for p in range(len(w) - window + 1):
            if first.setdefault(tuple(w[p : p + window]), i) < i:
                m[p : p + window] = [1] * window
        out[i, t] = (len(w), sum(m), sha(" ".join(x for x, y in zip(w, m, strict=True) if not y).encode()))
    return out

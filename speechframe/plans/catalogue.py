"""The queries over the test tables, and the SQL that DuckDB answers each with."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import signal as S
from ..functions import text as X
from ..functions import vectors as V
from ..operators import align, captions, cluster, decode, timeline, windows
from ..sources import transcripts
from .views import view, with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, others rounded to six places, as in the SQL."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(sql: str | None = None, *views: str):
    """Registers a function under its name; views are put before the SQL."""

    def register(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql is not None:
            text = sql if not views else with_views(*views) + (",\n" + sql.strip()[5:] if sql.strip().startswith("WITH ") else "\n" + sql)
            ORACLE_SQL[name] = text
        return f

    return register


# ------------------------------------------------------------------ captions and documents

_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _clock(x: str, mark: str) -> str:
    ms = f"greatest(0, CAST(round({x} * 1000) AS BIGINT))"
    return f"printf('%02d:%02d:%02d{mark}%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"


def _cue(mark: str) -> str:
    times = _clock('"start"', mark) + " || ' --> ' || " + _clock('coalesce("end", "start")', mark)
    return f"(row_number() OVER (PARTITION BY rec ORDER BY seg_idx))::VARCHAR || chr(10) || {times} || chr(10) || {_trim('text')} || chr(10) || chr(10)"


_CUES = "SELECT rec, seg_idx, row_number() OVER (PARTITION BY rec ORDER BY seg_idx) AS cue_no, {0} AS cue FROM v_segments"
_LINE = _trim("text") + " || chr(10)"
_DOCUMENT = "SELECT rec, '{0}' || string_agg(cue, '' ORDER BY seg_idx) AS document FROM (" + _CUES.replace("{0}", "{1}") + ") GROUP BY rec"


@query(_CUES.format(_cue(",")), "v_segments")
def srt_cues(spark, d):
    return captions.cues(view(spark, d, "v_segments"), "srt")


@query(_CUES.format(_cue(".")), "v_segments")
def vtt_cues(spark, d):
    return captions.cues(view(spark, d, "v_segments"), "vtt")


@query(_CUES.format(_LINE), "v_segments")
def txt_lines(spark, d):
    return captions.cues(view(spark, d, "v_segments"), "txt")


@query(_DOCUMENT.format("", _cue(",")), "v_segments")
def srt_document(spark, d):
    return captions.documents(view(spark, d, "v_segments"), "srt")


@query(_DOCUMENT.format("WEBVTT' || chr(10) || chr(10) || '", _cue(".")), "v_segments")
def vtt_document(spark, d):
    return captions.documents(view(spark, d, "v_segments"), "vtt")


@query(_DOCUMENT.format("", _LINE), "v_segments")
def txt_document(spark, d):
    return captions.documents(view(spark, d, "v_segments"), "txt")


@query("SELECT rec, string_agg(text, '' ORDER BY seg_idx) AS text FROM v_segments GROUP BY rec", "v_segments")
def full_text(spark, d):
    return captions.full_text(view(spark, d, "v_segments"))


@query(
    """SELECT rec, 0::BIGINT AS n_speakers, count(*) AS n_chunks, string_agg(text, '' ORDER BY seg_idx) AS text,
  count("end") AS n_ends, arg_max(text, seg_idx) AS last_text FROM v_segments GROUP BY rec""",
    "v_segments",
)
def transcript_json(spark, d):
    """Each document as JSON text, and what its parsed form holds."""
    made = captions.transcripts(view(spark, d, "v_segments")).select("rec", F.to_json("transcript", {"ignoreNullFields": "false"}).alias("json"))
    t = F.from_json("json", captions.TRANSCRIPT)
    back = made.select("rec", t.alias("t"))
    ends = F.size(F.filter("t.chunks", lambda c: F.get(c["timestamp"], 1).isNotNull()))
    return back.select("rec", F.size("t.speakers").alias("n_speakers"), F.size("t.chunks").alias("n_chunks"), "t.text", ends.alias("n_ends"), F.element_at("t.chunks", -1)["text"].alias("last_text"))


@query('SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY seg_idx) - 1 AS seg_idx, text, round("start", 6) AS "start", round("end", 6) AS "end" FROM v_segments', "v_segments")
def json_roundtrip(spark, d):
    made = captions.transcripts(view(spark, d, "v_segments")).select("rec", F.to_json("transcript", {"ignoreNullFields": "false"}).alias("value"))
    return transcripts.segments_of(transcripts.parse_transcripts(made))


@query('SELECT rec, seg_idx, round("start", 6) AS shown_end, round(coalesce("end", 1.7976931348623157e308), 6) AS sort_end FROM v_segments WHERE "end" IS NULL', "v_segments")
def null_end_fallback(spark, d):
    s = view(spark, d, "v_segments").where(F.col("end").isNull())
    return s.select("rec", "seg_idx", X.end_or_start(F.col("start"), F.col("end")).alias("shown_end"), X.end_or_max(F.col("end")).alias("sort_end"))


@query("SELECT doc_id, t AS trimmed, length(t)::BIGINT AS n FROM (SELECT doc_id, " + _trim("chr(8195) || chr(160) || text || chr(12288) || chr(10)") + " AS t FROM documents)")
def unicode_trim(spark, d):
    t = X.unicode_trim(F.concat(F.lit("  "), F.col("text"), F.lit("　\n")))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", t.alias("trimmed"), F.length(t).alias("n"))


@query("""SELECT page_id, url LIKE 'http://%' OR url LIKE 'https://%' AS is_url,
  CASE WHEN contains(n, '.') THEN lower(split_part(n, '.', -1)) END AS extension
FROM (SELECT *, split_part(split_part(split_part(url, '?', 1), '#', 1), '/', -1) AS n FROM pages)""")
def url_parts(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", X.is_url(F.col("url")).alias("is_url"), X.url_extension(F.col("url")).alias("extension"))


_MODELS = ["whisper-large-v3.en", "whisper-tiny.en", "whisper-large-v3", "whisper.en.broken", "my-model-en"]


@query("SELECT name, name LIKE '%.en' AS english_only, CASE WHEN name LIKE '%.en' THEN 'transcribe' ELSE 'translate' END AS task FROM (VALUES " + ", ".join(f"('{m}')" for m in _MODELS) + ") t(name)")
def model_name_rules(spark, d):
    names = spark.createDataFrame([(m,) for m in _MODELS], "name string")
    only = X.is_english_only_model(F.col("name"))
    return names.select("name", only.alias("english_only"), F.when(only, "transcribe").otherwise("translate").alias("task"))


# ------------------------------------------------------------------ signals


def _arrays(spark, d) -> DataFrame:
    rows = view(spark, d, "v_samples").groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s"))
    return rows.select("rec", F.transform("s", lambda x: x["v"]).alias("samples"))


def _long(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("samples").alias("i", "v"))


@query(
    """SELECT n.rec, c.chunk_idx, g.i, round(coalesce(s.v, 0), 6) AS v
FROM (SELECT rec, count(*) AS n FROM v_samples GROUP BY rec) n, LATERAL (SELECT unnest(range((n.n + 15) // 16)) AS chunk_idx) c, (SELECT unnest(range(16)) AS i) g
LEFT JOIN v_samples s ON s.rec = n.rec AND s.pos = c.chunk_idx * 16 + g.i""",
    "v_samples",
)
def chunk_tumbling(spark, d):
    return _long(windows.tumbling_chunks(_arrays(spark, d), 16), "rec", "chunk_idx")


@query("SELECT rec, pos // 2 AS i, round(sum(v) / 2, 6) AS v FROM v_samples GROUP BY rec, pos // 2 HAVING count(*) = 2", "v_samples")
def mono_mix(spark, d):
    return _long(_arrays(spark, d).select("rec", V.mono(F.col("samples"), 2).alias("samples")), "rec")


@query(
    """WITH n AS (SELECT rec, count(*) AS n FROM v_samples GROUP BY rec),
g AS (SELECT rec, n, unnest(range(CAST(ceil(n * 5 / 8) AS BIGINT))) AS i FROM n),
p AS (SELECT *, least(CAST(floor(i * 1.6::DOUBLE) AS BIGINT), n - 1) AS lo, i * 1.6::DOUBLE - floor(i * 1.6::DOUBLE) AS f FROM g)
SELECT p.rec, p.i, round(a.v + p.f * (b.v - a.v), 2) AS v FROM p
JOIN v_samples a ON a.rec = p.rec AND a.pos = p.lo JOIN v_samples b ON b.rec = p.rec AND b.pos = least(p.lo + 1, p.n - 1)""",
    "v_samples",
)
def resample_linear(spark, d):
    rate = F.pandas_udf(lambda s: s.map(lambda x: S.resample(np.asarray(x, float), 8, 5)), "array<double>")
    out = _long(_arrays(spark, d).select("rec", rate("samples").alias("samples")), "rec")
    return out.withColumn("v", F.round("v", 2))


@query("SELECT rec, pos AS i, round(CASE WHEN pos = 0 THEN v ELSE v - 0.97::DOUBLE * lag(v) OVER (PARTITION BY rec ORDER BY pos) END, 6) AS v FROM v_samples", "v_samples")
def preemphasis(spark, d):
    return _long(_arrays(spark, d).select("rec", V.pre_emphasis(F.col("samples")).alias("samples")), "rec")


_SLIDES = """SELECT rec, c AS chunk_idx, c * 4 AS "start", least(10, n - c * 4) AS "length", n
FROM (SELECT rec, n, unnest(range(CASE WHEN n <= 10 THEN 1 ELSE (n - 10 + 3) // 4 + 1 END)) AS c FROM (SELECT rec, count(*) AS n FROM v_samples GROUP BY rec))"""


@query(f'SELECT rec, chunk_idx, "start", "length" FROM ({_SLIDES})', "v_samples")
def sliding_windows(spark, d):
    n = view(spark, d, "v_samples").groupBy("rec").agg(F.count("*").alias("n"))
    return windows.sliding_windows(n, 10, 4)


@query(f'SELECT w.rec, w.chunk_idx, g.i, round(coalesce(s.v, 0), 6) AS v FROM ({_SLIDES}) w, (SELECT unnest(range(10)) AS i) g LEFT JOIN v_samples s ON s.rec = w.rec AND s.pos = w."start" + g.i', "v_samples")
def window_slices(spark, d):
    return _long(windows.window_slices(_arrays(spark, d), 10, 4), "rec", "chunk_idx")


@query("SELECT n, i, round(CASE WHEN n = 1 THEN 1 ELSE 0.54 - 0.46 * cos(2 * pi() * i / (n - 1)) END, 6) AS w FROM (SELECT n, unnest(range(n)) AS i FROM (VALUES (1::BIGINT), (7), (101)) t(n))")
def hamming_weights(spark, d):
    parts = [spark.range(n).select(F.lit(n).alias("n"), F.col("id").alias("i"), V.hamming(F.col("id"), n).alias("w")) for n in (1, 7, 101)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT hz, round(1127 * ln(1 + hz / 700.0::DOUBLE), 6) AS mel, round(700 * (exp(1127 * ln(1 + hz / 700.0::DOUBLE) / 1127) - 1), 6) AS back FROM (SELECT unnest(range(0, 8001, 500)) AS hz)")
def mel_points(spark, d):
    mel = V.hz_to_mel(F.col("id"))
    return spark.range(0, 8001, 500).select(F.col("id").alias("hz"), mel.alias("mel"), V.mel_to_hz(mel).alias("back"))


@query(
    """SELECT b.rec, b.block, k.k, round((power(sum(v * cos(2 * pi() * k.k * j / 8)), 2) + power(sum(v * sin(2 * pi() * k.k * j / 8)), 2)), 4) AS energy
FROM (SELECT rec, pos // 8 AS block, pos % 8 AS j, v, count(*) OVER (PARTITION BY rec, pos // 8) AS n FROM v_samples) b, (SELECT unnest(range(5)) AS k) k
WHERE b.n = 8 GROUP BY b.rec, b.block, k.k""",
    "v_samples",
)
def dft_power(spark, d):
    spectrum = F.pandas_udf(lambda s: s.map(lambda x: S.power_spectrum(np.asarray(x, float), 8)), "array<double>")
    blocks = windows.tumbling_chunks(_arrays(spark, d), 8)
    n = view(spark, d, "v_samples").groupBy("rec").agg(F.count("*").alias("n"))
    blocks = blocks.join(n, "rec").where("start + 8 <= n").select("rec", F.col("chunk_idx").alias("block"), spectrum("samples").alias("samples"))
    return _long(blocks, "rec", "block").select("rec", "block", F.col("i").alias("k"), F.round(F.col("v") * 8, 4).alias("energy"))


@query(
    """WITH e AS (SELECT i, 700 * (exp(i * (1127 * ln(1 + 8000 / 700.0::DOUBLE)) / 9 / 1127) - 1) * 64 / 16000 AS x FROM (SELECT unnest(range(10)) AS i)),
t AS (SELECT l.i AS bin, l.x AS l, c.x AS c, r.x AS r FROM e l JOIN e c ON c.i = l.i + 1 JOIN e r ON r.i = l.i + 2)
SELECT bin, k, round(w, 6) AS w FROM (SELECT bin, k, CASE WHEN k > l AND k <= c THEN (k - l) / (c - l) WHEN k > c AND k < r THEN (r - k) / (r - c) ELSE 0 END AS w
  FROM t, (SELECT unnest(range(33)) AS k)) WHERE w > 0"""
)
def mel_filterbank_cells(spark, d):
    bank = S.mel_filterbank(8, 64, 16_000)
    rows = [(b, k, float(bank[b, k])) for b, k in zip(*np.nonzero(bank > 0), strict=True)]
    return spark.createDataFrame([(int(b), int(k), w) for b, k, w in rows], "bin long, k long, w double")


@query()
def fbank_features(spark, d):
    """Log mel energies of each recording's samples, a row per frame."""
    kind = "array<array<double>>"
    features = F.pandas_udf(lambda s: s.map(lambda x: S.fbank(np.asarray(x, float)).tolist()), kind)
    out = _arrays(spark, d).select("rec", features("samples").alias("f"))
    return out.select("rec", F.posexplode("f").alias("frame", "f")).select("rec", "frame", F.size("f").alias("bins"), F.aggregate("f", F.lit(0.0), lambda s, x: s + x).alias("total"))


# ------------------------------------------------------------------ scores and timelines

_HYST = """h AS (SELECT *, coalesce(last_value(CASE WHEN score > 0.5 THEN 1 WHEN score < 0.5 THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY rec, chunk, speaker ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) = 1 AS active FROM v_scores)"""
_RUNS = _HYST + """,
r AS (SELECT rec, chunk, speaker, min(frame) AS first_frame, max(frame) + 1 AS end_frame FROM (
  SELECT *, frame - row_number() OVER (PARTITION BY rec, chunk, speaker ORDER BY frame) AS island FROM h WHERE active) GROUP BY rec, chunk, speaker, island)"""
_INTERVALS = _RUNS + """,
i AS (SELECT rec, chunk * 25 + first_frame AS "start", chunk * 25 + end_frame AS "end", printf('SPEAKER_%02d', (chunk + speaker) % 3) AS speaker FROM r)"""
_COALESCED = _INTERVALS + """,
m AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY rec, speaker ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM i),
c AS (SELECT rec, min("start") AS "start", max("end") AS "end", speaker FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY rec, speaker ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM m) GROUP BY rec, speaker, island)"""


def _scores(spark, d):
    return view(spark, d, "v_scores")


def _intervals(spark, d):
    runs = timeline.active_runs(windows.hysteresis(_scores(spark, d)))
    ids = runs.select("rec", "chunk", "speaker", ((F.col("chunk") + F.col("speaker")) % 3).alias("global_id")).distinct()
    return timeline.speaker_intervals(runs, ids, 25, 1)


@query(f"WITH {_HYST} SELECT rec, chunk, frame, speaker, active FROM h", "v_scores")
def hysteresis(spark, d):
    return windows.hysteresis(_scores(spark, d)).select("rec", "chunk", "frame", "speaker", "active")


@query("SELECT rec, chunk, frame, speaker, score > 0.5 AS active FROM v_scores", "v_scores")
def threshold_binarize(spark, d):
    return windows.threshold_binarize(_scores(spark, d)).select("rec", "chunk", "frame", "speaker", "active")


_ACTIVITY = "SELECT rec, chunk, speaker, count(*) FILTER (WHERE active) AS active_frames, count(*) AS frames, round(count(*) FILTER (WHERE active) / count(*)::DOUBLE, 6) AS ratio FROM h GROUP BY rec, chunk, speaker"


@query(f"WITH {_HYST} {_ACTIVITY}", "v_scores")
def activity_ratio(spark, d):
    return windows.activity(windows.hysteresis(_scores(spark, d)))


@query(f"WITH {_HYST} {_ACTIVITY} HAVING count(*) FILTER (WHERE active) * 100 >= count(*) * 85", "v_scores")
def min_activity_filter(spark, d):
    return windows.enough_activity(windows.activity(windows.hysteresis(_scores(spark, d))), 85)


@query(
    """SELECT rec, chunk * 25 + frame AS frame, speaker, round(sum(w * score) / sum(w), 6) AS "value"
FROM (SELECT *, 0.54 - 0.46 * cos(2 * pi() * frame / 49) AS w FROM v_scores) GROUP BY 1, 2, 3""",
    "v_scores",
)
def overlap_add(spark, d):
    return windows.overlap_add(_scores(spark, d), 50, 25)


@query(f"WITH {_RUNS} SELECT * FROM r", "v_scores")
def active_runs(spark, d):
    return timeline.active_runs(windows.hysteresis(_scores(spark, d)))


@query(f"WITH {_INTERVALS} SELECT * FROM i", "v_scores")
def speaker_timeline(spark, d):
    return _intervals(spark, d)


@query(f"WITH {_COALESCED} SELECT * FROM c", "v_scores")
def coalesced_intervals(spark, d):
    return timeline.coalesced(_intervals(spark, d))


@query(
    f"""WITH {_COALESCED},
s AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY "start", speaker, "end") AS n FROM c),
f AS (SELECT s.*, p.speaker IS DISTINCT FROM s.speaker AS fresh, last_value(s."end") OVER (PARTITION BY s.rec ORDER BY s.n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final
  FROM s LEFT JOIN s p ON p.rec = s.rec AND p.n = s.n - 1)
SELECT rec, "start", coalesce(lead("start") OVER w, final) AS "end", speaker, row_number() OVER w - 1 AS k FROM f WHERE fresh WINDOW w AS (PARTITION BY rec ORDER BY n)""",
    "v_scores",
)
def collapsed_turns(spark, d):
    return timeline.collapsed(timeline.coalesced(_intervals(spark, d)))


# ------------------------------------------------------------------ tokens and alignment


@query("SELECT rec, chunk, speaker, coalesce(arg_max(frame, (score, -frame)) FILTER (WHERE frame NOT IN (0, 7, 11)), 0) AS token FROM v_scores GROUP BY rec, chunk, speaker", "v_scores")
def token_argmax(spark, d):
    logits = _scores(spark, d).select("rec", "chunk", "speaker", F.col("frame").alias("token"), F.col("score").alias("logit"))
    suppressed = spark.createDataFrame([(0,), (7,), (11,)], "token long")
    return decode.greedy_choice(logits, suppressed, ("rec", "chunk", "speaker"))


@query(
    """WITH a AS (SELECT *, min(CASE WHEN token = 50257 THEN pos END) OVER (PARTITION BY rec, chunk) AS stop FROM v_tokens),
b AS (SELECT *, sum(CASE WHEN token >= 50365 THEN 1 ELSE 0 END) OVER (PARTITION BY rec, chunk ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM a WHERE stop IS NULL OR pos < stop),
g AS (SELECT rec, chunk, g, max(CASE WHEN token >= 50365 THEN (token - 50365) * 0.02::DOUBLE END) AS opened, string_agg(CASE WHEN token < 50365 THEN token::VARCHAR END, ' ' ORDER BY pos) AS tokens, bool_or(stop IS NOT NULL) AS ended FROM b GROUP BY rec, chunk, g),
l AS (SELECT *, lead(opened) OVER (PARTITION BY rec, chunk ORDER BY g) AS close FROM g),
t AS (SELECT *, count(*) OVER (PARTITION BY rec, chunk) AS many FROM l WHERE tokens IS NOT NULL)
SELECT rec, chunk, row_number() OVER (PARTITION BY rec, chunk ORDER BY g) - 1 AS k, tokens,
  round(CASE WHEN close IS NULL AND NOT ended THEN chunk * 30 ELSE coalesce(opened, 0) + chunk * 30 END, 6) AS "start", round(close + chunk * 30, 6) AS "end"
FROM t WHERE close IS NOT NULL OR ended OR many = 1""",
    "v_tokens",
)
def tokens_to_segments(spark, d):
    out = decode.segments_of_tokens(view(spark, d, "v_tokens"))
    return out.withColumn("tokens", F.array_join(F.transform("tokens", lambda t: t.cast("string")), " "))


_ALIGN = """WITH RECURSIVE
u AS (SELECT rec, "end", speaker, row_number() OVER (PARTITION BY rec ORDER BY "start", speaker, "end") AS n FROM v_turns),
s AS (SELECT *, coalesce("end", 1.7976931348623157e308) AS e, row_number() OVER (PARTITION BY rec ORDER BY seg_idx) AS i FROM v_segments),
f AS (
  SELECT rec, 0::BIGINT AS n, 0::BIGINT AS lo, 0::BIGINT AS hi, NULL::VARCHAR AS speaker FROM (SELECT DISTINCT rec FROM u)
  UNION ALL
  SELECT f.rec, u.n, f.hi, (SELECT min_by(s.i, {'dd': abs(s.e - u."end"), 'i': s.i}) FROM s WHERE s.rec = f.rec AND s.i > f.hi), u.speaker
  FROM f JOIN u ON u.rec = f.rec AND u.n = f.n + 1 WHERE EXISTS (SELECT 1 FROM s WHERE s.rec = f.rec AND s.i > f.hi))
SELECT s.rec, s.seg_idx, f.speaker, s.text, round(s."start", 6) AS "start", round(s."end", 6) AS "end" FROM f JOIN s ON s.rec = f.rec AND s.i > f.lo AND s.i <= f.hi"""


def _align_sql() -> str:
    return with_views("v_turns", "v_segments").replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + _ALIGN.partition("WITH RECURSIVE\n")[2]


@query()
def align_transcript(spark, d):
    return align.align(view(spark, d, "v_turns").select("rec", "start", "end", "speaker"), view(spark, d, "v_segments"))


@query()
def align_transcript_long(spark, d):
    """The same by one pass over arrays, for long recordings."""
    return align.align(view(spark, d, "v_turns").select("rec", "start", "end", "speaker"), view(spark, d, "v_segments"), kernel="pandas")


ORACLE_SQL["align_transcript"] = ORACLE_SQL["align_transcript_long"] = _align_sql()


# ------------------------------------------------------------------ vectors and clusters


def _emb(spark, d):
    return view(spark, d, "v_emb")


def _rows(spark, d):
    return cluster.usable_embeddings(_emb(spark, d))


_UNIT = "u AS (SELECT *, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM v_emb), w AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM u)"


@query(f"WITH {_UNIT} SELECT rec, chunk, speaker, g.i AS i, round(CASE WHEN n > 1.1920928955078125e-07 THEN e[g.i + 1] / n ELSE e[g.i + 1] END, 6) AS v FROM w, (SELECT unnest(range(64)) AS i) g", "v_emb")
def l2_normalized(spark, d):
    return cluster.normalized(_emb(spark, d)).select("rec", "chunk", "speaker", F.posexplode("embedding").alias("i", "v"))


_PAIRS = f"{_UNIT}, p AS (SELECT a.rec, a.row_no AS i, b.row_no AS j, 1 - list_dot_product(a.e, b.e) / (a.n * b.n) AS distance FROM w a JOIN w b ON a.rec = b.rec AND a.row_no < b.row_no)"


@query(f"WITH {_PAIRS} SELECT rec, i, j, round(distance, 6) AS distance FROM p", "v_emb")
def cosine_pairs(spark, d):
    return cluster.cosine_pairs(_rows(spark, d))


@query(f"WITH {_PAIRS} SELECT rec, m.i AS i, m.j AS j, round(m.distance, 6) AS distance FROM (SELECT rec, min({{'distance': distance, 'i': i, 'j': j}}) AS m FROM p GROUP BY rec)", "v_emb")
def closest_pair(spark, d):
    return cluster.closest_pair(cluster.cosine_pairs(_rows(spark, d)))


def _lda_matrix() -> np.ndarray:
    """Four rows: row r adds up every fourth dimension from r on."""
    return np.array([[1.0 if k % 4 == r else 0.0 for k in range(64)] for r in range(4)])


@query(
    """WITH x AS (SELECT rec, chunk, speaker, r.r, sum(e.v - 0.01::DOUBLE) AS s FROM v_emb, (SELECT unnest(range(4)) AS r) r,
  LATERAL (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS k) e WHERE e.k % 4 = r.r GROUP BY rec, chunk, speaker, r.r)
SELECT rec, chunk, speaker, r AS i, round(s / sqrt(sum(s * s) OVER (PARTITION BY rec, chunk, speaker)), 6) AS v FROM x""",
    "v_emb",
)
def lda_project(spark, d):
    out = cluster.lda_projected(_emb(spark, d).withColumn("embedding", F.col("embedding").cast("array<double>")), np.full(64, 0.01), _lda_matrix(), 4)
    return out.select("rec", "chunk", "speaker", F.posexplode("embedding").alias("i", "v"))


@query()
def ahc_clusters(spark, d):
    return cluster.cluster_speakers(_rows(spark, d))


@query()
def ahc_num_speakers(spark, d):
    return cluster.cluster_speakers(_rows(spark, d), cluster.ClusterConfig(num=5))


@query()
def ahc_max_speakers(spark, d):
    return cluster.cluster_speakers(_rows(spark, d), cluster.ClusterConfig(threshold=0.01, most=8))


@query()
def distinct_clusters(spark, d):
    return cluster.speaker_counts(cluster.cluster_speakers(_rows(spark, d)))


@query()
def diarize_end_to_end(spark, d):
    """Scores to turns with clustered speakers, and turns to the transcript of the same number."""
    scores = windows.hysteresis(_scores(spark, d))
    ids = cluster.cluster_speakers(cluster.usable_embeddings(_emb(spark, d)), cluster.ClusterConfig(num=3))
    runs = timeline.active_runs(scores).withColumn("chunk", F.col("chunk") % 10)
    turns = timeline.collapsed(timeline.coalesced(timeline.speaker_intervals(runs, ids, 0.5, 0.02)))
    return align.align(turns.select("rec", "start", "end", "speaker"), view(spark, d, "v_segments").select("rec", "seg_idx", "text", "start", "end"))


def speaker_captions(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: aligned segments as subtitle cues that name the speaker."""
    s = align_transcript(spark, d)
    return captions.cues(s.withColumn("text", F.concat(F.lit("["), "speaker", F.lit("] "), F.trim("text"))), "srt")

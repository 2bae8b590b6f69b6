"""Small cases with known results, for each operator."""

import io
import json
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechframe.functions import signal as S
from speechframe.functions import text as X
from speechframe.functions import vectors as V
from speechframe.operators import align, captions, cluster, decode, timeline, windows
from speechframe.operators import backend as B
from speechframe.options import PipelineOptions
from speechframe.plans import pipelines
from speechframe.sources import artifacts, audio, transcripts
from speechframe.streaming import live

SEGMENTS = "rec string, seg_idx long, text string, start double, end double"
TALK = [("a", 0, " Hello world.", 0.0, 2.5), ("a", 1, " How are you?", 2.5, 5.0), ("a", 2, " I am fine.", 5.0, None)]


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "fmt, want",
    [
        ("srt", "1\n00:00:00,000 --> 00:00:02,500\nHello world.\n\n2\n00:00:02,500 --> 00:00:05,000\nHow are you?\n\n3\n00:00:05,000 --> 00:00:05,000\nI am fine.\n\n"),
        ("vtt", "WEBVTT\n\n1\n00:00:00.000 --> 00:00:02.500\nHello world.\n\n2\n00:00:02.500 --> 00:00:05.000\nHow are you?\n\n3\n00:00:05.000 --> 00:00:05.000\nI am fine.\n\n"),
        ("txt", "Hello world.\nHow are you?\nI am fine.\n"),
    ],
)
def test_documents_and_convert(spark, tmp_path, fmt, want):
    segments = spark.createDataFrame(TALK, SEGMENTS)
    assert captions.documents(segments, fmt).first()["document"] == want
    transcripts.write_transcripts(captions.transcripts(segments), str(tmp_path))
    path = tmp_path / "a" / "output.json"
    body = path.read_text()
    assert body.endswith("}\n") and list(json.loads(body)) == ["speakers", "chunks", "text"]
    assert json.loads(body)["chunks"][2]["timestamp"] == [5.0, None]
    out = transcripts.convert_file(str(path), fmt, str(tmp_path / "deep" / "er"))
    assert out.name == f"output.{fmt}" and out.read_text() == want


def test_empty_document_and_refused(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"chunks": []}')
    assert transcripts.convert_file(str(tmp_path / "e.json"), "vtt", str(tmp_path)).read_text() == "WEBVTT\n\n"
    files = spark.createDataFrame([("x", "{}"), ("y", '{"chunks": [{"text": "a", "timestamp": [1]}]}'), ("z", '{"chunks": [{"text": "a", "timestamp": [1, null]}]}')], "rec string, value string")
    parsed = transcripts.parse_transcripts(files)
    assert [r["rec"] for r in transcripts.segments_of(parsed, strict=False).collect()] == ["z"]
    with pytest.raises(Exception, match="no chunks|two timestamps"):
        transcripts.segments_of(parsed).collect()


def test_timestamps_trim_urls(spark):
    for s, want in ((0.0, "00:00:00,000"), (2.5, "00:00:02,500"), (61.123, "00:01:01,123"), (3661.999, "01:01:01,999"), (0.001, "00:00:00,001"), (-1.0, "00:00:00,000"), (360000.0, "100:00:00,000")):
        assert one(spark, X.srt_timestamp(F.col("s")), s=s) == want
        assert one(spark, X.vtt_timestamp(F.col("s")), s=s) == want.replace(",", ".")
    assert one(spark, X.unicode_trim(F.col("s")), s="  　padded text \n") == "padded text"
    base = "https://example.com"
    for path, want in (("/audio.wav", "wav"), ("/audio.MP3", "mp3"), ("/audio.wav?token=abc", "wav"), ("/audio.flac#section", "flac"), ("/noext", None), ("/", None)):
        assert one(spark, X.url_extension(F.col("u")), u=base + path) == want
    for name in ("http_huggingface_co.png", "/data/http_download.mp3"):
        assert one(spark, X.is_url(F.col("u")), u=name) is False


def test_windows(spark):
    cases = {48_000: [(0, 48_000)], 160_000: [(0, 160_000)], 0: [], 8_000: [(0, 8_000)]}
    for n, want in cases.items():
        rows = windows.sliding_windows(spark.createDataFrame([("a", n)], "rec string, n long"), 160_000, 16_000).collect()
        assert [(r["start"], r["length"]) for r in rows] == want
    rows = windows.sliding_windows(spark.createDataFrame([("a", 320_000)], "rec string, n long"), 160_000, 16_000).orderBy("start").collect()
    assert rows[1]["start"] == 16_000 and rows[-1]["start"] + rows[-1]["length"] == 320_000 and len(rows) == 11
    for n, chunks in ((48, 1), (72, 2), (1, 1), (0, 1), (144, 3)):
        got = windows.tumbling_chunks(spark.createDataFrame([("a", [1.0] * n)], "rec string, samples array<float>"), 48).collect()
        assert len(got) == chunks and all(len(r["samples"]) == 48 for r in got) and sum(sum(r["samples"]) for r in got) == n
    assert one(spark, V.padded_slice(F.array(*[F.lit(float(x)).cast("float") for x in (1, 2, 3)]), F.lit(0), 5)) == [1, 2, 3, 0, 0]
    assert S.hamming(1).tolist() == [1.0] and S.hamming(101)[50] == 1 and abs(S.hamming(101)[0] - 0.08) < 1e-9


def scores(spark, rows):
    return spark.createDataFrame([("a", 0, f, 0, x) for f, x in enumerate(rows)], "rec string, chunk int, frame int, speaker int, score double")


def test_hysteresis_and_overlap(spark):
    for values, want in (([0.6, 0.5, 0.4, 0.5], [1, 1, 0, 0]), ([float("nan"), 0.8, float("nan")], [0, 1, 0])):
        got = windows.hysteresis(scores(spark, values)).orderBy("frame").collect()
        assert [int(r["active"]) for r in got] == want
    rows = [("a", c, f, s, x) for c, pair in enumerate([(0.8, 0.2), (0.2, 0.8)]) for f in range(4) for s, x in enumerate(pair)]
    frame = spark.createDataFrame(rows, "rec string, chunk int, frame int, speaker int, score double")
    got = {(r["frame"], r["speaker"]): r["active"] for r in windows.overlap_add(frame, 4, 2, 0.5).collect()}
    assert got[0, 0] and not got[0, 1] and not got[4, 0] and got[4, 1]
    for active, kept in ((2, True), (1, False)):
        rows = [("a", 0, f, 0, f < active) for f in range(10)]
        n = windows.enough_activity(windows.activity(spark.createDataFrame(rows, "rec string, chunk int, frame int, speaker int, active boolean"))).count()
        assert bool(n) is kept


TURNS = "rec string, start double, end double, speaker string"


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(0, 1, "00"), (1, 2, "00"), (2, 3, "00")], [(0, 3, "00")]),
        ([(0, 1.5, "00"), (1.5, 3, "01"), (3, 5, "00")], [(0, 1.5, "00"), (1.5, 3, "01"), (3, 5, "00")]),
        ([(0, 2, "00"), (1.5, 4, "01")], [(0, 1.5, "00"), (1.5, 4, "01")]),
        ([(0, 5, "00")], [(0, 5, "00")]),
        ([(0, 9, "00"), (1, 2, "00")], [(0, 2, "00")]),
        ([], []),
    ],
)
def test_collapse(spark, rows, want):
    frame = spark.createDataFrame([("a", float(s), float(e), p) for s, e, p in rows], TURNS)
    assert [(r["start"], r["end"], r["speaker"]) for r in timeline.collapsed(frame).orderBy("k").collect()] == want


@pytest.mark.parametrize("kernel", ["fold", "pandas"])
@pytest.mark.parametrize(
    "turns, ends, want",
    [
        ([(2.5, "00"), (5, "01")], [2.5, 5], ["00", "01"]),
        ([(3, "00"), (7, "01")], [2.5, 5, 7], ["00", "01", "01"]),
        ([(5, "00"), (10, "00")], [5, None], ["00", "00"]),
        ([(5, "00"), (8, "01")], [2, 4, 6, 8], ["00", "00", "01", "01"]),
        ([(3, "00"), (6, "01"), (10, "00")], [2.8, 5.5, 9], ["00", "01", "00"]),
        ([(1, "00")], [1, 2, 3, 4], ["00"]),
        ([(2, "00"), (9, "01")], [1, None, 8], ["00", "01", "01"]),
        ([], [1.0], []),
    ],
)
def test_align(spark, kernel, turns, ends, want):
    t = spark.createDataFrame([("a", float(k), float(e), s) for k, (e, s) in enumerate(turns)], TURNS)
    s = spark.createDataFrame([("a", k, "x", float(k), None if e is None else float(e)) for k, e in enumerate(ends)], SEGMENTS)
    got = align.align(t, s, kernel).orderBy("seg_idx").collect()
    assert [r["speaker"] for r in got] == want and [r["end"] for r in got] == ends[: len(want)]


def test_timeline(spark):
    def run(active, ids, step, frame):
        rows = [("a", c, f, s, bool(x)) for c, chunk in enumerate(active) for f, pair in enumerate(chunk) for s, x in enumerate(pair)]
        b = spark.createDataFrame(rows, "rec string, chunk int, frame int, speaker int, active boolean")
        a = spark.createDataFrame([("a", *x) for x in ids], "rec string, chunk int, speaker int, global_id int")
        return [(round(r["start"], 6), round(r["end"], 6), r["speaker"]) for r in timeline.coalesced(timeline.speaker_intervals(timeline.active_runs(b), a, step, frame)).orderBy("start", "speaker").collect()]

    assert run([[(1, 0), (1, 0), (0, 0), (0, 0)], [(0, 0), (0, 1), (0, 1), (0, 0)]], [(0, 0, 0), (1, 1, 1)], 1.0, 0.1) == [(0, 0.2, "SPEAKER_00"), (1.1, 1.3, "SPEAKER_01")]
    assert run([[(1,)] * 4, [(1,)] * 4], [(0, 0, 0), (1, 0, 0)], 0.2, 0.1) == [(0, 0.6, "SPEAKER_00")]
    assert run([[(1, 1)] * 4], [], 1.0, 0.1) == []


def naive_linkage(d, config):
    groups = [[i] for i in range(len(d))]
    floor = config.num if config.num is not None else config.least if config.least is not None else 1
    while len(groups) > max(floor, 1):
        best = min(((np.mean([d[x, y] for x in a for y in b]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), key=lambda t: t[0])
        if config.num is None and best[0] > config.threshold and not (config.most is not None and len(groups) > config.most):
            break
        groups[best[1]] += groups.pop(best[2])
    out = np.zeros(len(d), int)
    for k, g in enumerate(sorted(groups, key=min)):
        out[g] = k
    return out.tolist()


def test_average_linkage_like_naive():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(0, 9)
        d = np.zeros((n, n))
        for i in range(n):
            for j in range(i):
                d[i, j] = d[j, i] = rng.choice([0.125, 0.25, 0.5, 0.75, 1.0])
        c = cluster.ClusterConfig(threshold=rng.choice([0.2, 0.6, 3]), num=rng.choice([None, None, 1, 2, 4]), least=None, most=rng.choice([None, 1, 3]))
        if c.num is not None:
            c = cluster.ClusterConfig(threshold=c.threshold, num=c.num)
        assert cluster.average_linkage(d, c).tolist() == naive_linkage(d, c)


def test_clusters(spark):
    points = [(1, 0.1), (1, 0.2), (-1, 0.1), (-1, 0.2)]
    e = spark.createDataFrame([("a", c, 0, [float(x), float(y)]) for c, (x, y) in enumerate(points)] + [("a", 9, 0, [float("nan"), 1.0])], "rec string, chunk int, speaker int, embedding array<double>")
    usable = cluster.usable_embeddings(e)
    assert usable.count() == 4
    ids = lambda config: [r["global_id"] for r in cluster.cluster_speakers(usable, config).orderBy("chunk").collect()]
    assert ids(cluster.ClusterConfig(threshold=0.5)) == [0, 0, 1, 1]
    assert ids(cluster.ClusterConfig(threshold=3)) == [0, 0, 0, 0]
    assert len(set(ids(cluster.ClusterConfig(threshold=0.5, num=2)))) == 2
    assert len(set(ids(cluster.ClusterConfig(threshold=0.01, most=2)))) <= 2
    assert S.lda(np.arange(12.0).reshape(3, 4), np.zeros(4), np.eye(4)[:, :2], 2).shape == (3, 2) and S.lda(np.zeros((0, 4)), np.zeros(4), np.eye(4), 2).shape == (0, 2)


def test_tokens(spark):
    spec = decode.TokenSpec(budget=8)
    ts = lambda s: spec.first_timestamp + int(s / 0.02)
    streams = {
        "normal": ([ts(0), 5, 6, ts(2), ts(2), 7, ts(4)], [([5, 6], 60, 62), ([7], 62, 64)]),
        "flush": ([ts(1), 5, spec.end, 9], [([5], 61, None)]),
        "budget, alone": ([ts(1), 5, 6, 7, 8, 9, 10, 11, 12], [([5, 6, 7, 8, 9, 10, 11], 60, None)]),
        "budget, others": ([ts(0), 5, ts(1), 6, 7, 8, 9, 10, 11], [([5], 60, 61)]),
        "end at once": ([spec.end, 5], []),
    }
    for tokens, want in streams.values():
        rows = spark.createDataFrame([("a", 2, p, t) for p, t in enumerate(tokens)], "rec string, chunk int, pos int, token long")
        got = decode.segments_of_tokens(rows, spec).orderBy("k").collect()
        assert [(r["tokens"], r["start"], r["end"]) for r in got] == want
    for logits, off, want in (([0.1, 0.5, 0.3, 0.2], [], 1), ([0.1, 0.5, 0.3, 0.2], [1], 2), ([0.1, 0.5, 0.3, 0.9, 0.2], [1, 3], 2), ([0.1, 0.2], [0, 1], 0), ([0.5, 0.5], [], 0)):
        rows = spark.createDataFrame([("a", 0, 0, k, x) for k, x in enumerate(logits)], "rec string, chunk int, step int, token long, logit double")
        assert decode.greedy_choice(rows, spark.createDataFrame([(x,) for x in off], "token long")).first()["token"] == want
        assert one(spark, V.argmax_first(F.array(*map(F.lit, logits)), F.array(*map(F.lit, off)) if off else None)) == want


def test_signal():
    assert S.mono(np.array([1, 0, 0.5, 0.5, 0, 1, 9], np.float32), 2).tolist() == [0.5, 0.5, 0.5]
    assert len(S.resample(np.ones(3200), 32_000, 16_000)) == 1600 and len(S.resample(np.ones(800), 8_000, 16_000)) == 1600
    assert S.fbank(np.sin(0.01 * np.arange(16_000))).shape == (98, 80) and S.fbank(np.ones(200)).shape == (1, 80) and S.fbank(np.zeros(0)).shape == (0, 80)
    assert (S.fbank(np.zeros(1000)) < 0).all()
    bank = S.mel_filterbank(80, 512, 16_000)
    assert bank.shape == (80, 257) and (bank >= 0).all() and (bank.sum(1) > 0).all()
    assert np.allclose(S.power_spectrum(np.ones(8), 8), [8, 0, 0, 0, 0])
    assert S.speaker_samples(np.arange(1, 9), np.array([1, 0, 1, 0])).tolist() == [1, 2, 5, 6]


def wav(rate, channels, seconds, path):
    t = np.arange(int(rate * seconds)) / rate
    pcm = np.repeat((32_000 * np.sin(2 * np.pi * 440 * t)).astype("<i2"), channels).tobytes()
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(pcm)


def test_audio_and_pipelines(spark, tmp_path):
    wav(16_000, 1, 1, tmp_path / "m.wav")
    wav(44_100, 2, 0.5, tmp_path / "s.wav")
    rows = audio.read_audio(spark, str(tmp_path / "*.wav"))
    assert sorted(len(r["samples"]) for r in rows.collect()) == [8000, 16_000]
    options = PipelineOptions(num_speakers=2)
    samples = rows.select("rec", "samples")
    segments = pipelines.transcribe(samples, B.TestBackend(), options, 16_000)
    turns = pipelines.diarize(samples, B.TestBackend(), options, windows.SlidingConfig(16_000, 0.5, 0.25))
    labelled = pipelines.speaker_segments(turns, segments)
    assert segments.count() == 6 and turns.count() > 0 and 0 < labelled.count() <= 6
    (tmp_path / "none").mkdir()
    wav(16_000, 1, 0, tmp_path / "none" / "e.wav")
    silent = audio.read_audio(spark, str(tmp_path / "none" / "*.wav")).select("rec", "samples")
    with pytest.raises(Exception, match="no audio to segment"):
        pipelines.diarize(silent, B.TestBackend(), options).collect()
    with pytest.raises(wave.Error):
        audio.decode_wav(b"RIFF....nonsense")
    assert len(audio.decode_wav(_bytes(16_000, 1, 0))[0]) == 0


def _bytes(rate, channels, seconds):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"\0\0" * int(rate * seconds * channels))
    return buffer.getvalue()


def test_options_and_cli(tmp_path):
    from speechframe.cli import main

    for bad in ({"num_speakers": 2, "min_speakers": 1}, {"num_speakers": 2, "max_speakers": 3}, {"min_speakers": 3, "max_speakers": 2}, {"num_speakers": 0}, {"task": "sing"}, {"timestamp": "line"}, {"batch_size": 0}):
        with pytest.raises(ValueError):
            PipelineOptions(**bad)
    assert PipelineOptions(model_name="x.en", task="translate").effective_task == "transcribe"
    assert PipelineOptions(model_name="x.en.y", task="translate").effective_task == "translate"
    for argv in (["convert", "x.json", "-f", "doc"], ["transcribe", "--file-name", "x", "--num-speakers", "0"], ["transcribe", "--file-name", "x", "--task", "sing"], ["transcribe", "--file-name", "x", "--flash", "yes"]):
        with pytest.raises(SystemExit) as e:
            main(argv)
        assert e.value.code == 2


def test_transcribe_command(spark, tmp_path, capsys):
    from speechframe.cli import main, success_message

    wav(16_000, 1, 1, tmp_path / "a.wav")
    out = str(tmp_path / "out" / "t.json")
    assert main(["transcribe", "--file-name", str(tmp_path / "a.wav"), "--transcript-path", out, "--flash", "True", "--diarization_model", "m"]) == 0
    assert capsys.readouterr().out.strip() == success_message(out, False)
    assert "speaker segmented" in success_message(out, True) and "speaker" not in success_message(out, False)


def test_missing_file(spark, tmp_path):
    from speechframe.cli import main

    assert main(["convert", str(tmp_path / "none.json"), "-f", "srt"]) == 1


def test_artifacts(tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6, dtype="<f4").reshape(2, 3))
    assert artifacts.load_npy(tmp_path / "a.npy")[1, 2] == 5
    assert artifacts.as_matrix(np.zeros(3)).shape == (1, 3)
    with pytest.raises(ValueError):
        artifacts.as_matrix(np.zeros((1, 1, 1)))
    np.savez(tmp_path / "plda_transform.npz", mean=np.zeros(3), transform=np.eye(3))
    np.savez(tmp_path / "plda_model.npz", Phi=np.ones(3), sigma=np.ones(3))
    for n in ("segmentation.onnx", "embedding.onnx"):
        (tmp_path / n).write_bytes(b"")
    assert artifacts.load_models(artifacts.ensure(folder=tmp_path)).mean.shape == (1, 3)
    source = tmp_path / "src"
    source.mkdir()
    (source / "x").write_bytes(b"12")
    assert artifacts.fetch_file((source / "x").as_uri(), tmp_path / "to" / "x").read_bytes() == b"12"
    assert artifacts.providers("0")[0].startswith("CUDA") and artifacts.providers("cpu") == ["CPUExecutionProvider"]


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "t.json").write_text('{"chunks": [{"text": " a", "timestamp": [0, 1]}, {"text": " b", "timestamp": [1, null]}]}')
    q = live.stream_segments(spark, str(source)).writeStream.format("memory").queryName("segs").start()
    q.processAllAvailable()
    assert spark.table("segs").count() == 2
    q.stop()
    folder = str(tmp_path / "scores")
    schema = "rec string, speaker int, frame long, score double"
    spark.createDataFrame([("a", 0, 0, 0.9), ("a", 0, 1, 0.5)], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    q = live.live_hysteresis(stream).writeStream.format("memory").queryName("live").outputMode("append").start()
    q.processAllAvailable()
    spark.createDataFrame([("a", 0, 2, 0.5), ("a", 0, 1, 0.1), ("a", 0, 3, 0.4)], schema).coalesce(1).write.mode("append").parquet(folder)
    q.processAllAvailable()
    got = {r["frame"]: r["active"] for r in spark.table("live").collect()}
    assert got == {0: True, 1: True, 2: True, 3: False}
    q.stop()

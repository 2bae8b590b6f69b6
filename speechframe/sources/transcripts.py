"""Transcript documents in and out, and the subtitles made of them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import captions

CHUNKS = "chunks array<struct<text:string,timestamp:array<double>>>"


def parse_transcripts(files: DataFrame) -> DataFrame:
    """(rec, chunks, problem) from (rec, value). problem: null, or why the document is refused."""
    parsed = F.from_json("value", CHUNKS)["chunks"]
    bad = F.exists("chunks", lambda c: c.isNull() | c["text"].isNull() | c["timestamp"].isNull() | (F.size(c["timestamp"]) != 2) | F.get(c["timestamp"], 0).isNull())
    why = F.when(F.col("chunks").isNull(), "no chunks").when(bad, "a chunk lacks its text or two timestamps")
    return files.select("rec", parsed.alias("chunks")).withColumn("problem", why)


def segments_of(documents: DataFrame, strict: bool = True) -> DataFrame:
    """(rec, seg_idx, text, start, end) of parsed documents. strict: a refused document raises, else it is left out."""
    if strict:
        refuse: Column = F.when(F.col("problem").isNull(), F.col("chunks")).otherwise(F.raise_error(F.concat(F.col("rec").cast("string"), F.lit(": "), F.col("problem"))).cast(CHUNKS.partition(" ")[2]))
        documents = documents.select("rec", refuse.alias("chunks"))
    else:
        documents = documents.where("problem is null")
    spread = documents.select("rec", F.posexplode("chunks").alias("seg_idx", "c"))
    return spread.select("rec", F.col("seg_idx").cast("long").alias("seg_idx"), "c.text", F.get("c.timestamp", 0).alias("start"), F.get("c.timestamp", 1).alias("end"))


def read_transcripts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("rec"), "value")
    return segments_of(parse_transcripts(files), strict)


def pretty(document: dict) -> str:
    """The bytes of a transcript file: keys in order, two spaces, text unescaped, a newline at the end."""
    return json.dumps(document, indent=2, ensure_ascii=False) + "\n"


def as_document(row) -> dict:
    t = row["transcript"]
    return {
        "speakers": [{"speaker": x["speaker"], "text": x["text"], "timestamp": list(x["timestamp"])} for x in t["speakers"]],
        "chunks": [{"text": x["text"], "timestamp": list(x["timestamp"])} for x in t["chunks"]],
        "text": t["text"],
    }


def _write(root: str, name: str, content) -> callable:
    def run(rows):
        for row in rows:
            path = Path(root, str(row["rec"]).rstrip("/").rpartition("/")[2], name)
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(content(row), encoding="utf-8", newline="")

    return run


def write_transcripts(transcripts: DataFrame, root: str, name: str = "output.json") -> None:
    """<root>/<rec>/<name> per recording, written where the partitions are; root must be on a file system all share."""
    transcripts.foreachPartition(_write(root, name, lambda row: pretty(as_document(row))))


def write_captions(segments: DataFrame, fmt: str, root: str) -> None:
    """<root>/<rec>/output.<fmt> per recording."""
    captions.documents(segments, fmt).foreachPartition(_write(root, f"output.{fmt}", lambda row: row["document"]))


def convert_file(source: str, fmt: str, folder: str = ".", verbose: bool = False) -> Path:
    """One transcript file to <folder>/output.<fmt>; for many, read_transcripts() and write_captions()."""
    spark = SparkSession.builder.getOrCreate()
    segments = read_transcripts(spark, source)
    rows = captions.documents(segments, fmt).take(1)
    document = rows[0]["document"] if rows else captions.HEADERS[fmt]
    if verbose:
        print(document, end="")
    out = Path(folder, f"output.{fmt}")
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(document, encoding="utf-8", newline="")
    return out

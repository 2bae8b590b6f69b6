"""From documents to packed training sequences: five stages, each on all that the one before kept.

Every stage but the last returns the columns of documents, further ones of any name included. A null text counts as
empty, and a text of any length is read whole. Rows that repeat are judged alike by the classifier and the
decontamination; both dedup stages keep one row of those that repeat the id that stays and its text. Of equal texts the
largest id stays, of near duplicates the smallest; a null id is the smallest. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechframe.llm import common, decontamination, exact_dedup, near_dedup, packing, quality


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, keep=True)


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the largest id."""
    return exact_dedup.keep_exact(docs)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the smallest id."""
    return near_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each row by itself: others that share its id, or have none, don't count."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    out = packing.pack(packing.tokenised(docs, packing.default_tokenizer()))
    return out.select(common.id_back().alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", one_of_equal),
    ("minhash near-dedup", one_of_near),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: SQL can express neither the classifier, the near-duplicate search nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with common.scratch(spark):
            docs = common.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"), lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)

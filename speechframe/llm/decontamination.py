"""Benchmark decontamination by size-partitioned MinHash containment search. DataFrame functions only.

Shingles are five consecutive words. Items are partitioned by size: those of a partition may lack the same number m of
their n shingles and still meet the threshold t, m = n - ceil(t * n). An item's sketch is its m + 1 smallest shingle
hashes, a bottom-k MinHash with one k for the partition. A document that holds a share t of the item lacks m shingles
at most, so it holds a member of the sketch, however long it is. So documents are searched for sketches alone, about a
fifth of the items' shingles, and no contained item is missed. The documents and items found so are candidates; each
is verified by all of the item's shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C


def _hashed(df: DataFrame, text_col: str, k: int, *kept: Column) -> DataFrame:
    """kept and w, the hashes of the words, for texts of k words or more; they are split and hashed once per text."""
    words = F.filter(F.split(F.lower(C.text_or_empty(text_col)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return df.select(*kept, F.explode(F.array(F.transform(words, lambda w: F.xxhash64(w)))).alias("w")).where(F.size("w") >= k)


def _grams(k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(k)]))


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """The entries (item_id, shingle) of the items' sketches, from (item_id, shingle, item_shingles) without repeats."""
    lacking = F.col("item_shingles") - F.ceil(F.lit(threshold) * F.col("item_shingles") - F.lit(1e-9))
    at = F.row_number().over(Window.partitionBy("item_id").orderBy("shingle"))
    return items.withColumn("size_partition", lacking).withColumn("at", at).where(F.col("at") <= F.col("size_partition") + 1).select("item_id", "shingle")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles, containment) where a document holds at least `threshold` of
    an item's distinct shingles.

    A null text is empty. Items and documents under k words have no shingle and match nothing. Rows that repeat an id
    are read as one document, or item, with the shingles of all of them; a null id is an id. Empty tables give none.
    So that rows of one id count together, each row is searched for what it alone holds of a sketch.
    """
    of_item = _hashed(benchmark, item_text_col, k, F.col(item_col).alias("item_id")).select("item_id", F.explode(_grams(k)).alias("shingle")).distinct()
    items = C.cut(of_item.withColumn("item_shingles", F.count("shingle").over(Window.partitionBy("item_id"))), "items")
    entries = C.cut(sketches(items, threshold), "item-sketches")
    of_doc = _hashed(docs, text_col, k, F.col(id_col).alias("doc_id")).select("doc_id", F.explode(_grams(k)).alias("shingle"))
    found = C.cut(of_doc.join(C.small(entries), "shingle").select("doc_id", "item_id").distinct(), "candidates")
    # The rows of candidates only, with all their shingles once, against all shingles of their candidates' items.
    wanted = found.groupBy("doc_id").agg(F.collect_list(F.struct("item_id")).alias("items")).withColumnRenamed("doc_id", "found")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(C.small(wanted, 64), F.col("doc_id").eqNullSafe(F.col("found")))
    rows = _hashed(rows, "text", k, F.col("doc_id"), F.col("items")).select("doc_id", "items", F.explode(F.array(_grams(k))).alias("grams"))
    whole = items.groupBy(F.col("item_id").alias("item"), "item_shingles").agg(F.collect_list("shingle").alias("shingles"))
    whole = F.broadcast(whole) if items.limit(C.BROADCAST_BYTES // 16 + 1).count() <= C.BROADCAST_BYTES // 16 else whole
    pairs = rows.select("doc_id", "grams", F.inline("items")).join(whole, F.col("item_id").eqNullSafe(F.col("item")))
    shared = pairs.select("doc_id", "item_id", "item_shingles", F.explode(F.array_intersect("grams", "shingles")).alias("shingle")).distinct()
    counted = shared.groupBy("doc_id", "item_id", "item_shingles").agg(F.count("shingle").alias("shared_shingles"))
    return counted.withColumn("containment", F.col("shared_shingles") / F.col("item_shingles")).where(F.col("containment") >= threshold)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that hold an item by themselves; all columns kept, whatever their names.

    Rows that share an id, or have none, are judged each on its own text; rows that repeat both go or stay together.
    Empty tables drop nothing.
    """
    wide, column = C.by_position(docs)
    own = C.keyed_columns(column[id_col], column[text_col])
    wide = wide.withColumn("row", F.struct(own["d"].alias("d"), F.xxhash64(own["text"]).alias("h")))
    with C.scratch(docs.sparkSession):
        found = contaminated(wide, benchmark, id_col="row", text_col=column[text_col], **options)
        found = C.cut(found.select(F.col("doc_id").alias("row")).distinct(), "contaminated", lasting=True)
    return wide.join(C.small(found, 64), "row", "left_anti").drop("row").toDF(*docs.columns)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Shingles of a table t(id, text) in DuckDB.
SHINGLES_SQL = r"""
  SELECT DISTINCT id, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM {t}),
    unnest(range(1, len(w) - 3)) AS u(i)
"""
OP1_SQL = f"""
WITH d AS ({SHINGLES_SQL.replace("{t}", "(SELECT doc_id AS id, text FROM documents)")}),
b AS ({SHINGLES_SQL.replace("{t}", "(SELECT item_id AS id, text FROM benchmark)")}),
n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n.n)::BIGINT AS item_shingles, count(*)::BIGINT AS shared_shingles,
  count(*)::DOUBLE / any_value(n.n)::DOUBLE AS containment
FROM d JOIN b USING (s) JOIN n ON n.id = b.id GROUP BY d.id, b.id HAVING count(*)::DOUBLE / any_value(n.n)::DOUBLE >= 0.8
"""

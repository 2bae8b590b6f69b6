"""Views with the operators' schemas over the test tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "v_segments": """
SELECT conv_id AS rec, turn AS seg_idx, text, role AS speaker, CAST(end_cs - len_cs AS DOUBLE) / 100 AS "start",
  CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN NULL ELSE CAST(end_cs AS DOUBLE) / 100 END AS "end"
FROM (SELECT *, CAST(sum(len_cs) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_cs
  FROM (SELECT *, CAST(greatest(1, length(text)) * 6 AS BIGINT) AS len_cs FROM conversations) a) b""",
    "v_turns": """
SELECT conv_id AS rec, turn AS k, CAST(end_cs - len_cs AS DOUBLE) / 100 AS "start",
  CAST(greatest(end_cs - len_cs + 1, end_cs + (turn * 37 + conv_id * 11) % 200 - 100) AS DOUBLE) / 100 AS "end", role AS speaker
FROM (SELECT *, CAST(sum(len_cs) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_cs
  FROM (SELECT *, CAST(greatest(1, length(text)) * 6 AS BIGINT) AS len_cs FROM conversations) a) b""",
    "v_scores": """
SELECT CAST(floor(event_id / 1000) AS BIGINT) AS rec, CAST(floor(event_id / 100) AS BIGINT) AS chunk,
  CAST(floor((event_id % 100) / 2) AS BIGINT) AS frame, event_id % 2 AS speaker, floor(10 * value / (value + 10)) / 10 AS score
FROM events""",
    "v_tokens": """
SELECT user_id AS rec, CAST(floor((n - 1) / 20) AS BIGINT) AS chunk, n - 1 AS pos,
  CASE WHEN event_type = 'view' THEN 50365 + event_id % 1501 WHEN event_type = 'error' AND event_id % 7 = 0 THEN 50257 ELSE event_id % 50257 END AS token
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) a""",
    "v_samples": """
SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS v FROM events""",
    "v_emb": """
SELECT CAST(floor(vec_id / 50) AS BIGINT) AS rec, CAST(floor((vec_id % 50) / 2) AS BIGINT) AS chunk, vec_id % 2 AS speaker, vec_id % 50 AS row_no, embedding
FROM embeddings""",
}
_TABLE = {"v_segments": "conversations", "v_turns": "conversations", "v_scores": "events", "v_tokens": "events", "v_samples": "events", "v_emb": "embeddings"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = _TABLE[name]
    sql = SQL[name].replace('"', "`").replace(f"FROM {table}", f"FROM {{{table}}}")
    return spark.sql(sql, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def with_views(*names: str) -> str:
    """The views as common table expressions, for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names)

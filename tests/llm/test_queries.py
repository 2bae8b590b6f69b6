"""The registered queries and the pipeline over the small tables."""

import duckdb
import pytest

import corpus_pipeline
from speechframe.llm import queries

from . import cases

COLUMNS = {
    "op2": ["doc_id", "class_id"],
    "op3": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op4": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op7": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op8": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op9": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op10": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, sf_dir):
    got = queries.QUERIES[name](spark, sf_dir)
    assert set(COLUMNS.get(name.partition("_")[0], [])) <= set(got.columns)
    rows = got.collect()
    if sql := queries.ORACLE_SQL.get(name):
        con = duckdb.connect()
        for t in ("documents", "benchmark", "labels", "conversations"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        want = con.execute(sql)
        columns = [x[0] for x in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in rows)
    elif not name.startswith(("op8", "op1_")):
        assert len(rows) == duckdb.sql(f"select count(*) from '{sf_dir}/documents.parquet'").fetchall()[0][0]


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{len(sizes)}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_stages_stand_odd_rows(spark, tmp_path):
    """Nulls, repeats, clashing names and empty tables through every stage."""
    docs = cases.documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == docs.columns
            assert out.count() <= frame.count()
        assert bool(corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).count()) == bool(frame.count())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_decontamination_goes_by_row(spark, tmp_path):
    item = [f"w{i}" for i in range(24)]
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    whole, halves = " ".join(item), [" ".join(item[:14]), " ".join(item[10:])]
    rows = [(1, halves[0]), (1, halves[1]), (2, whole), (2, "clean"), (None, whole + " more"), (None, "clean too"), (None, None), (3, whole)]
    left = corpus_pipeline.without_benchmark(spark, cases.documents(spark, [(*r, "en", "s", 1, "d", "v", 1, 2, 3, 4) for r in rows]), str(tmp_path))
    assert left.columns == cases.documents(spark, []).columns
    assert {(r["doc_id"], r["text"]) for r in left.collect()} == {rows[i] for i in (0, 1, 3, 5, 6)}

"""Registered queries and the pipeline on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline as P
from courtlake.llm import oracle
from courtlake.llm.queries import QUERIES
from courtlake.llm.components import components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.STATEMENTS))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    got = sorted(map(tuple, df.collect()))
    want = con.execute(f"select {', '.join(df.columns)} from ({oracle.STATEMENTS[name]})").fetchall()
    assert got == sorted(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracle.STATEMENTS)))
def test_runs_over_all_rows(spark, name):
    rows = QUERIES[name](spark, SF)
    if "spelling" in name:  # a row per word
        assert rows.count() == rows.select("word").distinct().count() > 0
        return
    source = "pages" if "html" in name else "documents"
    key = "page_id" if "html" in name else "doc_id"
    assert rows.select(key).distinct().count() == spark.read.parquet(f"{SF}/{source}.parquet").select(key).distinct().count()


@pytest.mark.parametrize("name, key, truth", [("op1_language_id", "lang_pred", "lang"), ("op4_quality_classifier", "predicted", "quality"), ("op11_toxicity", "predicted", "toxic")])
def test_held_out_accuracy(spark, name, key, truth):
    table = "documents" if truth == "lang" else "labels"
    rows = QUERIES[name](spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet"), "doc_id").select(key, truth).collect()
    assert len(rows) > 50 and sum(r[0] == r[1] for r in rows) >= 0.95 * len(rows)


def test_pipeline(spark, tmp_path):
    """Each stage keeps the columns, works on its input, and its decisions take effect."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    columns = docs.columns
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
        assert name == "packing" or docs.columns == columns
        if name == "near_duplicates":
            assert docs.select("doc_id").distinct().count() == docs.count()
    assert seen[0] > seen[1] > seen[2] == seen[3] and seen[5] >= seen[4] > 0


def test_pipeline_without_rows_and_with_odd_ones(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "the same short text of rather more than twenty words that is here so that a row can pass the rules of quality for this test only"
    for rows in ([], [(1, text, None, None, 0), (1, text, None, None, 0), (None, text, "en", "s", 0), (2, None, None, "s", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in P.STAGES:
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{len(rows)}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{len(rows)}-{name}"))
        assert (docs.count() > 0) == bool(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []

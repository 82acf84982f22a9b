"""Pipeline stages on tables whose own columns have the names that operators might use, and on empty ones."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .fixtures import documents
from .test_phrases import passages

NAMES = ["_sha", "_gone", "_own", "_key", "_kept", "_id", "_0", "hit", "slot", "bits", "sha", "gone", "kept", "own", "id", "raw", "TEXT", "Doc_ID"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("t"))
    rows = [(5000 + (i or 0), t, lang) for i, t, lang in passages(8)]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id <> 50 OR n_chars > 0")
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") != 42, F.col("doc_id")))
    docs.write.parquet(f"{folder}/documents.parquet")
    marks = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_clashing_names(spark, table, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{table}/documents.parquet")
    more = docs.toDF(*[f"c{i}" for i in range(5)]).select("*", *[F.concat(F.lit(n), F.col("c0").cast("string")).alias(f"x{i}") for i, n in enumerate(NAMES)])
    more = more.toDF(*docs.columns, *NAMES)
    want, got = stage(spark, docs, table), stage(spark, more, table)
    if name == "best-fit packing":
        assert got.columns == want.columns and got.count() == want.count()
        return
    assert want.columns == docs.columns and got.columns == docs.columns + NAMES
    keys = lambda df: sorted((str(r[0]), str(r[1])) for r in df.collect())
    assert keys(got) == keys(want)
    for r in got.collect():
        assert list(r)[5:] == [None if r[0] is None else f"{n}{r[0]}" for n in NAMES]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, table, name):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    got = dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), table)
    assert got.count() == 0
    if name != "best-fit packing":
        assert got.columns == docs.columns

"""The pipeline, stage by stage and as a whole, against brute force."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from trackweave.llm import kneser_ney, phrases

from .fixtures import documents
from .test_dedup import brute_exact
from .test_models import corpus
from .test_phrases import brute, passages
from .test_resemblance import brute_roots
from .test_tokens import ids_of, library  # noqa: F401

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows, labels = corpus(spark, 300)
    extra = [(1000 + i, t, lang) for i, t, lang in rows] + [(2000 + i, t, lang) for i, t, lang in rows[:40]]
    extra += [(3000 + i, t + " more", lang) for i, t, lang in rows[40:60]] + [(4000 + (i or 0), t, lang) for i, t, lang in passages(8) if i != 400]
    docs = documents(spark, extra).dropDuplicates(["doc_id"]).select(COLUMNS)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1000 + i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def brute_stages(before):
    """What exact, near and substring dedup leave of {doc_id: text}, one after another."""
    exact = {i: before[i] for i in {w[1] for w in brute_exact(before.items())}}
    yield exact
    near = {i: exact[i] for i in set(brute_roots(exact).values())}
    yield near
    yield {w[0]: (near[w[0]] if not w[2] else w[4]) for w in brute(list(near.items()), 50)}


def check_pieces(pieces, held, library):  # noqa: F811
    for i, rows in pieces.groupby("doc_id"):
        ids = np.append(ids_of(library, held[i]), np.uint32(2)).astype("<u4")
        assert rows.length.sum() == len(ids) and all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(rows.start, rows.length, rows.ids_crc32))
    assert set(pieces.doc_id) == set(held) and (pieces.groupby("sequence_id").length.sum() <= 1024).all()


def test_stages(spark, sf_dir, library, tmp_path):  # noqa: F811
    """Each stage on its own input; the first one's is not narrowed, as odd fixtures are not like trusted text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wanted = brute_stages(texts(docs))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = texts(docs)
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "quality classifier":
            now = texts(after)
            bad = {i for i, t in before.items() if t and ("!!" in t[:400] or "$$$" in t or "###" in t) and 1000 <= i < 4000}
            good = {i for i in before if 1000 <= i < 4000} - bad
            assert len(bad & set(now)) <= 0.05 * len(bad) and len(good & set(now)) >= 0.99 * len(good)
            assert after.columns == COLUMNS and all(now[i] == before[i] for i in now)
        elif name == "best-fit packing":
            check_pieces(after.toPandas(), before, library)
        else:
            assert after.columns == COLUMNS and texts(after) == next(wanted)
            docs = after


def test_run(spark, sf_dir, library):  # noqa: F811
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rejected = {r["doc_id"] for r in kneser_ney.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("NOT kept").collect()}
    *_, left = brute_stages({i: t for i, t in texts(docs).items() if i not in rejected})
    check_pieces(corpus_pipeline.run(spark, sf_dir).toPandas(), left, library)


def test_last_id_is_reserved():
    assert phrases.LAST == (1 << 63) - 1

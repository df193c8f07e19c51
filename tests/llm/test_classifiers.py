"""Language and toxicity: held-out accuracy, folds and odd inputs."""

import os
import zlib

import pytest

from foliant.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_held_out_accuracy(docs):
    rows = langid.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and held
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_inputs(spark, docs):
    odd = spark.createDataFrame([(None, "the and", "en", "x"), (5, None, "fr", "x"), (5, "", None, "x"), (6, "123 !? _", "de", "x"), (7, "日", None, "x"), (7, "日", None, "x")], "doc_id long, text string, lang string, score string")
    got = langid.identify_language(docs.select("doc_id", "text", "lang").unionByName(odd.drop("score"))).where("doc_id is null or doc_id in (5, 6, 7)").collect()
    assert len(got) == 6 + 3
    assert {r.lang_pred for r in got if r.score == 0} == {"und"}
    alone = langid.identify_language(odd.where("doc_id = 7")).collect()
    assert [(r.lang_pred, r.score) for r in alone] == [("und", 0.0)] * 2
    assert langid.identify_language(odd.limit(0)).count() == 0


def test_toxicity_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    ones, zeros = [r.score for r in held if truth[r.doc_id]], [r.score for r in held if not truth[r.doc_id]]
    assert sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / len(ones) / len(zeros) > 0.75


def test_toxicity_odd_inputs(spark):
    docs = spark.createDataFrame([(i, "you idiot moron " * 3 if i % 2 else "a calm day " * 3, 1) for i in range(80)] + [(None, None, 1), (200, "", 1), (200, "", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(7, None)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == 83 and len({r.score for r in rows if r.doc_id in (None, 200)}) == 1
    alone = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert len(alone) == 83 and len({r.score for r in alone}) == 1
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0

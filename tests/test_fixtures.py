"""Inputs of the registered queries hold whole texts."""

import pytest

from foliant.functions.dialect import DUCK, SPARK
from foliant.plans import fixtures as fx
from foliant.plans import registry

LONG = " ".join(f"Word{i} follows." for i in range(3_000))


@pytest.fixture
def sf(spark, tmp_path):
    rows = [(i, LONG if i < 4 else t, "en", "src1", 0) for i, t in enumerate(["", "", "", "", "short", "", None])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_structured_holds_whole_texts(spark, sf):
    import duckdb

    documents = spark.read.parquet(f"{sf}/documents.parquet")
    documents.createOrReplaceTempView("documents")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    ours = {r.doc_id: r.text for r in spark.sql(fx.structured(SPARK)).collect()}
    assert ours == {r[0]: r[2] for r in con.sql(fx.structured(DUCK)).fetchall()}
    for i, text in ((r.doc_id, r.text or "") for r in documents.collect()):
        assert text[:400] in ours[i] and text[400:] in ours[i]


def test_queries_read_the_end_of_a_text(spark, sf):
    said = {(r.doc_id, r.item) for r in registry.QUERIES["sentence_split"](spark, sf).collect()}
    # The cut after 400 characters falls into one word.
    assert all(sum((i, f"Word{n} follows") in said for n in range(3_000)) >= 2_998 for i in range(4))
    chars = {r.doc_id: r.chars for r in registry.QUERIES["section_split"](spark, sf).orderBy("chars").collect()}
    assert all(chars[i] > len(LONG) - 400 for i in range(4))

"""The store: embedding, replacing, merging, uploads, streams."""

import os

import pytest

from foliant.sources import scratch, store
from foliant.streaming import ingest_stream

CHUNK = "chunk_id string, workspace_id string, source string, file_path string, page long, section string, page_content string, entries array<string>"


def chunk(k, workspace="w1", text="some words here"):
    return (k, workspace, "a.pdf", None, 1, "General (page 1)", text, [])


def test_store_round_trip(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "table"), 16, store.hashing_embedder(16)).ensure()
    assert s.chunks().count() == 0 and not s.has_documents("w1") and not s.clear("w1")
    s.add(spark.createDataFrame([chunk("1"), chunk("2", "007", "")], CHUNK))
    s.add(spark.createDataFrame([chunk("3")], CHUNK))
    rows = {r.chunk_id: r for r in s.chunks().collect()}
    assert set(rows) == {"1", "2", "3"} and rows["2"].vec is None and rows["2"].workspace_id == "007"
    assert abs(sum(x * x for x in rows["1"].vec) - 1) < 1e-6 and s.has_documents("007")
    s.replace(spark.createDataFrame([chunk("4")], CHUNK))
    assert {r.chunk_id for r in s.chunks().collect()} == {"2", "4"} and s.source("w1", "a.pdf").count() == 1
    assert s.clear("w1") and not s.has_documents("w1") and s.has_documents("007")
    with pytest.raises(Exception, match="must have 8 numbers"):
        store.Store(spark, str(tmp_path / "other"), 8, store.hashing_embedder(16)).add(spark.createDataFrame([chunk("1")], CHUNK))


def test_embedding_counts_tokens(spark):
    got = spark.createDataFrame([("a b a",), ("",), (None,)], "t string").select(store.hashing_embedder(32)("t").alias("v")).collect()
    assert sorted(x for x in got[0].v if x) == pytest.approx(sorted([1 / 5**0.5, 2 / 5**0.5])) and got[1].v is None and got[2].v is None


def test_uploads(spark, tmp_path):
    folder = str(tmp_path)
    path = store.upload(spark, folder, "w1", "x/report.pdf", b"one")
    store.upload(spark, folder, "w1", "report.pdf", b"two")
    store.upload(spark, folder, "w10", "report.pdf", b"three")
    os.mkdir(f"{folder}/w1_folder")
    assert path.endswith("/w1_report.pdf") and open(f"{folder}/w1_report.pdf", "rb").read() == b"two"
    assert store.delete_uploads(spark, folder, "w1") == 1 and store.delete_uploads(spark, f"{folder}/none", "w1") == 0
    assert sorted(f for f in os.listdir(folder) if not f.startswith(".")) == ["w10_report.pdf", "w1_folder"]


def test_a_document_split_over_batches_is_kept(spark, tmp_path):
    fields = "workspace_id string, source string, page int, text string"
    table, arriving = str(tmp_path / "table"), str(tmp_path / "in")
    put = lambda *rows: spark.createDataFrame(list(rows), fields).coalesce(1).write.mode("append").parquet(arriving)
    for batch in ([("w1", "a", 0, "old"), ("w1", "b", 0, "b")], [("w1", "a", 1, "more"), ("w2", "c", 0, "c")], [("w1", "a", 0, "new")]):
        put(*batch)
        query = ingest_stream(spark.readStream.schema(fields).parquet(arriving), table, str(tmp_path / "checkpoint"))
        query.awaitTermination()
    got = sorted((r.workspace_id, r.source, r.page, r.text) for r in spark.read.parquet(table).collect())
    assert got == [("w1", "a", 0, "new"), ("w1", "a", 1, "more"), ("w1", "b", 0, "b"), ("w2", "c", 0, "c")]
    store.merge_pages(spark.createDataFrame([("w1", "a", 5, "whole")], fields), table, whole_sources=True)
    assert sorted((r.source, r.page) for r in spark.read.parquet(table).where("workspace_id = 'w1'").collect()) == [("a", 5), ("b", 0)]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def __init__(self, **held):
            self.held = held

        def get(self, name, other=None):
            return self.held.get(name, other)

    class Session:
        def __init__(self, **held):
            self.conf = Conf(**held)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session(**{"spark.master": "spark://host:7077"}))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session(**{"spark.master": "local-cluster[2,1,1024]"}))
    local = Session(**{"spark.master": "local[2]", "spark.app.id": "x"})
    assert scratch.shared_dir(local) == scratch.shared_dir(local)
    assert scratch.shared_dir(Session(**{"spark.checkpoint.dir": "file:///shared/"})) == "file:///shared"

"""Ingestion and answers as calls: hand-worked pages, user views, clashing columns, empty tables."""

import pytest

from foliant.operators import ask, ingest
from foliant.sources import store

FILL = "The manager must check every entry of the monthly report before it leaves the office. "


def page(n, text, source="guide.pdf", workspace="w1"):
    return (workspace, source, f"uploads/{workspace}_{source}", n, text)


def contents(*entries):
    return "Table of Contents\n" + "\n".join(entries)


PAGES = [
    page(0, "Cover " + FILL * 5),
    page(1, contents("1.1 Adding records .... 3", "1.2 Deleting records .... 4", "1.1 Adding  Records .... 3", "2.1 Reports .... 9")),
    page(2, "Intro dropped. 1.1 Adding Records NO ACTION " + FILL * 2 + "1.2 Deleting Records Estimation time in total: 5 min " + FILL * 2 + "1.3 Too Short NO ACTION tail"),
    page(3, FILL * 4),
    page(4, "Short page."),
    page(5, "Version history\n" + FILL * 5),
    page(6, "Owner, effective date, status. " + FILL * 6),
    page(0, FILL * 5, "plain.pdf"),
    page(1, FILL * 5, "plain.pdf"),
    page(2, FILL * 5, "plain.pdf"),
    page(3, None, "plain.pdf"),
    page(2, "2.1 Reports NO ACTION " + FILL * 2, "other.pdf", "w2"),
]
FIELDS = "workspace_id string, source string, file_path string, page long, text string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, FIELDS)


def test_chunks_by_hand(pages):
    got = {(r.source, r.page, r.section): r for r in ingest.chunk_documents(pages).collect()}
    assert set(got) == {("guide.pdf", 2, "1.1 Adding Records"), ("guide.pdf", 2, "1.2 Deleting Records"), ("guide.pdf", 3, "General (page 3)"), ("plain.pdf", 2, "General (page 2)"), ("other.pdf", 2, "2.1 Reports")}
    # Same number 12, shared words 3 each, next page 4; then nothing for another number.
    assert got["guide.pdf", 2, "1.1 Adding Records"].entries == ["1.1 Adding records"]
    assert got["guide.pdf", 2, "1.2 Deleting Records"].entries == ["1.2 Deleting records"]
    assert got["guide.pdf", 3, "General (page 3)"].entries == [] and got["other.pdf", 2, "2.1 Reports"].entries == []
    assert got["guide.pdf", 2, "1.1 Adding Records"].page_content.startswith("1.1 Adding Records NO ACTION The manager")
    assert got["guide.pdf", 2, "1.1 Adding Records"].file_path == "uploads/w1_guide.pdf"


def test_pages_to_answers(spark, pages):
    mine = spark.createDataFrame([(1,)], "chunks int")
    for name in ("chunks", "asked", "best", "words"):
        mine.createOrReplaceTempView(name)
    chunks = store.embedded(ingest.chunk_documents(pages), store.hashing_embedder(64))
    questions = spark.createDataFrame([(1, "w1", "How to delete deleting records?", "x"), (2, "w2", "What about reports?", "y"), (3, "nowhere", "Anything?", "z"), (4, "w1", None, "z")], "question_id int, workspace_id string, question string, answer string")
    questions = questions.withColumn("vec", store.hashing_embedder(64)(questions["question"]))
    chunks = chunks.selectExpr("*", "1 AS title", "2 AS terms")
    got = {r.question_id: r for r in ask.answer_questions(questions, chunks).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].selected_section_title == "1.2 Deleting Records" and "The manager must check" in got[1].answer
    assert [(s.source, s.page, s.file_path) for s in got[1].sources][0] == ("guide.pdf", 2, "uploads/w1_guide.pdf")
    assert got[2].sources[0].file_path == "uploads/w2_other.pdf" and got[2].highlight_pages == [2]
    assert got[3].answer.startswith("I don't know") and got[3].sources is None
    # The vector of an empty question is null, so nothing is near it.
    assert got[4].answer == got[3].answer
    near = ask.retrieve_documents(questions, chunks).collect()
    assert {r.question_id for r in near} == {1, 2} and [r.section for r in near if r.question_id == 1 and r.idx == 0] == ["1.2 Deleting Records"]
    # The user's own views are as they were.
    assert spark.table("chunks").columns == ["chunks"] and not [t for t in spark.catalog.listTables() if t.name.startswith("near_")]
    assert ask.answer_questions(questions.limit(0), chunks).count() == 0
    assert {r.answer for r in ask.answer_questions(questions, chunks.limit(0)).collect()} == {got[3].answer}


def test_wrong_inputs(spark, pages):
    with pytest.raises(ValueError, match="lack the columns vec"):
        ask.retrieve_documents(pages.selectExpr("1 AS question_id", "workspace_id", "text AS question"), pages)
    assert ingest.chunk_documents(pages.limit(0)).count() == 0
    assert ingest.chunk_documents(pages.drop("file_path")).where("file_path IS NOT NULL").count() == 0

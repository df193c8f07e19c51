"""Questions over chunks: retrieval and answers as calls on DataFrames.

Questions are (question_id, workspace_id, question, vec), chunks (chunk_id, workspace_id,
source, file_path, page, section, page_content, entries, vec); more columns are ignored. The
vectors may come from any model, see ``sources.store.embedded``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.dialect import SPARK
from foliant.operators import answer, retrieve
from foliant.operators.steps import Step, run_steps

#: Steps that several others read.
KEEP = ("asked", "near", "retrieved", "best", "refs", "gathered", "texts", "prepared", "table_under", "points", "summaries", "subs", "led", "drafted", "highlights")
_QUESTION = ("question_id", "workspace_id", "question", "vec")
_CHUNK = ("chunk_id", "workspace_id", "source", "page", "section", "page_content", "entries", "vec")


def _tables(questions: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    for name, df, needed in (("questions", questions, _QUESTION), ("chunks", chunks, _CHUNK)):
        lacking = [c for c in needed if c not in df.columns]
        if lacking:
            raise ValueError(f"{name} lack the columns {', '.join(lacking)}")
    if not isinstance(questions.schema["question_id"].dataType, T.IntegralType):
        raise ValueError("question_id must be a whole number")
    path = F.col("file_path") if "file_path" in chunks.columns else F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    return {
        "questions": questions.select(F.col("question_id").cast("long").alias("question_id"), "workspace_id", F.coalesce("question", F.lit("")).alias("question"), "vec").where("question_id IS NOT NULL"),
        "chunks": chunks.select("chunk_id", "workspace_id", "source", path.alias("file_path"), F.col("page").cast("long").alias("page"), F.coalesce("section", F.lit("")).alias("section"), F.coalesce("page_content", F.lit("")).alias("page_content"), F.coalesce("entries", empty).alias("entries"), "vec"),
    }


def _retrieval(fetch: int) -> list[Step]:
    return [retrieve.analysed(SPARK, "SELECT * FROM questions"), *retrieve.nearest(SPARK, fetch), *retrieve.reranked(SPARK)]


def retrieve_documents(questions: DataFrame, chunks: DataFrame, fetch: int = retrieve.FETCH) -> DataFrame:
    """The re-ranked chunks of each question, best first: question_id, idx (from 0), branch, and the chunk's columns.

    Only chunks of the question's workspace are searched. A null or zero vector is near
    nothing; a question without chunks has no row. Question ids must be unique.
    """
    fields = "c.chunk_id, c.source, c.file_path, c.page, c.section, c.page_content, c.entries"
    last = f"SELECT r.question_id, r.idx, r.branch, {fields} FROM retrieved r JOIN chunks c ON r.chunk_id = c.chunk_id"
    return run_steps(questions.sparkSession, _retrieval(fetch), last, _tables(questions, chunks), KEEP)


def answer_questions(questions: DataFrame, chunks: DataFrame, fetch: int = retrieve.FETCH) -> DataFrame:
    """One row for each question: question_id, answer, highlight, highlight_pages, sources (source, page, file_path, section), selected_section_title, summary.

    A question whose workspace has no chunk near it gets NO_ANSWER and nulls.
    """
    fields = "question_id, answer, highlight, highlight_pages, sources, selected_section_title, summary"
    return run_steps(questions.sparkSession, [*_retrieval(fetch), *answer.answers(SPARK)], f"SELECT {fields} FROM answers", _tables(questions, chunks), KEEP)

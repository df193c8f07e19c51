"""Registered queries of retrieval, re-ranking and answering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from foliant.functions import text as t
from foliant.functions.dialect import DUCK, SPARK, Dialect
from foliant.operators import answer as a
from foliant.operators import ingest as i
from foliant.operators import retrieve as r
from foliant.operators.ask import KEEP, answer_questions
from foliant.operators.ingest import chunk_documents as ingest_chunks
from foliant.plans import fixtures as fx
from foliant.plans.base import Query, Steps, chain, run
from foliant.sources.scratch import written

_TABLES = ("documents", "embeddings")


def _with_vectors(rows: str, key: str) -> str:
    """Rows with the vector at ``key`` modulo the number of vectors, so none is left out of the search."""
    return f"SELECT r.*, v.embedding AS vec FROM (SELECT m.*, {key} % n_vectors AS slot FROM ({rows}) m CROSS JOIN (SELECT count(*) AS n_vectors FROM embeddings)) r LEFT JOIN vectors v ON r.slot = v.vec_id"


def _asked(d: Dialect) -> tuple[str, str]:
    return r.analysed(d, f"SELECT question_id, workspace_id, question, vec FROM ({_with_vectors(fx.questions(d), 'doc_id')}) UNION ALL SELECT CAST(999 AS BIGINT) AS question_id, 'nowhere' AS workspace_id, 'what about it' AS question, embedding AS vec FROM vectors WHERE vec_id = 1")


def base(d: Dialect) -> list[tuple[str, str]]:
    """``chunks`` and ``asked`` from the driver's tables: a document is a page with a section heading; some pages continue the one before."""
    title = f"CASE WHEN doc_id % 4 = 3 THEN concat('General (page ', CAST(page AS STRING), ')') ELSE {fx.title(d)} END"
    entries = d.array(["section", "'1.1 Adding records'", "concat('2.1 ', substring(text, 1, 24))"])
    pages = f"SELECT doc_id, workspace_id, source, page + CASE WHEN page > 5 THEN 1 ELSE 0 END AS page, text FROM ({fx.pages(d)})"
    both = f"SELECT p.*, s.other FROM ({pages}) p JOIN (SELECT doc_id AS id2, text AS other FROM ({fx.structured(d)})) s ON p.doc_id = s.id2"
    body = f"SELECT doc_id, workspace_id, source, page, {title} AS section, CASE WHEN doc_id % 3 = 0 THEN other ELSE text END AS text FROM ({both})"
    return [
        ("vectors", "SELECT vec_id, embedding FROM embeddings"),
        ("chunks", f"SELECT doc_id AS chunk_id, workspace_id, source, concat(source, '.pdf') AS file_path, CAST(page AS BIGINT) AS page, section, text AS page_content, {entries} AS entries, vec FROM ({_with_vectors(body, 'doc_id')})"),
        _asked(d),
    ]


def ingested(d: Dialect) -> list[tuple[str, str]]:
    """``chunks`` cut by the ingest operator from made pages, and ``asked``."""
    placed = "SELECT *, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY chunk_id) AS BIGINT) AS nth FROM chunked"
    return [
        ("vectors", "SELECT vec_id, embedding FROM embeddings"),
        ("pages", fx.ingested_pages(d)),
        *i.chunk_steps(d),
        ("chunks", f"SELECT chunk_id, workspace_id, source, file_path, page, section, page_content, entries, vec FROM ({_with_vectors(placed, 'nth')})"),
        _asked(d),
    ]


def _near(d: Dialect) -> list[tuple[str, str]]:
    return [*base(d), *r.nearest(d)]


def _ranked(d: Dialect) -> list[tuple[str, str]]:
    return [*_near(d), *r.reranked(d)]


def _best(d: Dialect) -> list[tuple[str, str]]:
    return [*_ranked(d), *a.best_documents(d)]


def _texts(d: Dialect) -> list[tuple[str, str]]:
    terms = d.words(["record", "the", "submit"])
    return [("texts", f"SELECT CAST(doc_id AS STRING) AS tid, text, '2.4 Review the Plan' AS title, {terms} AS terms, {d.words(['submit the form', 'of the'])} AS phrases FROM ({fx.structured(d)})")]


def _pointed(d: Dialect) -> list[tuple[str, str]]:
    return [*_texts(d), *a.points(d, "texts")]


def _summed(d: Dialect) -> list[tuple[str, str]]:
    return [*_pointed(d), *a.summaries(d, "texts")]


def _lit(d: Dialect) -> list[tuple[str, str]]:
    return [*_summed(d), ("sought", "SELECT x.tid, x.text, x.title, x.terms, x.phrases, p.points AS seeds FROM texts x JOIN point_lists p ON x.tid = p.tid"), *a.highlights(d, "sought")]


def _answered(d: Dialect) -> list[tuple[str, str]]:
    return [*_ranked(d), *a.answers(d)]


def _chunked(d: Dialect) -> list[tuple[str, str]]:
    return [("pages", fx.ingested_pages(d)), *i.chunk_steps(d)]


def _end_to_end(d: Dialect) -> list[tuple[str, str]]:
    """From pages to answers."""
    return [*ingested(d), *r.nearest(d), *r.reranked(d), *a.answers(d)]


def answer_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to chunks to answers, by the calls that users make."""
    documents, embeddings = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES)
    tables = {"documents": documents, "embeddings": embeddings, "vectors": embeddings.select("vec_id", "embedding")}
    pages = run(spark, fx.ingested_pages(SPARK), documents=documents)
    chunks = written(ingest_chunks(pages), "chunked")
    placed = run(spark, "SELECT *, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY chunk_id) AS BIGINT) AS nth FROM chunked", chunked=chunks)
    chunks = written(run(spark, _with_vectors("SELECT * FROM placed", "nth"), placed=placed, **tables), "chunks")
    found = answer_questions(run(spark, _asked(SPARK)[1], **tables), chunks)
    return run(spark, _answer_columns(SPARK), answers=found)


@dataclass(frozen=True)
class EndToEnd:
    """``answer_e2e`` with its SQL."""

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return answer_e2e(spark, sf_dir)

    def oracle(self) -> str:
        return chain(_end_to_end(DUCK), _answer_columns(DUCK))


def _source_text(d: Dialect, x: str) -> str:
    return f"{x}.source || ':' || CAST({x}.page AS STRING) || ':' || {x}.file_path || ':' || {x}.section"


def _answer_columns(d: Dialect) -> str:
    sources = d.map("sources", lambda x: _source_text(d, x))
    return f"SELECT question_id, answer, {_J(d, 'highlight')} AS highlight, {_J(d, d.map('highlight_pages', lambda p: f'CAST({p} AS STRING)'))} AS highlight_pages, {_J(d, sources)} AS sources, selected_section_title, summary FROM answers"


def knn(filtered: bool):
    def sql(d: Dialect) -> str:
        where = "AND e.label = q.label" if filtered else ""
        return f"SELECT vec_id, cos, n FROM (SELECT e.vec_id, round({r.cosine(d, 'e.embedding', 'q.embedding')}, 5) AS cos, row_number() OVER (ORDER BY round({r.cosine(d, 'e.embedding', 'q.embedding')}, 5) DESC, e.vec_id) AS n FROM embeddings e CROSS JOIN (SELECT embedding, label FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0 {where}) WHERE n <= {r.FETCH}"

    return sql


_KEEP = (*KEEP, *i.KEEP, "chunks")
_J = lambda d, x: d.join(x, " / ")

QUERIES = {
    "knn_topk": Query(knn(False), ("embeddings",)),
    "knn_filtered": Query(knn(True), ("embeddings",)),
    "knn_workspace": Steps(_near, lambda d: "SELECT question_id, chunk_id, CAST(place AS BIGINT) AS place, cos FROM near", _TABLES, _KEEP),
    "strict_override": Steps(lambda d: [*_near(d), *r.strict(d)], lambda d: "SELECT question_id, chunk_id, matched FROM strict_best", _TABLES, _KEEP),
    "rerank_default": Steps(lambda d: [*_near(d), r.scored(d)], lambda d: "SELECT question_id, chunk_id, CAST(toc_score AS BIGINT) AS toc_score, round(score, 5) AS score FROM scored", _TABLES, _KEEP),
    "rerank_toc_priority": Steps(_ranked, lambda d: "SELECT question_id, chunk_id, idx, branch FROM retrieved", _TABLES, _KEEP),
    "ranker_alt": Steps(lambda d: [*_near(d), *r.ranked_sections(d)], lambda d: "SELECT question_id, chunk_id, section, score, CAST(n AS BIGINT) AS n FROM sections_ranked", _TABLES, _KEEP),
    "best_subsection": Steps(_best, lambda d: "SELECT question_id, chunk_id, title, item FROM part_best", _TABLES, _KEEP),
    "best_document": Steps(_best, lambda d: "SELECT question_id, chunk_id, title, CAST(value AS BIGINT) AS value FROM best", _TABLES, _KEEP),
    "gather_contiguous": Steps(lambda d: [*_best(d), *a.gathered(d)], lambda d: f"SELECT g.question_id, md5(g.text) AS text_md5, {_J(d, 'l.ids')} AS chunk_ids FROM gathered g JOIN (SELECT question_id, {d.gather('CAST(chunk_id AS STRING)', 'ord')} AS ids FROM refs GROUP BY question_id) l ON g.question_id = l.question_id", _TABLES, _KEEP),
    "table_keypoints": Steps(_pointed, lambda d: "SELECT tid, CAST(1 AS BIGINT) AS kind, pos, item FROM table_points UNION ALL SELECT tid, CAST(2 AS BIGINT) AS kind, pos, item FROM table_cells_best WHERE item IS NOT NULL", ("documents",), _KEEP),
    "keypoints": Steps(_pointed, lambda d: "SELECT tid, place, point FROM points", ("documents",), _KEEP),
    "summary": Steps(_summed, lambda d: "SELECT tid, summary FROM summaries", ("documents",), _KEEP),
    "resume_points": Steps(lambda d: [*_texts(d), ("resume_from", f"SELECT tid, terms, phrases, {t.sentences(d, 'text')} AS items FROM texts"), *a.resumes(d, "resume_from")], lambda d: f"SELECT tid, {_J(d, 'resume')} AS resume FROM resumes", ("documents",), _KEEP),
    "highlights": Steps(_lit, lambda d: f"SELECT tid, {_J(d, 'snippets')} AS snippets FROM highlights", ("documents",), _KEEP),
    "highlight_pages": Steps(_answered, lambda d: "SELECT question_id, page, CAST(place AS BIGINT) AS place FROM pages_ranked", _TABLES, _KEEP),
    "sources_distinct": Steps(_answered, lambda d: f"SELECT question_id, {_J(d, d.map('sources', lambda x: _source_text(d, x)))} AS sources FROM citations", _TABLES, _KEEP),
    "chunk_documents": Steps(_chunked, lambda d: f"SELECT chunk_id, source, file_path, page, section, CAST(length(page_content) AS BIGINT) AS chars, md5(page_content) AS body_md5, {_J(d, 'entries')} AS entries FROM chunked", ("documents",), _KEEP),
    "whole_page": Steps(_chunked, lambda d: f"SELECT chunk_id, page, section, {_J(d, 'entries')} AS entries FROM chunked WHERE {t.is_general(d, 'section')}", ("documents",), _KEEP),
    "answer_e2e": EndToEnd(),
}

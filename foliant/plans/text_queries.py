"""Registered queries of pages, sections, sentences, tokens, question analysis and scores."""

from __future__ import annotations

from foliant.functions import pages as g
from foliant.functions import query as q
from foliant.functions import scoring as s
from foliant.functions import text as t
from foliant.functions.dialect import Dialect
from foliant.operators import ingest
from foliant.plans import fixtures as fx
from foliant.plans.base import Query, chain

_DOCS = ("documents",)


def _flag(x: str) -> str:
    return f"CAST(CASE WHEN {x} THEN 1 ELSE 0 END AS BIGINT)"


def _num(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _listed(d: Dialect, a: str) -> str:
    return d.join(a, " / ")


def scan_documents(d: Dialect) -> str:
    return f"SELECT doc_id, source, lang, {_num('length(text)')} AS chars FROM documents"


def scan_pages_html(d: Dialect) -> str:
    return f"SELECT page_id, url, {_num('length(html)')} AS chars FROM pages WHERE contains(html, '<p')"


def _predicate(name: str, words: str):
    def sql(d: Dialect) -> str:
        made = f"CASE doc_id % 5 WHEN 0 THEN concat(text, {words}) WHEN 1 THEN concat({words}, chr(10), text) ELSE text END"
        test = getattr(g, name)(d, "x")
        return f"SELECT doc_id, {_flag(test)} AS hit FROM (SELECT doc_id, {made} AS x FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"

    return sql


def header_strip(d: Dialect) -> str:
    return f"SELECT doc_id, md5(x) AS text_md5, {_num('length(x)')} AS chars FROM (SELECT doc_id, {g.without_header(d, 'text')} AS x FROM ({fx.pages(d)}))"


def page_filter_chain(d: Dialect) -> str:
    made = f"SELECT workspace_id, source, CAST(NULL AS STRING) AS file_path, page, CASE WHEN page % 11 = 4 AND source LIKE '%1' THEN concat(text, chr(10), 'toc', chr(10)) WHEN page % 13 = 5 THEN concat(text, ' Author approved by x') WHEN page % 13 = 7 THEN concat('Revision history', chr(10), 'a', chr(10), 'b', chr(10), text) ELSE text END AS text FROM ({fx.pages(d)})"
    return chain([("made", made), *ingest.kept_pages(d, "made")], f"SELECT source, {_num('page')} AS page, {_num('length(text)')} AS chars FROM kept")


def section_split(d: Dialect) -> str:
    return f"SELECT doc_id, pos, {g.section_title(d, 'item')} AS title, {_num('length(item)')} AS chars, md5(item) AS body_md5 FROM (SELECT doc_id, {g.sections(d, 'text')} AS parts FROM ({fx.structured(d)})), {d.explode('parts')} WHERE length(item) >= {g.MIN_SECTION_CHARS}"


def _entries(d: Dialect) -> list[tuple[str, str]]:
    part = lambda i: d.get(d.split("item", "\t"), str(i))
    return [
        ("listed", f"SELECT source, doc_id, {g.contents_entries(d, 'text')} AS entries FROM ({fx.contents_pages(d)})"),
        ("entries", f"SELECT source, doc_id, pos, {part(1)} AS number, {part(2)} AS title, CAST({part(3)} AS BIGINT) AS page_ref FROM listed, {d.explode('entries')}"),
        ("ranked", f"SELECT *, row_number() OVER (PARTITION BY source, number, {t.normalize(d, 'title')}, page_ref ORDER BY pos) AS n FROM entries"),
        ("contents", "SELECT source, pos, number, title, number || ' ' || title AS full_title, page_ref FROM ranked WHERE n = 1"),
    ]


def toc_extract(d: Dialect) -> str:
    return chain(_entries(d), "SELECT source, pos, number, title, page_ref FROM entries")


def toc_dedup(d: Dialect) -> str:
    return chain(_entries(d), "SELECT source, pos, full_title, page_ref FROM contents")


def toc_select(d: Dialect) -> str:
    steps = _entries(d)
    steps.append(("titled", f"SELECT doc_id, source, page, concat(CASE doc_id % 4 WHEN 0 THEN '1.1 Adding ' WHEN 1 THEN '2.1 Update ' WHEN 2 THEN 'Review ' ELSE '1 ' END, 'records') AS section FROM ({fx.pages(d)})"))
    lineage = t.same_lineage(d, "number", "entry_number")
    steps.append(("paired", f"SELECT doc_id, section, page, {t.section_number(d, 'section')} AS number, c.number AS entry_number, c.pos, c.full_title, c.page_ref FROM titled JOIN contents c ON titled.source = c.source"))
    both = d.shared(t.word_tokens(d, "section"), t.word_tokens(d, "full_title"))
    score = f"CASE WHEN number <> '' AND number = entry_number THEN 12 WHEN {lineage} THEN 8 ELSE 0 END + CASE WHEN {lineage} OR number = '' THEN {both} * 3 ELSE 0 END + CASE WHEN {lineage} AND abs(page_ref - (page + 1)) <= 1 THEN 4 ELSE 0 END"
    steps.append(("scored", f"SELECT doc_id, pos, full_title, {_num(score)} AS score FROM paired"))
    steps.append(("first", f"SELECT *, row_number() OVER (PARTITION BY doc_id, {t.normalize(d, 'full_title')} ORDER BY score DESC, pos) AS n FROM scored WHERE score > 0"))
    steps.append(("best", "SELECT doc_id, full_title, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS place FROM first WHERE n = 1"))
    return chain(steps, "SELECT doc_id, full_title, score, place FROM best WHERE place <= 4")


def internal_headings(d: Dialect) -> str:
    return f"SELECT doc_id, {_listed(d, g.headings(d, 'text'))} AS headings FROM ({fx.structured(d)})"


def nested_subsections(d: Dialect) -> str:
    part = lambda i: d.get(d.split("item", "\x02"), str(i))
    return f"SELECT doc_id, pos, {part(1)} AS title, md5({part(2)}) AS body_md5 FROM (SELECT doc_id, {g.subsections(d, 'text', d.lit('Adding Records'))} AS parts FROM ({fx.structured(d)})), {d.explode('parts')}"


def _split_query(function, table=fx.structured):
    def sql(d: Dialect) -> str:
        return f"SELECT doc_id, pos, item FROM (SELECT doc_id, {function(d, 'text')} AS parts FROM ({table(d)})), {d.explode('parts')}"

    return sql


def table_cells(d: Dialect) -> str:
    return f"SELECT doc_id, pos, {_listed(d, t.table_cells(d, 'item'))} AS cells FROM (SELECT doc_id, {t.lines(d, 'text')} AS parts FROM ({fx.structured(d)})), {d.explode('parts')}"


def tokenize(d: Dialect) -> str:
    return f"SELECT doc_id, {_num(d.size('a'))} AS n_tokens, md5({d.join('a')}) AS tokens_md5 FROM (SELECT doc_id, {t.tokens(d, 'text')} AS a FROM documents)"


def canonicalize(d: Dialect) -> str:
    return f"SELECT doc_id, md5({d.join('a')}) AS once, md5({d.join(t.stemmed(d, 'a'))}) AS twice FROM (SELECT doc_id, {t.stems(d, 'text')} AS a FROM documents)"


def normalize(d: Dialect) -> str:
    return f"SELECT doc_id, md5({t.normalize(d, 'text')}) AS plain, md5({t.clean(d, 'text')}) AS clean, md5({t.without_estimates(d, 'text')}) AS timeless, {t.heading(d, 'substring(text, 1, 90)')} AS heading, {t.header_cell(d, 'substring(text, 1, 60)')} AS cell FROM ({fx.structured(d)})"


def section_depth(d: Dialect) -> str:
    return f"SELECT doc_id, title, {_num(t.section_depth(d, 'title'))} AS depth, {t.section_number(d, 'title')} AS number, {_flag(t.is_general(d, 'title'))} AS general FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('General (page ', CAST(doc_id AS STRING), ')') WHEN 1 THEN concat(' 3.', CAST(doc_id % 9 AS STRING), '.1 Title') WHEN 2 THEN '12 Title' ELSE {fx.title(d)} END AS title FROM documents)"


def number_lineage(d: Dialect) -> str:
    a, b = "concat('1.', CAST(doc_id % 12 AS STRING))", "concat('1.', CAST(doc_id % 3 AS STRING), CASE WHEN doc_id % 2 = 0 THEN '.4' ELSE '' END)"
    return f"SELECT doc_id, {_flag(t.same_lineage(d, 'a', 'b'))} AS related FROM (SELECT doc_id, {a} AS a, {b} AS b FROM documents)"


def _analysed(d: Dialect, table: str) -> str:
    return f"SELECT *, {q.terms(d, 'question')} AS terms, {q.phrases(d, 'question')} AS phrases FROM ({table})"


def query_analysis(d: Dialect) -> str:
    return f"SELECT conv_id, turn, {t.normalize(d, 'question')} AS normalized, {_listed(d, 'terms')} AS terms, {q.summary(d, 'terms', 'phrases')} AS summary FROM ({_analysed(d, fx.user_turns(d))})"


def query_phrases(d: Dialect) -> str:
    return f"SELECT conv_id, turn, {_listed(d, 'phrases')} AS phrases FROM ({_analysed(d, fx.user_turns(d))})"


def synonym_expand(d: Dialect) -> str:
    made = "SELECT conv_id, turn, concat(question, CASE conv_id % 4 WHEN 0 THEN ' add records' WHEN 1 THEN ' delete the resource' WHEN 2 THEN ' verifies updates policies' ELSE '' END) AS question FROM (" + fx.user_turns(d) + ")"
    return f"SELECT conv_id, turn, {_listed(d, q.expand(d, 'k'))} AS expanded FROM (SELECT conv_id, turn, {q.keywords(d, 'question')} AS k FROM ({made}))"


def _sentences(d: Dialect) -> str:
    return f"SELECT doc_id, pos, item FROM (SELECT doc_id, {t.sentences(d, 'text')} AS parts FROM ({fx.structured(d)})), {d.explode('parts')}"


def useful_filter(d: Dialect) -> str:
    return f"SELECT doc_id, pos, {t.point(d, 'item', 8)} AS point FROM ({_sentences(d)}) WHERE {t.is_useful(d, 'item')}"


def visual_filter(d: Dialect) -> str:
    return f"SELECT doc_id, pos, {_flag(t.is_visual(d, 'x'))} AS visual FROM (SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN concat(item, ' -> next') WHEN 1 THEN concat('See Figure ', item) WHEN 2 THEN '|==|' ELSE item END AS x FROM ({_sentences(d)}))"


def scored_pairs(d: Dialect) -> str:
    """Each document with its source's question and made title and contents."""
    docs = f"SELECT doc_id, source, coalesce(text, '') AS text, {fx.title(d)} AS title FROM documents"
    return f"""SELECT m.doc_id, m.source, m.text, m.title, {d.array(["m.title", "'1.1 Adding records'", "concat('2.1 ', substring(m.text, 1, 30))"])} AS entries,
        qs.question_id, qs.question, qs.terms, qs.phrases, {t.stemmed(d, 'qs.terms')} AS keywords FROM ({docs}) m JOIN ({_analysed(d, fx.questions(d))}) qs ON m.source = qs.workspace_id"""


def _score_query(**columns):
    def sql(d: Dialect) -> str:
        shown = ", ".join(f"{f(d)} AS {name}" for name, f in columns.items())
        return f"SELECT doc_id, {shown} FROM (SELECT *, {q.expand(d, 'keywords')} AS expanded FROM ({scored_pairs(d)}))"

    return sql


QUERIES: dict[str, Query] = {
    "scan_documents": Query(scan_documents, _DOCS),
    "scan_pages_html": Query(scan_pages_html, ("pages",)),
    "toc_predicate": Query(_predicate("is_contents", "' .... 12'"), _DOCS),
    "toc_predicate_loose": Query(_predicate("is_contents_loose", "'.... .... .... .... 12'"), _DOCS),
    "front_matter_predicate": Query(_predicate("is_front_matter", "' Owner, status and effective date'"), _DOCS),
    "version_history_predicate": Query(_predicate("is_version_history", "' Version, description, update'"), _DOCS),
    "header_strip": Query(header_strip, _DOCS),
    "page_filter_chain": Query(page_filter_chain, _DOCS),
    "section_split": Query(section_split, _DOCS),
    "toc_extract": Query(toc_extract, _DOCS),
    "toc_dedup": Query(toc_dedup, _DOCS),
    "toc_select": Query(toc_select, _DOCS),
    "internal_headings": Query(internal_headings, _DOCS),
    "nested_subsections": Query(nested_subsections, _DOCS),
    "sentence_split": Query(_split_query(t.sentences), _DOCS),
    "long_statement_split": Query(_split_query(t.statements), _DOCS),
    "table_cells": Query(table_cells, _DOCS),
    "bullets": Query(_split_query(t.bullets), _DOCS),
    "tokenize": Query(tokenize, _DOCS),
    "canonicalize": Query(canonicalize, _DOCS),
    "normalize": Query(normalize, _DOCS),
    "section_depth": Query(section_depth, _DOCS),
    "number_lineage": Query(number_lineage, _DOCS),
    "query_analysis": Query(query_analysis, ("conversations",)),
    "query_phrases": Query(query_phrases, ("conversations",)),
    "synonym_expand": Query(synonym_expand, ("conversations",)),
    "useful_filter": Query(useful_filter, _DOCS),
    "visual_filter": Query(visual_filter, _DOCS),
    "action_phrase": Query(_score_query(run=lambda d: _flag(s.has_action_phrase(d, "title", "keywords")), content_run=lambda d: _flag(s.has_action_phrase(d, "title", "keywords", True)), phrase=lambda d: _flag(s.has_phrase(d, "title", "phrases"))), _DOCS),
    "keyword_overlap": Query(_score_query(overlap=lambda d: _num(t.overlap(d, "text", "terms")), full=lambda d: _num(s.full_bonus(d, "text", "terms", 18))), _DOCS),
    "title_dominance": Query(_score_query(dominance=lambda d: _num(s.dominance(d, "title", "terms")), boost=lambda d: _num(s.title_boost(d, "title", "expanded"))), _DOCS),
    "phrase_match": Query(_score_query(title_score=lambda d: _num(s.phrase_match(d, "title", "terms", "phrases")), text_score=lambda d: _num(s.phrase_match(d, "text", "terms", "phrases"))), _DOCS),
    "density": Query(_score_query(density=lambda d: f"round({s.density(d, 'text', 'expanded')}, 6)"), _DOCS),
    "intent_penalty": Query(_score_query(penalty=lambda d: _num(s.intent_penalty(d, t.tokens(d, "title"), t.tokens(d, "question"))), ranker_penalty=lambda d: _num(s.intent_penalty(d, q.content_words(d, "title"), q.content_words(d, "question")))), _DOCS),
    "contents_scores": Query(_score_query(entry_score=lambda d: _num(s.best_contents_score(d, "entries", "terms", "phrases")), entry=lambda d: s.best_contents_entry(d, "entries", "terms", "phrases"), boost=lambda d: _num(s.contents_boost(d, "title", "entries", "expanded")), priority=lambda d: _num(s.best_contents_match(d, "entries", "keywords", "phrases"))), _DOCS),
    "heading_boost": Query(_score_query(boost=lambda d: _num(s.heading_boost(d, "entries", "expanded"))), _DOCS),
    "info_score": Query(lambda d: f"SELECT doc_id, pos, round({t.information(d, 'item', d.words(['the', 'of', 'record']))}, 6) AS score FROM ({_sentences(d)})", _DOCS),
}

"""Retrieval: nearest chunks of each question's workspace, then re-ranking.

Inputs are the relations ``chunks`` (chunk_id, workspace_id, source, page, section,
page_content, entries, vec) and ``asked`` (question_id, workspace_id, question, vec, terms,
phrases). Embeddings are given columns, so any model can make them.
"""

from __future__ import annotations

from foliant.functions import pages as g
from foliant.functions import query as q
from foliant.functions import scoring as s
from foliant.functions import text as t
from foliant.functions.dialect import Dialect
from foliant.operators.steps import Step

FETCH = 20
KEEP = 8
TITLE_GATE = 6
PRIORITY_SCORE = 16


def dot(d: Dialect, a: str, b: str) -> str:
    if not d.spark:
        return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
    return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)"


def cosine(d: Dialect, a: str, b: str) -> str:
    """Cosine of two vectors in double precision; null where one is null or zero."""
    if not d.spark:
        return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
    return f"{dot(d, a, b)} / nullif(sqrt({dot(d, a, a)}) * sqrt({dot(d, b, b)}), 0)"


def analysed(d: Dialect, questions: str) -> Step:
    return ("asked", f"SELECT *, {t.stemmed(d, 'terms')} AS keywords, {q.expand(d, t.stemmed(d, 'terms'))} AS expanded, {t.tokens(d, 'question')} AS words FROM (SELECT *, {q.terms(d, 'question')} AS terms, {q.phrases(d, 'question')} AS phrases FROM ({questions}))")


def nearest(d: Dialect, fetch: int = FETCH) -> list[Step]:
    """``near``: the ``fetch`` chunks of its workspace that are nearest to each question, ranked from 0.

    A vector's length is computed once a row, not for each pair. The questions are a table of
    known size by then, so a batch of few is broadcast and the chunks stay where they are;
    beyond, a large workspace is split as a skewed join key.
    """
    length = lambda table: f"SELECT *, nullif(sqrt({dot(d, 'vec', 'vec')}), 0) AS len FROM {table}"
    return [
        ("asked_vectors", length("(SELECT question_id, workspace_id, vec FROM asked)")),
        ("chunk_vectors", length("(SELECT chunk_id, workspace_id, vec FROM chunks)")),
        ("measured", f"SELECT a.question_id, c.chunk_id, round({dot(d, 'a.vec', 'c.vec')} / (a.len * c.len), 6) AS cos FROM asked_vectors a JOIN chunk_vectors c ON a.workspace_id = c.workspace_id"),
        ("placed", "SELECT question_id, chunk_id, cos, row_number() OVER (PARTITION BY question_id ORDER BY cos DESC, chunk_id) - 1 AS place FROM measured WHERE cos IS NOT NULL"),
        ("near", f"SELECT p.place, p.cos, a.question_id, a.question, a.terms, a.phrases, a.keywords, a.expanded, a.words, c.chunk_id, c.workspace_id, c.source, c.page, c.section, c.page_content, c.entries, {g.headings(d, 'c.page_content')} AS headings FROM (SELECT * FROM placed WHERE place < {fetch}) p JOIN asked a ON p.question_id = a.question_id JOIN chunks c ON p.chunk_id = c.chunk_id"),
    ]


def strict(d: Dialect) -> list[Step]:
    """``strict_best``: for questions whose keywords all stand in one title (or else a heading of the text), the best such chunk."""
    first = d.get(d.where("headings", lambda h: s.covers(d, h, "keywords")), "1")
    return [
        ("titled", f"SELECT *, CASE WHEN {s.covers(d, 'section', 'keywords')} THEN section ELSE {first} END AS matched FROM near"),
        ("strict_best", f"""SELECT question_id, chunk_id, matched FROM (SELECT question_id, chunk_id, matched, row_number() OVER (PARTITION BY question_id ORDER BY
            CASE WHEN {s.has_action_phrase(d, 'matched', 'keywords')} OR {s.has_phrase(d, 'matched', 'phrases')} THEN 0 ELSE 1 END,
            {t.overlap(d, 'matched', 'keywords')} DESC, {t.section_depth(d, 'matched')} DESC, place) AS n FROM titled WHERE matched IS NOT NULL) WHERE n = 1"""),
    ]


def scored(d: Dialect) -> Step:
    """``scored``: the re-ranking score of each near chunk."""
    heading = f"{s.heading_boost(d, 'headings', 'expanded')} + CASE WHEN {d.any('headings', lambda h: s.has_phrase(d, h, 'phrases'))} THEN 10 ELSE 0 END"
    phrase = f"CASE WHEN {s.has_action_phrase(d, 'section', 'keywords')} OR {s.has_phrase(d, 'section', 'phrases')} THEN 12 ELSE 0 END"
    signals = f"SELECT *, {s.best_contents_match(d, 'entries', 'keywords', 'phrases')} AS toc_score, {s.title_boost(d, 'section', 'expanded')} + {s.contents_boost(d, 'section', 'entries', 'expanded')} + {phrase} + {heading} AS boosts FROM near"
    return (
        "scored",
        f"""SELECT *, CAST({KEEP} - place + boosts + toc_score - {s.intent_penalty(d, t.tokens(d, 'section'), 'words')} AS DOUBLE)
        + CASE WHEN boosts + toc_score >= {TITLE_GATE} THEN 2 * {s.density(d, 'page_content', 'expanded')} ELSE 0.0E0 END AS score FROM ({signals})""",
    )


def reranked(d: Dialect) -> list[Step]:
    """``retrieved`` (question_id, chunk_id, idx, branch): the chunks of each question in order, from 0.

    A strict match stands alone. Else chunks with a contents score of PRIORITY_SCORE come
    first, up to KEEP, filled by score to KEEP, and by one at least. Else the KEEP best by score.
    """
    return [
        *strict(d),
        scored(d),
        ("ordered", f"""SELECT question_id, chunk_id, place, score, toc_score >= {PRIORITY_SCORE} AS priority,
            row_number() OVER (PARTITION BY question_id, toc_score >= {PRIORITY_SCORE} ORDER BY CASE WHEN toc_score >= {PRIORITY_SCORE} THEN toc_score ELSE 0 END DESC, round(score, 9) DESC, place) AS n FROM scored"""),
        ("parted", f"SELECT *, priority AND n <= {KEEP} AS leads, least({KEEP}, sum(CASE WHEN priority THEN 1 ELSE 0 END) OVER (PARTITION BY question_id)) AS n_leads FROM ordered"),
        ("filled", "SELECT *, row_number() OVER (PARTITION BY question_id, leads ORDER BY CASE WHEN leads THEN n ELSE 0 END, round(score, 9) DESC, place) AS k FROM parted"),
        ("retrieved", f"""SELECT question_id, chunk_id, CAST(0 AS BIGINT) AS idx, 'strict' AS branch FROM strict_best
            UNION ALL SELECT question_id, chunk_id, CAST(CASE WHEN leads THEN k ELSE n_leads + k END - 1 AS BIGINT) AS idx, CASE WHEN n_leads > 0 THEN 'contents' ELSE 'default' END AS branch
            FROM filled f WHERE (leads OR k <= CASE WHEN n_leads > 0 THEN greatest({KEEP} - n_leads, 1) ELSE {KEEP} END) AND NOT EXISTS (SELECT 1 FROM strict_best b WHERE b.question_id = f.question_id)"""),
    ]


def ranked_sections(d: Dialect) -> list[Step]:
    """``sections_ranked``: the second ranker, which scores chunks by title, contents and body words and drops those without a hit in the first two."""
    words = lambda x: t.stemmed(d, q.content_words(d, x))
    own = t.stemmed(d, q.content_words(d, "question"))
    count = d.size(d.distinct("own"))

    def entry(e: str) -> str:
        return d.let(words(e), lambda w: d.let(d.shared("own", w), lambda n: f"CASE WHEN {n} > 0 AND {n} = {count} THEN 9 WHEN {n} >= 2 THEN 6 WHEN {n} = 1 THEN 3 WHEN {d.shared('wide', w)} >= 2 THEN 4 WHEN {d.shared('wide', w)} = 1 THEN 2 ELSE 0 END"))

    def entry_score(e: str) -> str:
        return d.let(entry(e), lambda v: f"{v} + CASE WHEN {v} > 0 AND {t.normalize(d, e)} <> '' AND {t.normalize(d, e)} = {t.normalize(d, 'section')} THEN 6 ELSE 0 END")

    title = d.let(words("section"), lambda w: d.let(d.shared("own", w), lambda n: f"{n} * 4 + greatest({d.shared('wide', w)} - {n}, 0) * 2 + CASE WHEN {n} > 0 AND {n} = {count} THEN 6 + 2 * ({t.section_depth(d, 'section')}) ELSE 0 END"))
    hit = f"{d.shared('wide', words('section'))} > 0 OR {d.shared('own', words('section'))} > 0"
    body = d.size(d.where("wide", lambda w: f"contains({t.normalize(d, 'page_content')}, {w})"))
    penalty = s.intent_penalty(d, q.content_words(d, "section"), q.content_words(d, "question"))
    return [
        ("worded", f"SELECT *, {q.expand(d, 'own', q.RANKER_STOP_WORDS)} AS wide FROM (SELECT *, {own} AS own FROM near)"),
        ("sections_scored", f"SELECT question_id, chunk_id, place, section, CASE WHEN {hit} THEN {title} + CASE WHEN {s.has_action_phrase(d, 'section', 'own', True)} THEN 12 ELSE 0 END ELSE 0 END AS of_title, {hit} AS in_title, {d.largest(d.map('entries', entry_score))} AS of_entries, {body} AS in_body, {penalty} AS penalty FROM worded"),
        ("sections_ranked", "SELECT question_id, chunk_id, section, round(CAST(of_title + of_entries - penalty AS DOUBLE) + in_body * 0.5E0, 3) AS score, row_number() OVER (PARTITION BY question_id ORDER BY of_title + of_entries - penalty + in_body * 0.5E0 DESC, place) AS n FROM sections_scored WHERE in_title OR of_entries > 0"),
    ]

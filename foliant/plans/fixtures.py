"""Inputs of the registered queries: the driver's documents seen as pages, sections, chunks and questions.

The driver's texts hold no headings, contents pages or tables, so those are put around them.
"""

from __future__ import annotations

from foliant.functions import text as t
from foliant.functions.dialect import Dialect

_NL = "chr(10)"


def pages(d: Dialect) -> str:
    """Documents as pages of their source, from 0."""
    return "SELECT doc_id, source AS workspace_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page, coalesce(text, '') AS text FROM documents"


def dealt_pages() -> str:
    """The rows of ``pages`` on Spark, in tasks by page: only ids meet by source, so no task has to sort all texts of one."""
    keyed = "SELECT struct(source, doc_id) AS row_key, source, doc_id, {} FROM documents"
    first = f"SELECT row_key, sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n AS first FROM ({keyed.format('count(*) AS n')} GROUP BY source, doc_id)"
    numbered = f"""SELECT d.doc_id, d.source, CAST(f.first + row_number() OVER (PARTITION BY d.row_key ORDER BY d.doc_id) - 1 AS INT) AS page, coalesce(d.text, '') AS text
        FROM ({keyed.format('text')}) d JOIN ({first}) f ON d.row_key = f.row_key"""
    return f"SELECT /*+ REPARTITION(source, page) */ doc_id, source AS workspace_id, source, page, text FROM ({numbered})"


def title(d: Dialect, x: str = "text") -> str:
    """A heading made of a text's first words; some hold action words and synonyms."""
    words = d.join(d.slice(t.tokens(d, x), "1", "4"))
    return f"concat(CAST(doc_id % 7 + 1 AS STRING), '.', CAST(doc_id % 3 + 1 AS STRING), ' Aa ', {words}, CASE doc_id % 5 WHEN 0 THEN ' Add Records' WHEN 1 THEN ' Delete Resource' WHEN 2 THEN ' After Update' ELSE '' END)"


def structured(d: Dialect) -> str:
    """Whole documents with two section headings, heading lines, a table, bullets and estimates put in at their start and end."""
    parts = [
        "'Before it. '", "CAST(doc_id % 4 + 1 AS STRING)", "'.1 Adding Records (New) NO ACTION'", _NL, "substring(text, 1, 400)", _NL,
        "CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('7.', CAST(doc_id % 6 AS STRING), '.2 Update Policy  Estimation time in total: 5 min') END", _NL,
        "'2.3 Review the Plan'", _NL, "'- check every record; then submit it'", _NL, "substring(text, 401)", _NL, "'2.3  review the plan'", _NL, "'2.4 Review the Plan'", _NL,
        "CASE doc_id % 4 WHEN 0 THEN concat('No | Action | Time', chr(10), '1 | Submit the form today | 5 min', chr(10), '2 | Review all open records | 9') WHEN 1 THEN concat('Role | Action | Time', chr(10), 'Owner | Verify the monthly report | 10', chr(10), '3 | x | -') WHEN 2 THEN concat('a  b   Confirm the new entry', chr(10), '> -> flow') ELSE '• notify the owner of changes' END",
    ]
    return f"SELECT doc_id, source, concat({', '.join(parts)}) AS text FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)"


def contents_pages(d: Dialect) -> str:
    """A contents page for each source, with entries that repeat, nest, and stand before a chapter line."""
    return f"""SELECT source, min(doc_id) AS doc_id, concat('Table of Contents', {_NL}, '1.1 Adding records .... 3', {_NL}, '1.2 Delete  resource ..... 5', {_NL}, '4 Chapter', {_NL}, '4.1 Lost entry .... 8', {_NL}, '5 Last chapter', {_NL},
        '2.1 Update policy ... ', CAST(min(doc_id) % 9 AS STRING), {_NL}, '2.1.1 Review ', max(source), ' ... 4', {_NL}, '1.1 adding  Records .. 3', {_NL}, '7.1 End .. 12') AS text FROM documents GROUP BY source"""


def questions(d: Dialect) -> str:
    """A question for each source, about words of its first document."""
    words = t.tokens(d, "text")
    return f"""SELECT row_number() OVER (ORDER BY source) AS question_id, source AS workspace_id, doc_id,
        concat('How to ', CASE doc_id % 3 WHEN 0 THEN 'add ' WHEN 1 THEN 'delete ' ELSE '' END, {d.join(d.slice(words, '1', '3'))}, ' records?') AS question
        FROM (SELECT source, doc_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE source IS NOT NULL) WHERE n = 1"""


def user_turns(d: Dialect) -> str:
    return "SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'"


def ingested_pages(d: Dialect) -> str:
    """Documents as pages with a file path; each second one with headings, and some sources with a contents page after their second page."""
    text = "CASE WHEN p.doc_id % 2 = 0 THEN s.text ELSE p.text END"
    return f"""SELECT p.workspace_id, p.source, concat('uploads/', p.workspace_id, '_', p.source, '.pdf') AS file_path, CAST(p.page * 2 AS BIGINT) AS page, {text} AS text
        FROM ({pages(d)}) p JOIN ({structured(d)}) s ON p.doc_id = s.doc_id
        UNION ALL SELECT source AS workspace_id, source, concat('uploads/', source, '_', source, '.pdf') AS file_path, CAST(3 AS BIGINT) AS page, text FROM ({contents_pages(d)}) WHERE doc_id % 2 = 1 AND source IS NOT NULL"""

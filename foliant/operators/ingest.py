"""From pages to chunks: page filters, contents entries, sections, whole pages.

Pages are the relation ``pages`` (workspace_id, source, file_path, page, text), pages
numbered from 0 in each source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import pages as g
from foliant.functions import text as t
from foliant.functions.dialect import SPARK, Dialect
from foliant.operators.steps import Step, run_steps

ENTRIES = 4
KEEP = ("flagged", "cut", "contents")
_SOURCE = "workspace_id, source"


def kept_pages(d: Dialect, pages: str = "pages") -> list[Step]:
    """``kept`` (workspace_id, source, file_path, page, text): pages left by all page filters, without repeated headers.

    Pages before a source's first contents page go, or its first two where it has none;
    then contents pages, front matter and version histories. The first contents page is
    judged on the text as it came, the rest on the text without header lines.
    """
    return [
        ("raw", f"SELECT {_SOURCE}, file_path, page, text, {g.is_contents(d, 'text')} AS is_contents FROM (SELECT {_SOURCE}, file_path, page, {t.trim(d, 'text')} AS text FROM {pages})"),
        ("flagged", f"SELECT {_SOURCE}, file_path, page, text AS raw_text, is_contents, {g.without_header(d, 'text')} AS text, min(CASE WHEN is_contents THEN page END) OVER (PARTITION BY {_SOURCE}) AS contents_page FROM raw"),
        ("kept", f"SELECT {_SOURCE}, file_path, page, text FROM flagged WHERE CASE WHEN contents_page IS NULL THEN page > 1 ELSE page >= contents_page END AND NOT {g.is_contents(d, 'text')} AND NOT {g.is_front_matter(d, 'text')} AND NOT {g.is_version_history(d, 'text')}"),
    ]


def contents_of(d: Dialect) -> list[Step]:
    """``contents`` (workspace_id, source, place, number, full_title, page_ref): different entries of each source's contents pages, in order."""
    part = lambda i: d.get(d.split("item", "\t"), str(i))
    return [
        ("contents_items", f"SELECT {_SOURCE}, page, pos, {part(1)} AS number, {part(2)} AS title, CAST({part(3)} AS BIGINT) AS page_ref FROM (SELECT {_SOURCE}, page, {g.contents_entries(d, 'raw_text')} AS items FROM flagged WHERE is_contents), {d.explode('items')}"),
        ("contents_first", f"SELECT *, row_number() OVER (PARTITION BY {_SOURCE}, number, {t.normalize(d, 'title')}, page_ref ORDER BY page, pos) AS n FROM contents_items"),
        ("contents", f"SELECT {_SOURCE}, CAST(row_number() OVER (PARTITION BY {_SOURCE} ORDER BY page, pos) AS BIGINT) AS place, number, number || ' ' || title AS full_title, page_ref FROM contents_first WHERE n = 1"),
    ]


def entries_of_chunks(d: Dialect) -> list[Step]:
    """``chunk_entries`` (chunk_id, entries): the ENTRIES contents entries of its source that suit a chunk's section best.

    An entry of the same number counts 12, of the same lineage 8; shared words 3 each, where
    the lineage is the same or the section has no number; a page reference next to the
    chunk's page 4, with the lineage. Reads cut and contents; words of both are made once a row.
    """
    lineage = t.same_lineage(d, "number", "entry_number")
    near = f"CASE WHEN {lineage} AND abs(page_ref - (page + 1)) <= 1 THEN 4 ELSE 0 END"
    score = f"CASE WHEN number <> '' AND number = entry_number THEN 12 WHEN {lineage} THEN 8 ELSE 0 END + CASE WHEN {lineage} OR number = '' THEN {d.shared('words_in', 'entry_words')} * 3 ELSE 0 END + {near}"
    return [
        ("headed", f"SELECT chunk_id, {_SOURCE}, page, {t.section_number(d, 'section')} AS number, {t.word_tokens(d, 'section')} AS words_in FROM cut"),
        ("worded_contents", f"SELECT {_SOURCE}, place, number AS entry_number, full_title, page_ref, {t.word_tokens(d, 'full_title')} AS entry_words, {t.normalize(d, 'full_title')} AS entry_norm FROM contents"),
        ("matched_contents", f"SELECT chunk_id, place, full_title, entry_norm, {score} AS score FROM headed h JOIN worded_contents c ON h.workspace_id = c.workspace_id AND h.source = c.source"),
        ("first_matches", "SELECT *, row_number() OVER (PARTITION BY chunk_id, entry_norm ORDER BY score DESC, place) AS n FROM matched_contents WHERE score > 0"),
        ("best_matches", "SELECT chunk_id, full_title, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, place) AS rank FROM first_matches WHERE n = 1"),
        ("chunk_entries", f"SELECT chunk_id, {d.gather('full_title', 'rank')} AS entries FROM best_matches WHERE rank <= {ENTRIES} GROUP BY chunk_id"),
    ]


def chunk_steps(d: Dialect, pages: str = "pages") -> list[Step]:
    """``chunked`` (chunk_id, workspace_id, source, file_path, page, section, page_content, entries).

    A page's sections of MIN_SECTION_CHARS characters or more; a page without a section
    heading is one chunk named ``General (page N)`` if it has MIN_PAGE_CHARS.
    """
    chunk_id = "concat(workspace_id, '/', source, '/', lpad(CAST(page AS STRING), 6, '0'), '/', lpad(CAST(pos AS STRING), 4, '0'))"
    fields = f"{_SOURCE}, file_path, page, pos, section, page_content"
    return [
        *kept_pages(d, pages),
        *contents_of(d),
        ("parted_pages", f"SELECT {_SOURCE}, file_path, page, text, {g.sections(d, 'text')} AS parts FROM kept"),
        ("cut", f"""SELECT {chunk_id} AS chunk_id, {fields} FROM (
            SELECT {_SOURCE}, file_path, page, pos, {g.section_title(d, 'item')} AS section, item AS page_content FROM parted_pages, {d.explode('parts')} WHERE length(item) >= {g.MIN_SECTION_CHARS}
            UNION ALL SELECT {_SOURCE}, file_path, page, CAST(0 AS BIGINT) AS pos, concat('General (page ', CAST(page AS STRING), ')') AS section, text AS page_content FROM parted_pages WHERE {d.size('parts')} = 0 AND length(text) >= {g.MIN_PAGE_CHARS})"""),
        *entries_of_chunks(d),
        ("chunked", f"SELECT c.chunk_id, c.workspace_id, c.source, c.file_path, CAST(c.page AS BIGINT) AS page, c.section, c.page_content, coalesce(e.entries, {d.none()}) AS entries FROM cut c LEFT JOIN chunk_entries e ON c.chunk_id = e.chunk_id"),
    ]


def chunk_documents(pages: DataFrame) -> DataFrame:
    """Chunks of pages (workspace_id, source, file_path, page, text), ready to be embedded and stored.

    Null texts count as empty; a null workspace or source is none and its pages are left out.
    file_path may be missing. Repeated (source, page) rows are cut each, under ids that repeat.
    """
    if "file_path" not in pages.columns:
        pages = pages.withColumn("file_path", F.lit(None).cast("string"))
    pages = pages.select("workspace_id", "source", "file_path", F.col("page").cast("long").alias("page"), "text").where("workspace_id IS NOT NULL AND source IS NOT NULL")
    return run_steps(pages.sparkSession, chunk_steps(SPARK), "SELECT * FROM chunked", {"pages": pages}, KEEP)

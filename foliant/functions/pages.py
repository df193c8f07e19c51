"""Pages of documents: which to skip, where sections and contents entries are."""

from __future__ import annotations

from foliant.functions import text as t
from foliant.functions.dialect import Dialect

# What marks front matter and version histories.
FRONT_PAIRS = (("authorship", "approval"), ("author", "approved by"), ("classification", "status"), ("document number", "reference code"), ("document no", "reference code"), ("document number", "document status"))
FRONT_WORDS = ("authorship", "approval", "approved by", "classification", "document status", "status", "document number", "document no", "reference code", "reference no", "effective date", "owner")
VERSION_PHRASES = ("version history", "revision history", "document control", "change log", "revision log", "amendment history", "version control", "approved by", "effective date")
FRONT_MAX_CHARS = 2500
MIN_PAGE_CHARS = 300
MIN_SECTION_CHARS = 120

# The forms of numbered headings and contents entries.
_NUMBER = r"(?:\d+\.)+\d+"
_TITLE = r"[A-Z][A-Za-z0-9/&()' -]{2,120}?"
_AFTER = r"\s+(?:Estimation time in total:|NO ACTION)"
_HEADING_LINE = r"(?m)^\s*((?:\d+\.)+\d+)\s+([A-Z][A-Za-z0-9/&()'., -]{2,140}?)\s*$"
_OPEN, _CLOSE = "\x01", "\x02"


def is_contents(d: Dialect, x: str) -> str:
    return d.let(f"lower(coalesce({x}, ''))", lambda v: f"(contains({v}, 'table of contents') OR {d.matches(v, r'(?m)^\s*toc\s*$')} OR {d.matches(v, r'(?m)\.{4,}\s*\d+$')})")


def is_contents_loose(d: Dialect, x: str) -> str:
    """The loader's test: the word, or more than three leaders of four dots."""
    return d.let(f"lower(coalesce({x}, ''))", lambda v: f"(contains({v}, 'contents') OR (length({v}) - length(replace({v}, '....', ''))) / 4 > 3)")


def is_front_matter(d: Dialect, x: str) -> str:
    def test(v: str) -> str:
        pairs = " OR ".join(f"(contains({v}, {d.lit(a)}) AND contains({v}, {d.lit(b)}))" for a, b in FRONT_PAIRS)
        held = d.size(d.where(d.words(FRONT_WORDS), lambda w: f"contains({v}, {w})"))
        return f"({pairs} OR ({held} >= 3 AND length({v}) < {FRONT_MAX_CHARS}))"

    return d.let(f"lower(coalesce({x}, ''))", test)


def is_version_history(d: Dialect, x: str) -> str:
    return d.let(f"lower(coalesce({x}, ''))", lambda v: f"({d.any(d.words(VERSION_PHRASES), lambda w: f'contains({v}, {w})')} OR (contains({v}, 'version') AND contains({v}, 'date') AND contains({v}, 'description')))")


def without_header(d: Dialect, x: str) -> str:
    """Without the lines that hold one of the first three; texts of fewer lines stay."""

    def of(a: str) -> str:
        heads = d.where(d.map(d.slice(a, "1", "3"), lambda h: t.trim(d, h)), lambda h: f"{h} <> ''")
        kept = d.let(heads, lambda hs: d.where(a, lambda v: f"NOT {d.any(hs, lambda h: f'contains({v}, {h})')}"))
        return f"CASE WHEN {d.size(a)} < 3 THEN {x} ELSE {t.trim(d, d.join(kept, chr(10)))} END"

    return d.let(t.lines(d, x), of)


def sections(d: Dialect, x: str) -> str:
    """Parts of a page from each section heading to the next; text before the first is dropped."""
    if d.spark:
        marked = f"regexp_replace({x}, {d.re(rf'(?<!\w){_NUMBER}\s+{_TITLE}(?={_AFTER})')}, '{_OPEN}$0')"
    else:
        marked = d.replace(x, rf"(^|[^0-9A-Za-z_])({_NUMBER}\s+{_TITLE}{_AFTER})", f"\\1{_OPEN}\\2")
    parts = d.split(f"coalesce({marked}, '')", _OPEN)
    return d.let(parts, lambda a: d.where(d.map(a, lambda p: t.trim(d, p)), lambda p, i: f"{i} > 1", index=True))


def section_title(d: Dialect, part: str) -> str:
    return f"{d.extract(part, rf'^({_NUMBER})', 1)} || ' ' || {d.extract(part, rf'^{_NUMBER}\s+({_TITLE}){_AFTER}', 1)}"


def contents_entries(d: Dialect, x: str) -> str:
    """Entries of a contents page, each as number, title and page, tab-separated."""
    if d.spark:
        pattern = rf"({_NUMBER})\s+(.+?)\s+\.{{2,}}\s*(\d+)(?=\s+(?:{_NUMBER})\s+|\z|\n\z)"
        pick = lambda i: d.extract_all(x, pattern, i)
        zipped = f"zip_with({pick(1)}, zip_with({pick(2)}, {pick(3)}, (h, p) -> struct(h, p)), (n, r) -> struct(n, r.h AS h, r.p AS p))"
        return d.map(zipped, lambda e: f"concat({e}.n, chr(9), {t.collapse(d, f'{e}.h')}, chr(9), {e}.p)")
    parts = d.split(d.replace(x, rf"(^|\s)({_NUMBER}\s)", f"\\1{_OPEN}\\2"), _OPEN)
    whole = rf"^({_NUMBER})\s+([^\n]+?)\s+\.{{2,}}\s*(\d+)\s*\z"
    return d.map(d.where(parts, lambda p: d.matches(p, whole)), lambda p: f"concat({d.extract(p, whole, 1)}, chr(9), {t.collapse(d, d.extract(p, whole, 2))}, chr(9), {d.extract(p, whole, 3)})")


def headings(d: Dialect, x: str) -> str:
    """Numbered heading lines of a text, without repeats."""

    def of(x: str) -> str:
        numbers, titles = d.extract_all(x, _HEADING_LINE, 1), d.extract_all(x, _HEADING_LINE, 2)
        return d.let(titles, lambda ts: d.map(numbers, lambda n, i: f"{n} || ' ' || {d.get(ts, i)}", index=True))

    found = d.let(f"coalesce({x}, '')", of)
    return d.let(found, lambda a: d.let(d.map(a, lambda h: t.normalize(d, h)), lambda norm: d.where(a, lambda h, i: f"{'array_position' if d.spark else 'list_position'}({norm}, {d.get(norm, i)}) = {i}", index=True)))


def subsections(d: Dialect, x: str, parent: str) -> str:
    """Parts of a text under its heading lines, as title and body (split by ``\\x02``), but the parent's own and empty ones."""
    parts = d.split(d.replace(f"coalesce({x}, '')", _HEADING_LINE, f"{_OPEN}\\1 \\2{_CLOSE}"), _OPEN)
    title = lambda p: d.get(d.split(p, _CLOSE), "1")
    body = lambda p: t.trim(d, d.get(d.split(p, _CLOSE), "2"))
    good = d.where(parts, lambda p, i: f"{i} > 1 AND {t.heading(d, title(p))} <> {t.heading(d, parent)} AND {body(p)} <> ''", index=True)
    return d.map(good, lambda p: f"{title(p)} || '{_CLOSE}' || {body(p)}")

"""Text functions: cleaning, tokens, stems, sentences, table cells, headings, and what is worth saying.

Each takes a dialect and SQL expressions and returns a SQL expression; ``column`` makes a Column.
Nulls count as empty text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.dialect import SPARK, Dialect

_CUT = "\x01"  # stands where a text is to be split


def column(function: Callable[..., str], *names: str, **options) -> Column:
    """A text or scoring function over columns (given by name) as a Spark column."""
    return F.expr(function(SPARK, *names, **options))


def collapse(d: Dialect, x: str) -> str:
    """White space runs as one space, none at the ends."""
    return d.strip(d.replace(f"coalesce({x}, '')", r"\s+", " "), " ")


def trim(d: Dialect, x: str) -> str:
    return d.replace(f"coalesce({x}, '')", r"^\s+|\s+\z")


def normalize(d: Dialect, x: str) -> str:
    return f"lower({collapse(d, x)})"


def lines(d: Dialect, x: str) -> str:
    """Lines of a text; a last empty one doesn't count."""
    unified = d.replace(f"coalesce({x}, '')", "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85  ]", "\n")
    return d.let(d.split(unified, "\n"), lambda a: f"CASE WHEN {d.get(a, d.size(a))} = '' THEN {d.slice(a, '1', d.size(a) + ' - 1')} ELSE {a} END")


def tokens(d: Dialect, x: str) -> str:
    return d.extract_all(f"lower(coalesce({x}, ''))", "[a-z0-9]+")


def stem(d: Dialect, t: str) -> str:
    n = f"length({t})"
    return f"CASE WHEN {n} > 4 AND {t} LIKE '%ies' THEN substring({t}, 1, {n} - 3) || 'y' WHEN {n} > 4 AND {t} LIKE '%es' THEN substring({t}, 1, {n} - 2) WHEN {n} > 3 AND {t} LIKE '%s' THEN substring({t}, 1, {n} - 1) ELSE {t} END"


def stemmed(d: Dialect, a: str) -> str:
    return d.map(a, lambda t: stem(d, t))


def stems(d: Dialect, x: str) -> str:
    """Stemmed tokens of a text."""
    return stemmed(d, tokens(d, x))


def space_words(d: Dialect, x: str) -> str:
    """Words between white space."""
    return d.where(d.split(collapse(d, x), " "), lambda w: f"{w} <> ''")


def sentences(d: Dialect, x: str) -> str:
    plain = d.strip(collapse(d, x), " .:-")
    cut = d.replace(d.replace(d.replace(plain, r"([.!?])\s+", "\\1" + _CUT), r";\s+", _CUT), r":\s+([A-Z])", ":" + _CUT + "\\1")
    return d.where(d.map(d.split(cut, _CUT), lambda p: d.strip(p, " .:-")), lambda p: f"{p} <> ''")


def statements(d: Dialect, x: str) -> str:
    """Parts of a long statement that have 12 characters or more."""
    plain = d.strip(collapse(d, x), " .:-")
    cut = d.replace(d.replace(plain, r"([.!?])\s+", "\\1" + _CUT), r";\s+", _CUT)
    return d.where(d.map(d.split(cut, _CUT), lambda p: d.strip(p, " .:-")), lambda p: f"length({p}) >= 12")


def table_cells(d: Dialect, line: str) -> str:
    def cells(v: str) -> str:
        return f"CASE WHEN contains({v}, '|') THEN {d.split(v, '|')} WHEN contains({v}, chr(9)) THEN {d.split(v, chr(9))} ELSE {d.split(d.replace(v, r'\s{2,}', _CUT), _CUT)} END"

    return d.let(f"coalesce({line}, '')", lambda v: d.where(d.map(cells(v), lambda c: d.strip(c, " :-")), lambda c: f"{c} <> '' AND NOT {d.matches(c, r'^[-=]+\z')}"))


def bullets(d: Dialect, x: str) -> str:
    return d.extract_all(f"coalesce({x}, '')", r"(?m)^\s*[-•]\s+([^\n]*[^\s])", 1)


def heading(d: Dialect, x: str) -> str:
    """A heading without number and edge marks, in lower case."""
    return f"lower({d.replace(d.strip(collapse(d, x), ' .:-|'), r'^\d+(\.\d+)*\s*')})"


def header_cell(d: Dialect, x: str) -> str:
    return collapse(d, d.replace(heading(d, x), r"[()_/\\-]+", " "))


def section_number(d: Dialect, x: str) -> str:
    return d.extract(f"coalesce({x}, '')", r"^\s*((\d+\.)*\d+)\b", 1)


def section_depth(d: Dialect, x: str) -> str:
    """Dots in the number that a heading starts with."""
    return d.let(d.extract(f"coalesce({x}, '')", r"^\s*((\d+\.)*\d+)", 1), lambda n: f"length({n}) - length(replace({n}, '.', ''))")


def same_lineage(d: Dialect, a: str, b: str) -> str:
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR {d.starts(a, f'{b} || {d.lit('.')}')} OR {d.starts(b, f'{a} || {d.lit('.')}')}))"


def word_tokens(d: Dialect, x: str) -> str:
    """Different tokens that are not numbers."""
    return d.distinct(d.where(tokens(d, x), lambda t: f"NOT {d.matches(t, '^[0-9]+' + chr(92) + 'z')}"))


def is_general(d: Dialect, title: str) -> str:
    return d.starts(f"lower({trim(d, title)})", "'general (page '")


_ESTIMATE = r"(?i)\bestimation time(\s+in\s+total)?\s*:"


def without_estimates(d: Dialect, x: str) -> str:
    """Without lines that state an estimation time, nor one that goes on over line ends; at most one blank line in a row."""
    kept = d.where(lines(d, x), lambda v: f"NOT {d.matches(v, _ESTIMATE)}")
    spanning = d.replace(d.join(kept, "\n"), _ESTIMATE + r"\s*[^\n]*")
    return trim(d, d.replace(spanning, r"\n{3,}", "\n\n"))


def clean(d: Dialect, x: str) -> str:
    """One line without estimates, section numbers before capitals and a last page number."""
    numbered = d.replace(without_estimates(d, x), r"\n?\s*\d+(\.\d+)*\s+([A-Z])", "\n\\2")
    return collapse(d, d.replace(numbered, r"\s\d+\s*\z"))


# A line with one of these belongs to a picture.
VISUAL_WORDS = ("figure", "image", "diagram", "flowchart", "flow chart", "workflow", "process flow", "see figure", "refer to figure", "illustration", "smartart", "screenshot")


def is_visual(d: Dialect, x: str) -> str:
    return d.let(normalize(d, x), lambda v: f"({v} = '' OR {d.any(d.words(VISUAL_WORDS), lambda k: f'contains({v}, {k})')} OR {d.matches(v, r'^[>|=-]{4,}' + chr(92) + 'z')} OR contains({v}, '->'))")


def is_useful(d: Dialect, x: str) -> str:
    """Whether a text can stand as a point: long enough, no picture, no number, no estimate."""

    def test(v: str) -> str:
        noise = d.matches(f"lower({v})", r"^(page \d+|\d+|table of contents)\z")
        letters = d.matches(v, r"\p{L}")
        return f"(length({v}) >= 12 AND NOT {is_visual(d, v)} AND {letters} AND NOT {noise} AND NOT {d.matches(v, _ESTIMATE)})"

    return d.let(d.strip(collapse(d, x), " .:-|"), test)


# Words that mark an instruction, and first words that mark a remark.
ACTION_WORDS = ("must", "should", "required", "require", "ensure", "verify", "check", "update", "create", "delete", "remove", "submit", "record", "complete", "review", "confirm", "notify", "enter", "select", "attach", "provide")
WEAK_STARTS = ("note", "example", "remarks", "remark", "time", "no", "status", "description", "details")


def information(d: Dialect, x: str, terms: str) -> str:
    """How much a sentence tells, given query terms."""

    def score(v: str) -> str:
        def of(w: str) -> str:
            n = d.size(w)
            actions = d.size(d.where(w, lambda t: d.has(d.words(ACTION_WORDS), t)))
            return (
                f"(least({n}, 24) / 4.0E0 + {actions} * 1.2E0 + CASE WHEN contains({v}, ':') THEN 1.0E0 ELSE 0.0E0 END"
                f" + CASE WHEN {d.any(w, lambda t: d.matches(t, '^[0-9]+' + chr(92) + 'z'))} THEN 0.4E0 ELSE 0.0E0 END"
                f" + {overlap(d, v, terms)} * 2.5E0"
                f" - CASE WHEN {d.has(d.words(WEAK_STARTS), f'coalesce({d.get(w, '1')}, {d.lit('')})')} THEN 1.5E0 ELSE 0.0E0 END"
                f" - CASE WHEN {n} < 5 THEN 2.0E0 ELSE 0.0E0 END - CASE WHEN {n} > 32 THEN 1.0E0 ELSE 0.0E0 END"
                f" + CASE WHEN {d.matches(f'lower({v})', '^(if|when|after|before) ')} THEN 0.8E0 ELSE 0.0E0 END)"
            )

        return f"CASE WHEN {v} = '' OR {d.matches(v, _ESTIMATE)} THEN -1.0E0 ELSE {d.let(tokens(d, v), of)} END"

    return d.let(collapse(d, x), score)


def overlap(d: Dialect, x: str, terms: str) -> str:
    """Number of different query terms among a text's stems."""
    return d.shared(stems(d, x), terms)


def shorten(d: Dialect, words: str, most: int) -> str:
    return f"CASE WHEN {d.size(words)} > {most} THEN {d.join(d.slice(words, '1', str(most)))} || '...' ELSE {d.join(words)} END"


def point(d: Dialect, x: str, most: int = 28) -> str:
    """The first sentence of a text as a point of at most ``most`` words; ``label: rest`` keeps a short label."""

    def of(s: str) -> str:
        left, right = d.extract(s, r"^([^:]*):", 1), d.extract(s, r"^[^:]*:((?s).*)", 1)

        def labelled(words: str) -> str:
            return f"CASE WHEN {d.size(words)} > 0 AND {collapse(d, left)} <> '' AND {d.size(space_words(d, left))} <= 6 THEN {trim(d, left)} || ': ' || {shorten(d, words, most)} ELSE {d.let(space_words(d, s), lambda w: f'CASE WHEN {d.size(w)} > {most} THEN {shorten(d, w, most)} ELSE {s} END')} END"

        return d.let(space_words(d, right), labelled)

    numbered = d.replace(d.strip(collapse(d, x), " .:-|"), r"^\d+(\.\d+)*\s*")
    return d.let(d.strip(f"coalesce({d.get(sentences(d, numbered), '1')}, '')", " ."), of)


def overview(d: Dialect, first: str) -> str:
    """The first sentence of the first point, at most 20 words."""
    sentence = d.extract(f"coalesce({first}, '')", r"^[^.]*")
    return d.let(space_words(d, sentence), lambda w: f"CASE WHEN {d.size(w)} > 20 THEN {shorten(d, w, 20)} ELSE {trim(d, sentence)} END")


def opening(d: Dialect, first: str) -> str:
    """The first 25 words of the first point and an ellipsis, always; nothing without a point."""
    return f"CASE WHEN {first} IS NULL THEN '' ELSE {d.join(d.slice(space_words(d, first), '1', '25'))} || '...' END"


def rest(d: Dialect, points: str) -> str:
    """All points but the first."""
    return f"CASE WHEN {d.size(points)} <= 1 THEN {d.none()} ELSE {d.slice(points, '2', f'greatest({d.size(points)} - 1, 1)')} END"


def encoded(d: Dialect, x: str) -> str:
    """Base64 of a text's UTF-8 bytes."""
    return f"replace(base64(encode({x}, 'UTF-8')), concat(chr(13), chr(10)), '')" if d.spark else f"base64(encode({x}))"

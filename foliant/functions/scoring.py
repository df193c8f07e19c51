"""Scores of titles, contents entries and texts against a question."""

from __future__ import annotations

from foliant.functions import query as q
from foliant.functions import text as t
from foliant.functions.dialect import Dialect


def _count(d: Dialect, a: str) -> str:
    return d.size(d.distinct(a))


def covers(d: Dialect, x: str, terms: str) -> str:
    """Whether all terms (at least one) are among a text's stems."""
    return f"({d.size(terms)} > 0 AND {d.subset(terms, t.stems(d, x))})"


def full_bonus(d: Dialect, x: str, terms: str, bonus: int) -> str:
    return f"CASE WHEN {covers(d, x, terms)} THEN {bonus} ELSE 0 END"


def dominance(d: Dialect, x: str, terms: str) -> str:
    """8 for each shared term; 22 more if all are shared, 12 from seven tenths."""
    return d.let(t.overlap(d, x, terms), lambda n: f"{n} * 8 + CASE WHEN {n} = 0 THEN 0 WHEN {n} >= {_count(d, terms)} THEN 22 WHEN {n} >= 0.7 * {_count(d, terms)} THEN 12 ELSE 0 END")


def phrase_match(d: Dialect, x: str, terms: str, phrases: str) -> str:
    """The best phrase found in a text: 6 a word for phrases, 4 a word for runs of 2 to 4 terms."""

    def best(v: str) -> str:
        known = d.map(d.where(phrases, lambda p: f"{p} <> '' AND contains({v}, {p})"), lambda p: f"CAST({d.size(d.split(p, ' '))} * 6 AS INT)")
        runs = [_run_scores(d, v, terms, n) for n in (4, 3, 2)]
        return f"CASE WHEN {v} = '' OR {d.size(terms)} = 0 THEN 0 ELSE {d.largest(d.concat(known, *runs))} END"

    return d.let(t.normalize(d, x), best)


def _run_scores(d: Dialect, v: str, terms: str, n: int) -> str:
    return d.map(d.where(q.ngrams(d, terms, n), lambda p: f"contains({v}, {p})"), lambda p: f"CAST({n * 4} AS INT)")


def contents_score(d: Dialect, entry: str, terms: str, phrases: str) -> str:
    """Score of a table-of-contents entry for choosing a document."""
    return f"CASE WHEN {entry} = '' THEN 0 ELSE {t.overlap(d, entry, terms)} * 14 + {phrase_match(d, entry, terms, phrases)} * 2 + {full_bonus(d, entry, terms, 28)} + {dominance(d, entry, terms)} END"


def best_contents_score(d: Dialect, entries: str, terms: str, phrases: str) -> str:
    return d.largest(d.map(entries, lambda e: contents_score(d, e, terms, phrases)))


def best_contents_entry(d: Dialect, entries: str, terms: str, phrases: str) -> str:
    """The first entry with the best score over 0, or nothing."""
    return d.let(d.map(entries, lambda e: contents_score(d, e, terms, phrases)), lambda s: f"coalesce({d.get(d.where(entries, lambda e, i: f'{d.get(s, i)} > 0 AND {d.get(s, i)} = {d.largest(s)}', index=True), '1')}, '')")


def density(d: Dialect, x: str, expanded: str) -> str:
    """Share of a text's stems that are keywords."""
    return d.let(t.stems(d, x), lambda w: f"CASE WHEN {d.size(w)} = 0 THEN 0.0E0 ELSE CAST({d.size(d.where(w, lambda k: d.has(expanded, k)))} AS DOUBLE) / {d.size(w)} END")


def title_boost(d: Dialect, title: str, expanded: str) -> str:
    return d.let(t.overlap(d, title, expanded), lambda n: f"{n} * 4 + CASE WHEN {n} > 0 AND {n} = {_count(d, expanded)} THEN 6 + 2 * ({t.section_depth(d, title)}) ELSE 0 END")


def has_action_phrase(d: Dialect, x: str, keywords: str, content_only: bool = False) -> str:
    """Whether a run of two or three keywords stands in a text's stems."""
    words = t.stemmed(d, q.content_words(d, x)) if content_only else t.stems(d, x)
    return d.let(d.join(words), lambda v: d.any(d.concat(q.ngrams(d, keywords, 3), q.ngrams(d, keywords, 2)), lambda p: f"contains({v}, {p})"))


def has_phrase(d: Dialect, x: str, phrases: str) -> str:
    return d.let(t.normalize(d, x), lambda v: f"({v} <> '' AND {d.any(phrases, lambda p: f'{p} <> {d.lit(str())} AND contains({v}, {p})')})")


def heading_boost(d: Dialect, headings: str, expanded: str) -> str:
    def one(h: str) -> str:
        return d.let(t.overlap(d, h, expanded), lambda n: f"{n} * 5 + CASE WHEN {n} > 0 AND {n} = {_count(d, expanded)} THEN 8 + 2 * ({t.section_depth(d, h)}) ELSE 0 END + CASE WHEN {has_action_phrase(d, h, expanded)} THEN 10 ELSE 0 END")

    return d.largest(d.map(headings, one))


def contents_boost(d: Dialect, title: str, entries: str, expanded: str) -> str:
    def one(e: str) -> str:
        base = d.let(t.overlap(d, e, expanded), lambda n: f"CASE WHEN {n} > 0 AND {n} = {_count(d, expanded)} THEN 9 WHEN {n} >= 2 THEN 6 WHEN {n} = 1 THEN 3 ELSE 0 END")
        same, own = t.normalize(d, e), t.normalize(d, title)
        return d.let(base, lambda s: f"{s} + CASE WHEN {s} > 0 AND {same} = {own} THEN 6 WHEN {s} > 0 AND {d.starts(own, f'{same} || {d.lit('.')}')} THEN 2 ELSE 0 END")

    return d.largest(d.map(entries, one))


def contents_match(d: Dialect, entry: str, keywords: str, phrases: str) -> str:
    """Score of a contents entry for priority in re-ranking."""

    def of(n: str) -> str:
        return f"{n} * 14 + CASE WHEN {d.size(keywords)} = 0 THEN 0 WHEN {n} = {_count(d, keywords)} THEN 40 WHEN {n} >= 0.7 * {_count(d, keywords)} THEN 24 ELSE 0 END"

    return f"CASE WHEN {entry} = '' THEN 0 ELSE {d.let(t.overlap(d, entry, keywords), of)} + CASE WHEN {has_action_phrase(d, entry, keywords)} THEN 12 ELSE 0 END + CASE WHEN {has_phrase(d, entry, phrases)} THEN 14 ELSE 0 END END"


def best_contents_match(d: Dialect, entries: str, keywords: str, phrases: str) -> str:
    return d.largest(d.map(entries, lambda e: contents_match(d, e, keywords, phrases)))


def intent_penalty(d: Dialect, title_words: str, question_words: str) -> str:
    """Penalty for a title about something else: ``after``, many actions, another action."""
    acts = lambda w: d.size(d.where(d.words(q.ACTIONS), lambda a: d.has(w, a)))
    alike = " OR ".join(f"(x = {d.lit(a)} AND y = {d.lit(b)}) OR (x = {d.lit(b)} AND y = {d.lit(a)})" for a, b in q.ALIKE)

    def other(x: str, y: str) -> str:
        return f"CASE WHEN {x} <> '' AND {y} <> '' AND {x} <> {y} AND NOT ({alike.replace('x =', f'{x} =').replace('y =', f'{y} =')}) THEN 12 ELSE 0 END"

    clash = d.let(q.action(d, question_words), lambda x: d.let(q.action(d, title_words), lambda y: other(x, y)))
    return f"(CASE WHEN {d.has(title_words, d.lit('after'))} AND NOT {d.has(question_words, d.lit('after'))} THEN 8 ELSE 0 END + CASE WHEN {acts(title_words)} >= 2 AND {acts(question_words)} <= 1 THEN 3 ELSE 0 END + {clash})"

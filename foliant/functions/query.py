"""Query analysis: terms, phrases, synonyms and actions of a question."""

from __future__ import annotations

from foliant.functions import text as t
from foliant.functions.dialect import Dialect

# Words that carry no meaning in a question.
STOP_WORDS = ("how", "what", "when", "where", "which", "who", "why", "tell", "me", "about", "to", "do", "does", "is", "are", "the", "a", "an", "of", "for", "on", "in", "after")
#: The section ranker keeps these three.
RANKER_STOP_WORDS = tuple(w for w in STOP_WORDS if w not in ("tell", "me", "about"))

# Synonyms by word, in the alphabetical order in which they are added.
SYNONYMS = {
    "add": ("add", "create", "insert", "new", "register"),
    "create": ("add", "create", "insert", "new", "register"),
    "insert": ("add", "create", "insert"),
    "new": ("add", "create", "new"),
    "edit": ("change", "edit", "modify", "revise", "update"),
    "update": ("change", "edit", "modify", "revise", "update"),
    "modify": ("change", "edit", "modify", "update"),
    "change": ("change", "edit", "modify", "update"),
    "delete": ("delete", "drop", "erase", "remove"),
    "remove": ("delete", "drop", "erase", "remove"),
    "erase": ("delete", "erase", "remove"),
    "record": ("record", "records", "rr"),
    "records": ("record", "records", "rr"),
    "rr": ("record", "records", "resource", "rr"),
    "resource": ("resource", "resources", "rr"),
    "resources": ("resource", "resources", "rr"),
    "flush": ("clear", "flush", "purge", "refresh"),
    "clear": ("clear", "flush", "purge"),
    "resolve": ("check", "lookup", "resolve", "test", "verify"),
    "test": ("check", "resolve", "test", "verify"),
    "verify": ("check", "resolve", "test", "verify"),
}
# What a question or title asks for.
ACTIONS = ("add", "edit", "delete", "create", "update", "remove")
#: Pairs of actions that mean the same.
ALIKE = (("add", "create"), ("edit", "update"), ("delete", "remove"))


def terms(d: Dialect, question: str) -> str:
    """Stems that are no stop words; all stems where none is left."""

    def pick(s: str) -> str:
        return d.let(d.where(s, lambda w: f"NOT {d.has(d.words(STOP_WORDS), w)}"), lambda f: f"CASE WHEN {d.size(f)} > 0 THEN {f} ELSE {s} END")

    return d.let(t.stems(d, question), pick)


def ngrams(d: Dialect, words: str, n: int) -> str:
    return d.map(d.range(f"{d.size(words)} - {n - 1}"), lambda i: d.join(d.slice(words, i, str(n))))


def phrases(d: Dialect, question: str) -> str:
    """Runs of 4, 3 and 2 stems without stop words that hold two different ones of two letters; the first eight."""

    def some(words: str, n: int) -> str:
        runs = d.map(d.range(f"{d.size(words)} - {n - 1}"), lambda i: d.slice(words, i, str(n)))
        good = d.where(runs, lambda r: f"{d.size(d.distinct(d.where(r, lambda w: f'length({w}) > 1')))} >= 2")
        return d.map(good, lambda r: d.join(r))

    stems = d.where(t.stems(d, question), lambda w: f"NOT {d.has(d.words(STOP_WORDS), w)}")
    return d.let(stems, lambda w: d.slice(d.distinct(d.concat(*(some(w, n) for n in (4, 3, 2)))), "1", "8"))


def summary(d: Dialect, terms: str, phrases: str) -> str:
    return f"coalesce({d.get(phrases, '1')}, {d.join(d.slice(terms, '1', '4'))})"


def synonyms(d: Dialect, word: str) -> str:
    """Synonyms of a word in alphabetical order, itself among them; none for a word without."""
    cases = " ".join(f"WHEN {d.lit(k)} THEN {d.words(v)}" for k, v in SYNONYMS.items())
    return f"CASE {word} {cases} ELSE {d.none()} END"


def expand(d: Dialect, keywords: str, stop_words: tuple[str, ...] = STOP_WORDS) -> str:
    """Each keyword and its synonyms, stemmed again, without stop words and repeats."""
    found = d.flat(d.map(keywords, lambda k: d.concat(d.array([k]), synonyms(d, k))))
    return d.distinct(d.where(t.stemmed(d, found), lambda w: f"NOT {d.has(d.words(stop_words), w)}"))


def keywords(d: Dialect, question: str) -> str:
    """Terms stemmed a second time, as the retriever compares them."""
    return t.stemmed(d, terms(d, question))


def content_words(d: Dialect, x: str) -> str:
    """Tokens that are no stop words of the section ranker; all where none is left."""
    return d.let(t.tokens(d, x), lambda a: d.let(d.where(a, lambda w: f"NOT {d.has(d.words(RANKER_STOP_WORDS), w)}"), lambda f: f"CASE WHEN {d.size(f)} > 0 THEN {f} ELSE {a} END"))


def action(d: Dialect, words: str) -> str:
    """The first of the fixed actions among the words, or nothing."""
    return f"coalesce({d.get(d.where(d.words(ACTIONS), lambda a: d.has(words, a)), '1')}, '')"

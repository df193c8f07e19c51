"""Quality rules from repetition coverage.

Rolling hashes of several n-gram lengths find the n-grams that a text repeats; the characters
inside them, as a share of the text's word characters, are its coverage. Lines that repeat an
earlier line are measured likewise. One pass over whole texts, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import bytehash as bh

#: Largest share of word characters inside duplicated n-grams that a kept text may have, by n.
MAX_COVERAGE = {3: 0.5, 5: 0.4, 8: 0.35, 12: 0.3}
#: Largest share of word characters on lines that repeat an earlier line.
MAX_LINE_COVERAGE = 0.3
#: Symbols a word: junk and tables have about one.
MAX_SYMBOLS_PER_WORD = 0.1
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SEED = np.uint64(0xD6E8FEB86659FD93)


def _by_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys equal only for equal hashes in the same row."""
    return bh.mix(hashes + (row.astype(np.uint64) + np.uint64(1)) * _SEED)


def _covered(ngrams: bh.PrefixHash, n: int, row: np.ndarray) -> np.ndarray:
    """True for words inside an n-gram that its row holds twice or more."""
    count = len(row)
    inside = np.zeros(count, bool)
    if count < n:
        return inside
    at = np.flatnonzero(row[: count - n + 1] == row[n - 1 :])
    twice = at[bh.duplicated(_by_row(ngrams.windows(n)[at], row[at]))]
    step = np.zeros(count + 1, np.int32)
    step[twice] += 1
    step[twice + n] -= 1
    return np.cumsum(step[:-1]) > 0


def measure(part: bh.TextSlice, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts of each row of a slice; ``covered_n`` and ``line_chars`` are in characters."""
    data, offsets = part.data, part.offsets
    rows = len(offsets) - 1
    w = bh.words(data, offsets)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    size = chars[w.stop] - chars[w.start]
    row = np.repeat(np.arange(rows), np.diff(w.offsets))
    text = bh.PrefixHash(data)
    ngrams = bh.PrefixHash(text.span(w.start, w.stop))
    out = {"n_words": np.diff(w.offsets), "word_chars": bh.row_sums(size, w.offsets), "n_symbols": bh.row_sums(_SYMBOL[data], offsets)}
    out["n_repeat_words"] = bh.row_sums(_covered(ngrams, REPEAT_WINDOW, row), w.offsets)
    for n in lengths:
        out[f"covered_{n}"] = bh.row_sums(_covered(ngrams, n, row) * size, w.offsets)

    breaks = np.flatnonzero(data == 0x0A)
    # In order, the k-th line start belongs to the k-th line end; where ends meet, the line is empty and has no word.
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    stop = np.sort(np.concatenate([offsets[1:], breaks]))
    line_row = np.searchsorted(offsets, start, "right") - 1
    filled = np.searchsorted(w.start, stop) > np.searchsorted(w.start, start)
    start, stop, line_row = start[filled], stop[filled], line_row[filled]
    key = _by_row(text.span(start, stop), line_row)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=rows)
    # Words of repeated lines, weighted by their characters.
    total = np.append(0, np.cumsum(size))
    held = total[np.searchsorted(w.start, stop[again])] - total[np.searchsorted(w.start, start[again])]
    out["line_chars"] = np.bincount(line_row[again], weights=held, minlength=rows).astype(np.int64)
    return out


def score_quality(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_coverage: dict[int, float] | None = None,
    max_line_coverage: float = MAX_LINE_COVERAGE,
    max_symbols_per_word: float = MAX_SYMBOLS_PER_WORD,
    passthrough: bool = False,
) -> DataFrame:
    """Measure whole texts and judge them.

    Returns one row per input row: ``id_col``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, repetition (largest coverage over its limit), kept. A null
    or empty text has zero counts, fails the base rule (under 20 words) and is not kept.
    Repeated rows are judged alike; null ids stay null. With ``passthrough`` the input's own
    columns are returned instead, for kept rows only.
    """
    limits = dict(sorted((MAX_COVERAGE if max_coverage is None else max_coverage).items()))
    names = df.columns
    base = df.toDF(*(f"c{i}" for i in range(len(names)))) if passthrough else df.select(F.col(id_col).alias("c0"), F.col(text_col).cast("string").alias("c1"))
    at = names.index(text_col) if passthrough else 1
    fields = base.schema.fields if passthrough else base.schema.fields[:1]
    extra = "" if passthrough else ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, repetition double, kept boolean"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + extra

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bh.text_slices(batch.column(at)):
                m = measure(part, tuple(limits))
                chars = np.maximum(m["word_chars"], 1)
                over = np.maximum.reduce([m["line_chars"] / chars / max_line_coverage, m["n_symbols"] / np.maximum(m["n_words"], 1) / max_symbols_per_word, *(m[f"covered_{n}"] / chars / most for n, most in limits.items())])
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
                kept = ~failed & (over <= 1)
                rows = batch.slice(part.first, part.stop - part.first)
                if passthrough:
                    yield rows.filter(pa.array(kept))
                    continue
                counts = [pa.array(m[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays([rows.column(0), *counts, pa.array(failed), pa.array(over), pa.array(kept)], names=["c0", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "repetition", "kept"])

    out = base.mapInArrow(work, schema)
    return out.toDF(*names) if passthrough else out.withColumnRenamed("c0", id_col)

"""Language identification in two steps: language family, then the language within it.

Features are hashed byte n-grams as shares of a text. A linear support vector machine for
each family against the rest picks the family; inside it, one machine for each pair of
languages votes. Scores are means of weights over all positions of a text, so whole texts
are scored at a few table look-ups a byte, without building their feature vectors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import bytehash as bh

#: Rows to learn from: at most so many of each language, those with the smallest id hashes.
SAMPLE_ROWS = 600
#: At most so many languages are learned (those with most rows).
SAMPLE_LANGUAGES = 200
#: A sampled text teaches by at most so many bytes in all; longer ones are passed over.
SAMPLE_TEXT_BYTES = 1 << 14
#: Most rows of all languages together; beyond, each gets an equal part of them.
SAMPLE_ALL_ROWS = 6_000
BITS = 13
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"

#: Family of a language; others are families of their own.
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"), "romance"),
    **dict.fromkeys(("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
    **dict.fromkeys(("tr", "az", "kk", "uz"), "turkic"),
    **dict.fromkeys(("hi", "mr", "ne", "bn", "gu", "pa", "ur"), "indic"),
}

_FOLD = np.where((np.arange(256) >= 0x80) | ((np.arange(256) >= 97) & (np.arange(256) <= 122)), np.arange(256), 0x20).astype(np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LETTER = re.compile(r"[^\W\d_]")
_VOID = 1 << BITS  # index of positions whose n-gram would leave its text


def positions(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Feature of each byte position, for each n-gram order in turn."""
    data = _FOLD[data].astype(np.uint64)
    value = np.zeros(len(data), np.uint64)
    ends = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    for n in ORDERS:
        moved = np.zeros(len(data), np.uint64)
        moved[: max(0, len(data) - n + 1)] = data[n - 1 :]
        value = value * np.uint64(256) + moved
        h = (value + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        index = (h >> np.uint64(64 - BITS)).astype(np.int32)
        index[ends < n] = _VOID
        yield index


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    family_of: list[int]  # of each language
    pairs: list[tuple[int, int]]  # of languages of one family
    weights: np.ndarray  # (families + pairs, features + void)
    bias: np.ndarray


def _svm(x: np.ndarray, y: np.ndarray, steps: int = 150, c: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, classes weighted alike, by accelerated gradient steps.

    Works in single precision on ``x`` as it is, so a machine needs no copy of it.
    """
    one = np.float32
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(one)
    y = y.astype(one)
    w = np.zeros(x.shape[1], one)
    bias = ahead_bias = one(0)
    ahead, t = w, 1.0
    rate = one(1 / (2 * (float(share @ np.einsum("ij,ij->i", x, x)) + float(share.sum())) + c))
    for _ in range(steps):
        push = share * y * np.maximum(0, 1 - y * (x @ ahead + ahead_bias))
        last, last_bias = w, bias
        w = ahead - rate * (-2 * (push @ x) + one(c) * ahead)
        bias = ahead_bias - rate * (-2 * push.sum() + one(c) * ahead_bias)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        step = one((t - 1) / t_next)
        ahead, ahead_bias, t = w + step * (w - last), bias + step * (bias - last_bias), t_next
    return w, float(bias)


def train(texts: list[str], langs: list[str], families: dict[str, str] | None = None) -> Model:
    families = FAMILIES if families is None else families
    languages = sorted(set(langs))
    family_names = sorted({families.get(x, x) for x in languages})
    family_of = [family_names.index(families.get(x, x)) for x in languages]
    x = np.zeros((len(texts), (1 << BITS) + 1), np.float32)
    for i, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        for index in positions(data, np.array([0, len(data)])):
            x[i] += np.bincount(index, minlength=x.shape[1]) / max(1, len(data))
    x[:, _VOID] = 0
    # Rare features get more weight, as in tf-idf; the scale is folded into the weights again.
    scale = (1 / ((x.std(0) if len(x) else np.zeros(x.shape[1])) + 1e-3)).astype(np.float32)
    x *= scale
    own = np.array([languages.index(v) for v in langs])
    own_family = np.array(family_of)[own] if len(own) else own
    pairs = [(a, b) for a, b in combinations(range(len(languages)), 2) if family_of[a] == family_of[b]]
    found = [_svm(x, np.where(own_family == f, 1.0, -1.0)) for f in range(len(family_names))] if len(family_names) > 1 else [(np.zeros(x.shape[1]), 1.0)] * len(family_names)
    for a, b in pairs:
        rows = (own == a) | (own == b)
        found.append(_svm(x[rows], np.where(own[rows] == a, 1.0, -1.0)))
    weights = np.array([w * scale for w, _ in found], np.float32) if found else np.zeros((0, x.shape[1]), np.float32)
    if len(weights):
        weights[:, _VOID] = 0
    return Model(languages, family_names, family_of, pairs, weights, np.array([b for _, b in found]))


def predict(part: bh.TextSlice, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Language index (-1: undetermined) and score of each text of a slice."""
    data, offsets = part.data, part.offsets
    rows, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    margin = np.zeros((len(model.bias), rows))
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        for index in positions(data, offsets):
            for c, w in enumerate(model.weights):
                margin[c, filled] += np.add.reduceat(w[index], offsets[:-1][filled], dtype=np.float64)
    margin = margin / size + model.bias[:, None]
    sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -7, 7)))
    best, score = np.full(rows, -1), np.zeros(rows)
    if not model.languages:
        return best, score
    n = len(model.families)
    family = margin[:n].argmax(0)
    of_family = sure(margin[:n].max(0))
    votes, weight = np.zeros((len(model.languages), rows)), np.ones((len(model.languages), rows))
    for (a, b), m in zip(model.pairs, margin[n:], strict=True):
        votes[a] += m > 0
        votes[b] += m <= 0
        weight[a] *= sure(m)
        weight[b] *= sure(-m)
    inside = np.array(model.family_of)[:, None] == family
    best = np.where(inside, votes + weight / 2, -1).argmax(0)
    score = of_family * weight[best, np.arange(rows)]
    letter = bh.row_sums(_ASCII_LETTER[data], offsets) > 0
    for i in np.flatnonzero(~letter):
        letter[i] = bool(_LETTER.search(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return np.where(letter, best, -1), np.where(letter, score, 0.0)


def sample_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, usable: Column, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str]]:
    """At most ``rows`` texts of each of at most SAMPLE_LANGUAGES languages, and SAMPLE_ALL_ROWS in all.

    So training holds at most SAMPLE_ALL_ROWS rows of features of 4 bytes, twice while a
    machine takes a subset of them, and SAMPLE_ALL_ROWS texts of SAMPLE_TEXT_BYTES.

    Rows are thinned on the map side by a hash threshold set from each language's count, so the
    ranking below sees a few times ``rows`` of them, whatever the size of the corpus.
    """
    data = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(F.col(text_col)) <= SAMPLE_TEXT_BYTES)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    counts = data.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_LANGUAGES).collect()
    if not counts:
        return [], []
    rows = min(rows, SAMPLE_ALL_ROWS // len(counts))
    bound = F.lit(0.0)
    for r in counts:
        bound = F.when(F.col("lang") == r["lang"], min(1.0, (3 * rows + 50) / r["count"])).otherwise(bound)
    near = data.where(F.pmod("h", F.lit(1 << 30)) < bound * F.lit(float(1 << 30)))
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "text"))).where(F.col("n") <= rows)
    found = ranked.orderBy("lang", "n").select("lang", "text").collect()
    return [r["text"] for r in found], [r["lang"] for r in found]


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", families: dict[str, str] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Predict the language of every whole text; learns from rows outside the held-out third.

    Returns one row per input row: ``id_col``, held_out (crc32 of the id's text mod 3 is 1),
    lang_pred, score (0 to 1). Texts that are null or hold no letter get ``und`` and score 0,
    as does everything when nothing can be learned. Repeated rows are predicted alike; other
    columns are not read.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(3))
    model = train(*sample_texts(docs, id_col, text_col, lang_col, fold != 1, sample_rows), families)
    base = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"), (fold == 1).alias("h"))
    key = base.schema["k"].dataType.simpleString()
    names = np.array([*model.languages, UNKNOWN], object)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bh.text_slices(batch.column(1)):
                best, score = predict(part, model)
                rows = batch.slice(part.first, part.stop - part.first)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(names[best], pa.string()), pa.array(score)], names=["k", "held_out", "lang_pred", "score"])

    return base.mapInArrow(work, f"k {key}, held_out boolean, lang_pred string, score double").withColumnRenamed("k", id_col)

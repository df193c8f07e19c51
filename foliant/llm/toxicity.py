"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A window of
WINDOW words is compressed with the ordinary dictionary alone and with the toxic one before
it; the bytes saved are the window's distance. The second form comes first: where it takes no
byte from the toxic dictionary, that saves nothing and the first form is not needed. Counts and
shares of windows by bytes saved go through thresholds and a logistic curve calibrated on
labelled rows.

Toxic text is ordinary for the most part, so both dictionaries are trained by compression:

1. The ordinary dictionary holds whole ordinary texts, many more than the toxic one.
2. The toxic texts' pieces that another half of the toxic texts compresses better than the
   ordinary dictionary alone are kept, and the toxic dictionary is trained on them, in short
   segments.
3. Pieces of further ordinary texts that the toxic dictionary compresses better are added to
   the ordinary one, so that what both kinds of text share saves nothing.

Windows overlap by WINDOW - STEP words, so no phrase of so many words is cut; all words of a
text are in a window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.sources.scratch import dropped, written

#: Labelled rows to learn from: at most so many of each class, and so many bytes of text of
#: each; rows with the smallest id hashes are taken, of a repeated id one, and no longer texts.
SAMPLE_ROWS = {1: 2_500, 0: 4_000}
SAMPLE_BYTES = 8 << 20
SAMPLE_TEXT_BYTES = 256 << 10
ORDINARY_DICT_BYTES = 2_000_000
TOXIC_DICT_BYTES = 32_768
#: Most bytes of pieces of further ordinary texts.
SHARED_BYTES = 200_000
#: Bytes of the segments that dictionary training chooses, and of what it counts.
SEGMENT = {"k": 24, "d": 8}
LEVEL = 12
#: Words of a window, and from one window's first to the next one's.
WINDOW, STEP = 12, 8
#: The same of the pieces that are chosen for training.
PIECE, PIECE_STEP = 4, 2
#: Savings in bytes whose counts and shares are the document's features.
STEPS = (1, 2, 3, 4, 5)
THRESHOLD = 0.3
#: Characters of the texts whose windows are held at once, beside one more text, and windows
#: among which equal ones are found.
HELD_CHARS = 1 << 20
HELD_WINDOWS = 1 << 15

#: Longer runs without white space count as several words.
_WORD = re.compile(r"\S{1,64}")


def windows(text: str, size: int | None = None, step: int | None = None) -> list[bytes]:
    """Overlapping runs of ``size`` words with single spaces around; the last one may be shorter."""
    size, step = size or WINDOW, step or STEP
    words = _WORD.findall(text.lower())
    return [f" {' '.join(words[i : i + size])} ".encode() for i in range(0, max(1, len(words) - size + step), step)] if words else []


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


class Scorer:
    """Savings of windows, and features and scores of texts."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        # The toxic part stands first, so matches in the ordinary part cost the same either way.
        # Nothing matches the very start of the content, so some bytes stand before the toxic part.
        blanked = bytes(8 + len(toxic)) + ordinary
        self.plain = self._compressor(blanked)
        self.marked = self._compressor(bytes(8) + toxic + ordinary)
        # What takes bytes from the toxic part does not come back as it was without that part.
        self.blanked = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(blanked, dict_type=zstandard.DICT_TYPE_RAWCONTENT), format=zstandard.FORMAT_ZSTD1_MAGICLESS)

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=64, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        held.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=how)

    def saving(self, window: bytes) -> int:
        """Bytes that the toxic part saves; none where the window's compressed form takes nothing from it."""
        marked = self.marked.compress(window)
        if self.blanked.decompress(marked, max_output_size=len(window)) == window:
            return 0
        return len(self.plain.compress(window)) - len(marked)

    def savings(self, windows: list[bytes]) -> np.ndarray:
        """The saving of each window; equal ones of HELD_WINDOWS are compressed once."""
        out = np.zeros(len(windows), np.int64)
        for at in range(0, len(windows), HELD_WINDOWS):
            part = windows[at : at + HELD_WINDOWS]
            found = {w: self.saving(w) for w in dict.fromkeys(part)}
            out[at : at + len(part)] = [found[w] for w in part]
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        """One row per text; a text without words has one window that saves nothing."""
        out, held, chars = [np.zeros((0, 2 * len(STEPS) + 3))], [], 0
        for i, text in enumerate(texts):
            held.append(windows(text))
            chars += len(text)
            if chars >= HELD_CHARS or i == len(texts) - 1:
                out.append(self._rows(held))
                held, chars = [], 0
        return np.concatenate(out)

    def _rows(self, cuts: list[list[bytes]]) -> np.ndarray:
        sizes = np.array([len(c) for c in cuts])
        n = np.maximum(sizes, 1)
        saved = np.zeros(n.sum(), np.int64)
        saved[np.repeat(sizes > 0, n)] = self.savings([w for c in cuts for w in c])
        first = np.cumsum(n) - n
        counts = np.add.reduceat((saved[:, None] >= np.array(STEPS)).astype(float), first)
        return np.c_[np.log1p(counts), 100 * counts / n[:, None], np.maximum.reduceat(saved, first), np.log(n), np.add.reduceat((saved < 0).astype(float), first) / n]

    def scores(self, texts: list[str], model: Model) -> np.ndarray:
        x = (self.features(texts) - model.mean) / model.scale
        # Rounded, so that equal texts get equal scores whatever stands beside them.
        return _logistic(x @ model.weights[:-1] + model.weights[-1]).round(12)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _joined(texts: list[str], size: int) -> tuple[bytes, list[str]]:
    """The words of the first texts up to ``size`` bytes, and the texts that are left."""
    parts, held, used = [], 0, 0
    for text in texts:
        if held >= size:
            break
        parts.append(f" {' '.join(_WORD.findall(text.lower()))} ".encode())
        held += len(parts[-1])
        used += 1
    return b"".join(parts)[:size], texts[used:]


def _saving_pieces(texts: list[str], ordinary: bytes, toxic: bytes, least: int) -> list[bytes]:
    """Different pieces of the texts that save ``least`` bytes or more."""
    scorer = Scorer(ordinary, toxic)
    found = list(dict.fromkeys(w for t in texts for w in windows(t, PIECE, PIECE_STEP)))
    return [w for w, saved in zip(found, scorer.savings(found), strict=True) if saved >= least]


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary's bytes; where the samples are too few for the trainer, their own."""
    size = min(size, max(1024, sum(map(len, samples)) // 2))
    try:
        return zstandard.train_dictionary(size, samples, **SEGMENT).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary."""
    base, further = _joined(ordinary, min(ORDINARY_DICT_BYTES, sum(len(t) for t in ordinary) // 2))
    kept = []
    for k in (0, 1):
        kept += _saving_pieces(toxic[k::2], base, _joined(toxic[1 - k :: 2], ORDINARY_DICT_BYTES // 2)[0], 1)
    marks = _trained(TOXIC_DICT_BYTES, kept)
    shared, room = [], ORDINARY_DICT_BYTES
    for text in further:
        room -= len(text)
        if room < 0:
            break
        shared.append(text)
    return b"".join(_saving_pieces(shared, base, marks, 1))[:SHARED_BYTES] + base, marks


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """Fit dictionaries and calibration. With one class only, every text gets that class's share, smoothed.

    The calibration sees each half of the texts through dictionaries of the other half: stretches
    that stand in toxic text by chance save nothing there.
    """
    x, y = [], []
    for k in (0, 1):
        scorer = Scorer(*dictionaries(toxic[k::2], ordinary[k::2]))
        x += [*scorer.features([*toxic[1 - k :: 2], *ordinary[1 - k :: 2]])]
        y += [1.0] * len(toxic[1 - k :: 2]) + [0.0] * len(ordinary[1 - k :: 2])
    ordinary_dict, toxic_dict = dictionaries(toxic, ordinary)
    x, y = np.array(x or Scorer(ordinary_dict, toxic_dict).features([""]), float), np.array(y or [0.0])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = _logistic(a @ w)
        ridge = 0.05 * np.ones(len(w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
        w = np.clip(w, -50, 50)
    return Model(ordinary_dict, toxic_dict, mean, scale, w)


def sample_labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column, rows: dict[int, int]) -> tuple[list[str], list[str]]:
    """Texts of at most ``rows`` labelled documents and SAMPLE_BYTES of each class, by smallest hash of their id.

    The bounds hold in the plan, so no more than this reaches the driver. Of rows that repeat
    an id one is taken; texts longer than SAMPLE_TEXT_BYTES are not.
    """
    ids = labels.where(usable & F.col(label_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).distinct()
    picked = None
    for y, n in rows.items():
        part = ids.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).where(F.octet_length("t") <= SAMPLE_TEXT_BYTES)
    found = texts.join(F.broadcast(picked), "k").groupBy("k", "y").agg(F.min("t").alias("t"))
    found = written(found, "labelled")
    order = Window.partitionBy("y").orderBy(F.xxhash64("k"), "k").rowsBetween(Window.unboundedPreceding, 0)
    sizes = found.select("k", "y", F.octet_length("t").alias("size")).withColumn("held", F.sum("size").over(order)).where(F.col("held") <= SAMPLE_BYTES).select("k", "y")
    out: dict[int, list[str]] = {1: [], 0: []}
    for y, t in found.join(F.broadcast(sizes), ["k", "y"]).orderBy(F.xxhash64("k"), "k").select("y", "t").collect():
        out[y].append(t)
    dropped(found)
    return out[1], out[0]


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: dict[int, int] | None = None) -> DataFrame:
    """Score every whole text; learns from labels of rows outside the held-out quarter.

    Returns one row per row of ``docs``: ``id_col``, held_out (crc32 of the id's text mod 4 is
    2), score (0 to 1), predicted (score of THRESHOLD or more). Null and empty texts have no
    window and get the score of no savings; longer runs than 64 characters without white space
    count as several words. Null labels teach nothing, and a repeated label row counts once;
    without any usable label every score is the same. Repeated documents are scored each. Only
    ids and texts are read, so other columns may have any names.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4))
    toxic, ordinary = sample_labelled(docs, labels, id_col, text_col, label_col, fold != 2, sample_rows or SAMPLE_ROWS)
    model = train(toxic, ordinary)
    base = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"), (fold == 2).alias("h"))
    key = base.schema["k"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.ordinary, model.toxic)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                score = scorer.scores([t or "" for t in part.column(1).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["k", "held_out", "score", "predicted"])

    return base.mapInArrow(work, f"k {key}, held_out boolean, score double, predicted int").withColumnRenamed("k", id_col)

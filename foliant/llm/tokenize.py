"""SentencePiece encoding and decoding through a table of distinct marked words.

The library writes a marker for every space and merges pieces inside the marked text. When
no piece of the vocabulary holds a marker behind another character, no merge crosses the
start of a marker run, so the text may be cut there and each distinct marked word segmented
once. A worker keeps one table of distinct words, bounded by ``TABLE_WORDS``; ids are joined
back by position. No row leaves its partition: there is no shuffle, and a hot word costs one
segmentation a worker. (A table over the whole corpus would need every word occurrence
shuffled twice, several times the input.)
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words a worker's table holds before it starts anew.
TABLE_WORDS = 200_000
_MARK = "▁"
_CHUNK = re.compile(f"[ {_MARK}]+[^ {_MARK}]*")
_ROWS = 256


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_model(path: str | None = None) -> bytes:
    """Bytes of a model file (about half a MB); they travel to the workers with the task."""
    with open(path or default_model(), "rb") as f:
        return f.read()


class ChunkEncoder:
    """Encodes texts exactly as the library's ``encode`` does, word by distinct word."""

    def __init__(self, model: bytes, table_words: int = TABLE_WORDS):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table: dict[str, tuple[int, ...]] = {}
        self.table_words = table_words
        pieces = (self.library.id_to_piece(i) for i in range(self.library.vocab_size()))
        plain = self.library.encode("a  b", out_type=str)[0].startswith(_MARK)
        #: False for models whose pieces or normaliser reach across markers: whole texts are encoded then.
        self.separable = plain and not any(_MARK in p.lstrip(_MARK) for p in pieces) and self._keeps_text()

    def _keeps_text(self) -> bool:
        probe = "  a  Ａﬁ é \t　b "
        return "".join(self.library.encode(probe, out_type=str)).startswith(_MARK * 3) and self.library.decode(self.library.encode(probe)) == probe

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.separable:
            return [self.library.encode(t) for t in texts]
        chunks = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        missing = {c for row in chunks for c in row if c not in self.table}
        if missing:
            if len(self.table) + len(missing) > self.table_words:
                self.table = {}
                missing = {c for row in chunks for c in row}
            order = list(missing)
            # The library puts a marker before a text, so each chunk goes without its first.
            own = [i for i, c in enumerate(order) if len(c) > 1]
            for i, ids in zip(own, self.library.encode([order[i][1:] for i in own], num_threads=1), strict=True):
                self.table[order[i]] = tuple(ids)
            if " " in missing or _MARK in missing:
                lone = (self.library.piece_to_id(_MARK),)
                self.table |= {c: lone for c in (" ", _MARK) if c in missing}
        table = self.table
        out = []
        for row in chunks:
            ids: list[int] = []
            for c in row:
                ids += table[c]
            out.append(ids)
        return out


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Encode whole texts and decode them again.

    Returns one row per input row: ``id_col``, n_tokens, ids (array of int; left out unless
    ``with_ids``), decoded, ids_sha256, decoded_sha256. A null or empty text has no ids and
    decodes to the empty string. Other columns of the input are not read, so their names
    cannot clash; repeated rows give repeated results; null ids stay null.
    """
    model = load_model(model_path)
    base = df.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    key = base.schema["k"].dataType.simpleString()
    shown = "ids array<int>, decoded string, " if with_ids else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = encoder.encode(texts)
                back = encoder.library.decode(ids) if ids else []
                sha = [hashlib.sha256(str(i)[1:-1].replace(" ", "").encode()).hexdigest() for i in ids]
                out = {"k": part.column(0), "n_tokens": pa.array([len(i) for i in ids], pa.int64())}
                if with_ids:
                    out |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(back, pa.string())}
                out |= {"ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for d in back], pa.string())}
                yield pa.RecordBatch.from_pydict(out)

    out = base.mapInArrow(work, f"k {key}, n_tokens long, {shown}ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("k", id_col)

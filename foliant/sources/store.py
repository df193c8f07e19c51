"""Document store: loading, workspace tables, embeddings, uploads, and upkeep.

Rows live in one Parquet table partitioned by workspace; a filter on workspace_id prunes
partitions. Replacing a workspace's documents is one dynamic partition overwrite, so readers
see the old or the new ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.sources.scratch import dropped, written

TEXT_TYPES = (".txt", ".md")
DIMENSION = 384
Decoder = Callable[[bytes], list[str]]
Embedder = Callable[[Column], Column]


def load(spark: SparkSession, path: str, workspace_id: str, decoder: Decoder | None = None) -> DataFrame:
    """Pages (workspace_id, source, file_path, page, text) of the files under ``path``.

    Text files are one page each, numbered 0. PDF files need ``decoder``, which turns a file's
    bytes into its pages' texts. Other types are an error.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("source"), "content")
    kind = F.lower(F.regexp_extract("source", r"\.[^.]*$", 0))
    known = [*TEXT_TYPES, ".pdf"] if decoder else list(TEXT_TYPES)
    checked = files.withColumn("kind", F.when(kind.isin(known), kind).otherwise(F.raise_error(F.concat(F.lit("Unsupported file type: "), kind)).cast("string")))
    texts = checked.where(F.col("kind").isin(*TEXT_TYPES)).select("file_path", "source", F.lit(0).alias("page"), F.decode("content", "utf-8").alias("text"))
    if decoder:

        def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples():
                    found = decoder(row.content)
                    yield pd.DataFrame({"file_path": [row.file_path] * len(found), "source": row.source, "page": range(len(found)), "text": found})

        decoded = checked.where(F.col("kind") == ".pdf").select("file_path", "source", "content").mapInPandas(pages, "file_path string, source string, page int, text string")
        texts = texts.unionByName(decoded)
    return texts.select(F.lit(workspace_id).alias("workspace_id"), "source", "file_path", "page", "text")


def replace_workspaces(df: DataFrame, table: str) -> None:
    """Write ``df`` to the table at path ``table``, in place of all that its workspaces held."""
    df.write.partitionBy("workspace_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(table)


def append(df: DataFrame, table: str) -> None:
    df.write.partitionBy("workspace_id").mode("append").parquet(table)


def merge_pages(df: DataFrame, table: str, whole_sources: bool = False) -> None:
    """Write ``df`` (workspace_id, source, page, ...) into the table in place of rows of the same page, or of the same source if it holds whole ones.

    Other rows of its workspaces stay. Only the workspaces that ``df`` names are read and
    written again; writing the same rows twice changes nothing.
    """
    spark = df.sparkSession
    keys = ["workspace_id", "source", *([] if whole_sources else ["page"])]
    if not _exists(spark, table):
        replace_workspaces(df, table)
        return
    new = written(df, "arrived")
    held = _typed(spark, table)
    # Rows are read before the overwrite of their own partitions.
    mine = written(held.join(new.select("workspace_id").distinct(), "workspace_id", "left_semi").join(new.select(*keys).distinct(), keys, "left_anti"), "held")
    replace_workspaces(mine.unionByName(new, allowMissingColumns=True), table)
    dropped(new, mine)


def _typed(spark: SparkSession, table: str) -> DataFrame:
    """The table with workspaces as text: left to itself, a partition named 007 would be the number 7."""
    found = spark.read.parquet(table).schema
    fields = [f if f.name != "workspace_id" else T.StructField("workspace_id", T.StringType()) for f in found]
    return spark.read.schema(T.StructType(fields)).parquet(table)


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is there with any rows' files."""
    where, fs = _path(spark, path)
    return fs.exists(where) and any(s.getPath().getName().startswith("workspace_id=") for s in fs.listStatus(where))


def clear_workspace(spark: SparkSession, table: str, workspace_id: str) -> bool:
    """Remove a workspace's partition; whether there was one."""
    path, fs = _path(spark, f"{table}/workspace_id={workspace_id}")
    return fs.delete(path, True)


def upload(spark: SparkSession, folder: str, workspace_id: str, name: str, content: bytes) -> str:
    """Keep a file as ``folder/workspace_name``, in place of an earlier one; its path."""
    path, fs = _path(spark, f"{folder}/{workspace_id}_{name.rsplit('/', 1)[-1]}")
    out = fs.create(path, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path.toString()


def delete_uploads(spark: SparkSession, folder: str, workspace_id: str) -> int:
    """Remove the uploaded files of a workspace (not folders); how many there were."""
    where, fs = _path(spark, folder)
    mine = [s.getPath() for s in fs.listStatus(where) if s.isFile() and s.getPath().getName().startswith(f"{workspace_id}_")] if fs.exists(where) else []
    return sum(fs.delete(p, False) for p in mine)


def has_documents(spark: SparkSession, table: str, workspace_id: str) -> bool:
    """Whether the table exists and holds a document of the workspace; other errors are raised."""
    if not _exists(spark, table):
        return False
    return not _typed(spark, table).where(F.col("workspace_id") == workspace_id).isEmpty()


def workspaces_with_documents(workspaces: DataFrame, rows: DataFrame, present: bool = True) -> DataFrame:
    """Those of ``workspaces`` (workspace_id) that have rows, or have none."""
    return workspaces.join(rows.select("workspace_id"), "workspace_id", "left_semi" if present else "left_anti")


def source_rows(rows: DataFrame, workspace_id: str, source: str) -> DataFrame:
    """A source's rows by page, those with a section heading before general ones."""
    general = F.lower(F.trim("section")).startswith("general (page ") if "section" in rows.columns else F.lit(False)
    return rows.where((F.col("workspace_id") == workspace_id) & (F.col("source") == source)).orderBy("page", general)


def fetch_source(spark: SparkSession, table: str, workspace_id: str, source: str) -> DataFrame:
    """``source_rows`` of the table at a path."""
    return source_rows(_typed(spark, table), workspace_id, source)


def tail(df: DataFrame, key: str, order: Column | str, n: int = 5) -> DataFrame:
    """The last ``n`` rows of each key."""
    order = F.col(order) if isinstance(order, str) else order
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where(F.col("__n") <= n).drop("__n")


def new_workspace_id() -> str:
    return str(uuid.uuid4())


def hashing_embedder(dim: int = DIMENSION) -> Embedder:
    """A deterministic embedding without a model: counts of a text's tokens by hash, as a unit vector; null for a text without tokens."""

    def embed(text: Column) -> Column:
        slots = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
        # One pass over the sorted slots, not one for each dimension: where each slot's run begins and ends.
        counts = F.transform(F.array(F.array_sort(slots)), lambda s: F.map_from_entries(F.transform(F.array_distinct(s), lambda k: F.struct(k, F.size(F.filter(s, lambda x: x == k)).cast("double")))))[0]
        raw = F.transform(F.array(counts), lambda m: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))))[0]
        return F.transform(F.array(raw), lambda v: _unit(v))[0]

    return embed


def _unit(v: Column) -> Column:
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(F.array(length), lambda n: F.when(n > 0, F.transform(v, lambda x: (x / n).cast("float"))))[0]


def embedded(chunks: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Chunks with vec, their text's embedding. An embedder is a function of columns; a model's is a pandas UDF."""
    return chunks.withColumn("vec", (embedder or hashing_embedder())(F.col("page_content")))


@dataclass(frozen=True)
class Store:
    """A table of embedded chunks at a path."""

    spark: SparkSession
    path: str
    dimension: int = DIMENSION
    embedder: Embedder = field(default_factory=hashing_embedder)

    def ensure(self) -> Store:
        """Make the table's folder where it is missing."""
        where, fs = _path(self.spark, self.path)
        fs.mkdirs(where)
        return self

    def chunks(self) -> DataFrame:
        """All chunks; an empty table has none, and the columns of any."""
        if _exists(self.spark, self.path):
            return _typed(self.spark, self.path)
        fields = "chunk_id string, source string, file_path string, page long, section string, page_content string, entries array<string>, vec array<float>, workspace_id string"
        return self.spark.createDataFrame([], fields)

    def _checked(self, chunks: DataFrame) -> DataFrame:
        rows = embedded(chunks, self.embedder)
        wrong = F.raise_error(F.concat(F.lit(f"a vector must have {self.dimension} numbers, not "), F.size("vec").cast("string")))
        return rows.withColumn("vec", F.when(F.col("vec").isNull() | (F.size("vec") == self.dimension), F.col("vec")).otherwise(wrong.cast("array<float>")))

    def add(self, chunks: DataFrame) -> None:
        append(self._checked(chunks), self.path)

    def replace(self, chunks: DataFrame) -> None:
        """Embed chunks and write them in place of all that their workspaces held, in one step."""
        replace_workspaces(self._checked(chunks), self.path)

    def clear(self, workspace_id: str) -> bool:
        return clear_workspace(self.spark, self.path, workspace_id)

    def has_documents(self, workspace_id: str) -> bool:
        return has_documents(self.spark, self.path, workspace_id)

    def source(self, workspace_id: str, source: str) -> DataFrame:
        return source_rows(self.chunks(), workspace_id, source)

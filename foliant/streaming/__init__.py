"""Incremental ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from foliant.sources.store import merge_pages


def ingest_stream(pages: DataFrame, table: str, checkpoint: str, whole_sources: bool = False) -> StreamingQuery:
    """Write a stream of pages to the store.

    A micro-batch replaces the pages that it brings again and leaves all others, so documents
    may be split over batches and a batch may be written twice. With ``whole_sources``, where
    each batch holds whole documents, pages that a new version lacks go as well.
    """
    return pages.writeStream.foreachBatch(lambda batch, _: merge_pages(batch, table, whole_sources)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

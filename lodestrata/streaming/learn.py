"""Incremental learning: documents that arrive as a stream replace their sources' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.functions.embedding import EmbeddingProvider
from lodestrata.operators.chunking import chunk
from lodestrata.operators.store import Store


def learn_batch(store: Store, documents: DataFrame, embedder: EmbeddingProvider, now: str, size: int = 1200, overlap: int = 150) -> None:
    """Chunk, embed and write the sources that a batch holds, in one write. Chunk ids follow from document and place."""
    documents = documents.dropDuplicates(["id"])
    made = chunk(documents, size, overlap).withColumns({"id": F.col("document_id") * 100_000 + F.col("chunk_index"), "created_at": F.lit(now), "embedding": embedder.embed(F.col("content"))})
    rows = made.join(documents.select(F.col("id").alias("document_id"), "source_key"), "document_id")
    store.replace_sources(documents.select("source_key"), documents, rows, now)


def learn_stream(stream: DataFrame, store: Store, embedder: EmbeddingProvider, checkpoint: str, now) -> StreamingQuery:
    """``stream``: whole sources of documents; a source is replaced by what the batch holds of it."""
    return stream.writeStream.foreachBatch(lambda df, _: learn_batch(store, df, embedder, now())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their value by type in tumbling windows, for batch or stream; late ones are dropped by watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))

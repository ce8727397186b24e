"""Chunking documents as they arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.chunking import fixed_chunks


def chunk_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, size: int = 1000, overlap: int = 100) -> StreamingQuery:
    """Append the chunks of every Parquet file that comes to ``source`` to ``sink``; ends when all there are done."""
    docs = spark.readStream.schema(schema).parquet(source)
    return fixed_chunks(docs, size, overlap).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start()

"""Windows over a stream of events: sliding ones and sessions, with a watermark and a definition of late rows.

The same functions make the windows of a table and of a stream. Of a stream, a window is given out once, when the
watermark (the latest time seen in earlier batches, less ``delay``) has reached its end. A row is late, and dropped,
if all of its windows, or the session that it would begin, have ended by the watermark of its batch; a row that is
only out of order counts. Rows without a time are in no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: How long a stream waits for rows, the length and step of a sliding window, and the silence that ends a session.
DELAY, SIZE, SLIDE, GAP = "1 hour", "1 hour", "15 minutes", "30 minutes"


def event_stream(spark: SparkSession, source: str, schema, files: int | None = None) -> DataFrame:
    """The Parquet files of ``source`` as they come, at most ``files`` a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)


def _timed(events: DataFrame, delay: str, time: str) -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull()).withWatermark(time, delay)


def once(events: DataFrame, keys: list[str], delay: str = DELAY, time: str = "ts") -> DataFrame:
    """Events of which those that repeat ``keys`` within ``delay`` are left out; keys are kept only so long."""
    timed = _timed(events, delay, time)
    return timed.dropDuplicatesWithinWatermark(keys) if events.isStreaming else timed.dropDuplicates(keys)


def sliding(events: DataFrame, by: list[str], value: str, size: str = SIZE, slide: str = SLIDE, delay: str = DELAY, time: str = "ts") -> DataFrame:
    """(start, end, by, n, total, least, most): rows of each group in windows that begin every ``slide``. Null values
    count as rows and not as values."""
    made = _timed(events, delay, time).groupBy(F.window(time, size, slide).alias("w"), *by)
    out = made.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total", "least", "most")


def sessions(events: DataFrame, by: list[str], value: str, gap: str = GAP, delay: str = DELAY, time: str = "ts") -> DataFrame:
    """(start, end, by, n, total): runs of a group's rows without a silence of ``gap``; a session ends ``gap`` after its
    last row. A state for each open session is all that a stream keeps."""
    made = _timed(events, delay, time).groupBy(F.session_window(time, gap).alias("w"), *by)
    return made.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def write_closed(made: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append windows to the Parquet folder ``sink`` as they close; ends when all that there is has been read. Started
    again on its checkpoint it goes on where it stopped, and each window is written once."""
    return made.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

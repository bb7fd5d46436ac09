"""Incremental indexing as a stream, and windowed event counts (an extension)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import index, store


def index_batches(documents: DataFrame, read: Callable[[SparkSession], DataFrame | None], write: Callable[[DataFrame, int], None], stop: Sequence[str] = ()) -> DataStreamWriter:
    """A stream of documents into a postings table.

    ``read`` gives the present table (or None) and ``write`` stores the next
    version under the batch's number.  A document that comes again replaces its
    rows, and a batch that is run again after a failure writes the same table.
    """

    def one(batch: DataFrame, number: int) -> None:
        latest = batch.dropDuplicates(["doc_id"])
        new = index.postings(index.text_tokens(latest, stop), index.doc_lengths(latest))
        old = read(batch.sparkSession)
        gone = old if old is None else store.delete_documents(old, latest)
        write(new if gone is None else gone.unionByName(new), number)

    return documents.writeStream.foreachBatch(one)


def _stamped(events: DataFrame, late: str) -> DataFrame:
    """On a stream, event time with a watermark, which takes no time without a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts and sums per type; on a stream, late rows within ``late`` still count."""
    stamped = _stamped(events, late)
    out = stamped.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user, ended by a pause of ``gap``."""
    stamped = _stamped(events, gap)
    out = stamped.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")

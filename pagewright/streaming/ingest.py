"""Indexing pages as they arrive, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from pagewright.operators import incremental
from pagewright.params import COMPAT, Params
from pagewright.sources import pages as source


def index_stream(pages: DataFrame, folder: str, checkpoint: str, params: Params = COMPAT) -> StreamingQuery:
    """Append each micro-batch of a stream of pages ``docid, url, content`` to the index in a folder.

    The checkpoint remembers what was read, batches are written under their number, so a restart goes on
    where it stopped and writes an unfinished batch again. Docids must grow from batch to batch.
    """

    def add(batch: DataFrame, number: int) -> None:
        incremental.append(source.clean(source.delivered(batch)), folder, number, params)

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(pages: DataFrame, width: str = "1 day", lateness: str = "7 days") -> DataFrame:
    """Pages and sites seen in each window of ``fetched_at``; rows later than the watermark are dropped.

    Works on streams and tables; rows without a time have no window.
    """
    timed = pages.filter("fetched_at IS NOT NULL")
    timed = timed.withWatermark("fetched_at", lateness) if pages.isStreaming else timed
    grouped = timed.groupBy(F.window("fetched_at", width).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("site_id").alias("sites")).select("w.start", "w.end", "rows", "sites")

"""Incremental ingest and event windows by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .. import storage
from ..plans.kb import KnowledgeBase
from ..sources import files, pages, web


def ingest_pages(spark: SparkSession, folder: str, kb: KnowledgeBase, checkpoint: str):
    """A query that indexes raw pages (url, html; Parquet files) as they land. Repeats are left out by chunk id,
    so a batch that is run again changes nothing."""
    raw = spark.readStream.schema("page_id long, url string, html string").parquet(folder)

    def add(batch: DataFrame, _: int) -> None:
        kb.add(pages.to_documents(pages.long_enough(pages.extract_pages(batch))))

    return raw.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_files(spark: SparkSession, folder: str, kb: KnowledgeBase, checkpoint: str):
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def add(batch: DataFrame, _: int) -> None:
        kb.add(files.to_documents(files.parse_files(batch)))

    return raw.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Reports the observed metrics of each batch of one query, with the batch's number, as they come."""

    def __init__(self, name: str, report: Callable[[dict], None]):
        self.name, self.report = name, report

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        for name, row in event.progress.observedMetrics.items():
            if name == self.name:
                self.report({"batch": event.progress.batchId, **row.asDict()})

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass


def crawl_metrics(least: int = 50) -> list:
    """What a crawl counts in the pass that reads its pages: found, read, failed, too short."""
    good = F.col("error").isNull()
    short = good & (F.coalesce(F.length("content"), F.lit(0)) < least)
    return [
        F.count(F.lit(1)).alias("found"), F.count_if(good).alias("crawled"), F.count_if(~good).alias("failed"), F.count_if(short).alias("short"),
    ]


def ingest_site(
    spark: SparkSession, options: dict[str, str], kb: KnowledgeBase, checkpoint: str, report: Callable[[dict], None] | None = None
) -> list[dict]:
    """Indexes the pages that changed since the last run with this checkpoint (see ``site_pages``); returns the counts of its batches.

    A batch is written before it is indexed, so each page is read once, and a batch that is run again replaces
    the same documents. Pages that could not be read are kept in the folder errors beside the checkpoint.
    """
    spark.dataSource.register(web.SitePages)
    told: list[dict] = []

    def note(row: dict) -> None:
        told.append(row)
        if report:
            report(row)

    listener = Progress("crawl", note)
    raw = spark.readStream.format("site_pages").options(**options).load().observe("crawl", *crawl_metrics(kb.config.min_content))

    def add(batch: DataFrame, number: int) -> None:
        read = storage.keep(batch, f"{storage.scratch(spark)}/batch")
        failed = read.where("error is not null").select("url", "lastmod", "error")
        failed.write.mode("overwrite").json(f"{checkpoint.rstrip('/')}_errors/batch={number}")
        kb.add(pages.to_documents(pages.long_enough(read.where("error is null"), kb.config.min_content)))

    spark.streams.addListener(listener)
    try:
        query = raw.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # reports come by another thread
    finally:
        spark.streams.removeListener(listener)
    return told


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums of ``events`` (ts, event_type, value) by window; works on streams and on tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = timed.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def without_repeats(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events by id, once within the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else timed.dropDuplicates(["event_id"])

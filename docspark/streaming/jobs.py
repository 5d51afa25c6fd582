"""Structured Streaming runner: jobs come as rows, pages that the cache has are skipped, results are appended."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docspark.operators.cache import PageCache, misses


def run_jobs(jobs: DataFrame, cache: PageCache, process: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch of pages (document_id, page_no and the cache's identity columns) goes through ``process``.

    A batch that is driven again finds its pages in the cache, so the cache is written last; its sink folder is
    overwritten by batch number.
    """

    def batch(pages: DataFrame, number: int) -> None:
        spark = pages.sparkSession
        todo = pages.dropDuplicates(["document_id", "page_no"])
        if cache.exists():
            todo = misses(todo, cache.read())
        out = f"{sink}/batch={number}"
        process(todo).write.mode("overwrite").parquet(out)
        done = spark.read.parquet(out)
        cache.upsert(done.select(*(c for c in done.columns if c in ("document_id", "page_no", "text", "checksum_sha256", "dpi", "source_method"))))

    writer = jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Pages per window and status, late rows dropped past the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n"))

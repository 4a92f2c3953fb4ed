"""The offline scan over streams: the same projections, no state but for the optional removal of repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.analyze import analyze


def scan_stream(urls: DataFrame, url: str = "url", config: Config | None = None, keep: list[str] | None = None, event_time: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """analyze() over a streaming frame. With event_time, a URL is scanned once within the watermark (bounded state)."""
    if event_time is not None:
        urls = urls.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([url])
    return analyze(urls, url, config, keep=keep)


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def write_stream(results: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Result rows as Parquet; once: all that is there now, then stop."""
    writer = results.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Filings as they arrive: each new file's sections are cleaned and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filings.functions import text as T
from filings.operators.records import SECTION


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """What is new under source (Parquet of sections) goes to sink, then the query ends. Run again, it takes up where it stopped; files are never taken twice."""
    s = spark.readStream.schema(SECTION).parquet(source).where("content is not null").withColumn("content", T.clean(F.col("content"))).withColumn("word_count", F.size(T.words(F.col("content"))).cast("long"))
    return s.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_totals(events: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Counts of a stream of events (ts, event_type) by window, closed once later events can't come."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("window.start", "event_type", "n", "value")

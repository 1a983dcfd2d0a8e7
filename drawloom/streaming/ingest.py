"""Incremental ingest, an extension: new files of spans become tags as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from drawloom.functions import tags as N
from drawloom.functions import text as T

SPANS = "doc_id string, page_num int, span_id int, text string, x0 double, y0 double, x1 double, y1 double, size double, seen timestamp"


def line_tag_stream(spark: SparkSession, path: str, *, late: str = "1 hour") -> DataFrame:
    """Line tags of arriving spans, each (document, page, tag) once while its watermark lasts."""
    rows = spark.readStream.schema(SPANS).parquet(path).withWatermark("seen", late)
    found = rows.withColumn("t", N.line_tag(F.upper("text"))).filter("t is not null")
    tags = found.select("doc_id", "page_num", "t.full_tag", "t.root", "t.component", "seen")
    return tags.dropDuplicatesWithinWatermark(["doc_id", "page_num", "full_tag"])


def tag_counts_stream(spark: SparkSession, path: str, *, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Spans and asset-shaped spans by window of arrival."""
    rows = spark.readStream.schema(SPANS).parquet(path).withWatermark("seen", late)
    asset = N.looks_asset(T.normalize_token(F.col("text")))
    return rows.groupBy(F.window("seen", window)).agg(F.count(F.lit(1)).alias("spans"), F.count_if(asset).alias("assets"))


def append_new(stream: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Write a stream to Parquet exactly once, all that is there now."""
    return stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

"""Streams run over the tables to their end, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import is_file, new_path
from ..streaming import jobs


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of files; one that is a single file is watched for in its folder."""
    path = f"{sf_dir}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if is_file(spark, path):
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.parquet(path)


def stream_changed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk hash of a directory once, however often and late the feed shows it."""
    store = new_path(spark, "changed")
    jobs.changed_chunks(spark, _stream(spark, sf_dir, "chunk_feed"), store, new_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(store).select("directory", "hash")


def stream_daily_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' log: entries a day."""
    events = _stream(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.col("event_type").alias("action"), F.col("event_id").cast("string").alias("title"))
    sink = new_path(spark, "log")
    jobs.daily_log(events, sink, new_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(sink).groupBy("day").agg(F.count(F.lit(1)).alias("entries"), F.min("entry").alias("first_entry"))


QUERIES = {"stream_changed_chunks": stream_changed_chunks, "stream_daily_log": stream_daily_log}

ORACLE = {
    "stream_changed_chunks": """SELECT DISTINCT directory, regexp_replace(lower(trim(hash, ' ' || chr(9) || chr(10) || chr(13))), '^sha256:', '') AS hash
FROM chunk_feed WHERE directory IS NOT NULL AND hash IS NOT NULL""",
    "stream_daily_log": """SELECT CAST(ts AS DATE) AS day, count(*) AS entries, min('## [' || strftime(ts, '%Y-%m-%d') || '] ' || event_type || ' | ' || CAST(event_id AS VARCHAR)) AS first_entry
FROM events GROUP BY CAST(ts AS DATE)""",
}

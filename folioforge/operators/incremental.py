"""Problem 3: only records that are new or changed since the last successful run.

Records become readable late and out of order: a record seen at one time is
loaded at another, and in between it is an open transaction. A run rereads the
feed from the oldest transaction that was open at the last successful run, so
none is skipped, and an anti-join of (key, version) pairs against a ledger of
what was processed takes out what the overlap brings again, so none is
repeated. Failed runs leave no trace: neither ledger nor window moves. A history
of runs is replayed the same way, step by step over a ledger table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import new_path, written

#: Runs are broadcast only while there are at most so many.
BROADCAST_RUNS = 100_000


def version_of(raw: Column) -> Column:
    """A content hash without blanks around it, letter case and algorithm prefix."""
    return F.regexp_replace(F.lower(F.regexp_replace(raw, r"^[ \t\r\n]+|[ \t\r\n]+$", "")), "^sha256:", "")


def feed_records(feed: DataFrame, key: str = "directory", version: str = "hash", seen: str = "seen_at", loaded: str = "loaded_at") -> DataFrame:
    """(key, version, opened, loaded): readable records. Null keys, versions or load times are no records; a null or later sighting counts as the load time."""
    return feed.select(
        F.col(key).alias("key"),
        version_of(F.col(version)).alias("version"),
        F.least(F.col(seen), F.col(loaded)).alias("opened"),
        F.col(loaded).alias("loaded"),
    ).where("key is not null and version is not null and loaded is not null")


def successful_runs(reports: DataFrame, run: str = "build_id", key: str = "directory", started: str = "started_at", status: str = "status") -> DataFrame:
    """(key, run, started, last): each successful run once, with the start of the key's successful run before it."""
    once = (
        reports.select(F.col(run).alias("run"), F.col(key).alias("key"), F.col(started).alias("started"), F.lower(status).alias("status"))
        .where("status = 'ok' and run is not null and key is not null and started is not null")
        .groupBy("key", "run")
        .agg(F.min("started").alias("started"))
    )
    order = Window.partitionBy("key").orderBy("started", "run")
    return once.select("key", "run", "started", F.lag("started").over(order).alias("last"))


def reread_from(records: DataFrame, last: Column) -> DataFrame:
    """One row: the opening of the oldest transaction open at ``last``, or ``last`` itself."""
    open_then = (F.col("opened") <= last) & (F.col("loaded") > last)
    return records.agg(F.coalesce(F.min(F.when(open_then, F.col("opened"))), last).alias("since"))


def new_records(records: DataFrame, ledger: DataFrame, last: Column | None, now: Column) -> DataFrame:
    """(key, version) pairs that a run started at ``now`` has to process, each once.

    records: of feed_records; ledger: (key, version) processed by successful
    runs; last: start of the last successful one, None before the first. Adding
    the result to the ledger in the transaction that ends the run makes a rerun
    after a failure give the same records again, and a rerun after success none.
    """
    readable = records.where(F.col("loaded") <= now)
    if last is not None:
        since = reread_from(records, last)
        readable = readable.crossJoin(F.broadcast(since)).where(F.col("opened") >= F.col("since"))  # one row
    return readable.select("key", "version").distinct().join(ledger.select("key", "version"), ["key", "version"], "left_anti")


def replayed_runs(records: DataFrame, runs: DataFrame, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """(key, version, run): a history of runs, run after run, each with what new_records gives it.

    The n-th successful runs of all keys make one step: their windows are read
    again from the oldest transaction open at each key's last run, and what the
    ledger holds is taken out by an anti-join; the rest is appended to the
    ledger, a table in the shared folder, before the next step. There are as
    many steps as the key with most runs has; of the feed a step reads only the
    load times that its windows span. Records are reduced to distinct pairs
    before they are shuffled, so that a key with a third of all records is
    spread. The runs are counted, and broadcast while few.
    """
    spark = records.sparkSession
    # normalised once, and in files by load time, so that a step reads those that its windows span
    records = written(records.repartitionByRange("loaded"), "records")
    numbered = written(runs.withColumn("step", F.row_number().over(Window.partitionBy("key").orderBy("started", "run"))), "runs")
    size = numbered.agg(F.count(F.lit(1)).alias("runs"), F.max("step").alias("steps")).first()
    few = (lambda side: F.broadcast(side)) if size["runs"] <= broadcast_runs else (lambda side: side)
    # windows of all runs at once: one pass over the feed instead of one for each step
    open_then = (records["key"] == numbered["key"]) & (records["opened"] <= numbered["last"]) & (records["loaded"] > numbered["last"])
    oldest = records.join(few(numbered), open_then).groupBy(numbered["key"].alias("key"), "run").agg(F.min("opened").alias("oldest"))
    windows = written(numbered.join(oldest, ["key", "run"], "left").select(F.col("key").alias("run_key"), "run", "step", "started", F.coalesce("oldest", "last").alias("since")), "windows")
    spans = {r["step"]: r for r in windows.groupBy("step").agg(F.max("started").cast("string").alias("until"), F.min("since").cast("string").alias("since"), F.count("since").alias("bounded"), F.count(F.lit(1)).alias("all")).collect()}  # one row a step
    ledger = new_path(spark, "ledger")
    schema = "key string, version string, run long"
    for step in range(1, (size["steps"] or 0) + 1):
        span, window = spans[step], windows.where(F.col("step") == step)
        moment = lambda x: F.lit(x).cast(records.schema["loaded"].dataType)
        readable = records.where(F.col("loaded") <= moment(span["until"]))
        if span["bounded"] == span["all"]:
            readable = readable.where(F.col("loaded") >= moment(span["since"]))  # what was loaded before the window was opened before it
        met = (F.col("key") == F.col("run_key")) & (F.col("loaded") <= F.col("started")) & (F.col("since").isNull() | (F.col("opened") >= F.col("since")))
        batch = readable.join(few(window), met).select("key", "version", F.col("run").cast("long").alias("run")).distinct()
        if step > 1:
            batch = batch.join(spark.read.schema(schema).parquet(f"{ledger}/step=*").select("key", "version"), ["key", "version"], "left_anti")
        batch.write.parquet(f"{ledger}/step={step}")
    return spark.read.schema(schema).parquet(f"{ledger}/step=*") if size["steps"] else spark.createDataFrame([], schema)


def earliest_runs(records: DataFrame, runs: DataFrame, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """(key, version, run): the check of a replay. A pair belongs to its key's first successful run that starts when a record of it is loaded."""
    loaded = records.groupBy("key", "version").agg(F.min("loaded").alias("loaded"))
    side = runs.select(F.col("key").alias("run_key"), "run", "started")
    read = loaded.join(F.broadcast(side) if runs.count() <= broadcast_runs else side, (F.col("key") == F.col("run_key")) & (F.col("loaded") <= F.col("started")))
    return read.groupBy("key", "version").agg(F.min(F.struct("started", "run")).alias("first")).select("key", "version", "first.run")


def build_batches(feed: DataFrame, reports: DataFrame) -> DataFrame:
    """(build_id, hash): what each successful build has to embed."""
    return replayed_runs(feed_records(feed), successful_runs(reports)).select(F.col("run").alias("build_id"), F.col("version").alias("hash"))


def build_totals(feed: DataFrame, reports: DataFrame) -> DataFrame:
    """(build_id, directory, embedded_chunks, reused_chunks) of every successful build: distinct hashes new to it, and those kept from before."""
    runs = successful_runs(reports)
    new = replayed_runs(feed_records(feed), runs).groupBy("key", "run").agg(F.count(F.lit(1)).alias("embedded"))
    order = Window.partitionBy("key").orderBy("started", "run").rowsBetween(Window.unboundedPreceding, -1)
    joined = runs.join(new, ["key", "run"], "left").withColumn("embedded", F.coalesce("embedded", F.lit(0)))
    return joined.select(F.col("run").alias("build_id"), F.col("key").alias("directory"), F.col("embedded").alias("embedded_chunks"), F.coalesce(F.sum("embedded").over(order), F.lit(0)).alias("reused_chunks"))

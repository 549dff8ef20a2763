"""Streams: incremental index builds, prompts with session memory, transcripts, the inbox, the daily log.

Each job is a function from a streaming DataFrame to a started query or a
further streaming DataFrame; state and progress live in the checkpoint folder
that the caller names, so a job goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import hooks, lexical
from ..operators.incremental import version_of
from ..sources.staging import folders

SEEN_DAYS = 7
SHOWN = 3
#: Parts of the store of changed chunks.
BUCKETS = 16


def changed_chunks(spark: SparkSession, feed: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append each (directory, hash) of the feed to the store once, with the batch that brought it.

    A batch that is run again after a failure writes its own folder again, and
    is compared with the other batches' only, so nothing is lost or doubled. The
    store is cut into buckets by the hash: a batch reads those that its own
    records fall in.
    """
    schema = "directory string, hash string, bucket int, batch int"

    def step(batch: DataFrame, number: int) -> None:
        new = batch.select("directory", version_of(F.col("hash")).alias("hash")).where("directory is not null and hash is not null").distinct().withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(BUCKETS)).cast("int"))
        if any(n != str(number) for n in folders(spark, store, "batch")):
            known = spark.read.schema(schema).parquet(store).where(F.col("batch") != number).drop("batch")
            new = new.join(known, ["bucket", "directory", "hash"], "left_anti")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={number}")

    return feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answered_prompts(prompts: DataFrame, corpus: DataFrame, sink: str, checkpoint: str, k: int = SHOWN) -> StreamingQuery:
    """Word search for each prompt (query_id, directory, question) of a stream against a static corpus; the k best go to the sink."""

    def step(batch: DataFrame, number: int) -> None:
        asked = batch.where(hooks.searchable(F.col("question")))
        best = lexical.top(lexical.bm25(corpus, asked), k, "query_id", "directory")
        best.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return prompts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unseen_hits(hits: DataFrame, days: int = SEEN_DAYS) -> DataFrame:
    """Hits (session, query_id, note, score) less the notes that their session was shown in the last days.

    The best three of a prompt are taken first, then those seen are taken off;
    what is shown is remembered by session until it has not been used for that long.
    """
    out, state = "session string, query_id long, note string, score double", "seen string"

    def show(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        seen = set(kept.get[0].split("\n")) if kept.exists else set()
        rows = []
        for query, group in pd.concat(frames).sort_values(["query_id", "score", "note"], ascending=[True, False, True]).groupby("query_id", sort=True):
            for note, score in group.head(SHOWN)[["note", "score"]].itertuples(index=False):
                if note not in seen:
                    rows.append((key[0], query, note, score))
                    seen.add(note)
        kept.update(("\n".join(sorted(seen)),))
        kept.setTimeoutDuration(days * 86_400_000)
        yield pd.DataFrame(rows, columns=["session", "query_id", "note", "score"])

    return hits.groupBy("session").applyInPandasWithState(show, out, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def latest_transcripts(turns: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """The fullest transcript of each (day, session): a session's later, longer state replaces the earlier one."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = {int(v): p for v, p in folders(spark, sink, "version").items() if int(v) < number}
        rows = batch.select("day", "session", "turns", "note")
        if before:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(before[max(before)]))
        best = rows.groupBy("day", "session").agg(F.max_by(F.struct("turns", "note"), "turns").alias("x"))
        best.select("day", "session", "x.turns", "x.note").write.mode("overwrite").parquet(f"{sink}/version={number}")

    return turns.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained_inbox(spark: SparkSession, inbox: str, archive: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Each file of the inbox once as a row (path, text); files read are moved to the archive."""
    files = spark.readStream.format("text").option("wholetext", True).option("cleanSource", "archive").option("sourceArchiveDir", archive).load(inbox)
    rows = files.select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("text"))
    return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_log(actions: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append-only log of (at, action, title), a folder a day, an entry a line."""
    entry = F.concat(F.lit("## ["), F.date_format("at", "yyyy-MM-dd"), F.lit("] "), F.col("action"), F.lit(" | "), F.col("title"))
    rows = actions.select(F.to_date("at").alias("day"), F.col("at"), entry.alias("entry"))
    return rows.writeStream.partitionBy("day").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

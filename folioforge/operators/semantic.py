"""Vector search: contracts of the indexes, exact cosine ranking, reuse of stored vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunking import content_hash

#: Rows of an index, and query vectors, that are scored against each other at once.
BLOCK = 2048


class SemanticIndexError(Exception):
    """An index that can't answer: absent, of another version, or under another contract."""


def _vectors(held: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of a list array, by width."""
    values, ends = held.values.to_numpy(zero_copy_only=False).astype(float), held.offsets.to_numpy()
    widths = np.diff(ends)
    return {int(w): (at := np.nonzero(widths == w)[0], values[ends[at][:, None] + np.arange(w)]) for w in np.unique(widths)}


def _scores(asked: pa.StructArray, stored: pa.StructArray) -> np.ndarray:
    """Cosines of all queries and stored vectors, over what widths they share; -inf where undefined."""
    out = np.empty((len(asked), len(stored)))
    for at_q, q in _vectors(asked.flatten()[1]).values():
        for at_x, x in _vectors(stored.flatten()[3]).values():
            shared = min(q.shape[1], x.shape[1])
            norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
            out[np.ix_(at_q, at_x)] = np.divide(q[:, :shared] @ x[:, :shared].T, norms, out=np.zeros(norms.shape), where=norms != 0).round(4)
    out[np.isnan(out)] = -np.inf
    return out


def _best(asked: pa.StructArray, stored: pa.StructArray, k: int, per_file: bool) -> Iterator[pd.DataFrame]:
    """(query, path, section, ord, score) of what can be among the best k of a block of queries and a block of an index."""
    path, section, ord_, _ = (x.to_pandas() for x in stored.flatten())
    names = pd.factorize(path, use_na_sentinel=False)[0]
    by_file = np.argsort(names, kind="stable")
    starts = np.nonzero(np.diff(names[by_file], prepend=-1))[0]
    for first in range(0, len(asked), 256):
        part = asked.slice(first, 256)
        s = _scores(part, stored)
        tops = np.maximum.reduceat(s[:, by_file], starts, axis=1) if per_file else s
        least = np.partition(tops, -k, axis=1)[:, -k] if tops.shape[1] > k else np.full(len(s), -np.inf)
        at_q, at_x = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        found = pd.DataFrame({"query": part.flatten()[0].to_numpy(zero_copy_only=False)[at_q], "path": path.to_numpy()[at_x], "section": section.to_numpy()[at_x], "ord": ord_.to_numpy()[at_x], "score": s[at_q, at_x]})
        found = found.sort_values(["score", "ord"], ascending=[False, True], kind="stable")
        if per_file:
            found = found.drop_duplicates(["query", "path"])
        yield found.groupby("query", sort=False).head(k)


def ranked(chunks: DataFrame, queries: DataFrame, k: int, per_file: bool = True) -> DataFrame:
    """(query, directory, path, section, ord, score, rank): the best k chunks, or files by their best chunk, of each directory.

    chunks: (directory, path, section, ord, vector); queries: (query, vector) to
    ask every directory, or (query, vector, directory) to ask that one. Scores
    are rounded to four places before they are ranked; ties go by ord. Null
    vectors and undefined scores are left out. Any number of queries: blocks of
    them meet blocks of each directory, and each meeting keeps only what can
    still be among the best, so the shuffle carries k rows a query and block.
    """
    spark = queries.sparkSession
    usable = chunks.select("directory", "path", "section", F.col("ord").cast("long").alias("ord"), "vector").where("vector is not null and directory is not null")
    sizes = usable.groupBy("directory").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("slots"))  # one row a directory
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    asked = queries.select(F.col("query").cast("long").alias("query"), "vector", *(["directory"] if "directory" in queries.columns else [])).where("vector is not null")
    parts = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    stored = usable.join(F.broadcast(sizes), "directory").withColumn("slot", F.pmod(F.xxhash64("ord"), "slots").cast("int"))
    stored = stored.repartition(parts, "directory", "slot").groupBy("directory", "slot").agg(F.collect_list(F.struct("path", "section", "ord", "vector")).alias("stored"))
    if "directory" in asked.columns:
        dealt = asked.join(F.broadcast(sizes.join(asked.groupBy("directory").agg(blocks), "directory")), "directory")
    else:
        dealt = asked.crossJoin(F.broadcast(asked.agg(blocks))).crossJoin(F.broadcast(sizes))  # every directory is asked
    dealt = dealt.select("directory", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.pmod(F.xxhash64("query"), "blocks").alias("block"), "query", "vector")
    dealt = dealt.repartition(parts, "directory", "slot").groupBy("directory", "slot", "block").agg(F.collect_list(F.struct("query", "vector")).alias("asked"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query", pa.int64()), ("directory", pa.string()), ("path", pa.string()), ("section", pa.string()), ("ord", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            for i, directory in enumerate(batch.column("directory").to_pylist()):
                for found in _best(batch.column("asked")[i].values, batch.column("stored")[i].values, k, per_file):
                    found.insert(1, "directory", directory)
                    yield pa.RecordBatch.from_pandas(found, schema=schema, preserve_index=False)

    found = stored.join(dealt, ["directory", "slot"]).select("directory", "stored", "asked").mapInArrow(score, "query long, directory string, path string, section string, ord long, score double")
    if per_file:
        best = Window.partitionBy("query", "directory", "path").orderBy(F.desc("score"), "ord")
        found = found.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")
    order = Window.partitionBy("query", "directory").orderBy(F.desc("score"), "ord")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def latest_by_hash(stored: DataFrame) -> DataFrame:
    """One stored chunk for each directory and hash: of copies the last stored."""
    fields = [c for c in stored.columns if c not in ("directory", "hash")]
    last = stored.groupBy("directory", "hash").agg(F.max_by(F.struct(*fields), F.col("stored_id")).alias("x"))
    return last.select("directory", "hash", "x.*")


def reuse(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks (directory, section, content, ...) with hash and what the previous index holds of each: vector and created_at, or null."""
    hashed = chunks.withColumn("hash", content_hash(F.col("section"), F.col("content")))
    return hashed.join(latest_by_hash(stored).select("directory", "hash", "vector", "created_at"), ["directory", "hash"], "left")


def build_report(reused: DataFrame) -> DataFrame:
    """(directory, files, chunks, embedded_chunks, reused_chunks) of what reuse() gave."""
    kept = F.count_if(F.col("vector").isNotNull())
    return reused.groupBy("directory").agg(F.countDistinct("relative_path").alias("files"), F.count(F.lit(1)).alias("chunks"), (F.count(F.lit(1)) - kept).alias("embedded_chunks"), kept.alias("reused_chunks"))


def require_contract(meta: DataFrame, directories: list[str], version: int = 1) -> dict:
    """The contract (provider, model, dimension) that these directories' indexes share; raises where there is none."""
    if not directories:
        raise SemanticIndexError("no directory to search")
    known = {r["directory"]: r for r in meta.where(F.col("directory").isin(*directories)).collect()}  # one row a directory asked
    for name in directories:
        if name not in known:
            raise SemanticIndexError(f"no readable index for {name}")
        if known[name]["version"] != version:
            raise SemanticIndexError(f"index of {name} has version {known[name]['version']}: rebuild it")
    first = known[directories[0]]
    for name in directories[1:]:
        for field in ("provider", "model", "dimension"):
            if known[name][field] != first[field]:
                raise SemanticIndexError(f"indexes of {directories[0]} and {name} differ in {field}: {first[field]} and {known[name][field]}")
    return {f: first[f] for f in ("provider", "model", "dimension")}


def contract_divergence(meta: DataFrame) -> DataFrame:
    """Indexes under another contract than most, or of another version: (directory, provider, model, dimension, version).

    A report over all of them; require_contract, which a search uses, compares
    with the first directory asked.
    """
    fields = ["provider", "model", "dimension"]
    common = meta.groupBy(*fields).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *fields).limit(1).select(*(F.col(f).alias(f"common_{f}") for f in fields))
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"common_{f}"))
    return meta.crossJoin(F.broadcast(common)).where(differs | (F.col("version") != 1)).select("directory", *fields, "version")  # one row on the right

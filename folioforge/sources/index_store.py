"""Index files: a metadata line, then a chunk a line, vectors as base64 of little-endian floats."""

from __future__ import annotations

import base64
import itertools
import json
import os
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from .corpus import numbered

VERSION = 1
META = "provider string, model string, dimension int, version int, chunk_chars int, excluded_callouts array<string>"
CHUNK = "path string, section string, hash string, created_at string, excerpt string, vector string"
STORED = "ord long, path string, section string, hash string, created_at string, excerpt string, vector array<float>"


def index_path(directory: str) -> Path:
    return Path(directory) / ".index" / "embeddings.jsonl"


def table_path(directory: str) -> Path:
    """The file that names the table of a large index."""
    return Path(directory) / ".index" / "embeddings.table.json"


@F.pandas_udf(ArrayType(FloatType()))
def decoded_vector(column: pd.Series) -> pd.Series:
    return column.map(lambda x: None if x is None else np.frombuffer(base64.b64decode(x), "<f4").tolist())


@F.pandas_udf(StringType())
def encoded_vector(column: pd.Series) -> pd.Series:
    return column.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode())


def _meta(raw: str) -> dict | None:
    """An index's contract; older ones lack fields: an unknown chunk limit is None, unnamed callout types are none."""
    try:
        given = json.loads(raw)
        return {k: given[k] for k in ("provider", "model", "dimension", "version")} | {"chunk_chars": given.get("chunk_chars"), "excluded_callouts": given.get("excluded_callouts") or []}
    except (ValueError, KeyError, TypeError):
        return None


def read_index(spark: SparkSession, directory: str) -> tuple[dict, DataFrame] | None:
    """Metadata and chunks in order; None where there is no readable index.

    Of the file of lines only the first comes to the driver; its lines are read
    split by split and numbered by where they stand. A large index is a table,
    which a small file beside it names.
    """
    table = table_path(directory)
    if table.is_file():
        named = json.loads(table.read_text(encoding="utf-8"))
        meta = _meta(json.dumps(named))
        return (meta, spark.read.schema(STORED).parquet(str(table.parent / named["table"]))) if meta else None
    path = index_path(directory)
    if not path.is_file():
        return None
    with path.open(encoding="utf-8") as file:
        found = _meta(file.readline())
    if found is None:
        return None
    lines = numbered(spark.read.text(str(path)).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")), "block", "at")
    rows = lines.where("nth > 0 and trim(line) != ''").select(F.col("nth").alias("ord"), F.from_json("line", CHUNK, {"mode": "PERMISSIVE"}).alias("c"))
    if rows.where("c.hash is null").limit(1).count():
        return None
    return found, rows.select("ord", "c.path", "c.section", "c.hash", "c.created_at", "c.excerpt", decoded_vector("c.vector").alias("vector"))


def write_index(directory: str, meta: dict, chunks: DataFrame, as_table: bool = False) -> None:
    """The whole index anew, in order, put in place at once: a reader sees the old or the new one.

    As a table it is written by the executors; the file of lines, which other
    tools read, passes through the driver line by line.
    """
    path = index_path(directory)
    path.parent.mkdir(parents=True, exist_ok=True)
    if as_table:
        name = f"embeddings-{uuid.uuid4().hex}.parquet"
        chunks.select(*(x.strip().split(" ")[0] for x in STORED.split(", "))).repartitionByRange("ord").sortWithinPartitions("ord").write.parquet(str(path.parent / name))
        _replace(table_path(directory), [json.dumps(meta | {"table": name}, ensure_ascii=False)])
        return
    lines = chunks.orderBy("ord").select(F.to_json(F.struct("path", "section", "hash", "created_at", "excerpt", encoded_vector("vector").alias("vector"))).alias("line"))
    _replace(path, itertools.chain([json.dumps(meta, ensure_ascii=False)], (r["line"] for r in lines.toLocalIterator(prefetchPartitions=True))))


def _replace(path: Path, lines: Iterable[str]) -> None:
    fd, staged = tempfile.mkstemp(dir=path.parent, suffix=".part")
    with os.fdopen(fd, "w", encoding="utf-8") as file:
        for line in lines:
            file.write(line + "\n")
    os.replace(staged, path)


def merged_copies(main: DataFrame, other: DataFrame, same_contract: Column | bool = True) -> DataFrame:
    """Two copies of an index with one contract: all chunks, one a hash, the main copy's first; of different contracts the main copy."""
    if same_contract is False:
        return main
    both = main.withColumn("copy", F.lit(0)).unionByName(other.withColumn("copy", F.lit(1)))
    first = both.groupBy("hash").agg(F.min_by(F.struct(*main.columns), F.struct("copy", "ord")).alias("x"))
    return first.select("x.*")

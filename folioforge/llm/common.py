"""Shared pieces of the training-data operators."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import written as written
from ..sources.tables import table as table

_WORD = re.compile("[a-z0-9]+")
_MARKS = re.compile("[̀-ͯ]+")

#: Rows per Arrow batch; texts may be long, so batches are kept small.
ARROW_ROWS = 2000


def words(text: str | None) -> list[str]:
    """Maximal runs of a-z and 0-9 of the lower-cased, accent-stripped text."""
    if not text:
        return []
    low = text.lower()
    if not low.isascii():
        low = _MARKS.sub("", unicodedata.normalize("NFD", low))
    return _WORD.findall(low)


def small_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch size unless the session already asks for less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)


def drawn(key: str, share: float, purpose: str) -> Column:
    """Whether a row is in a sample of this share of all rows, by 63 bits of a hash of its key: any share of any number of rows can be drawn."""
    return F.lit(True) if share >= 1 else F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(purpose)), 1) < F.lit(min(int(share * 2**63), 2**63 - 1))

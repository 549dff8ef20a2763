"""Queries over the append-only feed of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import incremental

_RECORDS = """
records AS (
  SELECT directory, regexp_replace(lower(trim(hash, ' ' || chr(9) || chr(10) || chr(13))), '^sha256:', '') AS hash, loaded_at
  FROM chunk_feed WHERE hash IS NOT NULL AND loaded_at IS NOT NULL AND directory IS NOT NULL
), first_seen AS (
  SELECT directory, hash, min(loaded_at) AS loaded FROM records GROUP BY directory, hash
), runs AS (
  SELECT directory, build_id, min(started_at) AS started FROM build_reports
  WHERE lower(status) = 'ok' AND build_id IS NOT NULL AND directory IS NOT NULL AND started_at IS NOT NULL GROUP BY directory, build_id
), taken AS (
  SELECT f.directory, f.hash, r.build_id, row_number() OVER (PARTITION BY f.directory, f.hash ORDER BY r.started, r.build_id) AS nth
  FROM first_seen f JOIN runs r ON f.directory = r.directory AND r.started >= f.loaded
)
"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.build_batches(spark.read.parquet(f"{sf_dir}/chunk_feed.parquet"), spark.read.parquet(f"{sf_dir}/build_reports.parquet"))


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.build_totals(spark.read.parquet(f"{sf_dir}/chunk_feed.parquet"), spark.read.parquet(f"{sf_dir}/build_reports.parquet"))


QUERIES = {"p3_found": p3_found, "p3_totals": p3_totals}

ORACLE = {
    "p3_found": f"WITH {_RECORDS} SELECT build_id, hash FROM taken WHERE nth = 1",
    "p3_totals": f"""WITH {_RECORDS}, new AS (SELECT directory, build_id, count(*) AS n FROM taken WHERE nth = 1 GROUP BY directory, build_id)
SELECT r.build_id, r.directory, CAST(coalesce(n.n, 0) AS BIGINT) AS embedded_chunks,
       CAST(coalesce(sum(coalesce(n.n, 0)) OVER (PARTITION BY r.directory ORDER BY r.started, r.build_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS reused_chunks
FROM runs r LEFT JOIN new n ON r.directory = n.directory AND r.build_id = n.build_id""",
}

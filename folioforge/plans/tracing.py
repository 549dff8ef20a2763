"""Repeated statements, origins, and pages that say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import semantic as V
from ..operators import tracing as R
from ..sources.tables import table
from . import sqltext as S

LITERAL = "Avant la cloture"
GAP = 0.05


def value_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.occurrences(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", LITERAL).withColumnRenamed("key", "doc_id")


_CHAINS = ("origine: transcrit.md\noriginal: piece.pdf", "origine: transcrit.md", "original: piece.pdf")


def archive_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes' origins, front matter that names them planted in most."""
    front = F.lit("")
    for i, said in enumerate(_CHAINS):
        front = F.when(F.col("doc_id") % 5 == i, F.lit(f"---\n{said}\n---\n")).otherwise(front)
    docs = table(spark, sf_dir, "documents", "doc_id", "directory", "relative_path", "text")
    return R.archive_chain(G.notes(docs.withColumn("text", F.concat(front, F.coalesce("text", F.lit(""))))))


def _detached(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """(stored_id, other_id, score): the nearest chunk of another note in each index asked, where it is clearly nearer than any third note's.

    asked: (query, vector, own_directory, own, directory), a row for each index.
    Scores are compared inside one index only.
    """
    home = asked.select("query", "directory", "own_directory", "own")
    order = Window.partitionBy("query", "directory").orderBy(F.desc("score"), "ord")
    other = V.ranked(chunks, asked, 3).drop("rank").join(home, ["query", "directory"]).where("directory != own_directory or path != own")
    first = other.withColumn("nth", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).where("nth = 1")
    return first.where(F.round(F.col("score") - F.coalesce("next", F.lit(-1.0)), 4) >= GAP).select(F.col("query").alias("stored_id"), F.col("ord").alias("other_id"), "score")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "index_chunks", "directory", "path", "section", "stored_id", "vector").withColumnRenamed("stored_id", "ord")


def _asking(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("ord").alias("query"), "vector", F.col("directory").alias("own_directory"), F.col("path").alias("own"))


def near_duplicate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample, as its SQL form states it: chunks with an id divisible by 100, each in its own index. The whole check is near_duplicate_living_pages."""
    chunks = _index(spark, sf_dir)
    return _detached(chunks, _asking(chunks.where("ord % 100 = 0")).withColumn("directory", F.col("own_directory")))


def near_duplicate_living_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of every living page asks both living indexes of its vault, as a duplicate crosses the two."""
    living = _index(spark, sf_dir).where(F.element_at(F.split("directory", "/"), -1).isin(*G.LIVING))
    vault = F.get(F.split("directory", "/"), F.lit(0))
    indexes = living.select(vault.alias("vault"), "directory").distinct()  # a few rows a vault
    asked = _asking(living).withColumn("vault", F.get(F.split("own_directory", "/"), F.lit(0)))
    return _detached(living, asked.join(F.broadcast(indexes), "vault").drop("vault"))


QUERIES = {f.__name__: f for f in (value_occurrences, archive_chain, near_duplicate_pages, near_duplicate_living_pages)}

_FRONTED = " ".join(f"WHEN {i} THEN '---' || chr(10) || '" + x.replace("\n", "' || chr(10) || '") + "' || chr(10) || '---' || chr(10)" for i, x in enumerate(_CHAINS))

ORACLE = {
    "archive_chain": f"""WITH fronted AS (SELECT doc_id, directory, relative_path, CASE doc_id % 5 {_FRONTED} ELSE '' END || coalesce(text, '') AS text FROM documents), {S.LINES.replace("FROM documents", "FROM fronted")},
named AS (SELECT doc_id, max(CASE WHEN starts_with(line, 'origine:') THEN nullif({S.strip("substring(line, 9)")}, '') END) AS origine, max(CASE WHEN starts_with(line, 'original:') THEN nullif({S.strip("substring(line, 10)")}, '') END) AS original FROM front GROUP BY doc_id)
SELECT doc_id, origine AS transcription, coalesce(original, origine) AS piece, CASE WHEN original IS NULL THEN 'transcription' ELSE 'original' END AS kind FROM named WHERE origine IS NOT NULL""",
    "value_occurrences": f"""WITH {S.LINES}, w AS (SELECT strip_accents(lower('{LITERAL}')) AS x)
SELECT doc_id, CAST(i AS INTEGER) AS line_no, CAST(len(string_split(strip_accents(lower(line)), x)) - 1 AS INTEGER) AS times FROM ls CROSS JOIN w WHERE contains(strip_accents(lower(line)), x)""",
    "near_duplicate_pages": f"""
WITH v AS (SELECT stored_id, directory, path, CAST(vector AS DOUBLE[]) AS x FROM index_chunks WHERE vector IS NOT NULL AND len([e for e in vector if isnan(e)]) = 0),
n AS (SELECT a.stored_id AS query, b.stored_id, b.directory, b.path, a.path AS own, a.x[1 : least(len(a.x), len(b.x))] AS xs, b.x[1 : least(len(a.x), len(b.x))] AS ys,
        sqrt(coalesce(list_sum([e * e for e in a.x]), 0)) * sqrt(coalesce(list_sum([e * e for e in b.x]), 0)) AS norms FROM v a JOIN v b ON a.directory = b.directory WHERE a.stored_id % 100 = 0),
s AS (SELECT query, path, own, stored_id, CASE WHEN norms > 0 THEN round(list_dot_product(xs, ys) / norms, 4) ELSE 0.0 END AS score FROM n),
f AS (SELECT *, row_number() OVER (PARTITION BY query, path ORDER BY score DESC, stored_id) AS nth FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, stored_id) AS place FROM f WHERE nth = 1),
o AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS next FROM r WHERE place <= 3 AND path <> own WINDOW w AS (PARTITION BY query ORDER BY score DESC, stored_id))
SELECT query AS stored_id, stored_id AS other_id, score FROM o WHERE k = 1 AND round(score - coalesce(next, -1), 4) >= {GAP}""",
    "near_duplicate_living_pages": f"""
WITH v AS (SELECT stored_id, directory, string_split(directory, '/')[1] AS vault, path, CAST(vector AS DOUBLE[]) AS x FROM index_chunks
        WHERE string_split(directory, '/')[-1] IN ('concepts', 'entites') AND vector IS NOT NULL AND len([e for e in vector if isnan(e)]) = 0),
n AS (SELECT a.stored_id AS query, b.stored_id, b.directory, b.path, a.directory = b.directory AND a.path = b.path AS self, a.x[1 : least(len(a.x), len(b.x))] AS xs, b.x[1 : least(len(a.x), len(b.x))] AS ys,
        sqrt(coalesce(list_sum([e * e for e in a.x]), 0)) * sqrt(coalesce(list_sum([e * e for e in b.x]), 0)) AS norms FROM v a JOIN v b ON a.vault = b.vault),
s AS (SELECT query, directory, path, self, stored_id, CASE WHEN norms > 0 THEN round(list_dot_product(xs, ys) / norms, 4) ELSE 0.0 END AS score FROM n),
f AS (SELECT *, row_number() OVER (PARTITION BY query, directory, path ORDER BY score DESC, stored_id) AS nth FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query, directory ORDER BY score DESC, stored_id) AS place FROM f WHERE nth = 1),
o AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS next FROM r WHERE place <= 3 AND NOT self WINDOW w AS (PARTITION BY query, directory ORDER BY score DESC, stored_id))
SELECT query AS stored_id, stored_id AS other_id, score FROM o WHERE k = 1 AND round(score - coalesce(next, -1), 4) >= {GAP}""",
}

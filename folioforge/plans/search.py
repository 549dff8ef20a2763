"""Chunking and word search over the notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, lexical
from ..sources.tables import table as _table
from . import sqltext as S


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lexical_results").select("query_id", "directory", "question").where("question is not null and directory is not null").distinct()


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes without front matter, as the corpus reader gives them."""
    return _notes(spark, sf_dir).select("directory", F.col("relative_path").alias("doc"), T.without_front_matter(F.col("text")).alias("text"))


def front_matter_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = T.without_front_matter(F.col("text"))
    return _notes(spark, sf_dir).select("doc_id", F.length("text").alias("chars"), F.length(body).alias("body_chars"), F.md5(body).alias("body_md5"))


def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.sections(_notes(spark, sf_dir), "doc_id", "text")
    return found.select(F.col("key").alias("doc_id"), "section_ord", "section", F.length("content").alias("chars"), F.md5("content").alias("content_md5"))


def chunk_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of every note, within the size limit, with embedding hash and excerpt."""
    found = chunking.chunks(_notes(spark, sf_dir), "doc_id", "text", F.array(F.lit(" Source ")))
    return found.select(F.col("key").alias("doc_id"), "section_ord", "piece_ord", "section", F.length("content").alias("chars"), "hash", "excerpt")


def chunk_hash_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and excerpt of the stored chunks' sections."""
    rows = _table(spark, sf_dir, "markdown_chunks").where("section is not null and content is not null")
    return rows.select("chunk_id", chunking.content_hash(F.col("section"), F.col("content")).alias("hash"), T.excerpt(F.col("content")).alias("excerpt"))


def callout_stripped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without the callouts that their index leaves out."""
    types = chunking.normal_types(F.col("excluded_callouts"))
    return _table(spark, sf_dir, "markdown_chunks").where("content is not null").select("chunk_id", F.size(types).alias("types"), F.md5(chunking.without_callouts(F.col("content"), types)).alias("kept_md5"))


def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.array_distinct(T.tokens(F.col("text"))))
    return _corpus(spark, sf_dir).select("directory", words.alias("term")).groupBy("directory", "term").agg(F.count(F.lit(1)).alias("df"))


def bm25_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best notes for each logged question in its directory."""
    best = lexical.best(_corpus(spark, sf_dir), _questions(spark, sf_dir), 5)
    return best.select("query_id", "directory", "doc", F.round("score", 6).alias("score"), "rank")


def bm25_all_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question against every directory, ranked within each, groups numbered by directory."""
    corpus = _corpus(spark, sf_dir)
    asked = corpus.select("directory").distinct().select(F.lit(1).alias("query_id"), "directory", F.lit("réserve comptable de la relance réserve").alias("question"))
    best = lexical.top(lexical.bm25(corpus, asked), 3, "directory")
    return best.select("directory", "doc", F.round("score", 6).alias("score"), "rank")


def merged_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best notes of a question over all its directories, scores merged."""
    corpus = _corpus(spark, sf_dir)
    asked = corpus.select("directory").distinct().select(F.lit(1).alias("query_id"), "directory", F.lit("arbitrage logistique").alias("question"))
    scored = lexical.bm25(corpus, asked).select("query_id", F.concat_ws("/", "directory", "doc").alias("doc"), "score")
    return lexical.top(scored, 3, "query_id").select("doc", F.round("score", 6).alias("score"), "rank")


_BM25 = f"""
corpus AS (
  SELECT d.directory, d.relative_path AS doc, coalesce({S.tokens("b.text")}, []) AS words
  FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM body GROUP BY doc_id) b ON d.doc_id = b.doc_id
), held AS (
  SELECT directory, count(*) AS n_docs, avg(len(words)) AS mean_length FROM corpus GROUP BY directory
), counted AS (
  SELECT directory, doc, length, term, count(*) AS tf FROM (SELECT directory, doc, len(words) AS length, unnest(words) AS term FROM corpus) GROUP BY ALL
), asked AS (
  SELECT query_id, directory, word, count(*) AS times FROM (SELECT query_id, directory, unnest({S.tokens("question")}) AS word FROM questions) GROUP BY ALL
), words AS (SELECT DISTINCT directory, word FROM asked),
found AS (
  SELECT c.directory, w.word, c.doc, c.length, sum(c.tf) AS tf FROM counted c JOIN words w ON c.directory = w.directory AND starts_with(c.term, w.word) GROUP BY ALL
), weighted AS (
  SELECT f.directory, f.word, h.mean_length, greatest(ln((h.n_docs - count(*) + 0.5) / (count(*) + 0.5)), 0) AS w
  FROM found f JOIN held h ON f.directory = h.directory GROUP BY f.directory, f.word, h.n_docs, h.mean_length
), scores AS (
  SELECT a.query_id, f.directory, f.doc,
         sum(a.times * CASE WHEN g.w > 0 THEN g.w ELSE 1e-6 END * f.tf * 2.2 / (f.tf + 1.2 * (0.25 + 0.75 * f.length / g.mean_length))) AS score
  FROM found f JOIN weighted g ON f.directory = g.directory AND f.word = g.word JOIN asked a ON a.directory = f.directory AND a.word = f.word GROUP BY ALL
)"""


def _bm25_sql(questions: str, by: str, k: int, columns: str, doc: str = "doc") -> str:
    return f"""WITH {S.LINES}, questions AS ({questions}), {_BM25},
ranked AS (SELECT *, {doc} AS shown, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 9) DESC, {doc}) AS rank FROM scores)
SELECT {columns}, shown AS doc, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {k}"""


_EXCERPT = f"""CASE WHEN length({S.collapse("content")}) <= 200 THEN {S.collapse("content")}
  ELSE regexp_replace(substring({S.collapse("content")}, 1, 200), ' [^ ]*$', '') || '…' END"""

QUERIES = {
    f.__name__: f
    for f in (front_matter_strip, section_chunks, chunk_ladder, chunk_hash_excerpt, callout_stripped_text, term_document_frequency, bm25_top5, bm25_all_directories, merged_top3)
}

ORACLE = {
    "front_matter_strip": f"""WITH {S.LINES}, rest AS (
  SELECT d.doc_id, d.text, CASE WHEN f.opened AND f.closed IS NOT NULL THEN coalesce((SELECT string_agg(line, chr(10) ORDER BY i) FROM body b WHERE b.doc_id = d.doc_id), '') ELSE d.text END AS body
  FROM documents d LEFT JOIN fences f ON d.doc_id = f.doc_id)
SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(length(body) AS INTEGER) AS body_chars, md5(body) AS body_md5 FROM rest""",
    "section_chunks": f"WITH {S.SECTIONS} SELECT doc_id, section_ord, section, CAST(length(content) AS INTEGER) AS chars, md5(content) AS content_md5 FROM sections WHERE content <> ''",
    "chunk_hash_excerpt": f"SELECT chunk_id, sha256(section || chr(10) || content) AS hash, {_EXCERPT} AS excerpt FROM markdown_chunks WHERE section IS NOT NULL AND content IS NOT NULL",
    "callout_stripped_text": f"""WITH c AS (
  SELECT chunk_id AS id, content, coalesce(list_sort(list_distinct([x for x in [lower({S.strip("t")}) for t in excluded_callouts] if x <> ''])), []) AS types FROM markdown_chunks WHERE content IS NOT NULL
), {S.without_callouts("c")} SELECT c.id AS chunk_id, CAST(len(c.types) AS INTEGER) AS types, md5(s.kept) AS kept_md5 FROM c JOIN stripped s ON c.id = s.id""",
    "chunk_ladder": f"""WITH {S.SECTIONS}, whole AS (SELECT doc_id || '/' || section_ord AS id, doc_id, section_ord, section, content FROM sections WHERE content <> ''), {S.ladder("whole")},
cut AS (SELECT p.id || '/' || p.piece_ord AS id, w.doc_id, w.section_ord, w.section, p.piece_ord, p.piece AS content, ['source'] AS types FROM pieces p JOIN whole w ON p.id = w.id), {S.without_callouts("cut")}
SELECT c.doc_id, c.section_ord, c.piece_ord, c.section, CAST(length(c.content) AS INTEGER) AS chars, sha256(c.section || chr(10) || s.kept) AS hash, {_EXCERPT} AS excerpt
FROM cut c JOIN stripped s ON c.id = s.id WHERE s.kept <> ''""",
    "term_document_frequency": f"""WITH {S.LINES}, questions AS (SELECT 1 AS query_id, '' AS directory, '' AS question WHERE false), {_BM25}
SELECT directory, term, count(DISTINCT doc) AS df FROM counted GROUP BY directory, term""",
    "bm25_top5": _bm25_sql("SELECT DISTINCT query_id, directory, question FROM lexical_results WHERE question IS NOT NULL AND directory IS NOT NULL", "query_id, directory", 5, "query_id, directory"),
    "bm25_all_directories": _bm25_sql("SELECT DISTINCT 1 AS query_id, directory, 'réserve comptable de la relance réserve' AS question FROM documents", "directory", 3, "directory"),
    "merged_top3": _bm25_sql("SELECT DISTINCT 1 AS query_id, directory, 'arbitrage logistique' AS question FROM documents", "query_id", 3, "", "directory || '/' || doc").replace("SELECT , ", "SELECT "),
}

"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encode, leak, markup, neardup, neighbors, ocr, repeat, split, terms
from .common import table, written
from .sql import FRAME, ORACLE

MIN_COSINE = 0.92


def _pieces(spark: SparkSession, sf_dir: str, oversized_only: bool) -> DataFrame:
    documents = split.split_oversized(table(spark, sf_dir, "documents"), "doc_id", "text", oversized_only=oversized_only)
    chunks = split.split_oversized(table(spark, sf_dir, "markdown_chunks"), "chunk_id", "content", "section", oversized_only=oversized_only)
    return documents.select(F.lit("documents").alias("item_table"), "*").unionByName(chunks.select(F.lit("markdown_chunks").alias("item_table"), "*"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _pieces(spark, sf_dir, True).where((F.col("piece_ord") == 0) & (F.col("section_chars") > split.LIMIT))
    return cut.select("item_table", "item_id", "section_ord").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, False)


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = markup.items_of(table(spark, sf_dir, "documents"), "documents", "doc_id", "directory", "text")
    return documents.unionByName(markup.items_of(table(spark, sf_dir, "markdown_chunks"), "markdown_chunks", "chunk_id", "directory", "content"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.found_markup(_marked(spark, sf_dir))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_items(_marked(spark, sf_dir))


def p2_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branches that cleaning takes out, with the pages that share them: two notes in three have a frame planted around them, as the tables have none."""
    frame = F.when(F.col("doc_id") % 3 != 0, f"{FRAME}\n").otherwise("")
    notes = table(spark, sf_dir, "documents").withColumn("text", F.concat(frame, F.coalesce("text", F.lit(""))))
    return markup.removed_branches(markup.items_of(notes, "documents", "doc_id", "directory", "text")).select("host", "path", "look", "pages")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.similar_pairs(table(spark, sf_dir, "index_chunks"), "stored_id", "vector", MIN_COSINE)


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows with an id divisible by 100 against all rows."""
    return neighbors.nearest(table(spark, sf_dir, "index_chunks"), "stored_id", "vector", asking="id % 100 = 0")


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the exact ten nearest of those rows p4_nearest finds, by brute force in blocks."""
    return neighbors.recall(table(spark, sf_dir, "index_chunks"), "stored_id", "vector", "id % 100 = 0")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.distinctive_terms(table(spark, sf_dir, "documents"), "doc_id", "text", min_tf=4, min_df=2, max_df=8, min_length=5, letters_only=True)


def p5_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted mixture of every term, one row for each of its counts."""
    counts = terms.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text").where("doc_id is null")
    return terms.term_model(written(counts, "terms"))


def _sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name: str, item: str, text: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(name).alias("item_table"), F.col(item).alias("item_id"), F.col(text).alias("text"))

    return part("markdown_chunks", "chunk_id", "content").unionByName(part("index_chunks", "stored_id", "excerpt"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_pairs(_sectioned(spark, sf_dir))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sections share a section's shingle set, and to how many other sets it is linked."""
    found = neardup.near_duplicate_classes(_sectioned(spark, sf_dir))
    return found.select("item_table", "item_id", "copies", "links")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.page_noise(table(spark, sf_dir, "ocr_responses"), "response_id", "page_markdowns")


def p7_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.repaired_responses(table(spark, sf_dir, "ocr_responses"), "response_id", "page_markdowns").select("response_id", "text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaked_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "bench_items"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat.repetitive(table(spark, sf_dir, "documents"), "doc_id", "text", "source").select("doc_id").distinct()


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat.repetition(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "n_words", "n_runs", "n_distinct", F.round("repeated_share", 9).alias("repeated_share"))


def p10_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated rule alone, as a check of what the controlled cutoffs give."""
    return repeat.repetition(table(spark, sf_dir, "documents"), "doc_id", "text").where((F.col("n_words") >= repeat.MIN_WORDS) & (F.col("repeated_share") >= repeat.SHARE)).select("doc_id").distinct()


def p10_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    holdout = repeat.labelled_holdout(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return repeat.controlled_cutoffs(holdout, "repeated_share", "rejectable", "stratum")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p1_found, p1_pieces, p2_found, p2_clean, p2_removed, p4_found, p4_nearest, p4_recall, p5_found, p5_model, p6_found, p6_classes, p7_found, p7_text, p8_ids, p9_found, p9_passages, p10_found, p10_shares, p10_rule, p10_cutoffs)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

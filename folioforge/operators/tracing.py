"""Where a statement is repeated, where it comes from, and references gathered until none is new."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.staging import written
from .citations import PAGE_WORD, fragments
from .graph import fronts


def occurrences(docs: DataFrame, key: str, text: str, literal: str) -> DataFrame:
    """(key, line_no from 1, times): lines that hold a text, case and accents aside."""
    wanted = T.fold(F.lit(literal))
    cut = docs.select(F.col(key).alias("key"), F.posexplode(T.lines(F.col(text))).alias("at", "line")).withColumn("folded", T.fold(F.col("line"))).where(F.position(wanted, F.col("folded")) > 0)
    return cut.select("key", (F.col("at") + 1).alias("line_no"), (F.size(F.split("folded", F.concat(F.lit("\\Q"), wanted, F.lit("\\E")), -1)) - 1).alias("times"))


def archive_chain(pages: DataFrame) -> DataFrame:
    """(doc_id, transcription, piece, kind) of the notes that name their origin; without an original the transcription is the piece."""
    found = fronts(pages, "origine", "original").where("origine is not null")
    return found.select("doc_id", F.col("origine").alias("transcription"), F.coalesce("original", "origine").alias("piece"), F.when(F.col("original").isNull(), "transcription").otherwise("original").alias("kind"))


def in_pdf(found: DataFrame, pages: DataFrame, *by: str) -> DataFrame:
    """Citations (by..., quote, locator) with status and page, from the pages' texts (by..., page, text).

    Status: no_text, empty, out_of_range, absent, misplaced, unlocated, found.
    The page is the first that holds all of the quotation's parts.
    """
    asked = T.once(T.once(found, said=T.composed(F.coalesce("quote", F.lit("")))), parts=fragments(F.col("said"))).drop("said").withColumn("wanted", F.when(F.lower("locator").startswith(PAGE_WORD), F.regexp_extract("locator", r"(\d+)$", 1).cast("int")))
    flat = pages.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("page", T.flat_quote(F.col("text")).alias("flat")))).alias("sheets"))
    met = asked.join(flat, list(by), "left")
    holding = F.filter("sheets", lambda s: F.forall("parts", lambda p: F.position(p, s["flat"]) > 0))
    met = met.withColumn("on", F.transform(holding, lambda s: s["page"])).withColumn("page", F.get("on", F.lit(0)))
    blank = F.col("sheets").isNull() | ~F.exists("sheets", lambda s: s["flat"] != "")
    status = (
        F.when(blank, "no_text")
        .when(F.size("parts") == 0, "empty")
        .when((F.col("wanted") > F.size("sheets")) | (F.col("wanted") < 1), "out_of_range")
        .when(F.col("page").isNull(), "absent")
        .when(F.col("wanted").isNull(), "unlocated")
        .when(F.array_contains("on", F.col("wanted")), "found")
        .otherwise("misplaced")
    )
    return met.withColumn("status", status).drop("parts", "wanted", "sheets", "on")


def same_lines(before: DataFrame, after: DataFrame, *by: str) -> DataFrame:
    """Lines (by..., line, missing, extra) that keep a text from being a permutation of another; none if it is one."""
    old = before.groupBy(*by, "line").agg(F.count(F.lit(1)).alias("n"))
    new = after.groupBy(*by, "line").agg(F.count(F.lit(1)).alias("m"))
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    return old.join(new, [*by, "line"], "full").select(*by, "line", F.greatest(n - m, F.lit(0)).alias("missing"), F.greatest(m - n, F.lit(0)).alias("extra")).where("missing != extra")


def realigned(entries: DataFrame, piece: DataFrame, *by: str) -> DataFrame:
    """Entries (by..., line_no, moment, line) in the order of their piece (by..., moment, piece_ord); those of no known moment stay at their day's start."""
    placed = entries.join(piece, [*by, "moment"], "left")
    order = Window.partitionBy(*by).orderBy(F.coalesce("piece_ord", F.lit(-1)), "line_no")
    return placed.withColumn("new_no", F.row_number().over(order) - 1).select(*entries.columns, "new_no")


def merge_actions(same: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, raw, replacement) for links to a page that is merged into another: the target changes, what is shown stays."""
    gone = same.select("vault", F.element_at(F.split("other", "/"), -1).alias("name"), F.element_at(F.split("page", "/"), -1).alias("kept"))
    shown = F.regexp_extract("raw", r"\|(.*)$", 1)
    return links.join(gone, ["vault", "name"]).select("doc_id", "raw", F.concat(F.lit("[["), F.col("kept"), F.lit("|"), F.when(shown != "", shown).otherwise(F.col("name")), F.lit("]]")).alias("replacement"))


def waves(search: Callable[[int], DataFrame], keep: Column) -> DataFrame:
    """References (path, ...) gathered wave after wave until one brings no new path; wave numbers from 0.

    search(n) gives the n-th wave; keep says which of its rows count. Each wave
    is small (its own top k), and only the number of new paths comes to the driver.
    There is no bound on the waves: what was kept is written, so plans stay short.
    """
    kept: DataFrame | None = None
    for n in itertools.count():
        wave = search(n).where(keep).dropDuplicates(["path"]).withColumn("wave", F.lit(n))
        if kept is not None:
            wave = wave.join(kept.select("path"), "path", "left_anti").select(*kept.columns)
        wave = written(wave, "wave")
        if not wave.limit(1).count():
            break
        kept = wave if kept is None else kept.unionByName(wave)
    return kept if kept is not None else search(0).where(F.lit(False)).withColumn("wave", F.lit(0))

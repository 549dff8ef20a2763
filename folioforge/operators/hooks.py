"""What is said to a session: which prompts are worth a search, what was shown before, a map within a budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LEAST_PROMPT = 12
MAP_BUDGET = 1400


def searchable(prompt: Column) -> Column:
    """Whether a prompt is worth a search: no command, long enough."""
    return ~prompt.rlike("^[/!#]") & (F.length(prompt) >= LEAST_PROMPT)


def long_words(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(T.fold(x), F.lit("[a-z0-9]{5,}"), F.lit(0)))


def vocabulary_gate(prompts: DataFrame, entries: DataFrame, text: str, *by: str) -> DataFrame:
    """Prompts that hold a long word which some, but at most a tenth, of the entries hold (one in any case)."""
    held = entries.select(*by, F.explode(long_words(F.col("entry"))).alias("word")).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("df"))
    size = entries.groupBy(*by).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 10)).alias("ceiling"))
    rare = held.join(size, list(by)).where("df <= ceiling").select(*by, "word")
    return prompts.withColumn("word", F.explode(long_words(F.col(text)))).join(rare, [*by, "word"], "left_semi").drop("word").distinct()


def unseen(hits: DataFrame, seen: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best hits of each group less those seen, which are taken off after the cut."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "directory", "relative_path")
    best = hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    return best.join(seen.select("directory", "relative_path").distinct(), ["directory", "relative_path"], "left_anti")


def condensed_map(names: DataFrame, budget: int = MAP_BUDGET) -> DataFrame:
    """(vault, map): the names of each section within a budget of characters, what a section leaves unused going to the next.

    names: (vault, section_ord, section, slug). No section can show more names
    than the budget holds, so no more of them, with the section's number of
    names, reach the fold.
    """
    order = Window.partitionBy("vault", "section_ord").orderBy("slug")
    sized = names.withColumn("nth", F.row_number().over(order)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("vault", "section_ord")))
    short = sized.where(F.col("nth") <= budget // 3).groupBy("vault", "section_ord", "section", "total").agg(F.array_sort(F.collect_list("slug")).alias("slugs"))
    grouped = short.groupBy("vault").agg(F.array_sort(F.collect_list(F.struct("section_ord", "section", "total", "slugs"))).alias("sections"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for vault, sections in f.itertuples(index=False):
                left, lines = budget - sum(len(s["section"]) + 4 for s in sections), []
                for at, s in enumerate(sections):
                    room, shown = max(0, left // (len(sections) - at)), []
                    for name in s["slugs"]:
                        if sum(map(len, shown)) + 2 * len(shown) + len(name) + 2 > room:
                            break
                        shown.append(name)
                    left -= sum(map(len, shown)) + 2 * len(shown)
                    more = s["total"] - len(shown)
                    lines.append(f"## {s['section']}\n" + ", ".join([*shown, *([f"(+{more} autres)"] if more else [])]))
                rows.append((vault, "\n".join(lines)))
            yield pd.DataFrame(rows, columns=["vault", "map"])

    return grouped.mapInPandas(fold, "vault string, map string")

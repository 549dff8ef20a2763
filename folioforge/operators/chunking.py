"""Markdown to chunks: sections, size ladder, callouts, hash and excerpt."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CHUNK_CHARS = 2000
WORD_OVERLAP = CHUNK_CHARS // 10
PREAMBLE, UNTITLED = "(préambule)", "(titre vide)"


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_ord, section, content) of the sections that hold any text.

    The split into lines, the titles and the running count of headings stay
    within one text, so no row leaves its document: arrays, not a shuffle.
    """
    cut = docs.select(F.col(key).alias("key"), T.lines(F.col(text)).alias("every"))
    at = cut.select("key", T.body_lines(F.col("every")).alias("ls")).withColumn("titles", F.transform("ls", T.heading_title))
    starts = F.filter(F.transform("titles", lambda t, i: F.when(t.isNotNull(), i)), lambda i: i.isNotNull())
    bounds = at.withColumn("starts", F.concat(F.array(F.lit(-1)), starts))

    def section(start: Column, i: Column) -> Column:
        stop = F.coalesce(F.get("starts", i + 1), F.size("ls"))
        title = F.when(start < 0, F.lit(PREAMBLE)).otherwise(F.coalesce(F.nullif(F.get("titles", start), F.lit("")), F.lit(UNTITLED)))
        content = T.strip(F.array_join(F.slice("ls", start + 2, F.greatest(stop - start - 1, F.lit(0))), "\n"))
        return F.struct(i.alias("section_ord"), title.alias("section"), content.alias("content"))

    found = F.filter(F.transform("starts", section), lambda x: x["content"] != "")
    return bounds.select("key", F.inline(found))


def merged(pieces: list[str], separator: str, limit: int) -> list[str]:
    out: list[str] = []
    room = 0
    for piece in pieces:
        need = len(piece) + len(separator)
        if out and need <= room:
            out[-1] += separator + piece
            room -= need
        else:
            out.append(piece)
            room = limit - need
    return out


def ladder(content: str, limit: int = CHUNK_CHARS, overlap: int = WORD_OVERLAP) -> list[str]:
    """Pieces within the limit: by paragraphs, of what is too long by lines, then by words with overlap."""
    fine = limit - overlap

    def by_words(line: str) -> list[str]:
        atoms = [w[i : i + fine] for w in line.split(" ") for i in range(0, len(w) or 1, fine)]
        whole = merged(atoms, " ", fine)
        led = [before[-overlap:].partition(" ")[2] for before in whole[:-1]]
        return [whole[0], *(f"{tail} {piece}" if tail else piece for tail, piece in zip(led, whole[1:], strict=True))]

    def by_lines(paragraph: str) -> list[str]:
        return merged([p for line in paragraph.split("\n") for p in ([line] if len(line) <= limit else by_words(line))], "\n", limit)

    if len(content) <= limit:
        return [content]
    return merged([p for part in content.split("\n\n") for p in ([part] if len(part) <= limit else by_lines(part))], "\n\n", limit)


def size_limited(found: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """Sections within the limit as they are, in the JVM; only longer ones go through Python."""
    small = found.where(F.length("content") <= limit).select("key", "section_ord", "section", F.lit(0).alias("piece_ord"), "content")
    schema = "key string, section_ord int, section string, piece_ord int, content string"

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, o, s, i, p) for k, o, s, c in f.itertuples(index=False) for i, p in enumerate(ladder(c, limit, limit // 10))]
            yield pd.DataFrame(rows, columns=["key", "section_ord", "section", "piece_ord", "content"])

    kind = dict(found.dtypes)["key"]
    long = found.where(F.length("content") > limit).select(F.col("key").cast("string"), "section_ord", "section", "content").mapInPandas(cut, schema)
    return small.unionByName(long.withColumn("key", F.col("key").cast(kind)))


def normal_types(types: Column) -> Column:
    """Callout types trimmed, lower-case, distinct, sorted; null is none."""
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform(types, lambda t: F.lower(T.strip(t))), lambda t: t != ""))), F.array().cast("array<string>"))


def without_callouts(content: Column, types: Column) -> Column:
    """The text without its callouts of these (normal) types.

    A callout opens with its line and goes on while lines start with '>'; a new
    opening decides anew. Without types the text stays to the byte. The state
    that a line leaves is carried in a fold over the lines.
    """
    state = F.aggregate(
        T.lines(content),
        F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept")),
        lambda acc, line: _step(acc, line, types),
    )
    return F.when(F.size(types) == 0, content).otherwise(T.strip(F.array_join(state["kept"], "\n")))


def _step(acc: Column, line: Column, types: Column) -> Column:
    kind = T.callout_type(line)
    inside = F.when(kind.isNotNull(), F.array_contains(types, kind)).when(line.startswith(">"), acc["inside"]).otherwise(F.lit(False))
    return F.struct(F.coalesce(inside, F.lit(False)).alias("inside"), F.when(F.coalesce(inside, F.lit(False)), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(line))).alias("kept"))


def embedding_text(section: Column, content: Column) -> Column:
    return F.concat(section, F.lit("\n"), content)


def content_hash(section: Column, content: Column) -> Column:
    return F.sha2(embedding_text(section, content), 256)


def chunks(docs: DataFrame, key: str, text: str, types: Column | None = None, limit: int = CHUNK_CHARS) -> DataFrame:
    """(key, section_ord, piece_ord, section, content, embedding, hash, excerpt) of every chunk that has text to embed."""
    cut = size_limited(sections(docs, key, text), limit)
    kept = without_callouts(F.col("content"), normal_types(types) if types is not None else F.array().cast("array<string>"))
    return cut.withColumn("embedding", kept).where("embedding != ''").withColumn("hash", content_hash(F.col("section"), F.col("embedding"))).withColumn("excerpt", T.excerpt(F.col("content")))

"""Conversation transcripts (JSON lines) to notes for the inbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import secrets
from ..functions import text as T

LINE = "type string, message struct<role: string, content: string>"
BLOCKS = "array<struct<type: string, text: string>>"


def turns(lines: DataFrame, *by: str) -> DataFrame:
    """(by..., line_no, role, said) of JSON lines (by..., line_no, value), secrets masked.

    Content is a text or a list of blocks, of which the text ones count. Lines
    that are no JSON, other types, empty turns and those that a tool or the
    system wrote are left out.
    """
    read = lines.select(*by, "line_no", F.from_json("value", LINE, {"mode": "PERMISSIVE"}).alias("x")).where(F.col("x.type").isin("user", "assistant"))
    raw = F.col("x.message.content")
    blocks = F.from_json(raw, BLOCKS, {"mode": "PERMISSIVE"})
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    said = F.when(F.trim(raw).startswith("["), F.array_join(F.coalesce(texts, F.array().cast("array<string>")), "\n")).otherwise(raw)
    kept = read.select(*by, "line_no", F.coalesce("x.message.role", "x.type").alias("role"), T.strip(F.coalesce(said, F.lit(""))).alias("said"))
    return kept.where("said != '' and not startswith(said, '<system-reminder>') and not startswith(said, '<local-command-')").withColumn("said", secrets.masked(F.col("said")))


def safe_id(raw: Column, size: int = 8) -> Column:
    """An identifier's letters, digits and hyphens, so many at most."""
    return F.substring(F.regexp_replace(raw, "[^A-Za-z0-9-]", ""), 1, size)


def inbox_notes(found: DataFrame, inbox: str) -> DataFrame:
    """(path, text) of sessions' notes (day, session, turns, note): a file a session and day, with front matter, named by letters, digits and hyphens only, so that none leaves the inbox.

    The same session of a day has the same path: a later, fuller state replaces
    the earlier one.
    """
    slug = F.concat(F.lit("session-"), F.date_format("day", "yyyy-MM-dd"), F.lit("-"), safe_id(F.col("session")))
    front = F.concat(F.lit("---\ntype: session\ndate: "), F.date_format("day", "yyyy-MM-dd"), F.lit("\ntours: "), F.col("turns").cast("string"), F.lit("\n---\n\n"))
    return found.select(F.concat(F.lit(inbox.rstrip("/") + "/"), slug, F.lit(".md")).alias("path"), F.concat(front, F.col("note"), F.lit("\n")).alias("text"))


def session_notes(found: DataFrame) -> DataFrame:
    """(session, turns, note) of turns (session, line_no, role, said): a block a turn, in order."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "role", "said"))), lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n\n"), x["said"]))
    return found.groupBy("session").agg(F.count(F.lit(1)).alias("turns"), F.array_join(blocks, "\n\n").alias("note"))

"""Checks of notes against their pieces: reports line by line, and an exit code.

Codes: 0 all well, 1 faults, 2 nothing that could be checked (which is no
success), 3 wrong use.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import citations as C
from .operators import entries as E
from .operators import tracing
from .sources.corpus import by_path
from .sources.pdf import pdf_pages

WELL, FAULTS, UNCHECKED, WRONG = range(4)
#: Missing and extra anchors that a report lists.
LISTED = 40


@dataclass
class Report:
    code: int
    lines: list[str] = field(default_factory=list)


def _texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, text) of whole files."""
    if not paths:
        return spark.createDataFrame([], "path string, text string")
    return spark.read.text(paths, wholetext=True).select(by_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))


def judged_citations(spark: SparkSession, vault: str, notes: list[str]) -> DataFrame:
    """(note, line, quote, author, path, original, reading, original_status, fault) of every attribution of these notes, pieces looked up below the vault.

    A piece that is a folder is 'series', one that is a PDF is searched by pages.
    Only pieces that are cited are read.
    """
    root = Path(vault).resolve()
    found = C.citations(_texts(spark, notes), "path", "text").withColumn("vault", F.lit(str(root)))
    cited = [r[0] for r in found.select(F.explode(F.array("path", "original")).alias("p")).where("p is not null").distinct().collect()]  # the pieces of some notes
    kinds = {p: "folder" if (root / p).is_dir() else "pdf" if p.lower().endswith(".pdf") else "text" for p in cited if (root / p).exists() and (root / p).resolve().is_relative_to(root)}
    relative = F.substring(F.col("path"), len(str(root)) + 2, 1_000_000)
    texts = _texts(spark, [str(root / p) for p, k in kinds.items() if k == "text"]).select(F.lit(str(root)).alias("vault"), relative.alias("path"), "text")
    # the spelling of a pointer and the file's own may differ ('./a', 'b/../a')
    spelled = spark.createDataFrame([(p, str((root / p).resolve().relative_to(root))) for p in kinds] or [], "path string, real string")
    pieces = texts.withColumnRenamed("path", "real").join(spelled, "real").select("vault", "path", "text")
    done = C.dual_pointers(found, pieces).withColumn("citation", F.xxhash64("key", "line"))
    pdfs = [p for p, k in kinds.items() if k == "pdf"]
    if pdfs:
        sheets = pdf_pages(spark.read.format("binaryFile").load([str(root / p) for p in pdfs]).select(by_path(F.col("path")).alias("path"), "content"))
        sheets = sheets.select(relative.alias("real"), "page", "text").join(spelled, "real").select("path", "page", "text")
        for pointer, where, status in (("path", "locator", "reading"), ("original", "original_locator", "original_status")):
            asked = done.where(F.col(pointer).isin(pdfs)).select("citation", F.col(pointer).alias("path"), "quote", F.col(where).alias("locator"))
            # a page without a locator is right where it holds the quotation
            seen = tracing.in_pdf(asked, sheets, "path").select("citation", F.when(F.col("status") == "unlocated", "found").otherwise(F.col("status")).alias("seen"))
            done = done.join(seen, "citation", "left").withColumn(status, F.coalesce("seen", status)).drop("seen")
    folders = [p for p, k in kinds.items() if k == "folder"]
    for pointer, status in (("path", "reading"), ("original", "original_status")):
        done = done.withColumn(status, F.when(F.col(pointer).isin(folders), "series").otherwise(F.col(status)))
    fault = F.col("author_missing") | ~F.col("reading").isin(*C.RIGHT) | ~F.col("original_status").isin(*C.RIGHT)
    return done.withColumn("fault", fault).select(F.col("key").alias("note"), "line", "quote", "author", "path", "original", "author_missing", "reading", "original_status", "fault")


def verify_citations(spark: SparkSession, vault: str, notes: list[str] | None = None) -> Report:
    """Every quotation of the notes (of the vault's lessons and compilations, if none are named) against reading and original."""
    root = Path(vault)
    if not root.is_dir():
        return Report(WRONG, [f"vault not found: {vault}"])
    chosen = [Path(n) for n in notes] if notes else [*sorted((root / "wiki" / "enseignements").glob("*.md")), *sorted((root / "references").glob("*.md"))]
    chosen = [str(n.resolve()) for n in chosen if n.is_file()]
    if not chosen:
        return Report(UNCHECKED, ["no note to check"])
    rows = judged_citations(spark, vault, chosen).orderBy("note", "line").collect()  # the attributions of the notes named
    if not rows:
        return Report(UNCHECKED, [f"{len(chosen)} notes, no quotation found"])
    lines = []
    for r in rows:
        label = f"{Path(r['note']).name}:{r['line']}"
        if r["reading"] == "undeclared":
            lines.append(f"{label}: no pointer under the quotation: {r['quote'][:60]}")
            continue
        if r["author_missing"]:
            lines.append(f"{label}: no author")
        if r["reading"] not in C.RIGHT:
            lines.append(f"{label}: reading {r['path']}: {r['reading']}")
        if r["original_status"] not in C.RIGHT:
            lines.append(f"{label}: original {r['original'] or ''}: {r['original_status']}")
    checked = sum(r["reading"] != "undeclared" for r in rows)
    lines.append(f"{len(chosen)} notes, {checked} quotations checked, {sum(r['fault'] for r in rows)} with faults")
    return Report(FAULTS if any(r["fault"] for r in rows) else WELL, lines)


def verify_entries(spark: SparkSession, sources: list[str], notes: list[str] | None = None, pattern: str | None = None) -> Report:
    """Whether the notes hold every dated entry of their sources, or every match of a pattern (case ignored)."""
    notes = notes or []
    if not sources:
        return Report(WRONG, ["no source named"])
    if lost := [p for p in (*sources, *notes) if not Path(p).is_file()]:
        return Report(WRONG, [f"unreadable: {p}" for p in lost])
    if pattern is not None:
        try:
            re.compile(pattern)
        except re.error as trouble:
            return Report(WRONG, [f"pattern: {trouble}"])
    role = F.when(F.col("path").isin([str(Path(p).resolve()) for p in sources]), "source").otherwise("note")
    texts = _texts(spark, [str(Path(p).resolve()) for p in (*sources, *notes)]).withColumn("role", role)
    if pattern is not None:
        found = E.pattern_anchors(texts, "text", pattern, "path", "role")
    else:
        found = E.anchors_of(texts.withColumn("name", F.col("path")), "path", "name", "text").withColumnRenamed("key", "path").join(texts.select("path", "role"), "path")
    found = found.persist()
    try:
        return _recounted(found, notes, pattern is not None)
    finally:
        found.unpersist()


def _recounted(found: DataFrame, notes: list[str], custom: bool) -> Report:
    source, note = (found.where(F.col("role") == r).select(F.lit(1).alias("key"), "anchor") for r in ("source", "note"))
    lines = [f"{r['role']} {Path(r['path']).name}: {r['n']}" for r in found.groupBy("role", "path").agg(F.count(F.lit(1)).alias("n")).orderBy("role", "path").collect()]  # a row a file
    total = source.count()
    if not total:
        return Report(UNCHECKED, [*lines, "the pattern matches nothing in the source" if custom else "no dated entry in the source"])
    if not notes:
        return Report(WELL, lines)
    if not custom:
        keyed = found.where("role = 'note'").withColumnRenamed("path", "key")
        lines += [f"{Path(r['key']).name}: days carried to bare hours, count deduced" for r in E.forms(keyed).where("form = 'deduced'").collect()]
        lines += [f"{Path(r['key']).name}: {'reversed' if r['reversed'] else f'''{r['breaks']} breaks of order'''}; compare with the piece" for r in E.order_breaks(keyed).where("breaks > 0").collect()]
        best = E.best_offset(source, note).first()
        lines.append(f"found {best['common']} of {total}" + (f", shifted by {best['hours']:+d} h" if best["hours"] and best["common"] else ""))
        source = source.withColumn("anchor", F.expr(f"anchor + make_interval(0, 0, 0, 0, {best['hours'] if best['common'] else 0}, 0, 0)"))
    differs = E.difference(source, note, "key", "anchor")
    missing, extra = (differs.where(F.col(c) > 0) for c in ("missing", "extra"))
    faults = False
    for name, part, counts in (("missing", missing, True), ("extra", extra, custom)):
        n = part.agg(F.coalesce(F.sum(name), F.lit(0))).first()[0]
        if n and counts:
            faults = True
            shown = part.orderBy("anchor").select(F.col("anchor").cast("string"), name).limit(LISTED).collect()
            each = [f"  {r[0]}" for r in shown for _ in range(r[1])][:LISTED]
            lines += [f"{name}: {n}", *each, *([f"  … and {n - LISTED} more"] if n > LISTED else [])]
    return Report(FAULTS if faults else WELL, lines if faults else [*lines, "complete"])

"""Markdown corpora on disk, and where a document of any kind goes."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.graph import LAYERS
from .staging import written

#: Largest document and the kinds that the OCR service takes.
OCR_BYTES = 50 * 1024 * 1024
OCR_KINDS = ("pdf", "png", "jpg", "jpeg", "avif")
SLICE_BYTES = 150 * 1024


class CorpusError(Exception):
    """A corpus or document that can't be read."""


def by_path(uri: Column) -> Column:
    """The path of a file's URI, its escapes undone; a plus sign is a plus sign."""
    return F.url_decode(F.replace(F.regexp_replace(uri, "^file:/*", "/"), F.lit("+"), F.lit("%2B")))


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(directory, relative_path, doc_ord, text) of every .md file below root, front matter left out.

    Files are ordered by the parts of their paths: paths alone are sorted and
    numbered, range by range, and the texts, which must be UTF-8, come to them by
    a join. Spark's file sources pass over names that start with a dot or an
    underscore.
    """
    base = Path(root).resolve()
    if not base.is_dir():
        raise CorpusError(f"not a directory: {root}")
    if not any(base.rglob("*.md")):
        return spark.createDataFrame([], "directory string, relative_path string, doc_ord int, text string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(str(base))
    path = by_path(F.col("path"))
    relative = F.substring(path, len(str(base)) + 2, 1_000_000)
    sane = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), path)))
    texts = files.select(relative.alias("relative_path"), T.without_front_matter(T.universal_lines(sane)).alias("text"))
    order = numbered(files.select(relative.alias("relative_path"), F.split(relative, "/").alias("parts")), "parts").select("relative_path", F.col("nth").cast("int").alias("doc_ord"))
    return texts.join(order, "relative_path").select(F.lit(str(root)).alias("directory"), "relative_path", "doc_ord", "text")


def numbered(df: DataFrame, *by: str) -> DataFrame:
    """The rows with nth, their number from 0 in the order of ``by``: ranges are sorted apart, and their sizes, one row each, give where they start."""
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    held = written(parts.withColumn("_row", F.monotonically_increasing_id()), "ranges")
    starts = held.groupBy("_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = starts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    return held.join(F.broadcast(before.drop("_n")), "_part").withColumn("nth", F.col("_start") + F.col("_row") - F.col("_first")).drop("_part", "_row", "_first", "_start")


def index_targets(root: str) -> list[str]:
    """The layers of a wiki, in their order, that hold a note directly."""
    return [str(Path(root) / x) for x in LAYERS if any((Path(root) / x).glob("*.md"))]


def route(name: Column, text_status: Column) -> Column:
    """How a document is taken in, by its name and, of a PDF, whether its text layer is good ('ok')."""
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(F.lower(name).rlike(r"(screenshot|capture)[^/]*\.(png|jpe?g|webp|heic)$"), "visual")
        .when(kind == "pdf", F.when(text_status == "ok", "text_layer").otherwise("ocr"))
        .when(kind.isin("png", "jpg", "jpeg", "avif"), "ocr")
        .when(kind.isin("webp", "heic"), "visual")
        .when(kind.isin("md", "txt", "csv", "tsv", "json", "jsonl", "xml", "html", "eml", "py", "sql", "sh", "yaml", "yml"), "as_is")
        .when(kind.isin("xlsx", "ods", "docx", "odt", "pptx"), "convert")
        .when(kind.isin("zip", "gz", "tgz", "tar"), "expand")
        .when(kind.isin("mp3", "mp4", "wav", "m4a", "mov", "webm"), "out_of_scope")
        .otherwise("unknown")
    )


def sliced(lines: DataFrame, key: str, order: str, text: str, limit: int = SLICE_BYTES) -> DataFrame:
    """The lines with the number of the slice that reads them: whole lines in order, by running size."""
    run = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("slice", F.floor(F.coalesce(F.sum(F.octet_length(text) + 1).over(run), F.lit(0)) / limit).cast("int"))


def ocr_requests(files: DataFrame) -> DataFrame:
    """(path, payload, refusal) of binary files (path, length, content): a data URI for the OCR service, or why there is none."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.when(kind == "pdf", "application/pdf").when(kind.isin("jpg", "jpeg"), "image/jpeg").otherwise(F.concat(F.lit("image/"), kind))
    field = F.when(kind == "pdf", "document_url").otherwise("image_url")
    refusal = F.when(~kind.isin(*OCR_KINDS), "kind").when(F.col("length") > OCR_BYTES, "size")
    uri = F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64("content"))
    return files.select("path", F.when(refusal.isNull(), F.struct(field.alias("type"), uri.alias("uri"))).alias("payload"), refusal.alias("refusal"))


def joined_pages(pages: Column) -> Column:
    """Pages (index, markdown) in the order of their index as one text with numbered figure markers."""
    ordered = F.transform(F.array_sort(pages), lambda p: p["markdown"])
    return F.concat(T.figure_markers(T.strip(F.array_join(ordered, "\n\n"))), F.lit("\n"))

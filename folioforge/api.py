"""The engine's calls over directories of notes."""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import chunking, lexical, semantic
from .operators.semantic import SemanticIndexError
from .providers import PROVIDERS, ProviderError, describe, embedded, resolve
from .sources import index_store
from .sources.corpus import OCR_BYTES, CorpusError, index_targets, joined_pages, numbered, ocr_requests, read_corpus

DEFAULT_TOP = 5


class LexicalIndexError(Exception):
    """A question or a directory that can't be searched."""


def lexical_search(spark: SparkSession, question: str, directories: list[str], top_k: int = DEFAULT_TOP) -> list[dict]:
    """The best notes of each directory by BM25, groups in the order asked; an empty directory has an empty group."""
    if not directories:
        raise LexicalIndexError("no directory to search")
    probe = spark.range(1).select(F.size(T.tokens(F.lit(question))).alias("n")).first()["n"]
    if not probe:
        raise LexicalIndexError("the question holds no searchable word")
    corpora = []
    for name in directories:
        try:
            corpora.append(read_corpus(spark, name))
        except CorpusError as trouble:
            raise LexicalIndexError(str(trouble)) from trouble
    corpus = corpora[0]
    for other in corpora[1:]:
        corpus = corpus.unionByName(other)
    corpus = corpus.select("directory", F.struct("doc_ord", "relative_path").alias("doc"), "text")
    asked = spark.createDataFrame([(1, d, question) for d in dict.fromkeys(directories)], "query_id long, directory string, question string")
    best = lexical.top(lexical.bm25(corpus, asked), top_k, "directory")
    shown = best.join(corpus.select("directory", "doc", "text"), ["directory", "doc"]).select("directory", "rank", F.col("doc.relative_path").alias("relative_path"), "score", snippet(F.col("text"), question).alias("excerpt"))
    return _grouped(shown, directories, ("relative_path", "score", "excerpt"))


def snippet(text, question: str, size: int = 30):
    """About so many words around the first that starts like a word of the question, on one line."""
    words = F.split(T.collapse(text), " ")
    first = F.filter(F.transform(words, lambda x, i: F.when(F.exists(T.tokens(F.lit(question)), lambda q: F.exists(T.tokens(x), lambda t: F.startswith(t, q))), i)), lambda i: i.isNotNull())
    at = F.greatest(F.coalesce(F.get(first, F.lit(0)), F.lit(0)) - size // 2 + 1, F.lit(0))
    at = F.when(F.coalesce(F.get(first, F.lit(0)), F.lit(0)) < size, F.lit(0)).otherwise(at)
    cut = F.array_join(F.slice(words, at + 1, size), " ")
    return F.concat(F.when(at > 0, "…").otherwise(""), cut, F.when(at + size < F.size(words), "…").otherwise(""))


def semantic_index_build(spark: SparkSession, directory: str, provider: str = "local", excluded_callouts: list[str] | None = None) -> dict:
    """Bring a directory's index up to date: what is stored under the same hash keeps its vector and date."""
    try:
        corpus = read_corpus(spark, directory)
    except CorpusError as trouble:
        raise SemanticIndexError(str(trouble)) from trouble
    types = sorted({x.strip().lower() for x in excluded_callouts or [] if x.strip()})
    cut = chunking.chunks(corpus.withColumn("key", F.col("relative_path")), "key", "text", F.array(*(F.lit(x) for x in types)).cast("array<string>") if types else None)
    cut = cut.join(corpus.select(F.col("relative_path").alias("key"), "doc_ord"), "key").persist()
    try:
        total = cut.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("key").alias("files")).first()
        if not total["chunks"]:
            raise SemanticIndexError(f"nothing to index in {directory}")
        engine = resolve(provider)
        previous = index_store.read_index(spark, directory)
        if previous:
            meta, stored = previous
            if meta["version"] != index_store.VERSION:
                raise SemanticIndexError(f"index of {directory} has version {meta['version']}: delete {index_store.index_path(directory)} and build again")
            if (meta["provider"], meta["model"]) != (engine.name, engine.model):
                raise SemanticIndexError(f"index of {directory} was built by {meta['provider']}/{meta['model']}: delete {index_store.index_path(directory)} and build again")
            known = stored.groupBy("hash").agg(F.max_by(F.struct("vector", "created_at"), "ord").alias("old"))
        else:
            known = spark.createDataFrame([], "hash string, old struct<vector: array<float>, created_at: string>")
        joined = cut.join(known, "hash", "left")
        pending = joined.where("old is null").select("hash", chunking.embedding_text(F.col("section"), F.col("embedding")).alias("text")).dropDuplicates(["hash"])
        fresh = embedded(pending, "hash", "text", engine).withColumnRenamed("key", "hash")
        now = datetime.now(UTC).isoformat()
        done = numbered(joined.join(fresh, "hash", "left"), "doc_ord", "section_ord", "piece_ord").select(
            (F.col("nth") + 1).alias("ord"), F.col("key").alias("path"), "section", "hash", F.coalesce("old.created_at", F.lit(now)).alias("created_at"), "excerpt", F.coalesce("old.vector", "vector").alias("vector"), F.col("old").isNull().alias("new")
        )
        done = done.persist()
        if done.where(F.size("vector") != engine.dimension).limit(1).count():
            raise SemanticIndexError("vectors of another dimension than the index")
        new = done.where("new").count()
        meta = {"provider": engine.name, "model": engine.model, "dimension": engine.dimension, "version": index_store.VERSION, "chunk_chars": chunking.CHUNK_CHARS, "excluded_callouts": types}
        index_store.write_index(directory, meta, done)
        done.unpersist()
        return {"files": total["files"], "chunks": total["chunks"], "embedded_chunks": new, "reused_chunks": total["chunks"] - new, "provider_name": engine.name, "model": engine.model, "dimension": engine.dimension}
    finally:
        cut.unpersist()


def semantic_search(spark: SparkSession, question: str, directories: list[str], top_k: int = DEFAULT_TOP, per_file: bool = True) -> list[dict]:
    """The best files of each directory by cosine; fails as a whole where an index is missing or under another contract."""
    if not directories:
        raise SemanticIndexError("no directory to search")
    loaded: dict[str, tuple[dict, DataFrame]] = {}
    for name in directories:
        found = index_store.read_index(spark, name)
        if found is None:
            raise SemanticIndexError(f"no readable index for {name}")
        loaded[name] = found
    first = loaded[directories[0]][0]
    for name, (meta, _) in loaded.items():
        if meta["version"] != index_store.VERSION:
            raise SemanticIndexError(f"index of {name} has version {meta['version']}: build it again")
        for field in ("provider", "model", "dimension"):
            if meta[field] != first[field]:
                raise SemanticIndexError(f"indexes of {directories[0]} and {name} differ in {field}: {first[field]} and {meta[field]}")
    vector = resolve(first["provider"]).embed([question])[0]
    if len(vector) != first["dimension"]:
        raise SemanticIndexError("the question's vector has another dimension than the indexes")
    chunks = None
    for name, (_, rows) in loaded.items():
        part = rows.select(F.lit(name).alias("directory"), "path", "section", "ord", "vector", "excerpt")
        chunks = part if chunks is None else chunks.unionByName(part)
    asked = spark.createDataFrame([(1, vector)], "query long, vector array<float>")
    best = semantic.ranked(chunks, asked, top_k, per_file)
    shown = best.join(chunks.select("directory", "ord", "excerpt"), ["directory", "ord"]).withColumnRenamed("path", "relative_path")
    return _grouped(shown, directories, ("relative_path", "section", "score", "excerpt"))


def semantic_info(spark: SparkSession, directory: str) -> dict:
    found = index_store.read_index(spark, directory)
    return found[0] if found else {"index": None, "message": f"{directory} has no index"}


class DocumentOcrError(Exception):
    """A document that can't be converted."""


def converted(spark: SparkSession, files: DataFrame, provider: str) -> DataFrame:
    """(path, markdown, pages, model, refusal) of binary files (path, length, content), each read by the provider's OCR on an executor.

    A file of another kind or over the size limit is refused and not sent.
    """
    engine = resolve(provider)
    asked = ocr_requests(files).select("path", "payload.type", "payload.uri", "refusal")

    def run(frames):
        for f in frames:
            rows = []
            for path, kind, uri, refusal in f.itertuples(index=False):
                done = engine.ocr({"type": kind, kind: uri}) if refusal is None else None
                rows.append((path, done and done["pages"], done and done["model"], refusal))
            yield pd.DataFrame(rows, columns=["path", "page_markdowns", "model", "refusal"])

    read = asked.mapInPandas(run, "path string, page_markdowns array<string>, model string, refusal string")
    pages = F.transform("page_markdowns", lambda p, i: F.struct(i.alias("index"), p.alias("markdown")))
    return read.select("path", joined_pages(pages).alias("markdown"), F.size("page_markdowns").alias("pages"), "model", "refusal")


def ocr_convert(spark: SparkSession, document: str, output: str | None = None, provider: str | None = None) -> dict:
    """One document to one Markdown file, beside it unless told otherwise; an older one is written over."""
    path = Path(document)
    if not path.is_file():
        raise DocumentOcrError(f"no such file: {document}")
    able = [n for n, p in PROVIDERS.items() if getattr(p, "ocr_model", None)]
    if provider is None and not able:
        raise DocumentOcrError("no provider with OCR is registered")
    try:
        files = spark.createDataFrame([(str(path), path.stat().st_size, bytearray(path.read_bytes()) if path.stat().st_size <= OCR_BYTES else None)], "path string, length long, content binary")
        done = converted(spark, files, provider or able[0]).first()
    except ProviderError as trouble:
        raise DocumentOcrError(f"OCR failed: {trouble}; no other provider is tried") from trouble
    except Exception as trouble:
        if "ProviderError" not in str(trouble):
            raise
        reason = next((x for x in str(trouble).splitlines() if "ProviderError" in x), str(trouble))
        raise DocumentOcrError(f"OCR failed: {reason.strip()}; no other provider is tried") from trouble
    if done["refusal"]:
        raise DocumentOcrError(f"{document}: {'kind not taken' if done['refusal'] == 'kind' else 'larger than the service takes'}")
    target = Path(output) if output else path.with_suffix(".md")
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(done["markdown"], encoding="utf-8")
    return {"source_path": str(path), "output_path": str(target), "pages": done["pages"], "model": done["model"]}


def llm_check() -> list[dict]:
    return describe()


def _grouped(rows: DataFrame, directories: list[str], fields: tuple[str, ...]) -> list[dict]:
    """At most top_k rows a directory, in the groups asked for."""
    groups: dict[str, list[dict]] = {d: [] for d in directories}
    for row in rows.orderBy("directory", "rank").collect():
        groups[row["directory"]].append({f: row[f] for f in fields})
    return [{"directory": d, "results": groups[d]} for d in directories]


def index_all(spark: SparkSession, wiki: str, provider: str = "local") -> tuple[list[dict], list[str]]:
    """Build every layer's index; a layer that fails doesn't keep the others back. Reports, and failures."""
    done, failed = [], []
    for target in index_targets(wiki):
        try:
            done.append({"directory": Path(target).name} | semantic_index_build(spark, target, provider))
        except Exception as trouble:
            failed.append(f"{target}: {trouble}")
    return done, failed

"""The vector indexes, the ranking quality, and what sessions are told."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import secrets
from ..functions import text as T
from ..operators import graph as G
from ..operators import hooks as H
from ..operators import lexical
from ..operators import semantic as V
from ..operators.chunking import content_hash, normal_types
from ..sources import index_store
from ..sources.corpus import SLICE_BYTES, sliced
from ..sources.tables import table
from . import planted, search
from . import sqltext as S
from .graph import FRONT, LINKS


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "index_chunks", "directory", "path", "section", "stored_id", "vector").withColumnRenamed("stored_id", "ord")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated set of query vectors: ids divisible by 100."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = V.ranked(_chunks(spark, sf_dir), _asked(spark, sf_dir), 5, per_file=False)
    return best.select("query", "directory", F.col("ord").alias("stored_id"), "score", "rank")


def best_chunk_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = V.ranked(_chunks(spark, sf_dir), _asked(spark, sf_dir), 5)
    return best.select("query", "directory", "path", F.col("ord").alias("stored_id"), "score", "rank")


def incremental_reuse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "markdown_chunks", "directory", "relative_path", "section", "content").where("section is not null and content is not null")
    return V.build_report(V.reuse(chunks, table(spark, sf_dir, "index_chunks", "directory", "hash", "stored_id", "vector", "created_at")))


def pending_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that the index of their directory does not hold yet."""
    chunks = table(spark, sf_dir, "markdown_chunks", "directory", "section", "content").where("section is not null and content is not null")
    hashed = chunks.select("directory", content_hash(F.col("section"), F.col("content")).alias("hash")).distinct()
    return hashed.join(table(spark, sf_dir, "index_chunks", "directory", "hash"), ["directory", "hash"], "left_anti")


def index_conflict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two copies of every index merged: what has no creation time as the main copy, the rest as the other; one chunk for each hash."""
    stored = table(spark, sf_dir, "index_chunks", "directory", "hash", "stored_id", "created_at").select(F.concat_ws("|", "directory", "hash").alias("hash"), F.col("stored_id").alias("ord"), "created_at")
    both = index_store.merged_copies(stored.where("created_at is null").drop("created_at"), stored.where("created_at is not null").drop("created_at"))
    return both.select(F.substring_index("hash", "|", 1).alias("directory"), F.substring_index("hash", "|", -1).alias("hash"), F.col("ord").alias("stored_id"))


def index_contract_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.contract_divergence(spark.read.parquet(f"{sf_dir}/index_meta.parquet"))


def index_chunk_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes by chunk limit, an unknown one apart."""
    return spark.read.parquet(f"{sf_dir}/index_meta.parquet").groupBy("chunk_chars").agg(F.count(F.lit(1)).alias("indexes"))


def vector_dimension_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors of a directory are missing or not of its pinned dimension."""
    meta = spark.read.parquet(f"{sf_dir}/index_meta.parquet").select("directory", "dimension")
    stored = table(spark, sf_dir, "index_chunks", "directory", "vector")
    wrong = F.col("vector").isNull() | (F.size("vector") != F.col("dimension"))
    return stored.join(F.broadcast(meta) if meta.count() <= 100_000 else meta, "directory").groupBy("directory").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(wrong).alias("defects"))


def index_callouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/index_meta.parquet").select("directory", F.array_join(normal_types(F.col("excluded_callouts")), ",").alias("types"))


def build_report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of a directory by status, each delivered once, and those whose counts don't add up."""
    once = spark.read.parquet(f"{sf_dir}/build_reports.parquet").dropDuplicates(["build_id", "directory", "status", "started_at"])
    status = F.lower(F.coalesce("status", F.lit("unknown")))
    uneven = F.coalesce(F.col("chunks") != F.col("embedded_chunks") + F.col("reused_chunks"), F.lit(False))
    return once.groupBy("directory", status.alias("status")).agg(F.count(F.lit(1)).alias("builds"), F.count_if(uneven).alias("uneven"))


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lexical_results", "query_id", "directory", "relative_path", "result_rank").where("result_rank is not null").groupBy("query_id", "directory", "relative_path").agg(F.min("result_rank").alias("nth"))


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The note that the word search puts first for a logged question, in the question's directory."""
    best = lexical.best(search._corpus(spark, sf_dir), search._questions(spark, sf_dir), 1)
    return best.select("query_id", "directory", F.col("doc").alias("relative_path"))


def bench_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the logged results fare: questions, hits among the first three, all expected found, mean rank of the hits."""
    expected = _expected(spark, sf_dir)
    met = expected.join(_logged(spark, sf_dir).where("nth <= 3"), ["query_id", "directory", "relative_path"], "left")
    by_question = met.groupBy("query_id").agg(F.min("nth").alias("best"), F.count("nth").alias("found"), F.count(F.lit(1)).alias("expected"))
    return by_question.agg(F.count(F.lit(1)).alias("questions"), F.count("best").alias("hits"), F.count_if(F.col("found") == F.col("expected")).alias("covered"), F.round(F.avg("best"), 6).alias("mean_rank"))


def bench_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose expected note is among the first three results or one link away from one."""
    pages = G.notes(table(spark, sf_dir, "documents", "doc_id", "directory", "relative_path", "text"))
    first = _logged(spark, sf_dir).where("nth <= 3").join(pages.select("directory", "relative_path", "vault", "slug"), ["directory", "relative_path"])
    onward = first.join(G.links(pages).where("not impossible").select("vault", "slug", "name"), ["vault", "slug"]).select("query_id", "vault", F.col("name").alias("slug"))
    reached = first.select("query_id", "vault", "slug").unionByName(onward).distinct()
    wanted = _expected(spark, sf_dir).select("query_id", F.split("directory", "/")[0].alias("vault"), T.slug(F.col("relative_path")).alias("slug"))
    return wanted.join(reached, ["query_id", "vault", "slug"], "left_semi").select("query_id", "vault", "slug").distinct()


def prompt_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "lexical_results", "query_id", "question").where("question is not null").distinct()
    return asked.where(H.searchable(F.col("question")))


def vocabulary_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with a word that is known to the vault's index, and rare there."""
    entries = G.index_entries(G.notes(table(spark, sf_dir, "documents", "doc_id", "directory", "relative_path", "text"))).select("vault", "entry")
    asked = table(spark, sf_dir, "lexical_results", "query_id", "directory", "question").where("question is not null").select("query_id", F.split("directory", "/")[0].alias("vault"), "question").distinct()
    return H.vocabulary_gate(asked, entries, "question", "vault")


def prompt_hits_minus_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best logged results of a question without the notes whose chunks came late."""
    hits = table(spark, sf_dir, "lexical_results", "query_id", "directory", "relative_path", "score").where("score is not null").groupBy("query_id", "directory", "relative_path").agg(F.max("score").alias("score"))
    seen = table(spark, sf_dir, "chunk_feed", "directory", "path", "seen_at").where("seen_at is null").select("directory", F.col("path").alias("relative_path"))
    return H.unseen(hits, seen, 3, "query_id").select("query_id", "directory", "relative_path", "nth")


def provenance_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a result comes from: the logged ranking, a plain scan for half of the question's long words, or both."""
    asked = table(spark, sf_dir, "lexical_results", "query_id", "directory", "question").where("question is not null").distinct()
    wanted = asked.withColumn("words", H.long_words(F.col("question"))).where(F.size("words") > 0)
    words = wanted.select("query_id", "directory", F.size("words").alias("all"), F.explode("words").alias("word"))
    terms = search._corpus(spark, sf_dir).select("directory", "doc", F.lit(0).cast("long").alias("length"), F.array_distinct(H.long_words(F.coalesce("text", F.lit("")))).alias("terms"))
    found = lexical.origins(terms, words, _logged(spark, sf_dir).select("query_id", "directory", F.col("relative_path").alias("doc")))
    return found.select("query_id", "directory", F.col("doc").alias("relative_path"), "origin")


def secret_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes, credentials planted in them, with these masked, and how many there were."""
    docs = planted.documents(table(spark, sf_dir, "documents", "doc_id", "directory", "relative_path", "text"))
    return docs.select("doc_id", secrets.masked_count(F.col("text")).alias("secrets"), F.md5(secrets.masked(F.col("text"))).alias("masked_md5"))


def figure_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned pages joined, images planted in a third of them, with numbered markers in their place."""
    pages = table(spark, sf_dir, "ocr_responses", "response_id", "page_markdowns").where("page_markdowns is not null")
    pictured = F.transform("page_markdowns", lambda p, i: F.concat(p, F.when((F.col("response_id") + i) % 3 == 0, " ![img](a.png) et ![](b.png)").otherwise("")))
    joined = pages.select("response_id", T.strip(F.array_join(pictured, "\n\n")).alias("whole"))
    return joined.select("response_id", F.regexp_count("whole", F.lit(r"!\[[^\]]*\]\([^)]*\)")).alias("figures"), F.md5(F.concat(T.figure_markers(F.col("whole")), F.lit("\n"))).alias("text_md5"))


def size_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each directory's notes, one a line, dealt to readers of 150 KiB: how many readers, and the bytes that the fullest has."""
    text = F.coalesce("text", F.lit(""))
    dealt = sliced(table(spark, sf_dir, "documents", "doc_id", "directory", "text").withColumn("text", text), "directory", "doc_id", "text")
    by_slice = dealt.groupBy("directory", "slice").agg(F.sum(F.octet_length("text") + 1).alias("bytes"))
    return by_slice.groupBy("directory").agg(F.countDistinct("slice").alias("slices"), F.max("bytes").alias("most"))


_COS = """
v AS (SELECT stored_id, directory, path, CAST(vector AS DOUBLE[]) AS x FROM index_chunks WHERE vector IS NOT NULL AND len([e for e in vector if isnan(e)]) = 0),
q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS y FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL),
n AS (SELECT q.query, v.*, y[1 : least(len(x), len(y))] AS ys, x[1 : least(len(x), len(y))] AS xs, sqrt(coalesce(list_sum([e * e for e in x]), 0)) * sqrt(coalesce(list_sum([e * e for e in y]), 0)) AS norms FROM v CROSS JOIN q),
s AS (SELECT query, directory, path, stored_id, CASE WHEN norms > 0 THEN round(list_dot_product(xs, ys) / norms, 4) ELSE 0.0 END AS score FROM n)"""
_HASHED = "hashed AS (SELECT directory, relative_path, sha256(section || chr(10) || content) AS hash FROM markdown_chunks WHERE section IS NOT NULL AND content IS NOT NULL)"
_TYPES = f"coalesce(list_sort(list_distinct([x for x in [lower({S.strip('t')}) for t in excluded_callouts] if x <> ''])), [])"
_LOGGED = "logged AS (SELECT query_id, directory, relative_path, min(result_rank) AS nth FROM lexical_results WHERE result_rank IS NOT NULL GROUP BY ALL)"
_EXPECTED = search.ORACLE["bm25_top5"].replace("rank <= 5", "rank = 1")
_LONG = "list_distinct(regexp_extract_all(strip_accents(lower({x})), '[a-z0-9]{{5,}}'))"

QUERIES = {
    f.__name__: f
    for f in (
        cosine_topk, best_chunk_per_file, incremental_reuse_report, pending_chunks, index_conflict_merge, index_contract_divergence, index_chunk_limits, vector_dimension_defects, index_callouts,
        build_report_totals, bench_scores, bench_one_hop, prompt_filter, vocabulary_gate, prompt_hits_minus_seen, provenance_both, secret_mask, figure_markers, size_slices,
    )
}

def _masking() -> str:
    """DuckDB has no lookahead: a value that opens like the mask is told by its first characters."""
    fresh = r"""(?:"[^"]*"|'[^']*'|[^\s,;)}\]\["'][^\s,;)}\]]*|["'][^\s,;)}\]]+|\[[^\s,;)}\]s][^\s,;)}\]]*)"""
    patterns = [
        (rf"(?im)^(\s*(?:export\s+)?{secrets.NAME}\s*[:=]\s*)[^\n]+$", rf"\1{secrets.MASK}"),
        (r"(?i)\b(authorization\s*:\s*(?:bearer|basic)\s+)(?:[^\s\[]\S*|\[[^\ss]\S*)", rf"\1{secrets.MASK}"),
        (rf"(?i)\b({secrets.NAME}\s*[:=]\s*){fresh}", rf"\1{secrets.MASK}"),
        *((p, secrets.MASK) for p in secrets.WHOLE),
    ]
    ctes = ["m0 AS (SELECT doc_id, text AS x, 0 AS n FROM planted)"]
    for i, (pattern, instead) in enumerate(patterns):
        p = pattern.replace("'", "''")
        ctes.append(f"m{i + 1} AS (SELECT doc_id, regexp_replace(x, '{p}', '{instead}', 'g') AS x, n + len(regexp_extract_all(x, '{p}')) AS n FROM m{i})")
    return f"WITH {planted.SQL}, {', '.join(ctes)} SELECT doc_id, CAST(n AS INTEGER) AS secrets, md5(x) AS masked_md5 FROM m{len(patterns)}"


ORACLE = {
    "secret_mask": _masking(),
    "figure_markers": f"""WITH w AS (SELECT response_id, {S.strip("array_to_string([page_markdowns[i] || CASE WHEN (response_id + i - 1) % 3 = 0 THEN ' ![img](a.png) et ![](b.png)' ELSE '' END for i in range(1, len(page_markdowns) + 1) if page_markdowns[i] IS NOT NULL], chr(10) || chr(10))")} AS whole FROM ocr_responses WHERE page_markdowns IS NOT NULL),
c AS (SELECT response_id, whole, string_split_regex(whole, '!\\[[^\\]]*\\]\\([^)]*\\)') AS parts FROM w)
SELECT response_id, CAST(len(parts) - 1 AS INTEGER) AS figures, md5(array_to_string([CASE WHEN i = 1 THEN parts[1] ELSE '[figure ' || (i - 1) || ' — non extraite]' || parts[i] END for i in range(1, len(parts) + 1)], '') || chr(10)) AS text_md5 FROM c""",
    "cosine_topk": f"WITH {_COS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query, directory ORDER BY score DESC, stored_id) AS INTEGER) AS rank FROM s) SELECT query, directory, stored_id, score, rank FROM r WHERE rank <= 5",
    "best_chunk_per_file": f"""WITH {_COS}, f AS (SELECT *, row_number() OVER (PARTITION BY query, directory, path ORDER BY score DESC, stored_id) AS nth FROM s),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query, directory ORDER BY score DESC, stored_id) AS INTEGER) AS rank FROM f WHERE nth = 1) SELECT query, directory, path, stored_id, score, rank FROM r WHERE rank <= 5""",
    "incremental_reuse_report": f"""WITH {_HASHED}, last AS (SELECT directory, hash, vector IS NOT NULL AS usable, row_number() OVER (PARTITION BY directory, hash ORDER BY stored_id DESC) AS nth FROM index_chunks)
SELECT h.directory, count(DISTINCT h.relative_path) AS files, count(*) AS chunks, count(*) FILTER (WHERE NOT coalesce(l.usable, false)) AS embedded_chunks, count(*) FILTER (WHERE coalesce(l.usable, false)) AS reused_chunks
FROM hashed h LEFT JOIN last l ON h.directory = l.directory AND h.hash = l.hash AND l.nth = 1 GROUP BY h.directory""",
    "pending_chunks": f"WITH {_HASHED} SELECT DISTINCT directory, hash FROM hashed h WHERE NOT EXISTS (SELECT 1 FROM index_chunks i WHERE i.directory = h.directory AND i.hash = h.hash)",
    "index_conflict_merge": "SELECT directory, hash, coalesce(min(CASE WHEN created_at IS NULL THEN stored_id END), min(stored_id)) AS stored_id FROM index_chunks WHERE directory IS NOT NULL AND hash IS NOT NULL GROUP BY directory, hash",
    "index_contract_divergence": """WITH c AS (SELECT provider, model, dimension, count(*) AS n FROM index_meta GROUP BY ALL ORDER BY n DESC, provider, model, dimension LIMIT 1)
SELECT m.directory, m.provider, m.model, m.dimension, m.version FROM index_meta m CROSS JOIN c
WHERE m.provider IS DISTINCT FROM c.provider OR m.model IS DISTINCT FROM c.model OR m.dimension IS DISTINCT FROM c.dimension OR m.version <> 1""",
    "index_chunk_limits": "SELECT chunk_chars, count(*) AS indexes FROM index_meta GROUP BY chunk_chars",
    "vector_dimension_defects": "SELECT i.directory, count(*) AS chunks, count(*) FILTER (WHERE i.vector IS NULL OR len(i.vector) <> m.dimension) AS defects FROM index_chunks i JOIN index_meta m ON i.directory = m.directory GROUP BY i.directory",
    "index_callouts": f"SELECT directory, array_to_string({_TYPES}, ',') AS types FROM index_meta",
    "build_report_totals": """WITH once AS (SELECT *, row_number() OVER (PARTITION BY build_id, directory, status, started_at ORDER BY report_id) AS nth FROM build_reports)
SELECT directory, lower(coalesce(status, 'unknown')) AS status, count(*) AS builds, count(*) FILTER (WHERE coalesce(chunks <> embedded_chunks + reused_chunks, false)) AS uneven FROM once WHERE nth = 1 GROUP BY ALL""",
    "bench_scores": f"""WITH e AS ({_EXPECTED}), {_LOGGED}, m AS (SELECT e.query_id, l.nth FROM e LEFT JOIN logged l ON e.query_id = l.query_id AND e.directory = l.directory AND e.doc = l.relative_path AND l.nth <= 3),
b AS (SELECT query_id, min(nth) AS best, count(nth) AS found, count(*) AS expected FROM m GROUP BY query_id)
SELECT count(*) AS questions, count(best) AS hits, count(*) FILTER (WHERE found = expected) AS covered, round(avg(best), 6) AS mean_rank FROM b""",
    "bench_one_hop": f"""WITH e AS ({_EXPECTED}), {_LOGGED}, {LINKS}, f AS (SELECT l.query_id, p.vault, p.slug FROM logged l JOIN pages p ON l.directory = p.directory AND l.relative_path = p.relative_path WHERE l.nth <= 3),
reached AS (SELECT * FROM f UNION SELECT f.query_id, f.vault, l.name FROM f JOIN parsed l ON f.vault = l.vault AND f.slug = l.slug WHERE NOT l.impossible),
w AS (SELECT query_id, string_split(directory, '/')[1] AS vault, regexp_replace(string_split(doc, '/')[-1], '\\.md$', '') AS slug FROM e)
SELECT DISTINCT w.query_id, w.vault, w.slug FROM w JOIN reached r ON w.query_id = r.query_id AND w.vault = r.vault AND w.slug = r.slug""",
    "prompt_filter": "SELECT DISTINCT query_id, question FROM lexical_results WHERE question IS NOT NULL AND NOT regexp_matches(question, '^[/!#]') AND length(question) >= 12",
    "vocabulary_gate": f"""WITH {FRONT}, entries AS (SELECT vault, '- [[' || slug || ']] — ' || coalesce(description, '') AS entry FROM props WHERE layer IN ('concepts', 'entites', 'syntheses', 'enseignements', 'sources')),
held AS (SELECT vault, word, count(*) AS df FROM (SELECT vault, unnest({_LONG.format(x="entry")}) AS word FROM entries) GROUP BY ALL), size AS (SELECT vault, greatest(1, count(*) // 10) AS ceiling FROM entries GROUP BY vault),
asked AS (SELECT DISTINCT query_id, string_split(directory, '/')[1] AS vault, question FROM lexical_results WHERE question IS NOT NULL), words AS (SELECT *, unnest({_LONG.format(x="question")}) AS word FROM asked)
SELECT DISTINCT w.query_id, w.vault, w.question FROM words w JOIN held h ON w.vault = h.vault AND w.word = h.word JOIN size s ON s.vault = h.vault WHERE h.df <= s.ceiling""",
    "prompt_hits_minus_seen": """WITH h AS (SELECT query_id, directory, relative_path, max(score) AS score FROM lexical_results WHERE score IS NOT NULL GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, directory, relative_path) AS INTEGER) AS nth FROM h)
SELECT query_id, directory, relative_path, nth FROM r WHERE nth <= 3 AND NOT EXISTS (SELECT 1 FROM chunk_feed c WHERE c.seen_at IS NULL AND c.directory = r.directory AND c.path = r.relative_path)""",
    "provenance_both": f"""WITH {S.LINES}, {_LOGGED}, corpus AS (SELECT directory, relative_path, doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM body GROUP BY ALL),
asked AS (SELECT DISTINCT query_id, directory, question FROM lexical_results WHERE question IS NOT NULL),
words AS (SELECT query_id, directory, len({_LONG.format(x="question")}) AS n_all, unnest({_LONG.format(x="question")}) AS word FROM asked),
held AS (SELECT directory, relative_path, unnest({_LONG.format(x="text")}) AS word FROM corpus),
scanned AS (SELECT w.query_id, w.directory, h.relative_path FROM words w JOIN held h ON w.directory = h.directory AND w.word = h.word GROUP BY ALL HAVING count(*) * 2 >= max(w.n_all))
SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l.directory, s.directory) AS directory, coalesce(l.relative_path, s.relative_path) AS relative_path,
       CASE WHEN l.query_id IS NOT NULL AND s.query_id IS NOT NULL THEN 'both' WHEN s.query_id IS NOT NULL THEN 'scan' ELSE 'ranking' END AS origin
FROM logged l FULL JOIN scanned s ON l.query_id = s.query_id AND l.directory = s.directory AND l.relative_path = s.relative_path""",
    "size_slices": f"""WITH d AS (SELECT directory, strlen(coalesce(text, '')) + 1 AS n, coalesce(sum(strlen(coalesce(text, '')) + 1) OVER (PARTITION BY directory ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents),
s AS (SELECT directory, before // {SLICE_BYTES} AS slice, sum(n) AS bytes FROM d GROUP BY ALL) SELECT directory, count(*) AS slices, CAST(max(bytes) AS BIGINT) AS most FROM s GROUP BY directory""",
}

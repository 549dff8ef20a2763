"""Files of whole vaults, scopes and benches, over listings that are planted alike in Spark and in SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..operators import graph as G
from ..operators import vault as V
from ..sources.tables import table
from . import graph, planted
from . import sqltext as S
from .graph import FRONT, PAGES

_LAYER = "CASE WHEN {last} IN ('concepts', 'entites', 'syntheses', 'enseignements', 'sources') THEN {last} ELSE 'concepts' END"


def _case(spark: bool) -> str:
    """Where a document's file lies in its vault, by its id."""
    text = "string" if spark else "varchar"
    n = f"cast(doc_id as {text})"
    last = "element_at(split(directory, '/'), -1)" if spark else "string_split(directory, '/')[-1]"
    spots = ("'note'", "'INDEX'", "'wiki/libre'", "'wiki/concepts/sous/a'", "'.claude/reglage'", "'LOG/j'", "'inbox/x'")
    whens = " ".join(f"WHEN {i} THEN " + ("'INDEX.md'" if s == "'INDEX'" else f"concat({s}, {n}, '.md')") for i, s in enumerate(spots))
    return f"CASE doc_id % 20 {whens} ELSE concat('wiki/', {_LAYER.format(last=last)}, '/', relative_path) END"


def _said(spark: bool) -> str:
    n = f"cast(doc_id as {'string' if spark else 'varchar'})"
    return f"""CASE WHEN doc_id % 60 = 7 THEN concat('---', chr(10), 'type: x', chr(10), '---', chr(10)) ELSE concat(coalesce(text, ''),
  CASE WHEN doc_id % 40 = 5 THEN ' [[lien]]' ELSE '' END, CASE WHEN doc_id % 6 = 1 THEN concat(' ![i](img/', {n}, '.png) ![j](https://x.y/z.png) ![k](/medias/', {n}, '.png "t")') ELSE '' END) END"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vault, path, text) of the notes dealt over their vaults, with images for some."""
    docs = table(spark, sf_dir, "documents", "doc_id", "directory", "relative_path", "text")
    vault = F.get(F.split("directory", "/"), F.lit(0)).alias("vault")
    notes = docs.select(vault, F.expr(_case(True)).alias("path"), F.expr(_said(True)).alias("text"))
    beside = docs.where("doc_id % 12 = 1").select(vault, F.expr("concat(regexp_replace(" + _case(True) + ", '[^/]*$', ''), 'img/', cast(doc_id as string), '.png')").alias("path"), F.lit("").alias("text"))
    rooted = docs.where("doc_id % 18 = 1").select(vault, F.expr("concat('medias/', cast(doc_id as string), '.png')").alias("path"), F.lit("").alias("text"))
    return notes.unionByName(beside).unionByName(rooted)


_FILES = f"""listed AS (
  SELECT doc_id, string_split(directory, '/')[1] AS vault, {_case(False)} AS path, {_said(False)} AS text FROM documents
), files AS (
  SELECT vault, path, text FROM listed UNION ALL SELECT vault, regexp_replace(path, '[^/]*$', '') || 'img/' || doc_id || '.png', '' FROM listed WHERE doc_id % 12 = 1
  UNION ALL SELECT vault, 'medias/' || doc_id || '.png', '' FROM listed WHERE doc_id % 18 = 1
)"""


def vault_parasites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.parasites(_files(spark, sf_dir))


def ghost_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ghosts(_files(spark, sf_dir))


def inbox_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.backlog(_files(spark, sf_dir))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.notes(table(spark, sf_dir, "documents", "doc_id", "directory", "relative_path", "text"))


def index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of each vault that lacks every seventh note and names some that are gone."""
    pages = _pages(spark, sf_dir)
    line = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("- [[concepts/perdu-"), F.col("doc_id").cast("string"), F.lit("|perdu]] — x"))).otherwise(F.concat(F.lit("- [["), "slug", F.lit("]]")))
    entries = V.index_lines(pages.where("doc_id % 7 != 0").select("vault", F.concat(F.lit("# INDEX\n"), line, F.lit("\n- sans lien")).alias("text")))
    return V.index_check(entries, pages)


def complement_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that open by naming a parent; some parents name them too."""
    pages = _pages(spark, sf_dir)
    opened = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# T\n\nSuite de [[x/"), F.col("slug"), F.lit("-mere|la page]]. Voir [[ailleurs]].\n"))).otherwise(F.lit("# T\n\nRien.\n"))
    children = pages.withColumn("text", F.concat(opened, F.coalesce("text", F.lit(""))))
    mothers = pages.where("doc_id % 2 = 0").withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Rien.\n\n[["), F.col("slug"), F.lit("]]")))).withColumn("slug", F.concat("slug", F.lit("-mere")))
    return V.complements(children.unionByName(mothers))


def current_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the notes, each with a history planted behind it, without the history."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n## Historique\n- [2020-01-01] avant\n# Suite\nmaintenant")))
    return V.current(chunking.sections(docs, "doc_id", "text")).groupBy(F.col("key").alias("doc_id")).agg(F.count(F.lit(1)).alias("sections"), F.sum(F.length("content")).alias("chars"))


def search_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a plain search may see, by vault, without and with the archives."""
    moved = _files(spark, sf_dir).withColumn("path", F.when(F.length("path") % 5 == 0, F.concat(F.lit("archives/"), F.col("path"))).otherwise(F.col("path")))
    return moved.groupBy("vault").agg(F.count_if(V.in_scope(F.col("path"))).alias("wiki"), F.count_if(V.in_scope(F.col("path"), True)).alias("with_archives"))


def neighbour_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that name a neighbouring folder, in a spelling of their own."""
    folders = F.array(*(F.lit(x) for x in ("Marketing", "ventes", "RH")))
    word = F.when(F.col("query_id") % 4 == 0, " dans:marketing").when(F.col("query_id") % 4 == 1, " dans:VENTES").when(F.col("query_id") % 4 == 2, " dans:inconnu").otherwise("")
    asked = table(spark, sf_dir, "lexical_results", "query_id", "question").where("question is not null").distinct()
    return asked.select("query_id", V.neighbour(F.concat(F.lit("  x"), word, F.lit(" "), "question"), folders).alias("n")).select("query_id", "n.*").distinct()


def repair_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a note's piece says the corrected or the old value, planted by its id."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("doc_id", "key")
    claims = docs.select("key", F.lit("Montant : 12 €").alias("old"), F.lit("montant : 15 €").alias("new"))
    says = F.when(F.col("key") % 4 == 0, " le MONTANT :  12 € ").when(F.col("key") % 4 == 1, " montant : 15 €").when(F.col("key") % 4 == 2, " Montant : 12 € puis montant : 15 €").otherwise(" rien")
    pieces = docs.where("key % 10 != 9").select("key", F.concat(F.coalesce("text", F.lit("")), says).alias("text"))
    return V.repair_verdict(claims, pieces).select(F.col("key").alias("doc_id"), "verdict")


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Expected notes of the logged questions (the two first results), and ranks that two searches give them."""
    logged = table(spark, sf_dir, "lexical_results", "query_id", "relative_path", "result_rank").where("result_rank is not null").groupBy(F.col("query_id").alias("question"), T.slug(F.col("relative_path")).alias("slug")).agg(F.min("result_rank").alias("r"))
    expected = logged.where("r <= 2").select("question", "slug")
    semantic = logged.select("question", "slug", ((F.col("question") + F.col("r")) % 5 + 1).cast("int").alias("nth"))
    lexical = logged.select("question", "slug", F.col("r").alias("nth")).where("question % 3 != 0")
    linked = logged.where("r = 1").select("question", "slug").join(logged.where("r = 2").select("question", F.col("slug").alias("to")), "question").where("question % 2 = 0").select("slug", "to").distinct()
    return expected, semantic, lexical, linked


def bench_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bench_line(V.bench(*_asked(spark, sf_dir)))


def bench_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, semantic, _, _ = _asked(spark, sf_dir)
    verdicts = expected.select("question").distinct().withColumn("verdict", F.when(F.col("question") % 5 == 0, "rien-trouve").otherwise("repondu"))
    return V.real_line(expected, semantic.where("nth <= 2").select("question", "slug"), verdicts)


def bench_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which layers the first results of the logged questions come from."""
    logged = table(spark, sf_dir, "lexical_results", "query_id", "directory", "relative_path", "result_rank").where(F.col("result_rank") <= V.FIRST).select("query_id", "directory", "relative_path").distinct()
    return logged.groupBy(F.element_at(F.split("directory", "/"), -1).alias("layer")).agg(F.count(F.lit(1)).alias("hits"))


def bench_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected notes that are gone, so that their questions can't count."""
    split = F.split("directory", "/")
    logged = table(spark, sf_dir, "lexical_results", "query_id", "directory", "relative_path").select(F.col("query_id").alias("question"), F.get(split, F.lit(0)).alias("vault"), F.when(F.col("query_id") % 6 == 0, F.concat(T.slug(F.col("relative_path")), F.lit("-perdue"))).otherwise(T.slug(F.col("relative_path"))).alias("slug")).where("slug is not null").distinct()
    return V.existing(logged, _pages(spark, sf_dir)).where("gone").select("question", "vault", "slug")


def bench_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made of a note's own opening words, or of other ones."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("slug"), "doc_id", "text")
    opening = F.array_join(F.slice(T.tokens(F.coalesce("text", F.lit(""))), 1, 6), ", ")
    questions = docs.select(F.col("doc_id").alias("question"), "slug", F.when(F.col("doc_id") % 2 == 0, F.upper(opening)).otherwise("zzz quelque chose").alias("asked"))
    return V.worded_like(questions, docs)


def open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions that wait for an answer: the notes' question callouts, one planted in every thirteenth."""
    asked = F.when(F.col("doc_id") % 13 == 0, "\n> [!Question]- ouverte\n> suite").otherwise("")
    docs = table(spark, sf_dir, "documents", "doc_id", "directory", "relative_path", "text").withColumn("text", F.concat(F.coalesce("text", F.lit("")), asked))
    return G.callouts(G.notes(docs)).where("kind = 'question'").select("doc_id", "n")


def missing_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of notes, every eighth under another name, that no index is known of."""
    directory = F.when(F.length("directory") % 8 == 0, F.concat("directory", F.lit("-neuf"))).otherwise(F.col("directory")).alias("directory")
    held = spark.read.parquet(f"{sf_dir}/index_meta.parquet").select("directory")
    return table(spark, sf_dir, "documents", "directory").select(directory).distinct().join(held, "directory", "left_anti")


def pairing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, and lessons of the same name made for two of three of them, some with the links that both should have."""
    pages = _pages(spark, sf_dir).where("layer = 'sources'")
    ahead, back = (F.when(F.col("doc_id") % n == 0, F.concat(F.lit(f" [[{folder}/"), F.col("slug"), F.lit("]]"))).otherwise("") for n, folder in ((2, "enseignements"), (5, "sources")))
    sources = pages.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), ahead))
    lessons = pages.where("doc_id % 3 != 0").withColumn("text", F.concat(F.lit("leçon"), back)).withColumn("layer", F.lit("enseignements"))
    alone = pages.where("doc_id % 7 = 0").withColumn("slug", F.concat("slug", F.lit("-seule"))).withColumn("layer", F.lit("enseignements"))
    return G.pairing_defects(sources.unionByName(lessons).unionByName(alone))


def post_ingest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every fourth note, taken as just written, has wrong, faults planted."""
    pages = G.notes(planted.documents(table(spark, sf_dir, "documents", "doc_id", "directory", "relative_path", "text")))
    return V.post_ingest(pages, pages.where("doc_id % 4 = 0"))


def shown_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged results as a prompt shows them, and whether they are short enough to be quoted whole."""
    hits = table(spark, sf_dir, "lexical_results", "query_id", "relative_path", "excerpt").where("excerpt is not null").distinct()
    return hits.select("query_id", "relative_path", F.md5(V.shown_hit(F.col("excerpt"))).alias("shown_md5"), V.shown_quote(F.col("excerpt")).alias("whole")).distinct()


#: The counters of a lint report, each with the check that it counts.
COUNTED = {
    "contradictions": open_questions, "dangling": graph.dangling_links, "one_way": complement_links, "duplicates": graph.duplicate_names, "orphans": graph.orphan_pages, "index_gaps": index_check,
    "conflicts": graph.conflict_files, "inbox": inbox_backlog, "front_matter": graph.front_matter_defects, "parasites": vault_parasites, "missing_indexes": missing_indexes, "unpaired": graph.unpaired_layers,
    "notes_by_layer": graph.layer_counts, "ambiguous": graph.ambiguous_links, "false": graph.false_links, "ghosts": ghost_images, "secrets": graph.secret_scan,
}


def lint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings each check of a vault has."""
    rows = [found(spark, sf_dir).agg(F.count(F.lit(1)).alias("findings")).select(F.lit(name).alias("check_name"), "findings") for name, found in COUNTED.items()]
    return functools.reduce(DataFrame.unionByName, rows)


_ASKED = """logged AS (SELECT query_id AS question, regexp_replace(string_split(relative_path, '/')[-1], '\\.md$', '') AS slug, min(result_rank) AS r FROM lexical_results WHERE result_rank IS NOT NULL GROUP BY ALL),
expected AS (SELECT question, slug FROM logged WHERE r <= 2), semantic AS (SELECT question, slug, (question + r) % 5 + 1 AS nth FROM logged), lexical AS (SELECT question, slug, r AS nth FROM logged WHERE question % 3 <> 0),
linked AS (SELECT DISTINCT a.slug, b.slug AS to_slug FROM logged a JOIN logged b ON a.question = b.question AND a.r = 1 AND b.r = 2 WHERE a.question % 2 = 0)"""

QUERIES = {
    f.__name__: f
    for f in (
        vault_parasites, ghost_images, inbox_backlog, index_check, complement_links, current_sections, search_scope, neighbour_scope, repair_verdicts,
        bench_variants, bench_real, bench_layers, bench_gone, bench_wording, open_questions, missing_indexes, lint_report, post_ingest_check, shown_hits, pairing_check,
    )
}

ORACLE = {
    "vault_parasites": f"""WITH {_FILES}, cut AS (SELECT *, string_split(path, '/') AS p FROM files)
SELECT vault, path, 'root_note' AS kind FROM cut WHERE len(p) = 1 AND ends_with(path, '.md') AND path NOT IN ('INDEX.md', 'INSTRUCTIONS-CLAUDE.md', 'BENCH.md', 'LOG.md')
UNION ALL SELECT vault, path, 'unindexed' FROM cut WHERE len(p) = 2 AND p[1] = 'wiki' AND ends_with(path, '.md')
UNION ALL SELECT vault, path, 'nested' FROM cut WHERE len(p) > 3 AND p[1] = 'wiki' AND p[2] IN ('concepts', 'entites', 'syntheses', 'enseignements', 'sources') AND ends_with(path, '.md')
UNION ALL SELECT vault, path, 'empty' FROM cut WHERE ends_with(path, '.md') AND {S.strip("CASE WHEN text = '---' || chr(10) || 'type: x' || chr(10) || '---' || chr(10) THEN '' ELSE text END")} = ''
UNION ALL SELECT vault, path, 'settings' FROM cut WHERE p[1] = '.claude'
UNION ALL SELECT vault, path, 'log_link' FROM cut WHERE p[1] = 'LOG' AND ends_with(path, '.md') AND regexp_matches(text, '\\[\\[[^\\[\\]]+\\]\\]')""",
    "ghost_images": f"""WITH {_FILES}, shown AS (SELECT DISTINCT vault, path, regexp_replace(path, '[^/]*$', '') AS folder, unnest(regexp_extract_all(text, '{V.IMAGE}', 1)) AS target FROM files WHERE starts_with(path, 'wiki/') AND ends_with(path, '.md'))
SELECT s.vault, s.path, s.target FROM shown s WHERE NOT regexp_matches(s.target, '^[a-z][a-z0-9+.-]*:') AND NOT EXISTS (SELECT 1 FROM files f WHERE f.vault = s.vault AND f.path IN (s.folder || s.target, regexp_replace(s.target, '^/', '')))""",
    "inbox_backlog": f"WITH {_FILES} SELECT vault, path, CAST(strlen(text) AS INTEGER) AS bytes FROM files WHERE starts_with(path, 'inbox/')",
    "index_check": f"""WITH {PAGES}, e AS (SELECT DISTINCT vault, CASE WHEN doc_id % 11 = 0 THEN 'perdu-' || doc_id ELSE slug END AS slug FROM pages WHERE doc_id % 7 <> 0),
h AS (SELECT DISTINCT vault, slug FROM pages WHERE layer IN ('concepts', 'entites', 'syntheses', 'enseignements', 'sources'))
SELECT vault, slug, 'hole' AS gap FROM (SELECT * FROM h EXCEPT SELECT * FROM e) UNION ALL SELECT vault, slug, 'dead' FROM (SELECT * FROM e EXCEPT SELECT * FROM h)""",
    "complement_links": f"""WITH {PAGES} SELECT DISTINCT c.vault, c.slug, c.slug || '-mere' AS parent FROM pages c WHERE c.doc_id % 3 = 0
  AND EXISTS (SELECT 1 FROM pages m WHERE m.vault = c.vault AND m.slug = c.slug AND m.doc_id % 2 = 0) AND NOT EXISTS (SELECT 1 FROM pages m WHERE m.vault = c.vault AND m.slug = c.slug AND m.doc_id % 4 = 0)""",
    "current_sections": f"""WITH told AS (SELECT doc_id, directory, relative_path, coalesce(text, '') || chr(10) || '## Historique' || chr(10) || '- [2020-01-01] avant' || chr(10) || '# Suite' || chr(10) || 'maintenant' AS text FROM documents),
{S.SECTIONS.replace("FROM documents", "FROM told").lstrip()} SELECT doc_id, count(*) AS sections, CAST(sum(length(content)) AS BIGINT) AS chars FROM sections WHERE content <> '' AND lower({S.strip("section")}) <> 'historique' GROUP BY doc_id""",
    "search_scope": f"""WITH {_FILES}, moved AS (SELECT vault, CASE WHEN length(path) % 5 = 0 THEN 'archives/' || path ELSE path END AS path FROM files)
SELECT vault, count(*) FILTER (WHERE starts_with(path, 'wiki/')) AS wiki, count(*) FILTER (WHERE starts_with(path, 'wiki/') OR starts_with(path, 'archives/')) AS with_archives FROM moved GROUP BY vault""",
    "neighbour_scope": f"""SELECT DISTINCT query_id, {S.collapse("'x  ' || question")} AS question, CASE query_id % 4 WHEN 0 THEN 'Marketing' WHEN 1 THEN 'ventes' END AS folder, CASE query_id % 4 WHEN 0 THEN 'marketing' WHEN 1 THEN 'VENTES' WHEN 2 THEN 'inconnu' END AS asked FROM lexical_results WHERE question IS NOT NULL""",
    "repair_verdicts": """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN NULL ELSE doc_id % 4 END AS k FROM documents) SELECT doc_id, CASE k WHEN 0 THEN 'stale' WHEN 1 THEN 'confirmed' ELSE 'undetermined' END AS verdict FROM s""",
    "bench_variants": f"""WITH {_ASKED}, away AS (SELECT question, slug FROM semantic WHERE nth <= 3 UNION SELECT s.question, l.to_slug FROM semantic s JOIN linked l ON s.slug = l.slug WHERE s.nth <= 3),
m AS (SELECT e.question, e.slug, (SELECT min(nth) FROM semantic s WHERE s.question = e.question AND s.slug = e.slug AND nth <= 3) AS sem, (SELECT min(nth) FROM lexical s WHERE s.question = e.question AND s.slug = e.slug AND nth <= 3) AS lex,
      EXISTS (SELECT 1 FROM away a WHERE a.question = e.question AND a.slug = e.slug) AS hop FROM expected e),
b AS (SELECT question, count(*) AS n, min(sem) AS sem, min(lex) AS lex, bool_or(hop) AS hop, count(*) FILTER (WHERE sem IS NOT NULL OR lex IS NOT NULL OR hop) AS found FROM m GROUP BY question)
SELECT count(*) AS questions, count(sem) AS semantic_hits, round(avg(sem), 6) AS semantic_rank, count(*) FILTER (WHERE hop) AS hops, count(lex) AS lexical_hits, round(avg(lex), 6) AS lexical_rank,
  count(*) FILTER (WHERE found = n) AS covered, count(*) FILTER (WHERE lex IS NOT NULL AND sem IS NULL) AS lexical_only, count(*) FILTER (WHERE lex < sem) AS lexical_better FROM b""",
    "bench_real": f"""WITH {_ASKED}, m AS (SELECT e.question, e.slug, EXISTS (SELECT 1 FROM semantic s WHERE s.question = e.question AND s.slug = e.slug AND s.nth <= 2) AS hit FROM expected e),
b AS (SELECT question, bool_or(hit) AS some_hit, bool_and(hit) AS all_hit FROM m GROUP BY question)
SELECT count(*) AS questions, count(*) FILTER (WHERE some_hit) AS "real", count(*) FILTER (WHERE all_hit) AS complete, count(*) FILTER (WHERE question % 5 = 0) AS empty FROM b""",
    "bench_layers": "SELECT string_split(directory, '/')[-1] AS layer, count(*) AS hits FROM (SELECT DISTINCT query_id, directory, relative_path FROM lexical_results WHERE result_rank <= 3) GROUP BY 1",
    "bench_gone": f"""WITH {PAGES}, l AS (SELECT DISTINCT query_id AS question, string_split(directory, '/')[1] AS vault, regexp_replace(string_split(relative_path, '/')[-1], '\\.md$', '') || CASE WHEN query_id % 6 = 0 THEN '-perdue' ELSE '' END AS slug FROM lexical_results)
SELECT question, vault, slug FROM l WHERE slug IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pages p WHERE p.vault = l.vault AND p.slug = l.slug)""",
    "bench_wording": f"SELECT doc_id AS question, CAST(doc_id AS VARCHAR) AS slug FROM documents WHERE doc_id % 2 = 0 AND len({S.tokens("coalesce(text, '')")}) > 0",
}

_CALLED = graph.ORACLE["callout_census"].replace("FROM documents", "FROM called").removeprefix("WITH ")
ORACLE["open_questions"] = f"""SELECT doc_id, n FROM (WITH called AS (SELECT doc_id, directory, relative_path, coalesce(text, '') || CASE WHEN doc_id % 13 = 0 THEN chr(10) || '> [!Question]- ouverte' || chr(10) || '> suite' ELSE '' END AS text FROM documents),
{_CALLED}) WHERE kind = 'question'"""
ORACLE["missing_indexes"] = "SELECT DISTINCT x AS directory FROM (SELECT CASE WHEN length(directory) % 8 = 0 THEN directory || '-neuf' ELSE directory END AS x FROM documents) WHERE x NOT IN (SELECT directory FROM index_meta)"
ORACLE["lint_report"] = " UNION ALL ".join(f"SELECT '{name}' AS check_name, count(*) AS findings FROM ({(graph.ORACLE | ORACLE)[found.__name__]})" for name, found in COUNTED.items())
_WITHIN = {"dangling": planted.over(graph.ORACLE["dangling_links"]), "ambiguous": graph.ORACLE["ambiguous_links"], "false": graph.ORACLE["false_links"], "secret": graph.ORACLE["secret_scan"]}
ORACLE["post_ingest_check"] = f"""WITH {planted.SQL}, pages AS (SELECT doc_id, string_split(directory, '/')[-1] AS layer, text FROM planted)
SELECT doc_id, 'one_block' AS kind FROM pages WHERE layer = 'enseignements' AND doc_id % 4 = 0 AND NOT regexp_matches(text, '(?m)^[ \\t]*###+( |$)')""" + "".join(f" UNION ALL SELECT DISTINCT doc_id, '{kind}' FROM ({sql}) WHERE doc_id % 4 = 0" for kind, sql in _WITHIN.items())
ORACLE["shown_hits"] = f"""SELECT DISTINCT query_id, relative_path, md5(CASE WHEN length({S.collapse("excerpt")}) <= {V.HIT_CHARS} THEN {S.collapse("excerpt")} ELSE substring({S.collapse("excerpt")}, 1, {V.HIT_CHARS}) || '…' END) AS shown_md5, length(excerpt) <= {V.QUOTE_CHARS} AS whole
FROM lexical_results WHERE excerpt IS NOT NULL"""
ORACLE["pairing_check"] = f"""WITH {FRONT}, src AS (SELECT vault, slug, bool_or(doc_id % 3 <> 0) AS lesson, bool_or(doc_id % 2 = 0) AS ahead, bool_or(doc_id % 3 <> 0 AND doc_id % 5 = 0) AS back, bool_or(origine IS NOT NULL) AS named, bool_or(doc_id % 7 = 0) AS alone
  FROM props WHERE layer = 'sources' GROUP BY vault, slug)
SELECT vault, slug, 'no_lesson' AS defect FROM src WHERE NOT lesson UNION ALL SELECT vault, slug, 'source_unlinked' FROM src WHERE lesson AND NOT ahead UNION ALL SELECT vault, slug, 'lesson_unlinked' FROM src WHERE lesson AND NOT back
UNION ALL SELECT vault, slug, 'no_origin' FROM src WHERE NOT named UNION ALL SELECT vault, slug || '-seule', 'no_source' FROM src WHERE alone"""

"""Integrity of the notes: names, links, front matter, callouts, index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import secrets
from ..functions import text as T
from ..operators import graph as G
from ..operators import hooks as H
from ..sources.tables import table
from . import planted
from . import sqltext as S


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.notes(table(spark, sf_dir, "documents", "doc_id", "directory", "relative_path", "text"))


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes with planted faults: the tables themselves have none of these kinds."""
    return G.notes(planted.documents(table(spark, sf_dir, "documents", "doc_id", "directory", "relative_path", "text")))


def wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.links(_pages(spark, sf_dir)).select("doc_id", "raw", "target", "folder", "name", "impossible")


def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dangling_links(_pages(spark, sf_dir))


def ambiguous_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ambiguous_links(_planted(spark, sf_dir))


def false_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.false_links(_planted(spark, sf_dir))


def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.orphans(_pages(spark, sf_dir))


def one_way_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.one_way_links(_planted(spark, sf_dir))


def unpaired_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.unpaired(_pages(spark, sf_dir))


def front_matter_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.front_defects(_pages(spark, sf_dir))


def common_day_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that several notes wrongly share: the day of a batch instead of their own."""
    wrong = G.front_defects(_pages(spark, sf_dir)).where("wrong_date")
    return wrong.groupBy("date").agg(F.count(F.lit(1)).alias("notes"))


def callout_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.callouts(_pages(spark, sf_dir))


def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.same_names(_planted(spark, sf_dir))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.secrets(_planted(spark, sf_dir))


def conflict_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planted(spark, sf_dir).where(F.col("relative_path").rlike(G.CONFLICT)).select("doc_id", "relative_path")


def empty_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).where(F.coalesce(T.strip(F.col("text")), F.lit("")) == "").select("doc_id", "layer")


def index_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.index_gaps(_pages(spark, sf_dir), table(spark, sf_dir, "markdown_chunks", "directory", "relative_path"))


def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.index_entries(_pages(spark, sf_dir))


def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).groupBy("vault", "layer").agg(F.count(F.lit(1)).alias("notes"))


def lint_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings each check has."""
    pages = _pages(spark, sf_dir)
    checks = {
        "orphans": G.orphans(pages),
        "dangling": G.dangling_links(pages),
        "ambiguous": G.ambiguous_links(pages),
        "false": G.false_links(pages),
        "unpaired": G.unpaired(pages),
        "front_matter": G.front_defects(pages),
        "misplaced": G.callouts(pages).where("misplaced"),
        "secrets": G.secrets(pages),
    }
    rows = [found.agg(F.count(F.lit(1)).alias("findings")).select(F.lit(name).alias("check_name"), "findings") for name, found in checks.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def condensed_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).where(F.col("layer").isin(*G.LAYERS))
    order = F.array_position(F.array(*(F.lit(x) for x in G.LAYERS)), F.col("layer")).cast("int")
    return H.condensed_map(pages.select("vault", order.alias("section_ord"), F.col("layer").alias("section"), "slug").distinct())


_LAYERS = "['concepts', 'entites', 'syntheses', 'enseignements', 'sources']"
PAGES = r"""
pages AS (
  SELECT doc_id, string_split(directory, '/')[1] AS vault, string_split(directory, '/')[-1] AS layer,
         regexp_replace(string_split(relative_path, '/')[-1], '\.md$', '') AS slug, directory, relative_path, text FROM documents
)"""
LINKS = (
    PAGES
    + r""", found AS (
  SELECT doc_id, vault, layer, slug, unnest(regexp_extract_all(regexp_replace(coalesce(text, ''), '(?ms)^[ \t]*```.*?(?:^[ \t]*```[^\n]*|\z)', '', 'g'), '\[\[(.*?)\]\]', 1)) AS raw FROM pages
), links AS (
  SELECT *, trim(regexp_extract(raw, '^([^|#]*)', 1)) AS target, regexp_matches(raw, '["{\[,]') AS impossible FROM found
), parsed AS (
  SELECT *, string_split(target, '/')[-1] AS name, CASE WHEN contains(target, '/') THEN string_split(target, '/')[-2] END AS folder FROM links
), names AS (SELECT vault, slug, list_sort(list_distinct(list(layer))) AS layers FROM pages GROUP BY vault, slug)"""
)
FRONT = (
    S.LINES
    + ","
    + PAGES
    + """, props AS (
  SELECT p.doc_id, p.vault, p.layer, p.slug, """
    + ", ".join(f"max(CASE WHEN starts_with(f.line, '{n}:') THEN nullif({S.strip(f"regexp_extract(f.line, '^{n}:[ \\t]*(.*)$', 1)")}, '') END) AS {n}" for n in ("type", "date", "auteur", "description", "origine", "question", "aliases"))
    + """ FROM pages p LEFT JOIN front f ON p.doc_id = f.doc_id GROUP BY ALL
), defects AS (
  SELECT doc_id, layer, date, concat_ws(',', CASE WHEN type IS NULL THEN 'type' END, CASE WHEN date IS NULL THEN 'date' END, CASE WHEN auteur IS NULL THEN 'auteur' END, CASE WHEN description IS NULL THEN 'description' END,
           CASE WHEN origine IS NULL AND layer = 'sources' THEN 'origine' END, CASE WHEN question IS NULL AND layer = 'syntheses' THEN 'question' END) AS missing,
         coalesce(regexp_replace(type, 's$', '') <> regexp_replace(layer, 's$', ''), false) AS wrong_type,
         coalesce(layer IN ('enseignements', 'sources') AND regexp_extract(slug, '^([0-9]{4}-[0-9]{2}-[0-9]{2})-', 1) <> '' AND date <> regexp_extract(slug, '^([0-9]{4}-[0-9]{2}-[0-9]{2})-', 1), false) AS wrong_date
  FROM props
)"""
)
_DANGLING = """dangling AS (
  SELECT l.doc_id, l.vault, l.target FROM parsed l LEFT JOIN names n ON l.vault = n.vault AND l.name = n.slug
  WHERE NOT l.impossible AND l.target <> '' AND (n.layers IS NULL OR l.folder IS NOT NULL AND NOT list_contains(n.layers, l.folder)))"""
_AMBIGUOUS = """ambiguous AS (
  SELECT l.doc_id, l.vault, l.name, array_to_string(n.layers, ',') AS layers FROM parsed l JOIN names n ON l.vault = n.vault AND l.name = n.slug
  WHERE NOT l.impossible AND l.folder IS NULL AND len(n.layers) > 1)"""
_ORPHANS = """orphans AS (
  SELECT p.doc_id, p.vault, p.layer, p.slug FROM pages p WHERE p.layer IN ('concepts', 'entites') AND NOT EXISTS (
    SELECT 1 FROM parsed l WHERE NOT l.impossible AND l.vault = p.vault AND l.name = p.slug AND (l.folder IS NULL OR l.folder = p.layer) AND NOT (l.slug = p.slug AND l.layer = p.layer)))"""
_UNPAIRED = """pair AS (
  SELECT vault, slug, bool_or(layer = 'sources') AS in_sources, bool_or(layer = 'enseignements') AS in_lessons FROM pages WHERE layer IN ('sources', 'enseignements') GROUP BY vault, slug),
unpaired AS (SELECT * FROM pair WHERE in_sources <> in_lessons)"""
_CALLOUTS = f"""kinds AS (
  SELECT p.doc_id, p.layer, lower({S.strip(f"regexp_extract(l.line, '^>[{S.WS}]*\\[!([^\\]]+)\\][-+]?', 1)")}) AS kind FROM ls l JOIN pages p ON l.doc_id = p.doc_id WHERE regexp_matches(l.line, '^>[{S.WS}]*\\[![^\\]]+\\]')
), callouts AS (
  SELECT doc_id, layer, kind, count(*) AS n, kind = 'question' AND layer IN ('enseignements', 'sources') OR kind = 'warning' AND layer = 'sources' AS misplaced FROM kinds GROUP BY doc_id, layer, kind)"""
_SECRETS = f"""secrets AS (
  SELECT doc_id, regexp_matches(relative_path, '{G.SECRET_PATH}') AS by_path, CAST(len(regexp_extract_all(coalesce(text, ''), '{secrets.FOUND}')) AS INTEGER) AS in_text FROM pages)"""

QUERIES = {
    f.__name__: f
    for f in (
        wikilinks, dangling_links, ambiguous_links, false_links, orphan_pages, one_way_links, unpaired_layers, front_matter_defects, common_day_defects, callout_census,
        duplicate_names, secret_scan, conflict_files, empty_notes, index_gaps, index_entries, layer_counts, lint_counters, condensed_map,
    )
}

ORACLE = {
    "wikilinks": f"WITH {LINKS} SELECT doc_id, raw, target, folder, name, impossible FROM parsed",
    "dangling_links": f"WITH {LINKS}, {_DANGLING} SELECT * FROM dangling",
    "ambiguous_links": planted.over(f"WITH {LINKS}, {_AMBIGUOUS} SELECT * FROM ambiguous"),
    "false_links": planted.over(f"WITH {LINKS} SELECT doc_id, raw FROM parsed WHERE impossible"),
    "orphan_pages": f"WITH {LINKS}, {_ORPHANS} SELECT * FROM orphans",
    "one_way_links": planted.over(f"""WITH {LINKS}, edges AS (SELECT DISTINCT vault, slug, name FROM parsed WHERE NOT impossible AND slug <> name)
SELECT e.vault, e.slug, e.name FROM edges e WHERE EXISTS (SELECT 1 FROM pages p WHERE p.vault = e.vault AND p.slug = e.name)
  AND NOT EXISTS (SELECT 1 FROM edges b WHERE b.vault = e.vault AND b.slug = e.name AND b.name = e.slug)"""),
    "unpaired_layers": f"WITH {PAGES}, {_UNPAIRED} SELECT * FROM unpaired",
    "front_matter_defects": f"WITH {FRONT} SELECT doc_id, layer, missing, wrong_type, wrong_date, date FROM defects WHERE missing <> '' OR wrong_type OR wrong_date",
    "common_day_defects": f"WITH {FRONT} SELECT date, count(*) AS notes FROM defects WHERE wrong_date GROUP BY date",
    "callout_census": f"WITH {S.LINES}, {PAGES}, {_CALLOUTS} SELECT * FROM callouts",
    "duplicate_names": planted.over(f"""WITH {FRONT}, living AS (SELECT vault, layer || '/' || slug AS page, slug AS name FROM props WHERE layer IN ('concepts', 'entites')
  UNION ALL SELECT vault, layer || '/' || slug, unnest(string_split(regexp_replace(aliases, '[\\[\\]"'']', '', 'g'), ',')) FROM props WHERE layer IN ('concepts', 'entites') AND aliases IS NOT NULL),
named AS (SELECT DISTINCT vault, page, regexp_replace(regexp_replace(strip_accents(lower(trim(name))), '[-_ ]+', ' ', 'g'), 's$', '') AS normal FROM living)
SELECT DISTINCT a.vault, a.page, b.page AS other FROM named a JOIN named b ON a.vault = b.vault AND a.normal = b.normal AND a.page < b.page AND a.normal <> ''"""),
    "secret_scan": planted.over(f"WITH {PAGES}, {_SECRETS} SELECT * FROM secrets WHERE by_path OR in_text > 0"),
    "conflict_files": f"WITH {planted.SQL} SELECT doc_id, relative_path FROM planted WHERE regexp_matches(relative_path, '{G.CONFLICT}')",
    "empty_notes": f"WITH {PAGES} SELECT doc_id, layer FROM pages WHERE coalesce({S.strip('text')}, '') = ''",
    "index_gaps": """WITH a AS (SELECT DISTINCT directory, relative_path FROM documents), b AS (SELECT DISTINCT directory, relative_path FROM markdown_chunks)
SELECT directory, relative_path, 'hole' AS gap FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT directory, relative_path, 'dead' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "index_entries": f"WITH {FRONT} SELECT doc_id, vault, CAST(list_position({_LAYERS}, layer) AS INTEGER) AS layer_ord, '- [[' || slug || ']] — ' || coalesce(description, '') AS entry FROM props WHERE list_contains({_LAYERS}, layer)",
    "condensed_map": f"""WITH RECURSIVE {PAGES}, named AS (SELECT DISTINCT vault, list_position({_LAYERS}, layer) AS section_ord, layer AS section, slug FROM pages WHERE list_contains({_LAYERS}, layer)),
numbered AS (SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY vault, section_ord) AS total, sum(length(slug) + 2) OVER (PARTITION BY vault, section_ord ORDER BY slug) AS upto FROM named WINDOW w AS (PARTITION BY vault, section_ord ORDER BY slug)),
sections AS (SELECT vault, section_ord, section, total, list(slug ORDER BY nth) AS slugs, list(upto ORDER BY nth) AS sizes FROM numbered WHERE nth <= {H.MAP_BUDGET // 3} GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY vault ORDER BY section_ord) AS k, count(*) OVER (PARTITION BY vault) AS n FROM sections),
start AS (SELECT vault, CAST({H.MAP_BUDGET} - sum(length(section) + 4) AS BIGINT) AS room FROM ordered GROUP BY vault),
walk AS (
  SELECT vault, CAST(0 AS BIGINT) AS k, room, '' AS line FROM start
  UNION ALL SELECT vault, k, room - CASE WHEN shown > 0 THEN CAST(sizes[shown] AS BIGINT) ELSE 0 END,
    '## ' || section || chr(10) || array_to_string(list_concat(slugs[1:shown], CASE WHEN total > shown THEN ['(+' || (total - shown) || ' autres)'] ELSE [] END), ', ')
  FROM (SELECT w.vault, o.k, w.room, o.section, o.total, o.slugs, o.sizes, len([x for x in o.sizes if x <= greatest(0, w.room // (o.n - o.k + 1))]) AS shown FROM walk w JOIN ordered o ON w.vault = o.vault AND o.k = w.k + 1)
)
SELECT vault, string_agg(line, chr(10) ORDER BY k) AS map FROM walk WHERE k > 0 GROUP BY vault""",
    "layer_counts": f"WITH {PAGES} SELECT vault, layer, count(*) AS notes FROM pages GROUP BY vault, layer",
    "lint_counters": f"""WITH {FRONT}, {LINKS[len(PAGES) :].lstrip(", ")}, {_DANGLING}, {_AMBIGUOUS}, {_ORPHANS}, {_UNPAIRED}, {_CALLOUTS}, {_SECRETS}
SELECT 'orphans' AS check_name, count(*) AS findings FROM orphans UNION ALL SELECT 'dangling', count(*) FROM dangling UNION ALL SELECT 'ambiguous', count(*) FROM ambiguous
UNION ALL SELECT 'false', count(*) FROM parsed WHERE impossible UNION ALL SELECT 'unpaired', count(*) FROM unpaired
UNION ALL SELECT 'front_matter', count(*) FROM defects WHERE missing <> '' OR wrong_type OR wrong_date
UNION ALL SELECT 'misplaced', count(*) FROM callouts WHERE misplaced UNION ALL SELECT 'secrets', count(*) FROM secrets WHERE by_path OR in_text > 0""",
}

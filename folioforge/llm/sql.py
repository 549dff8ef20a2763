"""DuckDB forms of the queries that SQL can express."""

from ..plans import sqltext

WORDS = "regexp_extract_all(strip_accents(lower(coalesce({text}, ''))), '[a-z0-9]+')"
BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def _words(text: str) -> str:
    return WORDS.format(text=text)


def _grams(size: int) -> str:
    return f"[array_to_string(w[i : i + {size - 1}], ' ') for i in range(1, len(w) - {size - 2})]"


P1 = rf"""
WITH d AS (
  SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d
), f AS (
  SELECT doc_id, max(CASE WHEN i = 1 THEN trim(line, {BLANKS}) = '---' END) AS opened,
         min(CASE WHEN i > 1 AND trim(line, {BLANKS}) = '---' THEN i END) AS closed
  FROM l GROUP BY doc_id
), b AS (
  SELECT l.doc_id, l.line, l.i, regexp_matches(l.line, '^[ \t]*#+( |$)') AS heading
  FROM l JOIN f ON l.doc_id = f.doc_id
  WHERE NOT (coalesce(f.opened, false) AND f.closed IS NOT NULL AND l.i <= f.closed)
), s AS (
  SELECT doc_id, line, i, heading, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section_ord FROM b
), t AS (
  SELECT doc_id, section_ord, trim(string_agg(line, chr(10) ORDER BY i), {BLANKS}) AS body FROM s WHERE NOT heading GROUP BY doc_id, section_ord
)
SELECT 'documents' AS item_table, doc_id AS item_id, CAST(section_ord AS INTEGER) AS section_ord FROM t WHERE length(body) > 2000
UNION ALL
SELECT 'markdown_chunks', chunk_id, CAST(0 AS INTEGER) FROM markdown_chunks WHERE length(trim(content, {BLANKS})) > 2000
"""

_SECTIONS = P1[: P1.index("SELECT 'documents' AS item_table")].rstrip()
PIECES = f"""{_SECTIONS}, titles AS (
  SELECT doc_id, section_ord, trim(regexp_replace(any_value(line), '^[ \\t]*#+', ''), {BLANKS}) AS title FROM s WHERE heading GROUP BY doc_id, section_ord
), parts AS (
  SELECT 'documents' AS item_table, t.doc_id AS item_id, CAST(t.section_ord AS INTEGER) AS section_ord, h.title AS section, t.body AS content FROM t LEFT JOIN titles h ON t.doc_id = h.doc_id AND t.section_ord = h.section_ord
  UNION ALL SELECT 'markdown_chunks', chunk_id, CAST(0 AS INTEGER), section, trim(content, {BLANKS}) FROM markdown_chunks WHERE content IS NOT NULL
), whole AS (SELECT item_table || '/' || item_id || '/' || section_ord AS id, * FROM parts WHERE content <> ''), {sqltext.ladder("whole")},
ranked AS (SELECT *, lag(piece) OVER (PARTITION BY id ORDER BY piece_ord) AS before FROM pieces)
SELECT w.item_table, w.item_id, w.section_ord, w.section, CAST(length(w.content) AS INTEGER) AS section_chars, r.piece_ord, r.piece, CAST({sqltext.shared_words("before", "piece")} AS INTEGER) AS overlap_chars
FROM ranked r JOIN whole w ON r.id = w.id
"""

#: A page's frame that p2_removed plants.
FRAME = '<nav class="menu"><p>Accueil</p> Plan du site</nav>'
REMOVED = """
SELECT coalesce(directory, '') AS host, unnest(['nav', 'nav>p']) AS path, unnest(['class=menu', '']) AS look, count(*) AS pages
FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1 HAVING count(*) >= 12
"""

P4 = """
WITH v AS (
  SELECT stored_id AS id, CAST(vector AS DOUBLE[]) AS x FROM index_chunks
  WHERE len(vector) = 64 AND len([e for e in vector if e IS NULL OR isnan(e) OR isinf(e)]) = 0 AND len([e for e in vector if e <> 0]) > 0
), p AS (
  SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.x, b.x) AS c FROM v a JOIN v b ON a.id <> b.id
), r AS (
  SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS rank FROM p
)
SELECT DISTINCT least(a, b) AS stored_id_a, greatest(a, b) AS stored_id_b FROM r WHERE rank <= 10 AND c >= 0.92
"""

P5 = f"""
WITH w AS (SELECT doc_id, unnest({_words("text")}) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term),
d AS (SELECT term, count(*) AS df FROM c GROUP BY term)
SELECT c.doc_id, c.term FROM c JOIN d ON c.term = d.term
WHERE c.tf >= 4 AND d.df BETWEEN 2 AND 8 AND length(c.term) >= 5 AND NOT regexp_matches(c.term, '[0-9]')
"""

P6 = f"""
WITH items AS (
  SELECT 'markdown_chunks' AS item_table, chunk_id AS id, {_words("content")} AS w FROM markdown_chunks
  UNION ALL SELECT 'index_chunks', stored_id, {_words("excerpt")} FROM index_chunks
), s AS (
  SELECT item_table, id, list_distinct({_grams(3)}) AS g FROM items WHERE len(w) >= 20
), e AS (SELECT item_table, id, len(g) AS n, unnest(g) AS x FROM s),
o AS (
  SELECT a.item_table, a.id AS id_a, b.id AS id_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM e a JOIN e b ON a.item_table = b.item_table AND a.x = b.x AND a.id < b.id GROUP BY a.item_table, a.id, b.id
)
SELECT item_table, id_a, id_b FROM o WHERE 5 * shared >= 3 * (na + nb - shared)
"""

P6_CLASSES = P6.split("SELECT item_table, id_a")[0].rstrip() + """, k AS (SELECT item_table, id, array_to_string(list_sort(g), '|') AS k FROM s),
c AS (SELECT item_table, k, count(*) AS n FROM k GROUP BY ALL),
l AS (SELECT DISTINCT o.item_table, x.k AS a, y.k AS b FROM o JOIN k x ON x.item_table = o.item_table AND x.id = o.id_a JOIN k y ON y.item_table = o.item_table AND y.id = o.id_b
      WHERE 5 * shared >= 3 * (na + nb - shared) AND x.k <> y.k),
m AS (SELECT item_table, k, count(DISTINCT z) AS links FROM (SELECT item_table, a AS k, b AS z FROM l UNION ALL SELECT item_table, b, a FROM l) GROUP BY ALL)
SELECT k.item_table, k.id AS item_id, c.n - 1 AS copies, coalesce(m.links, 0) AS links
FROM k JOIN c ON c.item_table = k.item_table AND c.k = k.k LEFT JOIN m ON m.item_table = k.item_table AND m.k = k.k
"""

P9 = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
i AS (SELECT item_id, {_words("text")} AS w FROM bench_items),
dg AS (SELECT doc_id, unnest({_grams(13)}) AS g FROM d WHERE len(w) >= 13),
ig AS (SELECT item_id, unnest({_grams(13)}) AS g FROM i WHERE len(w) >= 13)
SELECT DISTINCT dg.doc_id, ig.item_id FROM dg JOIN ig ON dg.g = ig.g
"""

PASSAGES = f"""
WITH d AS (SELECT DISTINCT doc_id AS id, {_words("text")} AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT DISTINCT item_id AS id, {_words("text")} AS w FROM bench_items WHERE item_id IS NOT NULL),
dg AS (SELECT id, unnest({_grams(13)}) AS g, unnest(range(0, len(w) - 12)) AS p FROM d WHERE len(w) >= 13),
ig AS (SELECT id, unnest({_grams(13)}) AS g, unnest(range(0, len(w) - 12)) AS q FROM i WHERE len(w) >= 13),
m AS (SELECT dg.id AS doc_id, ig.id AS item_id, p, q FROM dg JOIN ig ON dg.g = ig.g),
r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS run FROM m)
SELECT doc_id, item_id, CAST(min(p) AS INTEGER) AS doc_start, CAST(min(q) AS INTEGER) AS item_start, CAST(count(*) + 12 AS INTEGER) AS n_words FROM r GROUP BY doc_id, item_id, p - q, run
"""

SHARES = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
g AS (SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, CASE WHEN len(w) >= 5 THEN {_grams(5)} ELSE [] END AS g FROM d)
SELECT doc_id, n_words, CAST(len(g) AS INTEGER) AS n_runs, CAST(len(list_distinct(g)) AS INTEGER) AS n_distinct,
       CASE WHEN len(g) > 0 THEN round(1 - CAST(len(list_distinct(g)) AS DOUBLE) / len(g), 9) ELSE 0.0 END AS repeated_share
FROM g
"""

P10 = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
g AS (SELECT doc_id, {_grams(5)} AS g FROM d WHERE len(w) >= 40)
SELECT doc_id FROM g WHERE 1 - CAST(len(list_distinct(g)) AS DOUBLE) / len(g) >= 0.30
"""

ORACLE = {"p1_found": P1, "p2_removed": REMOVED, "p1_pieces": PIECES, "p9_passages": PASSAGES, "p4_found": P4, "p5_found": P5, "p6_found": P6, "p6_classes": P6_CLASSES, "p9_found": P9, "p10_found": P10, "p10_rule": P10, "p10_shares": SHARES}

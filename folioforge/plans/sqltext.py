"""Pieces of DuckDB SQL that several oracle queries share."""

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NEWLINE = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({x})), '[\\p{{L}}\\p{{N}}]+')"


#: ls: every line of every note (doc_id, i from 1, line), the empty one behind a final line end aside.
LINES = f"""
raw_lines AS (
  SELECT doc_id, directory, relative_path, regexp_split_to_array(text, '{NEWLINE}') AS parts FROM documents WHERE text IS NOT NULL
), cut_lines AS (
  SELECT doc_id, directory, relative_path, CASE WHEN parts[-1] = '' THEN parts[1 : len(parts) - 1] ELSE parts END AS parts FROM raw_lines
), ls AS (
  SELECT doc_id, directory, relative_path, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM cut_lines
), fences AS (
  SELECT doc_id, bool_or(i = 1 AND {strip("line")} = '---') AS opened, min(CASE WHEN i > 1 AND {strip("line")} = '---' THEN i END) AS closed FROM ls GROUP BY doc_id
), body AS (
  SELECT ls.* FROM ls JOIN fences f ON ls.doc_id = f.doc_id WHERE NOT (f.opened AND f.closed IS NOT NULL AND ls.i <= f.closed)
), front AS (
  SELECT ls.* FROM ls JOIN fences f ON ls.doc_id = f.doc_id WHERE f.opened AND f.closed IS NOT NULL AND ls.i > 1 AND ls.i < f.closed
)"""

SECTIONS = (
    LINES
    + f""", titled AS (
  SELECT *, CASE WHEN regexp_matches(regexp_replace(line, '^[{WS}]+', ''), '^#+( |$)')
                 THEN {strip(f"regexp_replace(regexp_replace(line, '^[{WS}]+', ''), '^#+', '')")} END AS title
  FROM body
), numbered AS (
  SELECT *, count(title) OVER w AS section_ord, last_value(title IGNORE NULLS) OVER w AS section
  FROM titled WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), sections AS (
  SELECT doc_id, CAST(section_ord AS INTEGER) AS section_ord,
         CASE WHEN section_ord = 0 THEN '(préambule)' ELSE coalesce(nullif(any_value(section), ''), '(titre vide)') END AS section,
         {strip("string_agg(line, chr(10) ORDER BY i)")} AS content
  FROM numbered WHERE title IS NULL GROUP BY doc_id, section_ord
)"""
)


def _packed(atoms: str, separator: str, limit: int) -> str:
    """Neighbours of a list joined while they stay within the limit, the room of a separator behind each included."""
    return f"""list_reduce([[a] for a in {atoms}], lambda acc, x: CASE WHEN length(acc[-1]) + length(x[1]) + 2 * length({separator}) <= {limit}
      THEN list_concat(acc[1 : len(acc) - 1], [acc[-1] || {separator} || x[1]]) ELSE list_concat(acc, x) END)"""


def _tail(before: str, overlap: int) -> str:
    """The whole words at the end of a piece."""
    return f"CASE WHEN strpos(right({before}, {overlap}), ' ') > 0 THEN substring(right({before}, {overlap}), strpos(right({before}, {overlap}), ' ') + 1) ELSE '' END"


def ladder(source: str, limit: int = 2000, overlap: int = 200) -> str:
    """CTEs that end in pieces(id, piece_ord from 0, piece), from the rows (id, content) of a CTE: paragraphs, lines, words with overlap."""
    fine = limit - overlap
    words = f"flatten([[substring(w, 1 + {fine} * j, {fine}) for j in range(0, greatest(1, CAST(ceil(length(w) / {fine}.0) AS BIGINT)))] for w in string_split(line, ' ')])"
    return f"""rung_paragraphs AS (
  SELECT id, unnest(string_split(content, chr(10) || chr(10))) AS part, generate_subscripts(string_split(content, chr(10) || chr(10)), 1) AS p FROM {source} WHERE length(content) > {limit}
), rung_lines AS (
  SELECT id, p, unnest(string_split(part, chr(10))) AS line, generate_subscripts(string_split(part, chr(10)), 1) AS l FROM rung_paragraphs WHERE length(part) > {limit}
), rung_words AS (
  SELECT id, p, l, {_packed(words, "' '", fine)} AS ws FROM rung_lines WHERE length(line) > {limit}
), led AS (
  SELECT id, p, l, list_concat(ws[1:1], [{_tail('ws[j - 1]', overlap)} || CASE WHEN {_tail('ws[j - 1]', overlap)} <> '' THEN ' ' ELSE '' END || ws[j] for j in range(2, len(ws) + 1)]) AS ws FROM rung_words
), line_atoms AS (
  SELECT n.id, n.p, flatten(list(CASE WHEN length(n.line) <= {limit} THEN [n.line] ELSE w.ws END ORDER BY n.l)) AS atoms FROM rung_lines n LEFT JOIN led w ON n.id = w.id AND n.p = w.p AND n.l = w.l GROUP BY n.id, n.p
), paragraph_atoms AS (
  SELECT g.id, flatten(list(CASE WHEN length(g.part) <= {limit} THEN [g.part] ELSE {_packed('a.atoms', 'chr(10)', limit)} END ORDER BY g.p)) AS atoms FROM rung_paragraphs g LEFT JOIN line_atoms a ON g.id = a.id AND g.p = a.p GROUP BY g.id
), cut_pieces AS (
  SELECT id, {_packed('atoms', 'chr(10) || chr(10)', limit)} AS ps FROM paragraph_atoms UNION ALL SELECT id, [content] FROM {source} WHERE length(content) <= {limit}
), pieces AS (SELECT id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS piece_ord, unnest(ps) AS piece FROM cut_pieces)"""


def shared_words(before: str, piece: str, overlap: int = 200) -> str:
    """How many characters a piece repeats of the end of the one before it."""
    tail = _tail(before, overlap)
    return f"CASE WHEN {before} IS NOT NULL AND {tail} <> '' AND starts_with({piece}, {tail} || ' ') THEN length({tail}) + 1 ELSE 0 END"


def without_callouts(source: str) -> str:
    """CTEs that end in stripped(id, kept), from the rows (id, content, types) of a CTE."""
    return f"""callout_lines AS (
  SELECT id, types, unnest(regexp_split_to_array(content, '{NEWLINE}')) AS line, generate_subscripts(regexp_split_to_array(content, '{NEWLINE}'), 1) AS i, len(regexp_split_to_array(content, '{NEWLINE}')) AS n FROM {source}
), callout_kinds AS (
  SELECT *, lower({strip(f"regexp_extract(line, '^>[{WS}]*\\[!([^\\]]+)\\][-+]?', 1)")}) AS kind, regexp_matches(line, '^>[{WS}]*\\[![^\\]]+\\]') AS opening FROM callout_lines WHERE NOT (i = n AND line = '')
), callout_blocks AS (
  SELECT *, sum(CASE WHEN opening OR NOT starts_with(line, '>') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS block FROM callout_kinds
), callout_heads AS (
  SELECT *, first_value(opening) OVER w AS block_opening, first_value(kind) OVER w AS block_kind FROM callout_blocks WINDOW w AS (PARTITION BY id, block ORDER BY i)
), callout_kept AS (
  SELECT id, string_agg(line, chr(10) ORDER BY i) AS kept FROM callout_heads WHERE NOT (block_opening AND list_contains(types, block_kind)) GROUP BY id
), stripped AS (
  SELECT s.id, CASE WHEN len(s.types) = 0 THEN s.content ELSE {strip("coalesce(r.kept, '')")} END AS kept FROM {source} s LEFT JOIN callout_kept r ON s.id = r.id
)"""

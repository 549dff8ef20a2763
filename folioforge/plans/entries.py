"""Dated entries and quotations of the notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import citations as C
from ..functions import text as T
from ..functions.secrets import MASK
from ..operators import entries as E
from ..sources import transcripts as X
from ..sources.corpus import numbered
from ..sources.staging import written
from ..sources.tables import table
from . import sqltext as S

NUMBERED = "(?:n°|no\\.) ?[0-9]+"


def entry_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.anchors(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "line_no", "anchor", "whole")


def entry_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.anchors(table(spark, sf_dir, "documents"), "doc_id", "text")
    return E.order_breaks(found).withColumnRenamed("key", "doc_id")


def _series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each user's events as a source, and a copy of them that lost its largest values and runs in another time zone."""
    events = table(spark, sf_dir, "events", "user_id", "ts", "value").select(F.col("user_id").alias("key"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("anchor"), "value")
    note = events.where("value < 80").withColumn("anchor", F.expr("anchor + make_interval(0, 0, 0, 0, cast(key % 5 as int) - 2, 0, 0)"))
    return events.select("key", "anchor"), note.select("key", "anchor")


def best_hour_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_offset(*_series(spark, sf_dir)).withColumnRenamed("key", "user_id")


def entries_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each copy lacks of its source, the best shift taken off."""
    source, note = _series(spark, sf_dir)
    shift = E.best_offset(source, note).select("key", "hours")
    moved = source.join(shift, "key").select("key", F.expr("anchor + make_interval(0, 0, 0, 0, hours, 0, 0)").alias("anchor"))
    return E.difference(moved, note, "key", "anchor").withColumnRenamed("key", "user_id")


def anchors_multiset_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, note = _series(spark, sf_dir)
    return source.exceptAll(note).select(F.col("key").alias("user_id"), "anchor")


def anchors_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, note = _series(spark, sf_dir)
    return source.intersectAll(note).select(F.col("key").alias("user_id"), "anchor")


def custom_anchor_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a note and the sections kept of it do not share, by note."""
    left = E.pattern_anchors(table(spark, sf_dir, "documents"), "text", NUMBERED, "directory", "relative_path")
    right = E.pattern_anchors(table(spark, sf_dir, "markdown_chunks"), "content", NUMBERED, "directory", "relative_path")
    return E.difference(left, right, "directory", "relative_path", "anchor")


def canonical_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.entry_lines(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of a vault on one line of time, numbered; ranges of it are sorted apart."""
    docs = table(spark, sf_dir, "documents")
    said = E.entry_lines(docs, "doc_id", "text").where("moment is not null")
    homes = docs.select(F.col("doc_id").alias("key"), F.split("directory", "/")[0].alias("vault"))
    placed = written(numbered(said.join(homes, "key").select("vault", "moment", "key", "line_no", "author"), "vault", "moment", "key", "line_no"), "timeline")
    first = placed.groupBy("vault").agg(F.min("nth").alias("first"))
    return placed.join(first, "vault").select("vault", (F.col("nth") - F.col("first") + 1).cast("int").alias("nth"), "moment", F.col("key").alias("doc_id"), "line_no", "author")


def session_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each note's entries as a conversation in JSON lines, credentials planted in some, and the note that the inbox gets of it."""
    said = E.entry_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    content = F.concat("said", F.when(F.col("line_no") % 3 == 0, " API_TOKEN=abc").otherwise(""))
    line = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.col("author").alias("role"), content.alias("content")).alias("message")))
    noise = F.explode(F.array(F.lit("{"), F.to_json(F.struct(F.lit("tool").alias("type"))), line))
    lines = said.select(F.col("key").alias("session"), "line_no", noise.alias("value"))
    spoken = X.turns(lines, "session")
    notes = X.session_notes(spoken).withColumn("day", F.lit("2024-01-02").cast("date")).withColumn("session", F.col("session").cast("string"))
    return X.inbox_notes(notes, "inbox/").select(F.regexp_extract("path", r"-(\d+)\.md$", 1).alias("session"), F.md5("text").alias("note_md5"))


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = C.citations(docs, "doc_id", "text")
    vaults = docs.select(F.col("doc_id").alias("key"), F.split("directory", "/")[0].alias("vault"))
    return found.join(vaults, "key")


def citation_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.citations(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "line", "form", F.md5("quote").alias("quote_md5"), "author", "path", "locator", "original", "original_locator")


def citation_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each quotation stands in the note it points to, at the line it says."""
    cited = _cited(spark, sf_dir).withColumn("target", F.concat_ws("/", "vault", "path"))
    pieces = table(spark, sf_dir, "documents").select(F.concat_ws("/", "directory", "relative_path").alias("target"), "text")
    done = C.located(cited, pieces, "target")
    return done.select(F.col("key").alias("doc_id"), "line", "target", "status", "start")


def citation_self_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each quotation starts in the very note that gives it; the pointer's line is hardly ever that."""
    docs = table(spark, sf_dir, "documents")
    done = C.located(C.citations(docs, "doc_id", "text"), docs.select(F.col("doc_id").alias("key"), "text"), "key")
    return done.select(F.col("key").alias("doc_id"), "line", "status", "start")


_SERIES = """
source AS (SELECT user_id AS key, date_trunc('minute', ts) AS anchor FROM events),
note AS (SELECT user_id AS key, date_trunc('minute', ts) + to_hours(CAST(user_id % 5 AS INTEGER) - 2) AS anchor FROM events WHERE value < 80),
sc AS (SELECT key, anchor, count(*) AS n FROM source GROUP BY ALL), nc AS (SELECT key, anchor, count(*) AS n FROM note GROUP BY ALL),
offsets AS (SELECT unnest(range(-12, 15)) AS h),
met AS (SELECT sc.key, h, sum(least(sc.n, nc.n)) AS common FROM sc CROSS JOIN offsets JOIN nc ON nc.key = sc.key AND nc.anchor = sc.anchor + to_hours(h) GROUP BY sc.key, h),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY common DESC, h) AS r FROM met),
best AS (SELECT k.key, CAST(coalesce(m.h, -12) AS INTEGER) AS hours, CAST(coalesce(m.common, 0) AS BIGINT) AS common FROM (SELECT DISTINCT key FROM source) k LEFT JOIN ranked m ON k.key = m.key AND m.r = 1)
"""


def _ts(y: str, mo: str, d: str, h: str, mi: str) -> str:
    return f"try_strptime(CASE WHEN length({y}) <= 2 THEN '20' || lpad({y}, 2, '0') ELSE lpad({y}, 4, '0') END || '-' || lpad({mo}, 2, '0') || '-' || lpad({d}, 2, '0') || ' ' || lpad({h}, 2, '0') || ':' || lpad({mi}, 2, '0'), '%Y-%m-%d %H:%M')"


def _g(pattern: str, n: int) -> str:
    return f"regexp_extract(b, '{pattern}', {n})"


_ISO, _NUM, _HOUR = E.ISO, E.NUMERIC, r"^(\d{1,2})[:h](\d{2})($|\D)"
_IDAY, _NDAY = r"^(\d{4})-(\d{1,2})-(\d{1,2})($|[^\d:T-])", r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})($|[^\d:/.-])"


def _either(pattern: str, hour: str, minute: str) -> str:
    return f"CASE WHEN month_first THEN {_ts(_g(pattern, 3), _g(pattern, 1), _g(pattern, 2), hour, minute)} ELSE {_ts(_g(pattern, 3), _g(pattern, 2), _g(pattern, 1), hour, minute)} END"


def _is(p: str) -> str:
    return f"regexp_matches(b, '{p}')"


_ANCHORS = f"""{S.LINES}, led AS (
  SELECT doc_id, i - 1 AS line_no, line, regexp_replace(line, '{E.LEAD}', '') AS b FROM ls
), opened AS (SELECT doc_id, line_no, b, contains(substring(line, 1, length(line) - length(b)), '#') AS heading FROM led WHERE regexp_matches(b, '^\\d')),
kinds AS (
  SELECT *, {_is(_ISO)} OR {_is(_NUM)} AS is_full, NOT ({_is(_ISO)} OR {_is(_NUM)}) AND ({_is(_IDAY)} OR {_is(_NDAY)}) AS is_day,
    CASE WHEN {_is(_NUM)} THEN CAST({_g(_NUM, 1)} AS INTEGER) WHEN {_is(_NDAY)} THEN CAST({_g(_NDAY, 1)} AS INTEGER) END AS p1,
    CASE WHEN {_is(_NUM)} THEN CAST({_g(_NUM, 2)} AS INTEGER) WHEN {_is(_NDAY)} THEN CAST({_g(_NDAY, 2)} AS INTEGER) END AS p2 FROM opened
), seen AS (SELECT *, coalesce(max(p1) OVER (PARTITION BY doc_id) <= 12 AND max(p2) OVER (PARTITION BY doc_id) > 12, false) AS month_first FROM kinds),
dated AS (
  SELECT *, CASE WHEN {_is(_ISO)} THEN {_ts(*(_g(_ISO, i) for i in range(1, 6)))} WHEN {_is(_NUM)} THEN {_either(_NUM, _g(_NUM, 4), _g(_NUM, 5))} END AS full_at,
    CASE WHEN is_day THEN CASE WHEN {_is(_IDAY)} THEN {_ts(*(_g(_IDAY, i) for i in range(1, 4)), "'00'", "'00'")} ELSE {_either(_NDAY, "'00'", "'00'")} END END AS day_at FROM seen
), more AS (
  SELECT *, CASE WHEN is_day AND NOT heading AND trim(substring(b, 1 + length(CASE WHEN {_is(_IDAY)} THEN regexp_extract(b, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') ELSE regexp_extract(b, '^\\d{{1,2}}[/.-]\\d{{1,2}}[/.-]\\d{{2,4}}') END)), ' ' || chr(9) || '—–-:·|') <> '' THEN day_at END AS entry_day,
    last_value(CAST(coalesce(full_at, day_at) AS DATE) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM dated
), bares AS (
  SELECT *, coalesce(full_at, entry_day) AS whole_at,
    CASE WHEN NOT is_full AND NOT is_day AND {_is(_HOUR)} AND CAST({_g(_HOUR, 1)} AS INTEGER) < 24 AND CAST({_g(_HOUR, 2)} AS INTEGER) < 60 AND carried IS NOT NULL
      THEN CAST(carried AS TIMESTAMP) + to_hours(CAST({_g(_HOUR, 1)} AS INTEGER)) + to_minutes(CAST({_g(_HOUR, 2)} AS INTEGER)) END AS bare FROM more
), kept AS (SELECT *, count(whole_at) OVER (PARTITION BY doc_id) AS n_whole FROM bares),
anchors AS (SELECT doc_id, line_no, coalesce(whole_at, bare) AS anchor, whole_at IS NOT NULL AS whole FROM kept WHERE whole_at IS NOT NULL OR n_whole = 0 AND bare IS NOT NULL)"""

_ENTRY = E.ENTRY.replace("'", "''")
_ENTRIES = f"""{S.LINES}, entries AS (
  SELECT doc_id, directory, i - 1 AS line_no, try_strptime(regexp_extract(line, '{_ENTRY}', 1) || ' ' || regexp_extract(line, '{_ENTRY}', 2), '%Y-%m-%d %H:%M') AS moment,
         regexp_extract(line, '{_ENTRY}', 3) AS author, regexp_extract(line, '{_ENTRY}', 4) AS said FROM ls WHERE regexp_matches(line, '{_ENTRY}'))"""


_JSON_KEYS = [k for k in E.MOMENT_KEYS if k != "date"]


def json_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events of a day as an export, whose entries name their moment under one key or another; a note in between names none."""
    events = table(spark, sf_dir, "events", "user_id", "event_id", "ts")
    moment = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    held = F.create_map(F.element_at(F.array(*(F.lit(k.title()) for k in _JSON_KEYS)), (F.col("event_id") % len(_JSON_KEYS) + 1).cast("int")), moment)
    entry = F.to_json(F.map_concat(F.create_map(F.lit("date"), F.lit("n/a")), held))
    docs = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.concat(F.lit('{"edited_at": "2001-01-01 00:00", "rows": ['), F.array_join(F.collect_list(entry), ", "), F.lit('], "note": {"x": 1}}')).alias("text"))
    named = docs.select(F.concat_ws("|", "user_id", "day").alias("key"), F.lit("export.JSON").alias("path"), "text")
    part = F.split("key", r"\|")
    return E.anchors_of(named, "key", "path", "text").select(F.get(part, F.lit(0)).cast("bigint").alias("user_id"), F.get(part, F.lit(1)).alias("day"), "anchor")


def series_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as numbered captures of each user's series, some numbers and authors missing."""
    events = table(spark, sf_dir, "events", "user_id", "event_id", "ts", "value")
    author = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("a"), F.col("event_id").cast("string")))
    captures = events.where("event_id % 7 != 0").select("user_id", F.col("event_id").alias("number"), author.alias("author"), F.col("ts").alias("first"), (F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 2, 0, 0)")).alias("last"))
    return E.continuity(captures, "user_id")


_WORDS = "|".join(x.replace(".", "\\.") for x in (*C.LINE_WORDS, C.PAGE_WORD))
_CITED = f"""{S.LINES}, kept AS (
  SELECT doc_id, i, line, starts_with(line, '>') AS quoted, starts_with(line, '>') AND starts_with(trim(substring(line, 2)), '[!') AS callout FROM ls WHERE length({S.strip('line')}) > 0
), steps AS (
  SELECT *, CASE WHEN NOT quoted OR callout OR NOT coalesce(lag(quoted) OVER w AND i - lag(i) OVER w = 1, false) THEN 1 ELSE 0 END AS opens FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS block FROM steps
), placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY i) AS nth FROM numbered),
joined AS (
  SELECT doc_id, block, min(i) AS first_at, max(CASE WHEN nth = 1 THEN line END) AS head, bool_and(quoted) AS quoted, bool_or(callout) AS callout,
         string_agg({S.strip("substring(line, 2)")}, ' ' ORDER BY i) AS said, coalesce(string_agg(CASE WHEN nth > 1 THEN line END, chr(10) ORDER BY i), '') AS tail
  FROM placed GROUP BY doc_id, block
), seen AS (
  SELECT *, CASE WHEN lag(quoted) OVER w AND NOT lag(callout) OVER w THEN {S.strip("lag(said) OVER w")} ELSE '' END AS above,
    last_value(CASE WHEN NOT quoted THEN head END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS header
  FROM joined WINDOW w AS (PARTITION BY doc_id ORDER BY block)
), formed AS (
  SELECT *, CASE WHEN quoted AND lower({S.strip(f"regexp_extract(head, '^>[{S.WS}]*\\[!([^\\]]+)\\][-+]?', 1)")}) = 'source' THEN 'callout'
                 WHEN NOT quoted AND regexp_matches(head, '^[^>`]*`[^`]+`') AND above <> '' THEN 'plain' END AS form FROM seen
), cut AS (
  SELECT *, string_split(CASE WHEN form = 'callout' THEN tail ELSE head END, '`') AS p, {S.strip("header")} AS title, regexp_replace(above, '^[«»"'' ]+|[«»"'' ]+$', '', 'g') AS bare FROM formed WHERE form IS NOT NULL
), pointed AS (
  SELECT *, [x for x in [{{'path': trim(p[j]), 'loc': regexp_extract(p[j + 1], '(?i)^\\s*((?:{_WORDS})\\s*\\d+|#\\S+)', 1), 'orig': regexp_matches(lower(p[j - 1]), '{C.ORIGINAL_WORD}\\s*:?\\s*$')}} for j in range(2, len(p)) if j % 2 = 0] if x.path <> ''] AS ps,
    string_split_regex(regexp_replace(title, '[*#`]', '', 'g'), '\\s+[—–-]\\s+') AS ts FROM cut
), chosen AS (
  SELECT doc_id, CAST(first_at AS INTEGER) AS line, form, CASE WHEN bare <> '' THEN bare ELSE above END AS quote,
    CASE WHEN form = 'callout' THEN regexp_replace(regexp_replace(head, '^[^\\]]*\\][-+]?', ''), '^[ \\t·—\\-,]+|[ \\t·—\\-,]+$', '', 'g')
         WHEN (starts_with(title, '**') OR starts_with(title, '#') OR starts_with(title, '-')) AND len(ts) > 1 THEN {S.strip("ts[2]")} ELSE '' END AS author,
    [x for x in ps if NOT x.orig][1] AS r, [x for x in ps if x.orig][-1] AS o FROM pointed
), cited AS (
  SELECT doc_id, line, form, quote, author, r.path AS path, coalesce(r.loc, '') AS locator, o.path AS original, coalesce(o.loc, '') AS original_locator FROM chosen WHERE form = 'callout' OR r.path IS NOT NULL
)"""


def _flat(x: str) -> str:
    """T.flat_quote in DuckDB."""
    for old, new in ((r"\\[nrt]", " "), (r'\\"', '"'), (r"\\/", "/"), (r"\\\\", r"\\")):
        x = f"regexp_replace({x}, '{old}', '{new}', 'g')" if x.startswith("regexp") else f"regexp_replace(nfc_normalize({x}), '{old}', '{new}', 'g')"
    return S.collapse(f"translate({x}, '{T.TYPOGRAPHIC}', '{T.TYPED.replace(chr(39), chr(39) * 2)}')")


def _locating(asked: str, name: str) -> str:
    """CTEs that end in <name>(id, status, start), from asked(id, quote, locator, piece): C.located step by step."""
    n = name
    walk = f"CASE WHEN strpos(substring(b.same, w.pos), b.parts[w.k + 1]) > 0 THEN w.pos + strpos(substring(b.same, w.pos), b.parts[w.k + 1]) - 1 ELSE 0 END"
    return f"""{n}_q AS ({asked}
), {n}_l AS (
  SELECT *, [{_flat("x")} for x in CASE WHEN piece = '' THEN [] WHEN regexp_split_to_array(piece, '{S.NEWLINE}')[-1] = '' THEN regexp_split_to_array(piece, '{S.NEWLINE}')[:-2] ELSE regexp_split_to_array(piece, '{S.NEWLINE}') END] AS flat,
    [x for x in [{_flat("y")} for y in regexp_split_to_array(quote, '…|\\.\\.\\.')] if length(x) >= {C.MIN_FRAGMENT}] AS parts, [x for x in [{_flat("y")} for y in regexp_split_to_array(quote, '[{C.JOINTS}]')] if length(x) >= {C.MIN_FRAGMENT}] AS joints FROM {n}_q
), {n}_b AS (
  SELECT *, array_to_string([x for x in flat if x <> ''], chr(10)) AS run, array_to_string([x for x in flat if x <> ''], ' ') AS same, [j for j in range(1, len(flat) + 1) if flat[j] <> ''] AS numbers FROM {n}_l
), {n}_p AS (SELECT *, CASE WHEN len(parts) > 0 THEN coalesce(strpos(same, parts[1]), 0) ELSE 0 END AS place FROM {n}_b),
{n}_w AS (
  SELECT id, 1 AS k, place AS pos FROM {n}_p WHERE place > 0 UNION ALL SELECT w.id, w.k + 1, {walk} FROM {n}_w w JOIN {n}_p b ON w.id = b.id WHERE w.k < len(b.parts) AND w.pos > 0
), {n}_o AS (SELECT id, bool_and(pos > 0) AS in_order FROM {n}_w GROUP BY id),
{n}_r AS (
  SELECT id, unnest(numbers) AS row, 0 AS k, 1 AS pos, 0 AS n FROM {n}_p WHERE place = 0 AND len(parts) > 0 AND len(joints) >= 2
  UNION ALL SELECT r.id, r.row, r.k + 1,
    CASE WHEN strpos(substring(b.flat[r.row], r.pos), b.joints[r.k + 1]) > 0 THEN r.pos + strpos(substring(b.flat[r.row], r.pos), b.joints[r.k + 1]) - 1 + length(b.joints[r.k + 1]) ELSE r.pos END,
    r.n + CASE WHEN strpos(substring(b.flat[r.row], r.pos), b.joints[r.k + 1]) > 0 THEN 1 ELSE 0 END
  FROM {n}_r r JOIN {n}_p b ON r.id = b.id WHERE r.k < len(b.joints)
), {n}_m AS (SELECT r.id, min(r.row) AS again FROM {n}_r r JOIN {n}_p b ON r.id = b.id WHERE r.k = len(b.joints) AND r.n >= len(b.joints) - 1 GROUP BY r.id),
{n}_s AS (
  SELECT p.*, o.in_order, m.again, CASE WHEN place > 0 THEN numbers[1 + length(regexp_replace(substring(run, 1, place - 1), '[^\\n]', '', 'g'))] END AS real,
    CASE WHEN starts_with(lower(locator), 'l') THEN CAST(regexp_extract(locator, '(\\d+)$', 1) AS INTEGER) END AS wanted
  FROM {n}_p p LEFT JOIN {n}_o o ON p.id = o.id LEFT JOIN {n}_m m ON p.id = m.id
), {name} AS (
  SELECT id, CAST(coalesce(real, again) AS INTEGER) AS start,
    CASE WHEN piece IS NULL THEN 'missing' WHEN len(parts) = 0 THEN 'empty' WHEN place = 0 THEN CASE WHEN again IS NOT NULL THEN 'recomposed' ELSE 'absent' END
         WHEN len(parts) > 1 AND NOT in_order THEN 'disordered' WHEN wanted IS NULL THEN CASE WHEN starts_with(locator, '#') THEN 'anchor' ELSE 'unlocated' END
         WHEN wanted <> real THEN 'misplaced' ELSE 'found' END AS status FROM {n}_s
)"""


def _located(own: bool) -> str:
    recursive = "WITH RECURSIVE " + _CITED
    if own:
        asked = "SELECT c.doc_id * 1000000 + c.line AS id, c.quote, c.locator, d.text AS piece FROM cited c JOIN documents d ON c.doc_id = d.doc_id"
        return f"{recursive}, {_locating(asked, 'done')} SELECT c.doc_id, c.line, s.status, s.start FROM cited c JOIN done s ON s.id = c.doc_id * 1000000 + c.line"
    aimed = f"aimed AS (SELECT c.doc_id * 1000000 + c.line AS id, c.doc_id, c.line, c.quote, c.locator, concat_ws('/', string_split(d.directory, '/')[1], c.path) AS target FROM cited c JOIN documents d ON c.doc_id = d.doc_id)"
    asked = "SELECT a.id, a.quote, a.locator, t.text AS piece FROM aimed a LEFT JOIN documents t ON t.directory || '/' || t.relative_path = a.target"
    return f"{recursive}, {aimed}, {_locating(asked, 'done')} SELECT a.doc_id, a.line, a.target, s.status, s.start FROM aimed a JOIN done s ON s.id = a.id"


def _dual() -> str:
    """The notes of _dual_notes, judged as C.dual_pointers does."""
    piece = "LEFT JOIN pieces t ON t.vault = c.vault AND t.path ="
    cited = _CITED.replace("FROM documents", "FROM quoting")
    derived = """CASE WHEN starts_with(low, 'wiki/') OR contains(low, '/wiki/') THEN 'note' WHEN contains(low, '.ocr.') THEN 'ocr' WHEN contains(low, '.transcription.') THEN 'transcription' WHEN contains(low, '.standardise') THEN 'standardised' END"""
    first = f"SELECT c.id, c.quote, c.locator, t.text AS piece FROM placed_in c {piece} c.path WHERE c.path IS NOT NULL"
    second = f"SELECT c.id, c.quote, c.original_locator AS locator, t.text AS piece FROM placed_in c {piece} c.original WHERE c.path IS NOT NULL AND c.original IS NOT NULL AND c.kind IS NULL"
    present = ", ".join(f"'{x}'" for x in C.PRESENT)
    return f"""WITH RECURSIVE {_DUAL_SQL}, {cited}, placed_in AS (
  SELECT *, {derived} AS kind FROM (SELECT c.*, c.doc_id * 1000000 + c.line AS id, 'v' AS vault, lower(replace(c.original, chr(92), '/')) AS low FROM cited c)
), {_locating(first, 'reads')}, {_locating(second, 'origs')}, judged AS (
  SELECT c.doc_id, c.line, c.form, c.path IS NOT NULL AND c.author = '' AS author_missing, coalesce(r.status, 'undeclared') AS reading,
    CASE WHEN c.original IS NULL OR c.path IS NULL THEN 'undeclared' WHEN c.kind IS NOT NULL THEN 'derived:' || c.kind WHEN o.status = 'absent' AND r.status IN ({present}) THEN 'altered' ELSE o.status END AS original_status
  FROM placed_in c LEFT JOIN reads r ON c.id = r.id LEFT JOIN origs o ON c.id = o.id
)
SELECT *, author_missing OR reading NOT IN ('anchor', 'found') OR original_status NOT IN ('anchor', 'found') AS fault FROM judged"""


#: A note's first line as a piece, and what notes that quote it may look like: own texts are quoted well and badly by doc_id.
_FORMS = (
    ("{q}", "> [!source]- Jean Martin, 2024", "> `lu/{d}.md` Ligne 2", "> original `brut/{d}.txt` l. 3"),
    ("{q}", "> [!source]", "> `lu/{d}.md` L 2", "> original `lu/{d}.ocr.md` #a"),
    ("{q}", "> [!source] A", "> `lu/{d}.md` Ligne 9", "> original: `wiki/{d}.md`"),
    ("{q} … fin du texte", "> [!source] A", "> `lu/{d}.md` #x", "> original `brut/{d}.txt` Ligne 3"),
    ("fin du texte ... {q}", "> [!source] A", "> `lu/{d}.md` Ligne 2", ""),
    ("jamais écrit nulle part", "> [!source] A", "> `lu/{d}.md` Ligne 2", "> original `brut/{d}.txt` Ligne 3"),
    ("alpha beta | fin du texte", "> [!source] A", "> `lu/{d}.md` Ligne 4", "> original `brut/{d}.txt` Ligne 9"),
    ("seulement lu", "> [!source] A", "> `lu/{d}.md` Ligne 5", "> original `brut/{d}.txt` Ligne 5"),
    ("{q}", "", "`lu/{d}.md` Ligne 2, original `brut/{d}.txt` Ligne 3", ""),
    ("{q}", "> [!source] A", "> sans pointeur", ""),
    ("{q}", "> [!source] A", "> `perdu/{d}.md` Ligne 2", "> original `perdu/{d}.txt` p. 2"),
)


def _dual_parts(q: str, d: str, cat: Callable[..., str]) -> list[str]:
    """SQL expressions of the notes' texts by form, for an engine's own concat."""
    out = []
    for quote, head, reading, original in _FORMS:
        text = "\n".join(("**2024 — Anne Roy** — note", "", f"> « {quote} »", "", *(x for x in (head, reading, original) if x), "", "suite"))
        pieces = []
        for at, part in enumerate(text.replace("{q}", "\0q\0").replace("{d}", "\0d\0").split("\0")):
            pieces.append({"q": q, "d": d}[part] if at % 2 else "'" + part.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        out.append(cat(*pieces))
    return out


def _dual_sql(engine: str) -> tuple[str, str, str]:
    """The quoting note, the reading and the raw piece of a document, as SQL of either engine."""
    text = "string" if engine == "spark" else "varchar"
    d = f"cast(doc_id as {text})"
    every = "" if engine == "spark" else ", 'g'"
    q = f"concat('mots ', substring(regexp_replace(coalesce(text, ''), '[^a-zA-Z ]+', ' '{every}), 1, 60))"
    note = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_dual_parts(q, d, lambda *xs: " || ".join(f"({x})" for x in xs))))
    lf = "chr(10)"
    return f"CASE doc_id % {len(_FORMS)} {note} END", f"'titre' || {lf} || {q} || {lf} || {lf} || 'alpha beta puis fin du texte' || {lf} || 'seulement lu'", f"'titre' || {lf} || {lf} || {q} || {lf} || 'alpha beta, fin du texte'"


def dual_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of every document's opening words, planted well and badly by its id, judged by both of their pointers."""
    note, reading, raw = _dual_sql("spark")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    quoting = docs.select("doc_id", F.expr(note).alias("text"))
    vault = F.lit("v").alias("vault")
    pieces = docs.select(vault, F.expr("concat('lu/', cast(doc_id as string), '.md')").alias("path"), F.expr(reading).alias("text")).unionByName(docs.select(vault, F.expr("concat('brut/', cast(doc_id as string), '.txt')").alias("path"), F.expr(raw).alias("text")))
    done = C.dual_pointers(C.citations(quoting, "doc_id", "text").withColumn("vault", vault), pieces)
    return done.select(F.col("key").alias("doc_id"), "line", "form", "author_missing", "reading", "original_status", "fault")


_NOTE, _READING, _RAW = _dual_sql("duckdb")
_DUAL_SQL = f"""quoting AS (SELECT doc_id, directory, relative_path, {_NOTE} AS text FROM documents),
pieces AS (SELECT 'v' AS vault, 'lu/' || cast(doc_id as varchar) || '.md' AS path, {_READING} AS text FROM documents UNION ALL SELECT 'v', 'brut/' || cast(doc_id as varchar) || '.txt', {_RAW} FROM documents)"""

QUERIES = {
    f.__name__: f
    for f in (entry_anchors, entry_order, best_hour_offset, entries_missing, anchors_multiset_missing, anchors_common, custom_anchor_difference, canonical_entries, timeline, session_transcript, citation_pointers, citation_locate, citation_self_locate, dual_pointer, json_anchors, series_continuity)
}

ORACLE = {
    "entry_anchors": f"WITH {_ANCHORS} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, anchor, whole FROM anchors",
    "entry_order": f"""WITH {_ANCHORS}, steps AS (SELECT *, lag(anchor) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM anchors)
SELECT doc_id, count(*) AS entries, min(anchor) AS first, max(anchor) AS last, count(*) FILTER (WHERE anchor < before) AS breaks,
       count(*) FILTER (WHERE anchor < before) > 0 AND count(*) FILTER (WHERE anchor > before) = 0 AS reversed FROM steps GROUP BY doc_id""",
    "best_hour_offset": f"WITH {_SERIES} SELECT key AS user_id, hours, common FROM best",
    "entries_missing": f"""WITH {_SERIES}, moved AS (SELECT s.key, s.anchor + to_hours(b.hours) AS anchor, count(*) AS n FROM source s JOIN best b ON s.key = b.key GROUP BY ALL)
SELECT coalesce(m.key, nc.key) AS user_id, coalesce(m.anchor, nc.anchor) AS anchor, greatest(coalesce(m.n, 0) - coalesce(nc.n, 0), 0) AS missing, greatest(coalesce(nc.n, 0) - coalesce(m.n, 0), 0) AS extra
FROM moved m FULL JOIN nc ON m.key = nc.key AND m.anchor = nc.anchor WHERE coalesce(m.n, 0) <> coalesce(nc.n, 0)""",
    "anchors_multiset_missing": f"WITH {_SERIES} SELECT key AS user_id, anchor FROM (SELECT key, anchor FROM source EXCEPT ALL SELECT key, anchor FROM note)",
    "anchors_common": f"WITH {_SERIES} SELECT key AS user_id, anchor FROM (SELECT key, anchor FROM source INTERSECT ALL SELECT key, anchor FROM note)",
    "custom_anchor_difference": f"""
WITH a AS (SELECT directory, relative_path, lower(unnest(regexp_extract_all(text, '(?i){NUMBERED}'))) AS anchor FROM documents),
b AS (SELECT directory, relative_path, lower(unnest(regexp_extract_all(content, '(?i){NUMBERED}'))) AS anchor FROM markdown_chunks),
x AS (SELECT directory, relative_path, anchor, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT directory, relative_path, anchor, count(*) AS n FROM b GROUP BY ALL)
SELECT coalesce(x.directory, y.directory) AS directory, coalesce(x.relative_path, y.relative_path) AS relative_path, coalesce(x.anchor, y.anchor) AS anchor,
       greatest(coalesce(x.n, 0) - coalesce(y.n, 0), 0) AS missing, greatest(coalesce(y.n, 0) - coalesce(x.n, 0), 0) AS extra
FROM x FULL JOIN y ON x.directory = y.directory AND x.relative_path = y.relative_path AND x.anchor = y.anchor WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)""",
    "canonical_entries": f"WITH {_ENTRIES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, moment, author, said FROM entries",
    "timeline": f"""WITH {_ENTRIES} SELECT string_split(directory, '/')[1] AS vault, CAST(row_number() OVER (PARTITION BY string_split(directory, '/')[1] ORDER BY moment, doc_id, line_no) AS INTEGER) AS nth,
       moment, doc_id, CAST(line_no AS INTEGER) AS line_no, author FROM entries WHERE moment IS NOT NULL""",
    "session_transcript": f"""WITH {_ENTRIES}, told AS (SELECT doc_id, line_no, '## ' || author || chr(10) || chr(10) || {S.strip("said || CASE WHEN line_no % 3 = 0 THEN ' API_TOKEN=" + MASK + "' ELSE '' END")} AS block FROM entries WHERE {S.strip("said || CASE WHEN line_no % 3 = 0 THEN ' x' ELSE '' END")} <> '')
SELECT substring(CAST(doc_id AS VARCHAR), 1, 8) AS session, md5('---' || chr(10) || 'type: session' || chr(10) || 'date: 2024-01-02' || chr(10) || 'tours: ' || count(*) || chr(10) || '---' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY line_no) || chr(10)) AS note_md5 FROM told GROUP BY doc_id""",
    "citation_pointers": f"WITH {_CITED} SELECT doc_id, line, form, md5(quote) AS quote_md5, author, path, locator, original, original_locator FROM cited",
    "citation_locate": _located(False),
    "citation_self_locate": _located(True),
    "dual_pointer": _dual(),
    "json_anchors": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, date_trunc('minute', ts) AS anchor FROM events",
    "series_continuity": """WITH c AS (SELECT user_id, event_id AS number, CASE WHEN event_id % 3 = 0 THEN 'a' || event_id END AS author, ts AS first, ts + INTERVAL 2 HOUR AS last FROM events WHERE event_id % 7 <> 0)
SELECT user_id, number, CAST(greatest(coalesce(number - lag(number) OVER w - 1, 0), 0) AS INTEGER) AS missing,
  last_value(author IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS author,
  coalesce(first < lag(first) OVER w, false) AS backward, coalesce(first <= lag(last) OVER w, false) AS overlap FROM c WINDOW w AS (PARTITION BY user_id ORDER BY number)""",
}

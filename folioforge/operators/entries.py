"""Dated entries: where a text's entries start, and whether a copy still has them all."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.staging import written

# Signs that may stand before an entry's date at the start of its line, and how many of them.
LEAD_SIGNS, LEAD_MOST = r" \t\[(*_\->#|", 6
LEAD = f"^[{LEAD_SIGNS}]{{0,{LEAD_MOST}}}"
# The accepted forms of a day and of an hour. A day is written year first with hyphens, or year last with slashes, dots or hyphens.
_YEAR_FIRST, _YEAR_LAST = r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})"
_MINUTES = r"(\d{2})"
ISO = f"^{_YEAR_FIRST}[T ](\\d{{1,2}}):{_MINUTES}"
NUMERIC = f"^{_YEAR_LAST},?\\s+(\\d{{1,2}})[:h]{_MINUTES}"
ISO_DAY = f"^{_YEAR_FIRST}(?![\\d:T-])"
NUMERIC_DAY = f"^{_YEAR_LAST}(?![\\d:/.-])"
HOUR = f"^(\\d{{1,2}})[:h]{_MINUTES}(?!\\d)"
# Keys that hold the moment of an entry in exports, the first that does counts.
MOMENT_KEYS = ("timestamp", "datetime", "created_at", "createdat", "date", "sent_at", "sentat", "published_at", "time", "ts")
OFFSETS = range(-12, 15)


def _stamp(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    """A timestamp without zone from texts, null if there is no such date; two-digit years are of this century."""
    y = F.when(F.length(year) <= 2, F.concat(F.lit("20"), F.lpad(year, 2, "0"))).otherwise(F.lpad(year, 4, "0"))
    joined = F.concat(y, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit(" "), F.lpad(hour, 2, "0"), F.lit(":"), F.lpad(minute, 2, "0"), F.lit(":00"))
    return F.try_to_timestamp(joined, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def _group(x: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(x, pattern, n)


def anchors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, anchor, whole): the start of every dated entry, to the minute.

    An entry opens its line with a full timestamp, or with a day and more text;
    a bare hour takes the day of the last date before it. Bare hours (whole is
    false) count only in texts without a full one. Day and month are taken in
    the order that a text's own dates prove, day first if they prove none. Only
    lines that open with a digit reach the shuffle.
    """
    cut = docs.select(F.col(key).alias("key"), F.posexplode(T.lines(F.col(text))).alias("line_no", "line"))
    body = F.regexp_replace("line", LEAD, "")
    opened = cut.withColumn("body", body).where(F.col("body").rlike(r"^\d")).withColumn("heading", F.substring("line", F.lit(1), F.length("line") - F.length("body")).contains("#"))
    b = F.col("body")
    first = F.when(b.rlike(NUMERIC), _group(b, NUMERIC, 1)).when(b.rlike(NUMERIC_DAY), _group(b, NUMERIC_DAY, 1)).cast("int")
    second = F.when(b.rlike(NUMERIC), _group(b, NUMERIC, 2)).when(b.rlike(NUMERIC_DAY), _group(b, NUMERIC_DAY, 2)).cast("int")
    whole_text = Window.partitionBy("key")
    seen = opened.withColumn("first", first).withColumn("second", second).drop("line")
    month_first = F.coalesce((F.max("first").over(whole_text) <= 12) & (F.max("second").over(whole_text) > 12), F.lit(False))
    seen = seen.withColumn("month_first", month_first)

    def ordered(pattern: str, hour: Column, minute: Column) -> Column:
        a, c, year = (_group(b, pattern, i) for i in (1, 2, 3))
        return F.when(F.col("month_first"), _stamp(year, a, c, hour, minute)).otherwise(_stamp(year, c, a, hour, minute))

    zero = F.lit("00")
    full = F.when(b.rlike(ISO), _stamp(*(_group(b, ISO, i) for i in range(1, 6)))).when(b.rlike(NUMERIC), ordered(NUMERIC, _group(b, NUMERIC, 4), _group(b, NUMERIC, 5)))
    is_full = b.rlike(ISO) | b.rlike(NUMERIC)
    day = F.when(is_full, F.lit(None)).when(b.rlike(ISO_DAY), _stamp(*(_group(b, ISO_DAY, i) for i in range(1, 4)), zero, zero)).when(b.rlike(NUMERIC_DAY), ordered(NUMERIC_DAY, zero, zero))
    is_day = ~is_full & (b.rlike(ISO_DAY) | b.rlike(NUMERIC_DAY))
    rest = F.regexp_replace(F.when(b.rlike(ISO_DAY), F.regexp_replace(b, ISO_DAY, "")).otherwise(F.regexp_replace(b, NUMERIC_DAY, "")), r"^[ \t—–\-:·|]+|[ \t—–\-:·|]+$", "")
    dated = seen.withColumn("full", full).withColumn("day", day).withColumn("entry_day", F.when(is_day & ~F.col("heading") & (rest != ""), F.col("day")))
    before = Window.partitionBy("key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.to_date(F.coalesce("full", "day")), ignorenulls=True).over(before)
    hour = F.when(~is_full & ~is_day & b.rlike(HOUR) & (_group(b, HOUR, 1).cast("int") < 24) & (_group(b, HOUR, 2).cast("int") < 60), F.concat(F.lpad(_group(b, HOUR, 1), 2, "0"), F.lit(":"), _group(b, HOUR, 2), F.lit(":00")))
    bare = F.when(hour.isNotNull(), F.concat(carried.cast("string"), F.lit(" "), hour).cast("timestamp_ntz"))
    found = dated.withColumn("bare", bare).withColumn("anchor", F.coalesce("full", "entry_day"))
    found = found.withColumn("any_whole", F.count("anchor").over(whole_text) > 0)
    kept = found.where(F.col("anchor").isNotNull() | ~F.col("any_whole") & F.col("bare").isNotNull())
    return kept.select("key", "line_no", F.coalesce("anchor", "bare").alias("anchor"), F.col("anchor").isNotNull().alias("whole"))


def moment_of(said: str) -> datetime | None:
    """The moment that a text value names: a timestamp anywhere in it, else what opens a line; a bare day only with more text behind it."""
    if found := re.search(ISO[1:], said):
        return _moment(*map(int, found.groups()))
    lines = [re.sub(LEAD, "", line) for line in said.splitlines()]
    days = [tuple(map(int, m.groups()[:2])) for line in lines for m in re.finditer(_YEAR_LAST, line)]
    month_first = any(b > 12 for _, b in days) and not any(a > 12 for a, _ in days)
    for line in lines:
        full = re.match(NUMERIC, line)
        found = full or re.match(ISO_DAY, line) or re.match(NUMERIC_DAY, line)
        if not found:
            continue
        parts = [*map(int, found.groups()), 0, 0][:5]
        if found.re.pattern != ISO_DAY:
            a, b, year = parts[:3]
            parts[:3] = (year, a, b) if month_first else (year, b, a)
        moment = _moment(*parts)
        if moment and (full or line[found.end() :].strip(" \t—–-:·|")):
            return moment
    return None


def _moment(year: int, month: int, day: int, hour: int, minute: int) -> datetime | None:
    try:
        return datetime(year + 2000 if year < 100 else year, month, day, hour, minute)
    except ValueError:
        return None


def export_moments(text: str) -> list[datetime] | None:
    """The moments of an export's entries, one each, in order; None for texts that are no JSON.

    An entry is an object that names its moment; what it holds is not looked
    into, as that dates a part of it. Of a list of objects only these count.
    """
    try:
        data = json.loads(text)
    except ValueError:
        return None
    found: list[datetime] = []
    flat = isinstance(data, list) and any(isinstance(x, dict) for x in data)
    waiting = [data]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            named = {k.lower(): v for k, v in node.items()}
            moments = (moment_of(named[k]) for k in MOMENT_KEYS if isinstance(named.get(k), str))
            if moment := next((m for m in moments if m), None):
                found.append(moment)
                continue
        if isinstance(node, list) or isinstance(node, dict) and not flat:
            waiting += [x for x in (node.values() if isinstance(node, dict) else node) if isinstance(x, dict) or isinstance(x, list) and not flat][::-1]
    return found


def export_anchors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, anchor, whole) of exports in JSON, line_no counting their entries; texts that are none, or hold JSON by lines, as anchors() reads them."""
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for k, body in f.itertuples(index=False):
                found = export_moments(body)
                rows += [(k, 0, None, body)] if found is None else [(k, i, m, None) for i, m in enumerate(found)]
            yield pd.DataFrame(rows, columns=["key", "line_no", "anchor", "other"]).astype({"anchor": "datetime64[us]"})

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    read = written(rows.mapInPandas(run, f"key {kind}, line_no int, anchor timestamp_ntz, other string"), "exports")
    dated = read.where("other is null").select("key", "line_no", "anchor", F.lit(True).alias("whole"))
    return dated.unionByName(anchors(read.where("other is not null"), "key", "other"))


def anchors_of(docs: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """The anchors of each piece by its kind: exports by their entries, all else by its lines."""
    export = F.lower(F.col(path)).endswith(".json")
    return export_anchors(docs.where(export), key, text).unionByName(anchors(docs.where(~export), key, text))


def forms(found: DataFrame) -> DataFrame:
    """(key, form) of anchors: 'full' where entries carry whole dates, 'deduced' where days were carried to bare hours."""
    return found.groupBy("key").agg(F.when(F.min("whole"), "full").otherwise("deduced").alias("form"))


def continuity(captures: DataFrame, *by: str) -> DataFrame:
    """Captures (by..., number, author, first, last) of one series, in order: (by..., number, missing, author, backward, overlap).

    missing: how many numbers lack before this one; author: of the capture, or
    of the last one that names any; backward: it opens before the one before it
    opens; overlap: it opens no later than the one before it ends.
    """
    order = Window.partitionBy(*by).orderBy("number")
    step = F.col("number") - F.lag("number").over(order) - 1
    return captures.select(
        *by,
        "number",
        F.greatest(F.coalesce(step, F.lit(0)), F.lit(0)).cast("int").alias("missing"),
        F.last("author", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("author"),
        F.coalesce(F.col("first") < F.lag("first").over(order), F.lit(False)).alias("backward"),
        F.coalesce(F.col("first") <= F.lag("last").over(order), F.lit(False)).alias("overlap"),
    )


def projected_entry(moment: Column, author: Column, said: Column, attachments: Column) -> Column:
    """One line of an export's entry: moment, author, text on one line, names of what is attached."""
    names = F.array_join(F.filter(attachments, lambda x: x.isNotNull()), ", ")
    tail = F.when(F.coalesce(names, F.lit("")) != "", F.concat(F.lit(" ["), names, F.lit("]"))).otherwise(F.lit(""))
    return F.concat(F.lit("- "), F.date_format(moment, "yyyy-MM-dd HH:mm"), F.lit(" — "), F.coalesce(author, F.lit("")), F.lit(" : "), T.collapse(F.coalesce(said, F.lit(""))), tail)


def order_breaks(found: DataFrame) -> DataFrame:
    """(key, entries, first, last, breaks, reversed) of rows (key, line_no, anchor): how often an entry is earlier than the one before it."""
    order = Window.partitionBy("key").orderBy("line_no")
    step = found.withColumn("before", F.lag("anchor").over(order))
    back, on = F.count_if(F.col("anchor") < F.col("before")), F.count_if(F.col("anchor") > F.col("before"))
    return step.groupBy("key").agg(F.count(F.lit(1)).alias("entries"), F.min("anchor").alias("first"), F.max("anchor").alias("last"), back.alias("breaks"), ((back > 0) & (on == 0)).alias("reversed"))


def counted(found: DataFrame, *by: str) -> DataFrame:
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def best_offset(source: DataFrame, note: DataFrame, span: range = OFFSETS) -> DataFrame:
    """(key, hours, common): by how many hours a note's anchors (key, anchor) are best shifted against its source's.

    The multisets are counted first, so 27 shifts are tried on distinct minutes
    only. Of equal overlaps the lowest shift wins; without any it is the lowest.
    """
    shifts = F.explode(F.array(*(F.lit(h) for h in span)))
    shifted = counted(source, "key", "anchor").select("key", "n", shifts.alias("hours"), "anchor").withColumn("anchor", F.expr("anchor + make_interval(0, 0, 0, 0, hours, 0, 0)"))
    met = shifted.join(counted(note, "key", "anchor").withColumnRenamed("n", "m"), ["key", "anchor"]).groupBy("key", "hours").agg(F.sum(F.least("n", "m")).alias("common"))
    best = met.groupBy("key").agg(F.max_by(F.struct("hours", "common"), F.struct("common", -F.col("hours"))).alias("best"))
    keys = source.select("key").distinct()
    return keys.join(best, "key", "left").select("key", F.coalesce("best.hours", F.lit(span[0])).alias("hours"), F.coalesce("best.common", F.lit(0)).alias("common"))


def difference(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """Rows by, missing, extra: what the right multiset lacks of the left one, and has beyond it; only keys that differ."""
    both = counted(left, *by).join(counted(right, *by).withColumnRenamed("n", "m"), list(by), "full")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    return both.select(*by, F.greatest(n - m, F.lit(0)).alias("missing"), F.greatest(m - n, F.lit(0)).alias("extra")).where("missing > 0 or extra > 0")


def pattern_anchors(docs: DataFrame, text: str, pattern: str, *keep: str) -> DataFrame:
    """Lower-case matches of a pattern, case ignored, one row each."""
    return docs.select(*keep, F.explode(F.regexp_extract_all(F.col(text), F.lit(f"(?i){pattern}"), F.lit(0))).alias("match")).withColumn("anchor", F.lower("match")).drop("match")


#: One entry to a line: day, hour, author, text.
ENTRY = r"^- (\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}) — ([^:]+?) : (.*)$"


def entry_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, moment, author, said) of the lines in the entry form."""
    cut = docs.select(F.col(key).alias("key"), F.posexplode(T.lines(F.col(text))).alias("line_no", "line")).where(F.col("line").rlike(ENTRY))
    moment = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract("line", ENTRY, 1), F.regexp_extract("line", ENTRY, 2)), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    return cut.select("key", "line_no", moment.alias("moment"), F.regexp_extract("line", ENTRY, 3).alias("author"), F.regexp_extract("line", ENTRY, 4).alias("said"))

"""Text functions as column expressions; each stays inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks and line ends as Python's str.strip and str.splitlines see them, for Java's regular expressions.
WS = r"\t-\r\x1c-\x20\x85\xa0  -     　"
NEWLINE = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"


def _fold_table() -> tuple[str, str]:
    """Lower-case letters that decompose to one letter and marks, with that letter."""
    pairs = []
    for point in range(0xC0, 0x3000):
        c = chr(point)
        rest = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(rest) == 1 and rest != c and c == c.lower():
            pairs.append((c, rest))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _fold_table()


def strip(x: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(x, f"^[{WS}]+|[{WS}]+$", "")


def collapse(x: Column) -> Column:
    """Runs of blanks to one space, none at the ends."""
    return F.trim(F.regexp_replace(x, f"[{WS}]+", " "))


def lines(x: Column) -> Column:
    """The lines of a text; a final line end opens no further line."""
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(x, f"(?:{NEWLINE})\\z", ""), NEWLINE, -1))


def universal_lines(x: Column) -> Column:
    """Every line end as a line feed, as files are read in text mode."""
    return F.regexp_replace(x, "\r\n?", "\n")


def fold(x: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.regexp_replace(F.lower(x), r"\p{Mn}+", ""), _ACCENTED, _PLAIN)


def tokens(x: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def front_matter_lines(all_lines: Column) -> Column:
    """How many lines the front matter takes with its two fences, 0 without a closed one."""
    fences = F.filter(F.transform(all_lines, lambda x, i: F.when(x.contains("---") & (strip(x) == "---"), i)), lambda i: i.isNotNull())
    return F.when(F.get(fences, F.lit(0)) == 0, F.coalesce(F.get(fences, F.lit(1)) + 1, F.lit(0))).otherwise(F.lit(0)).cast("int")


def body_lines(all_lines: Column) -> Column:
    """The lines behind closed front matter, or all."""
    taken = front_matter_lines(all_lines)
    return F.slice(all_lines, taken + 1, F.greatest(F.size(all_lines) - taken, F.lit(0)))


#: Blanks that may stand beside other signs on one line, and closed front matter at the start of a text, with its last line end.
_BESIDE = r"[\t \x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]*"
FRONT_MATTER = rf"(?s)\A{_BESIDE}---{_BESIDE}(?:{NEWLINE})(?:.*?(?:{NEWLINE}))??{_BESIDE}---{_BESIDE}(?:{NEWLINE}|\z)"


def without_front_matter(x: Column) -> Column:
    """The text behind closed front matter; any other text to the byte."""
    behind = F.regexp_replace(x, FRONT_MATTER, "")
    return F.when(F.substring(x, 1, 200).rlike(f"^{_BESIDE}---") & (F.length(behind) < F.length(x)), F.array_join(lines(behind), "\n")).otherwise(x)


def heading_title(line: Column) -> Column:
    """A heading's title, null for other lines: number signs up to the first space or the end, after blanks."""
    bare = F.regexp_replace(line, f"^[{WS}]+", "")
    return F.when(line.contains("#") & bare.rlike("^#+( |$)"), strip(F.regexp_replace(bare, "^#+", "")))


def callout_type(line: Column) -> Column:
    """The lower-case type in the opening line of a callout, null for other lines."""
    found = F.regexp_extract(line, rf"^>[{WS}]*\[!([^\]]+)\][-+]?", 1)
    return F.when(found != "", F.lower(strip(found)))


def excerpt(x: Column, limit: int = 200) -> Column:
    """One line of at most limit characters; longer ones end at a word and with an ellipsis."""
    flat = collapse(x)
    head = F.substring(flat, 1, limit)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("…")))


def slug(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")


def wikilinks(x: Column) -> Column:
    """What stands between double brackets, one element a link."""
    return F.regexp_extract_all(x, F.lit(r"\[\[([^\[\]]*)\]\]"), F.lit(1))


def link_target(raw: Column) -> Column:
    """A link's target, before its display text or section."""
    return F.trim(F.regexp_extract(raw, r"^([^|#]*)", 1))


def normal_name(x: Column) -> Column:
    """A name without case, accents, hyphens, underscores and the plural at its end."""
    return F.regexp_replace(F.regexp_replace(fold(x), r"[-_ ]+", " "), "s$", "")


def figure_markers(x: Column) -> Column:
    """Image references replaced by numbered markers, in order."""
    parts = F.split(x, r"!\[[^\]]*\]\([^)]*\)", -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("[figure "), i.cast("string"), F.lit(" — non extraite]"), p))), "")


def _compositions() -> list[tuple[str, str, str]]:
    """Each combining mark with the letters that it may follow, and those it makes of them."""
    found: dict[str, tuple[list[str], list[str]]] = {}
    for point in range(0xC0, 0x2000):
        parts = unicodedata.decomposition(chr(point)).split()
        if len(parts) == 2 and parts[0][0] != "<" and 0x300 <= int(parts[1], 16) < 0x370 and unicodedata.normalize("NFC", chr(point)) == chr(point):
            letters, whole = found.setdefault(chr(int(parts[1], 16)), ([], []))
            letters.append(chr(int(parts[0], 16)))
            whole.append(chr(point))
    return [(mark, "".join(a), "".join(b)) for mark, (a, b) in sorted(found.items())]


_COMPOSITIONS = _compositions()


def composed(x: Column) -> Column:
    """Letters followed by a combining mark as the one character that means both, where there is one; other texts are not touched."""

    def step(now: Column, m: Column) -> Column:
        parts = F.split(now, m["mark"], -1)

        def joined(part: Column, i: Column) -> Column:
            last = F.right(part, F.lit(1))
            new = F.call_function("translate", last, m["letters"], m["whole"])
            return F.when(i == F.size(parts) - 1, part).otherwise(F.concat(F.left(part, F.length(part) - 1), F.when(new != last, new).otherwise(F.concat(last, m["mark"]))))

        return F.when(F.contains(now, m["mark"]), F.array_join(F.transform(parts, joined), "")).otherwise(now)

    marks = F.array(*(F.struct(F.lit(m).alias("mark"), F.lit(a).alias("letters"), F.lit(b).alias("whole")) for m, a, b in _COMPOSITIONS))
    return F.when(x.rlike("[\u0300-\u036f]"), F.aggregate(marks, x, step)).otherwise(x)


#: Escapes of JSON texts with what they stand for, in the order in which they are undone, and typographic signs with their plain ones.
ESCAPES = ((r"\\[nrt]", " "), (r'\\"', '"'), (r"\\/", "/"), (r"\\\\", r"\\"))
TYPOGRAPHIC, TYPED = "\u2019\u2018\u201c\u201d\u2013\u2014\u00a0", "''\"\"-- "


def flattened(x: Column) -> Column:
    """A composed text without escapes, curly quotes, long dashes and special blanks, for comparison."""
    for old, new in ESCAPES:
        x = F.regexp_replace(x, old, new)
    return collapse(F.translate(x, TYPOGRAPHIC, TYPED))


def flat_quote(x: Column) -> Column:
    """flattened() of any text: its letters are composed first."""
    return flattened(composed(x))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows with further columns, each evaluated once: what is generated is not copied into the expressions that use it."""
    return df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once")).select("*", *(f"_once.{n}" for n in columns)).drop("_once")

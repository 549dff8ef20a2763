"""Problem 1: cut oversized sections at natural boundaries.

The ladder is paragraphs (blank line), lines, words: only what is still too
long goes down a rung. Each rung packs its atoms greedily, and the greedy cuts
of all sections of a batch are found together by pointer doubling: every
boundary is joined to its farthest legal successor (one sorted search over the
running lengths; on the word rung the length that the overlap needs is already
taken off), then the successor table is squared until the longest chain is
covered, each round marking twice as many cuts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, small_batches

LIMIT = 2000
OVERLAP = 200
BLANKS = " \t\r\n"

_HEADING = re.compile(r"^[ \t]*(#+)(?:[ ]([^\n]*))?$", re.MULTILINE)
PIECES = "item_id long, section_ord int, section string, section_chars int, piece_ord int, piece string, overlap_chars int"
_ARROW = pa.schema([("item_id", pa.int64()), ("section_ord", pa.int32()), ("section", pa.string()), ("section_chars", pa.int32()), ("piece_ord", pa.int32()), ("piece", pa.string()), ("overlap_chars", pa.int32())])


def front_matter_end(text: str) -> int:
    """Offset behind the closing line of the front matter, 0 without one (text with \\n only)."""
    first = text.find("\n")
    if first < 0 or text[:first].strip(BLANKS) != "---":
        return 0
    at = first + 1
    while at <= len(text):
        end = text.find("\n", at)
        line = text[at:] if end < 0 else text[at:end]
        if line.strip(BLANKS) == "---":
            return len(text) if end < 0 else end + 1
        if end < 0:
            return 0
        at = end + 1
    return 0


def sections(text: str) -> Iterator[tuple[int, str | None, str]]:
    """(number, title, trimmed body); number 0 precedes the first heading and has no title."""
    text = text.replace("\r\n", "\n")
    at, number, title = front_matter_end(text), 0, None
    for m in _HEADING.finditer(text, at):
        yield number, title, text[at : m.start()].strip(BLANKS)
        at, number, title = m.end(), number + 1, (m[2] or "").strip(BLANKS)
    yield number, title, text[at:].strip(BLANKS)


def greedy_cuts(cost: np.ndarray, first: np.ndarray, limit: int) -> np.ndarray:
    """Starts of the greedy packs. cost: of each atom with its separator; first: first atom of each group."""
    n = len(cost)
    run = np.concatenate(([0], np.cumsum(cost)))
    ends = np.append(first[1:], n)
    group_end = np.repeat(ends, ends - first)
    here = np.arange(n)
    far = np.searchsorted(run, run[:-1] + limit, side="right") - 1
    hop = np.append(np.minimum(np.maximum(far, here + 1), group_end), n)
    cut = np.zeros(n + 1, bool)
    cut[first] = True
    while True:
        cut[hop[np.flatnonzero(cut)]] = True
        if (hop[first] >= ends).all():
            break
        hop = hop[hop]
    return np.flatnonzero(cut[:n])


def pack(groups: list[list[str]], separator: str, limit: int) -> list[list[str]]:
    """Greedily join neighbouring atoms of each group with the separator while they stay within the limit."""
    flat = [a for g in groups for a in g]
    if not flat:
        return [[] for _ in groups]
    cost = np.fromiter(map(len, flat), np.int64, len(flat)) + len(separator)
    first = np.cumsum([0, *(len(g) for g in groups[:-1])])
    cuts = greedy_cuts(cost, first, limit)
    bounds = [*cuts.tolist(), len(flat)]
    joined = [separator.join(flat[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    at = np.searchsorted(cuts, np.append(first, len(flat)))
    return [joined[a:b] for a, b in zip(at, at[1:], strict=False)]


def with_overlap(pieces: list[str], overlap: int) -> list[str]:
    """Each piece led by the whole words at the end of the one before it."""
    out = pieces[:1]
    for before, piece in zip(pieces, pieces[1:], strict=False):
        _, _, tail = before[-overlap:].partition(" ") if overlap else ("", "", "")
        out.append(f"{tail} {piece}" if tail else piece)
    return out


def split_texts(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[list[str]]:
    """Pieces of each text, none over the limit. All texts go down the ladder together."""
    words_limit = limit - overlap

    def by_words(lines: list[str]) -> list[list[str]]:
        atoms = [[w[i : i + words_limit] for word in line.split(" ") for w in [word] for i in range(0, max(1, len(w)), words_limit)] for line in lines]
        return [with_overlap(p, overlap) for p in pack(atoms, " ", words_limit)]

    def rung(wholes: list[str], separator: str, finer) -> list[list[str]]:
        split = [w.split(separator) for w in wholes]
        long = iter(finer([a for s in split for a in s if len(a) > limit]))
        return pack([[b for a in s for b in ([a] if len(a) <= limit else next(long))] for s in split], separator, limit)

    def by_lines(paragraphs: list[str]) -> list[list[str]]:
        return rung(paragraphs, "\n", by_words) if paragraphs else []

    over = [t for t in texts if len(t) > limit]
    pieces = iter(rung(over, "\n\n", by_lines) if over else [])
    return [next(pieces) if len(t) > limit else [t] for t in texts]


def shared_prefix(before: str, piece: str, overlap: int) -> int:
    """How many leading characters of a piece repeat the end of the one before it."""
    _, _, tail = before[-overlap:].partition(" ") if overlap else ("", "", "")
    return len(tail) + 1 if tail and piece.startswith(f"{tail} ") else 0


def split_oversized(df: DataFrame, item: str, text: str, section: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP, oversized_only: bool = False) -> DataFrame:
    """Pieces of every section, each within the limit and under its section's title.

    With ``section`` (a column of titles) a row is one section; else the text is
    cut into sections at its Markdown headings, front matter aside. Lengths are
    code points. A section within the limit is one piece; empty sections and null
    texts give none, null titles stay null. With ``oversized_only`` sections
    within the limit are left out. Rows repeated in the input are repeated in
    the result, and other columns are ignored whatever their names. Narrow: one
    pass, no shuffle.
    """
    small_batches(df.sparkSession)
    chosen = df.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("body"), (F.col(section) if section else F.lit(None).cast("string")).alias("title"))
    one = section is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, bodies = [], []
            for key, body, title in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if body is None or oversized_only and len(body) <= limit:
                    continue
                for number, name, part in [(0, title, body.strip(BLANKS))] if one else sections(body):
                    if part and (len(part) > limit or not oversized_only):
                        head.append((key, number, name, len(part)))
                        bodies.append(part)
            columns: list[list] = [[] for _ in _ARROW]
            for (key, number, name, chars), pieces in zip(head, split_texts(bodies, limit, overlap), strict=True):
                for i, piece in enumerate(pieces):
                    led = shared_prefix(pieces[i - 1], piece, overlap) if i else 0
                    for c, v in zip(columns, (key, number, name, chars, i, piece, led), strict=True):
                        c.append(v)
            yield batch_of(_ARROW, columns)

    return chosen.mapInArrow(run, PIECES)

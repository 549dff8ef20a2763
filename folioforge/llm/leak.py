"""Problem 9: passages of evaluation items inside documents, by winnowing.

Both sides keep the least k-gram hash of every window of consecutive k-grams.
With windows of ``span - k + 1`` grams, two texts that share ``span`` words in a
row share a whole window and so a kept hash: no such passage is missed. Equal
hashes are then extended word by word to the longest common run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, rows_of, small_batches, words, written

SPAN = 13
GRAM = 5
#: Items are broadcast only while their texts have at most this many characters together.
BROADCAST_CHARS = 32_000_000
#: Beyond that, a mark with more rows than this is spread, and at most so many marks are.
HOT_ROWS, HOT_MARKS = 50_000, 10_000

HITS = "doc_id long, item_id long, doc_start int, item_start int, n_words int"
_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("n_words", pa.int32())])
_MARKS = pa.schema([("id", pa.int64()), ("start", pa.int32()), ("mark", pa.int64())])


class _Hashes(dict):
    """64-bit hash of each word, kept while there are few enough."""

    MOST = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def marks(texts: list[list[str]], span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, word position, hash) of the grams that winnowing keeps; texts under ``span`` words have none."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n, window = int(sizes.sum()), span - gram + 1
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none.astype(np.uint64)
    h = np.fromiter((_hashes[w] for t in texts for w in t), np.uint64, n)
    g = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : n - gram + 1 + j]
    g ^= g >> np.uint64(29)
    low = g[: len(g) - window + 1].copy()
    for j in range(1, window):
        np.minimum(low, g[j : len(low) + j], out=low)
    owner = np.repeat(np.arange(len(texts)), sizes)
    whole = owner[: len(low)] == owner[span - 1 : span - 1 + len(low)]
    kept = np.zeros(len(g), bool)
    for j in range(window):
        kept[j : len(low) + j] |= whole & (g[j : len(low) + j] == low)
    at = np.flatnonzero(kept)
    starts = np.cumsum(sizes) - sizes
    return owner[at], at - starts[owner[at]], g[at]


def common_run(a: list[str], i: int, b: list[str], j: int) -> tuple[int, int, int]:
    """Start in a, start in b and length of the longest equal run through a[i] and b[j]; 0 long if these differ."""
    end, n = 0, min(len(a) - i, len(b) - j)
    while end < n and a[i + end] == b[j + end]:
        end += 1
    if not end:
        return i, j, 0
    back, m = 0, min(i, j)
    while back < m and a[i - back - 1] == b[j - back - 1]:
        back += 1
    return i - back, j - back, back + end


def _runs(doc: list[str], pairs: list[tuple[int, int, list[str], int]], span: int) -> set[tuple[int, int, int, int]]:
    """Maximal common runs of at least span words; pairs: (position, item, its words, position there)."""
    found: set[tuple[int, int, int, int]] = set()
    covered: dict[tuple[int, int], int] = {}
    for p, item, other, q in sorted(pairs, key=lambda x: (x[1], x[0], x[3])):
        if covered.get((item, p - q), -1) > p:
            continue
        a, b, n = common_run(doc, p, other, q)
        if n:
            covered[item, p - q] = a + n
        if n >= span:
            found.add((item, a, b, n))
    return found


def leaked_passages(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, span: int = SPAN, gram: int = GRAM, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Every maximal run of at least ``span`` equal words that a document shares with an item.

    A row gives document, item, word positions in both and the length; words are
    compared without case, accents, marks and spacing. Null and short texts, null
    ids and empty tables give no rows, repeated input rows no further ones; other
    columns are ignored whatever their names. While the items are few (their
    characters are counted first) they are broadcast and one narrow pass finds
    the runs; beyond that, kept hashes with the words beside them are joined by a
    shuffle, hot ones spread, and the texts brought to their hits.
    """
    if span < gram:
        raise ValueError("a passage must be at least as long as a gram")
    spark = docs.sparkSession
    small_batches(spark)
    left = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).alias("text")).where("id is not null and text is not null")
    right = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    size = right.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    return (_near if size <= broadcast_chars else _far)(left, right, span, gram)


def _near(left: DataFrame, right: DataFrame, span: int, gram: int) -> DataFrame:
    known = right.distinct().collect()
    held = left.sparkSession.sparkContext.broadcast([(r["id"], r["text"]) for r in known])
    cache: dict[str, tuple] = {}

    def index() -> tuple:
        if not cache:
            ids, texts = [i for i, _ in held.value], [words(t) for _, t in held.value]
            which, start, mark = marks(texts, span, gram)
            order = np.argsort(mark, kind="stable")
            cache["at"] = (ids, texts, which[order], start[order], mark[order])
        return cache["at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, which, start, mark = index()
        for batch in batches:
            out: list[list] = [[] for _ in _HITS]
            keys, bodies = batch.column(0).to_pylist(), [words(t) for t in batch.column(1).to_pylist()]
            w, s, m = marks(bodies, span, gram)
            lo, hi = np.searchsorted(mark, m, "left"), np.searchsorted(mark, m, "right")
            pairs: dict[int, list] = defaultdict(list)
            for k in np.flatnonzero(hi > lo):
                for x in range(lo[k], hi[k]):
                    pairs[int(w[k])].append((int(s[k]), ids[which[x]], texts[which[x]], int(start[x])))
            for d, found in pairs.items():
                for row in sorted(_runs(bodies[d], found, span)):
                    for c, v in zip(out, (keys[d], *row), strict=True):
                        c.append(v)
            yield batch_of(_HITS, out)

    return left.mapInArrow(run, HITS).distinct()


def contexts(texts: list[list[str]], span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, word position of the gram, hash) of the kept grams with the words before them, and with those behind.

    A passage of ``span`` words has span - gram words around its kept gram, half
    of them at least on one side: two texts that share it share one of the two
    longer runs. Boilerplate grams that stand in other surroundings do not meet.
    """
    w, s, _ = marks(texts, span, gram)
    beside = (span - gram + 1) // 2
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    h = np.fromiter((_hashes[x] for t in texts for x in t), np.uint64, int(lengths.sum()))
    first = (np.cumsum(lengths) - lengths)[w] + s
    found = []
    for back in (0, beside):
        inside = (s >= back) & (s - back + gram + beside <= lengths[w])
        at, g = first[inside] - back, np.full(int(inside.sum()), back + 1, np.uint64)
        for j in range(gram + beside):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[at + j]
        found.append((w[inside], s[inside], g ^ g >> np.uint64(29)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _marked(df: DataFrame, span: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            w, s, m = contexts([words(t) for t in batch.column(1).to_pylist()], span, gram)
            yield batch_of(_MARKS, [pa.array(ids[w]), pa.array(s.astype(np.int32)), pa.array(m.view(np.int64))])

    return df.mapInArrow(run, "id long, start int, mark long")


def _met(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, doc_at, item_id, item_at) of equal marks. A mark of many documents is spread over several keys, which its items visit all.

    The marks held apart are at most HOT_MARKS, as each has more than one part in
    HOT_MARKS of all rows; they are broadcast.
    """
    counted = docs.groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
    total = docs.count()
    hot = F.broadcast(counted.where(F.col("n") > max(HOT_ROWS, total // HOT_MARKS)).select("mark", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("parts")))
    left = docs.join(hot, "mark", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "doc_at"), F.coalesce("parts", F.lit(1))).cast("int"))
    right = items.join(hot, "mark", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return left.drop("parts").join(right.drop("parts"), ["mark", "part"]).select("doc_id", "doc_at", "item_id", "item_at")


def _far(left: DataFrame, right: DataFrame, span: int, gram: int) -> DataFrame:
    """Marks are joined by a shuffle; of each document, item and offset between them only the places where a run can start are kept, then the texts come to them."""
    docs = written(_marked(left, span, gram).toDF("doc_id", "doc_at", "mark"), "marks")
    items = _marked(right, span, gram).toDF("item_id", "item_at", "mark")
    # hits of one run lie on one diagonal, not further apart than a passage: only each chain's first is needed
    diagonal = Window.partitionBy("doc_id", "item_id", "offset").orderBy("doc_at")
    chained = _met(docs, items).distinct().withColumn("offset", F.col("doc_at") - F.col("item_at"))
    first = chained.withColumn("before", F.lag("doc_at").over(diagonal)).where(F.col("before").isNull() | (F.col("doc_at") - F.col("before") > 1))
    hits = first.groupBy("doc_id", "item_id").agg(F.collect_list(F.struct("doc_at", "item_at")).alias("at"))
    whole = hits.join(left.distinct().toDF("doc_id", "doc_text"), "doc_id").join(right.distinct().toDF("item_id", "item_text"), "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _HITS]
            for d, i, at, a, b in rows_of(batch, "doc_id", "item_id", "at", "doc_text", "item_text"):
                doc, item = words(a), words(b)
                for row in sorted(_runs(doc, [(x["doc_at"], i, item, x["item_at"]) for x in at if x["doc_at"] < len(doc) and x["item_at"] < len(item)], span)):
                    for c, v in zip(out, (d, *row), strict=True):
                        c.append(v)
            yield batch_of(_HITS, out)

    return whole.mapInArrow(run, HITS).distinct()

"""Problem 10: how much of a document repeats itself, and from where on that rejects it.

The share is exact: one minus distinct over all runs of consecutive words. The
cutoffs on it are risk controlled. Every row is labelled by other measures than
the share (sentences that stand twice, and how far the words compress), and the
exact (Clopper-Pearson) upper bound of the rate at which clean rows are rejected
is computed for every cutoff of a grid and every stratum. In each stratum the
cutoffs are tested from the strictest down until the first that can't be
certified (fixed sequence), the strata sharing the error (Bonferroni). Only
certified cutoffs reject: a stratum without one rejects nothing.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, rows_of, small_batches, words, written

RUN = 5
MIN_WORDS = 40
SHARE = 0.30
#: Largest tolerated share of clean documents that a cutoff rejects, and the chance of exceeding it anywhere.
RISK, CHANCE = 0.02, 0.05
#: Strata up to which their cutoffs are broadcast.
BROADCAST_STRATA = 100_000
#: Cutoffs to test; the last is the share that the task states.
GRID = (0.90, 0.80, 0.70, 0.60, 0.50, 0.45, 0.40, 0.35, SHARE)
#: Labels: rows whose sentences stand twice in so much of their text, or whose words compress to so little, may be rejected.
REPEATED_SENTENCES, COMPRESSED = 0.10, 0.36
#: The row of the cutoffs that is fitted on all strata together.
EVERY = "*"

SHARES = "doc_id long, stratum string, n_words int, n_runs int, n_distinct int, repeated_share double, repeated_sentences double, compressed double"
_SHARES = pa.schema(
    [("doc_id", pa.int64()), ("stratum", pa.string()), ("n_words", pa.int32()), ("n_runs", pa.int32()), ("n_distinct", pa.int32()), ("repeated_share", pa.float64()), ("repeated_sentences", pa.float64()), ("compressed", pa.float64())]
)
_SENTENCE = re.compile(r"[.!?…;:]+\s|\n+")
_CUTOFFS = "stratum string, clean long, cutoff double, bound double"
_CUTOFF_ROWS = pa.schema([("stratum", pa.string()), ("clean", pa.int64()), ("cutoff", pa.float64()), ("bound", pa.float64())])


def repeated_sentences(text: str | None) -> float:
    """The share of a text's sentences and lines of three words or more, by characters, that stood before in it."""
    said = [s for s in (" ".join(words(x)) for x in _SENTENCE.split(text or "")) if s.count(" ") >= 2]
    chars = sum(map(len, said))
    return 1 - sum(map(len, set(said))) / chars if chars else 0.0


def compressed(found: list[str]) -> float:
    """Compressed over plain size of a text's words; 1 without any."""
    plain = " ".join(found).encode()
    return min(1.0, len(zlib.compress(plain, 9)) / len(plain)) if plain else 1.0


def repetition(df: DataFrame, item: str, text: str, stratum: str | None = None, run: int = RUN, labelled: bool = False) -> DataFrame:
    """Repeated content of every document.

    repeated_share is 1 - distinct/all runs of ``run`` consecutive words. Texts
    with fewer words than a run have no runs and a share of 0; null texts count
    as empty, null strata as ''. Every row gives one, repeated rows and null ids
    included; other columns are ignored whatever their names. With ``labelled``
    every row has the measures for labels as well, which are null otherwise.
    Narrow: one pass, no shuffle.
    """
    small_batches(df.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _SHARES]
            for key, body, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = words(body)
                n = max(0, len(w) - run + 1)
                distinct = len(set(zip(*(w[i:] for i in range(run)), strict=False))) if n else 0
                measures = (repeated_sentences(body), compressed(w)) if labelled else (None, None)
                for c, v in zip(out, (key, kind, len(w), n, distinct, 1 - distinct / n if n else 0.0, *measures), strict=True):
                    c.append(v)
            yield batch_of(_SHARES, out)

    kind = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")
    return df.select(F.col(item).cast("long").alias("doc_id"), F.col(text).alias("text"), kind.alias("stratum")).mapInArrow(go, SHARES)


def upper_bound(errors: int, n: int, level: float) -> float:
    """Exact upper confidence bound of a proportion after ``errors`` in n trials; 1 without trials."""
    if n <= 0 or errors >= n:
        return 1.0

    ways = math.lgamma(n + 1) - math.lgamma(errors + 1) - math.lgamma(n - errors + 1)

    def at_most(p: float) -> float:
        # from the most likely term down; what is left once a term adds nothing is a shrinking series
        term = total = 1.0
        for k in range(errors, 0, -1):
            term *= k / (n - k + 1) * ((1 - p) / p)
            total += term
            if term < total * 1e-18:
                break
        return math.exp(ways + errors * math.log(p) + (n - errors) * math.log1p(-p)) * total

    low, high = errors / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if p < 1 and at_most(p) > level else (low, p)
    return high


def certified(clean: int, wrong: list[int], steps: list[float], level: float, risk: float) -> tuple[float | None, float]:
    """The last cutoff of a fixed sequence that can be certified, and its bound; no cutoff, and the first one's bound, where none can."""
    best: tuple[float | None, float] = (None, 1.0)
    for cutoff, errors in zip(steps, wrong, strict=True):
        bound = upper_bound(int(errors), int(clean), level)
        if bound > risk:
            return best if best[0] is not None else (None, bound)
        best = (cutoff, bound)
    return best


def _cutoffs(labelled: DataFrame, score: str, rejectable: str, stratum: str, grid: tuple[float, ...], risk: float, chance: float) -> tuple[DataFrame, tuple | None, int]:
    """The strata's own rows, the row of all rows together (None without any row), and the number of strata."""
    steps = sorted(set(grid), reverse=True)
    if not steps:
        raise ValueError("the grid holds no cutoff")
    clean = ~F.coalesce(F.col(rejectable).cast("boolean"), F.lit(False))
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    counted = written(
        labelled.groupBy(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")).agg(
            F.count(F.when(clean, 1)).alias("clean"),
            F.array(*(F.count(F.when(clean & (value >= c), 1)) for c in steps)).alias("wrong"),
        ),
        "strata",
    )
    n, all_clean, *all_wrong = counted.agg(F.count(F.lit(1)), F.sum("clean"), *(F.sum(F.col("wrong")[i]) for i in range(len(steps)))).first()
    level = chance / (n + 1)
    common = certified(all_clean, all_wrong, steps, level, risk) if n else (None, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, m, *(certified(m, wrong, steps, level, risk) if upper_bound(0, m, level) <= risk else common)) for name, m, wrong in rows_of(batch, "stratum", "clean", "wrong")]
            yield batch_of(_CUTOFF_ROWS, [list(c) for c in zip(*rows, strict=True)] or [[] for _ in _CUTOFF_ROWS])

    return counted.mapInArrow(run, _CUTOFFS), (EVERY, all_clean, *common) if n else None, n


def controlled_cutoffs(labelled: DataFrame, score: str, rejectable: str, stratum: str, grid: tuple[float, ...] = GRID, risk: float = RISK, chance: float = CHANCE) -> DataFrame:
    """The lowest certified cutoff of each stratum: one row (stratum, clean, cutoff, bound), and one for all rows together under '*'.

    ``rejectable`` is true for rows that may be rejected; the others, and rows
    without a label, are clean. Rejecting from the cutoff on rejects more than
    ``risk`` of a stratum's clean rows in at most ``chance`` of all tables, for
    all strata together. A stratum with too few clean rows to certify anything,
    were none of them wrong, stands under the common row; one that has enough
    and can't be certified has a null cutoff: it rejects nothing. Null scores
    count as 0, null strata as one stratum. What comes to the driver are the
    counts of all rows together; any number of strata is certified in tasks.
    """
    own, common, _ = _cutoffs(labelled, score, rejectable, stratum, grid, risk, chance)
    return labelled.sparkSession.createDataFrame([common] if common else [], _CUTOFFS).unionByName(own)


def labelled_holdout(df: DataFrame, item: str, text: str, stratum: str, min_words: int = MIN_WORDS) -> DataFrame:
    """Measures and labels of every row; the texts are read once.

    A row may be rejected if it has ``min_words`` words and repeats sentences or
    compresses well; the share of repeated runs, which the cutoffs are on, takes
    no part in the label. No row is left out: the cutoffs are counted on the
    whole table, whatever its size.
    """
    scored = written(repetition(df, item, text, stratum, labelled=True), "shares")
    rejectable = (F.col("n_words") >= min_words) & ((F.col("repeated_sentences") >= REPEATED_SENTENCES) | (F.col("compressed") <= COMPRESSED))
    return scored.withColumn("rejectable", rejectable)


def repetitive(df: DataFrame, item: str, text: str, stratum: str, share: float = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents of at least ``min_words`` words whose repeated share reaches their stratum's certified cutoff, with their measures.

    The grid ends at ``share``, so no cutoff is lower; where labels and share
    disagree on more than the tolerated risk of a stratum's clean rows, its
    cutoff is higher or it has none. An empty table gives no rows. The strata's
    cutoffs are broadcast up to BROADCAST_STRATA of them and shuffled beyond.
    """
    scored = labelled_holdout(df, item, text, stratum, min_words)
    own, _, n = _cutoffs(scored, "repeated_share", "rejectable", "stratum", (*(c for c in GRID if c > share), share), RISK, CHANCE)
    side = own.select("stratum", "cutoff")
    return scored.where(F.col("n_words") >= min_words).join(F.broadcast(side) if n <= BROADCAST_STRATA else side, "stratum").where(F.col("repeated_share") >= F.col("cutoff")).drop("repeated_sentences", "compressed", "rejectable")

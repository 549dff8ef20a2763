"""Problem 5: how distinctive a term is of a record, by a mixture of two Poissons.

A term occurs by one of two laws: in the few records that are about it (elite)
often, in all others rarely. For each term the mixture is fitted by expectation
maximisation to the histogram of its counts over all records, those without it
included. Both laws are rates: a record's exposure grows with its length, so
that a long note needs more occurrences to count as elite. A count scores the
posterior probability of the elite law, given the record's exposure.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, small_batches, words, written

#: Rounds of the fit at most; it ends before where no posterior of the batch moves by more than TOLERANCE.
ROUNDS, TOLERANCE = 200, 1e-3
#: How much of the exposure follows the length: 0 none, 1 all.
LENGTH_WEIGHT = 0.5
#: A term's occurrences are spread over so many keys when they meet the model.
SALTS = 8
#: Counts at least this likely to come from the elite law are distinctive.
ELITE = 0.5

COUNTS = "term string, tf int, length_class int, n long, doc_id long, n_words long"
_COUNTS = pa.schema([("term", pa.string()), ("tf", pa.int32()), ("length_class", pa.int32()), ("n", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64())])
MODEL = "term string, df long, elite_share double, elite_rate double, other_rate double, converged boolean, tf int, length_class int, n long, score double, weight double"
_MODEL = pa.schema(
    [("term", pa.string()), ("df", pa.int64()), ("elite_share", pa.float64()), ("elite_rate", pa.float64()), ("other_rate", pa.float64()), ("converged", pa.bool_()), ("tf", pa.int32()), ("length_class", pa.int32()), ("n", pa.int64()), ("score", pa.float64()), ("weight", pa.float64())]
)


def length_class(n_words: int) -> int:
    """Lengths in steps of the root of two; a class stands for one exposure."""
    return round(2 * math.log2(1 + n_words))


def term_counts(df: DataFrame, item: str, text: str, min_length: int = 1, letters_only: bool = False, min_tf: int = 1) -> DataFrame:
    """Three kinds of rows from one pass.

    (term, tf, length_class, n) of a batch; with doc_id the counts of at least
    min_tf in a record; with a null term a length class, its records and words.
    """
    small_batches(df.sparkSession)

    def kept(term: str) -> bool:
        return len(term) >= min_length and not (letters_only and not term.isalpha())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            histogram: Counter = Counter()
            records: Counter = Counter()
            lengths: Counter = Counter()
            out: list[list] = [[] for _ in _COUNTS]

            def put(*row: object, out: list[list] = out) -> None:
                for c, v in zip(out, row, strict=True):
                    c.append(v)

            for key, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = words(body)
                at = length_class(len(found))
                records[at] += 1
                lengths[at] += len(found)
                counts = Counter(found)
                histogram.update((term, tf, at) for term, tf in counts.items())
                if key is not None:
                    for term, tf in counts.items():
                        if tf >= min_tf and kept(term):
                            put(term, tf, at, 1, key, None)
            for (term, tf, at), n in histogram.items():
                if kept(term):
                    put(term, tf, at, n, None, None)
            for at, n in records.items():
                put(None, None, at, n, None, lengths[at])
            yield batch_of(_COUNTS, out)

    return df.select(F.col(item).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, COUNTS)


def exposures(classes: list[tuple[int, int, int]], weight: float = LENGTH_WEIGHT) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """Place, exposure and number of records of each length class, from rows (class, records, words)."""
    at = {c: i for i, (c, _, _) in enumerate(classes)}
    n = np.array([x[1] for x in classes], float)
    total = np.array([x[2] for x in classes], float)
    mean = max(total.sum() / max(n.sum(), 1), 1e-9)
    return at, (1 - weight) + weight * total / np.maximum(n, 1) / mean, n


def fit_two_poisson(owner: np.ndarray, tf: np.ndarray, at: np.ndarray, n: np.ndarray, exposure: np.ndarray, records: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elite share and both rates of each term, the posterior of each histogram row, and whether each term's fit converged.

    owner: term index (from 0, rising) of each row (tf > 0, class place, n
    records). Records without the term, by class, are taken into the fit with a
    count of 0.
    """
    terms, classes = int(owner[-1]) + 1 if len(owner) else 0, len(records)
    sums = lambda x: np.bincount(owner, x, terms)
    zeros = np.maximum(0.0, records[None] - np.bincount(owner * classes + at, n, terms * classes).reshape(terms, classes))
    e, df, total = exposure[at], sums(n), sums(n * tf)
    whole = float(records.sum())
    # rates to start with: what the records with the term show, and half of what all show
    mean = total / max(float((records * exposure).sum()), 1e-9)
    most = np.zeros(terms)
    np.maximum.at(most, owner, tf / e)
    elite = np.maximum((total / np.maximum(sums(n * e), 1e-9) + most) / 2, mean * 1.5 + 1e-9)
    other = np.maximum(mean * 0.5, 1e-12)
    share = np.clip(0.5 * df / max(whole, 1.0), 1e-12, 0.5)

    def posterior(k: np.ndarray | float, e: np.ndarray, s: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        odds = np.log(s) - np.log1p(-s) + k * (np.log(high) - np.log(low)) - e * (high - low)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))

    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if terms else np.zeros(0, np.int64)
    moved, p, p0 = np.full(terms, np.inf), np.full(len(tf), np.inf), np.full(zeros.shape, np.inf)
    for _ in range(rounds if terms else 0):
        p_before, p0_before = p, p0
        p = posterior(tf, e, share[owner], elite[owner], other[owner])
        p0 = posterior(0.0, exposure[None], share[:, None], elite[:, None], other[:, None])
        moved = np.maximum(np.maximum.reduceat(np.abs(p - p_before), starts), np.abs(p0 - p0_before).max(1))
        if moved.max() <= tolerance:
            break
        heavy = sums(n * p) + (zeros * p0).sum(1)
        heavy_e, light_e = sums(n * p * e) + (zeros * p0 * exposure).sum(1), sums(n * (1 - p) * e) + (zeros * (1 - p0) * exposure).sum(1)
        elite = np.maximum(sums(n * p * tf) / np.maximum(heavy_e, 1e-300), 1e-9)
        other = np.clip(sums(n * (1 - p) * tf) / np.maximum(light_e, 1e-300), 1e-12, elite * (1 - 1e-9))
        share = np.clip(heavy / max(whole, 1e-300), 1e-12, 1 - 1e-12)
    return share, elite, other, posterior(tf, e, share[owner], elite[owner], other[owner]), moved <= tolerance


def term_model(counts: DataFrame) -> DataFrame:
    """The fitted mixture, from the rows of term_counts: one row for each term, count and length class that occurs.

    A term's histogram is one array: it has a number for each different count
    and length class, however many records there are. The length classes, some
    dozens at most, come to the driver.
    """
    lengths = counts.where("term is null and doc_id is null").groupBy("length_class").agg(F.sum("n").alias("n"), F.sum("n_words").alias("n_words"))
    place, exposure, records = exposures([tuple(r) for r in lengths.orderBy("length_class").collect()])
    gathered = (
        counts.where("term is not null and doc_id is null")
        .groupBy("term", "tf", "length_class")
        .agg(F.sum("n").alias("n"))
        .groupBy("term")
        .agg(F.sort_array(F.collect_list(F.struct("tf", "length_class", "n"))).alias("h"))
        .select("term", F.col("h.tf").alias("tf"), F.col("h.length_class").alias("length_class"), F.col("h.n").alias("n"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.array([len(x) for x in batch.column(1)], np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            tf, classes, n = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(float) for i in (1, 2, 3))
            at = np.array([place[int(c)] for c in classes], np.int64)
            share, elite, other, score, converged = fit_two_poisson(owner, tf, at, n, exposure, records)
            df = np.bincount(owner, n, len(sizes)).astype(np.int64)
            yield batch_of(_MODEL, [batch.column(0).take(pa.array(owner)), *(pa.array(x[owner]) for x in (df, share, elite, other, converged)), pa.array(tf.astype(np.int32)), pa.array(classes.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(score), pa.array(score * -np.log(share[owner]))])

    return gathered.mapInArrow(run, MODEL)


def term_scores(df: DataFrame, item: str, text: str, min_tf: int = 1, min_length: int = 1, letters_only: bool = False) -> DataFrame:
    """Rows (doc_id, term, tf, df, score, weight) of terms that occur at least min_tf times in a record.

    All records and all their counts go into the fit; the limits only say which
    terms and counts are returned. Null texts are records without words, rows
    with a null id count but are not returned, repeated rows count and come
    back each; an empty table gives no rows. Other columns are ignored whatever
    their names. The texts are read once: histogram, lengths and occurrences are
    written together. Occurrences meet the model by term, count and length class
    under salted keys, so a term of many records is spread.
    """
    counts = written(term_counts(df, item, text, min_length, letters_only, min_tf), "terms")
    model = term_model(counts).where(F.col("tf") >= min_tf)
    salted = model.select("term", "tf", "length_class", "df", "score", "weight", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    seen = counts.where("doc_id is not null").select("doc_id", "term", "tf", "length_class", F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("salt"))
    return seen.join(salted, ["term", "tf", "length_class", "salt"]).select("doc_id", "term", "tf", "df", "score", "weight")


def distinctive_terms(df: DataFrame, item: str, text: str, min_tf: int, min_df: int, max_df: int, min_length: int = 1, letters_only: bool = False, elite: float = ELITE) -> DataFrame:
    """(doc_id, term) of the counts that come from the elite law with a probability of at least ``elite``, in terms of that many records; each once."""
    scored = term_scores(df, item, text, min_tf, min_length, letters_only)
    return scored.where((F.col("score") >= elite) & F.col("df").between(min_df, max_df)).select("doc_id", "term").distinct()

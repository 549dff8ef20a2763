"""Problem 4: the most similar vectors of every vector.

Vectors are put into cells around spherical centroids, and what is left of each
is product-quantised to four bits for two dimensions. The codebooks minimise a
score-aware loss: the part of the error along the vector, which changes inner
products most, weighs more than the part across it. Each query scans the codes
in its nearest cells by tables of 16 entries, and the best of the scan are
scored again exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, drawn, small_batches, written

DIMENSION = 64
K = 10
#: Bound of the training sample, in vectors.
SAMPLE_ROWS = 40_000
#: Most cells; their number is the square root of the number of vectors.
MOST_CELLS = 65_536
#: Cells that a query scans when near copies are asked for, and at least when all neighbours are.
PROBES_NEAR, PROBES_ALL = 3, 96
#: When all neighbours are asked for, a query scans so many times the square root of the number of cells.
PROBES_GROWTH = 5
#: A cell's vectors, and the queries that scan it, are split into blocks of about so many.
BLOCK_ROWS, QUERY_ROWS = 8192, 65_536
#: Best codes of a scan that are scored exactly, as a multiple of k.
RERANK = 5
#: How much more error along the vector weighs than error across it.
PARALLEL_WEIGHT = 4.0
SALTS = 8
WIDTH = 2


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def cells_of(x: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The nearest cells of each row, best first."""
    scores = x @ centroids.T
    probes = min(probes, centroids.shape[0])
    if probes == centroids.shape[0]:
        return np.argsort(-scores, axis=1, kind="stable")
    top = np.argpartition(-scores, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(scores, top, 1), axis=1, kind="stable"), 1)


class Index:
    """Centroids, codebooks (subspace, 16, width) and, from the sample, each cell's share of the vectors."""

    def __init__(self, centroids: np.ndarray, books: np.ndarray, share: np.ndarray):
        self.centroids, self.books, self.share = centroids, books, share

    @classmethod
    def train(cls, sample: np.ndarray, cells: int, seed: int = 7, rounds: int = 8) -> Index:
        x = unit(sample)
        rng = np.random.default_rng(seed)
        centroids = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
        for _ in range(rounds):
            home = _home(x, centroids)
            sums = np.zeros_like(centroids)
            np.add.at(sums, home, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            empty = norm[:, 0] < 1e-9
            sums[empty] = x[rng.choice(len(x), int(empty.sum()))] if empty.any() else sums[empty]
            centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        home = _home(x, centroids)
        rest = x - centroids[home]
        parts = x.shape[1] // WIDTH
        books = np.stack([rest[rng.choice(len(x), 16), m * WIDTH : (m + 1) * WIDTH] for m in range(parts)])
        index = cls(centroids.astype(np.float32), books.astype(np.float32), np.bincount(home, minlength=len(centroids)) / len(x))
        for _ in range(4):
            codes = index.encode(x, home)
            index._refit(x, rest, codes)
        return index

    def _refit(self, x: np.ndarray, rest: np.ndarray, codes: np.ndarray) -> None:
        """The codebooks that minimise the score-aware loss for these codes, subspace by subspace."""
        extra = PARALLEL_WEIGHT - 1
        along = np.zeros(len(x))
        parts = len(self.books)
        errors = []
        for m in range(parts):
            s = slice(m * WIDTH, (m + 1) * WIDTH)
            e = ((rest[:, s] - self.books[m][codes[:, m]]) * x[:, s]).sum(1)
            errors.append(e)
            along += e
        for m in range(parts):
            s = slice(m * WIDTH, (m + 1) * WIDTH)
            xm, rm, others = x[:, s].astype(np.float64), rest[:, s].astype(np.float64), along - errors[m]
            left = np.zeros((16, WIDTH, WIDTH))
            right = np.zeros((16, WIDTH))
            np.add.at(left, codes[:, m], extra * xm[:, :, None] * xm[:, None, :] + np.eye(WIDTH))
            np.add.at(right, codes[:, m], extra * xm * (others + (rm * xm).sum(1))[:, None] + rm)
            used = np.bincount(codes[:, m], minlength=16) > 0
            self.books[m][used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0].astype(np.float32)
            new = ((rm - self.books[m][codes[:, m]]) * xm).sum(1)
            along += new - errors[m]
            errors[m] = new

    def encode(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Codes of rows by coordinate descent over the subspaces, from the nearest codewords on."""
        extra = PARALLEL_WEIGHT - 1
        rest = x - self.centroids[home]
        parts = len(self.books)
        codes = np.empty((len(x), parts), np.uint8)
        square, along = [], []
        for m in range(parts):
            s = slice(m * WIDTH, (m + 1) * WIDTH)
            gap = rest[:, None, s] - self.books[m][None]
            square.append((gap**2).sum(2))
            along.append((gap * x[:, None, s]).sum(2))
            codes[:, m] = square[m].argmin(1)
        rows = np.arange(len(x))
        total = sum(along[m][rows, codes[:, m]] for m in range(parts))
        for _ in range(1):
            for m in range(parts):
                others = total - along[m][rows, codes[:, m]]
                codes[:, m] = (square[m] + extra * (others[:, None] + along[m]) ** 2).argmin(1)
                total = others + along[m][rows, codes[:, m]]
        return codes

    def scan(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate scores (query, row) of a cell's codes, by one table of 16 entries for each subspace."""
        scores = np.repeat((queries @ self.centroids[cell])[:, None], len(codes), axis=1)
        for m in range(len(self.books)):
            tables = queries[:, m * WIDTH : (m + 1) * WIDTH] @ self.books[m].T
            scores += tables[:, codes[:, m]]
        return scores


def _home(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 4096] @ centroids.T).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def pack_codes(codes: np.ndarray) -> np.ndarray:
    return codes[:, ::2] | codes[:, 1::2] << 4


def unpack_codes(packed: np.ndarray) -> np.ndarray:
    out = np.empty((len(packed), packed.shape[1] * 2), np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


def _matrix(column: pa.Array, width: int, dtype: type) -> np.ndarray:
    """Rows of a binary column without nulls."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


_KEPT = pa.schema([("id", pa.int64()), ("vector", pa.binary())])


def usable_vectors(df: DataFrame, item: str, vector: str, dimension: int = DIMENSION) -> DataFrame:
    """(id, vector as float32 bytes) of vectors that have the dimension, only finite elements, and some non-zero one; null ids are left out."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(item).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dimension) & ~F.exists("v", lambda e: e.isNull() | F.isnan(e)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dimension)
            good = np.flatnonzero(np.isfinite(x).all(1) & (x != 0).any(1))
            yield batch_of(_KEPT, [batch.column(0).take(pa.array(good)), [x[i].tobytes() for i in good]])

    return rows.mapInArrow(run, "id long, vector binary")


_SENT = pa.schema([("cell", pa.int32()), ("block", pa.int32()), ("askers", pa.int32()), ("id", pa.int64()), ("vector", pa.binary()), ("codes", pa.binary()), ("asks", pa.bool_())])
_PAIRS = pa.schema([("id", pa.int64()), ("neighbor", pa.int64()), ("cosine", pa.float64())])


def _searched(classes: DataFrame, index: Index, total: int, asking: int, k: int, probes: int, min_cosine: float | None) -> DataFrame:
    """(id, neighbor, cosine): the best k of each probed block for each asking vector, itself aside.

    Blocks of a cell's vectors meet blocks of its queries, so that a group is
    bounded however dense a cell is.
    """
    held = classes.sparkSession.sparkContext.broadcast(index)
    blocks = np.maximum(1, np.ceil(index.share * total / BLOCK_ROWS)).astype(np.int64)
    askers = np.maximum(1, np.ceil(index.share * asking * min(probes, len(index.centroids)) / QUERY_ROWS)).astype(np.int64)
    width = index.centroids.shape[1]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column(1), width, np.float32))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ask = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            near = cells_of(x, ix.centroids, probes)
            home = near[:, 0]
            codes = [c.tobytes() for c in pack_codes(ix.encode(x, home))]
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            own, turn = mixed % blocks[home], mixed // 7919
            vectors = batch.column(1).to_pylist()
            out: list[list] = [[] for _ in _SENT]
            for r in range(len(ids)):
                cell = int(home[r])
                for a in range(int(askers[cell])):
                    for c, v in zip(out, (cell, int(own[r]), a, int(ids[r]), vectors[r], codes[r], bool(ask[r]) and a == turn[r] % askers[cell]), strict=True):
                        c.append(v)
                if ask[r]:
                    for cell in near[r].tolist():
                        for b in range(int(blocks[cell])):
                            if cell != home[r] or b != own[r]:
                                for c, v in zip(out, (cell, b, int(turn[r] % askers[cell]), int(ids[r]), vectors[r], None, True), strict=True):
                                    c.append(v)
            yield batch_of(_SENT, out)

    def search(group: pa.Table) -> pa.Table:
        ix, cell = held.value, group.column("cell")[0].as_py()
        stored = group.filter(group.column("codes").is_valid())
        if not stored.num_rows:
            return _PAIRS.empty_table()
        asked = group.filter(group.column("asks"))
        if not asked.num_rows:
            return _PAIRS.empty_table()
        rows = unit(_matrix(stored.column("vector"), width, np.float32)).astype(np.float64)
        codes = unpack_codes(_matrix(stored.column("codes"), len(ix.books) // 2, np.uint8))
        queries = unit(_matrix(asked.column("vector"), width, np.float32))
        ids, qids = stored.column("id").to_numpy(), asked.column("id").to_numpy()
        keep = min(len(ids), k * RERANK + 1)
        found = []
        for at in range(0, len(queries), 512):
            q = queries[at : at + 512]
            scores = ix.scan(q, cell, codes)
            best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep] if keep < len(ids) else np.tile(np.arange(len(ids)), (len(q), 1))
            exact = np.einsum("qd,qkd->qk", q.astype(np.float64), rows[best])
            exact[ids[best] == qids[at : at + 512, None]] = -np.inf
            order = np.lexsort((ids[best], -exact), axis=1)[:, :k]
            score = np.take_along_axis(exact, order, 1)
            who = ids[np.take_along_axis(best, order, 1)]
            good = np.isfinite(score) & (score >= (min_cosine - 1e-6 if min_cosine is not None else -2))
            q_at, _ = np.nonzero(good)
            found.append((qids[at : at + 512][q_at], who[good], score[good]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=_PAIRS)

    sent = classes.select("id", "vector", "asks").mapInArrow(send, "cell int, block int, askers int, id long, vector binary, codes binary, asks boolean")
    return sent.groupBy("cell", "block", "askers").applyInArrow(search, "id long, neighbor long, cosine double")


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbor")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def trained_index(vectors: DataFrame, total: int, dimension: int = DIMENSION, sample_rows: int = SAMPLE_ROWS) -> Index | None:
    """An index fitted on a sample of at most about sample_rows vectors, chosen by a hash of the id; None without vectors."""
    got = vectors.where(drawn("id", sample_rows / max(total, 1), "train")).orderBy("id").select("vector").toArrow().column(0).to_pylist()
    if not got:
        return None
    return Index.train(np.frombuffer(b"".join(got), np.float32).reshape(-1, dimension), max(1, min(MOST_CELLS, math.isqrt(total))))


def probes_of(cells: int) -> int:
    """Cells that a query for all neighbours scans: more in larger indexes, whose cells hold a smaller part of a neighbourhood each."""
    return max(PROBES_ALL, math.ceil(PROBES_GROWTH * math.sqrt(cells)))


def nearest(df: DataFrame, item: str, vector: str, k: int = K, probes: int | None = None, min_cosine: float | None = None, asking: str | None = None, dimension: int = DIMENSION) -> DataFrame:
    """(id, neighbor, cosine, rank): up to k nearest other rows of every row, approximately.

    asking: a condition on id that says which rows ask; all rows answer.
    probes: cells that each scans, by default what probes_of gives. With min_cosine
    less similar neighbours are left out, as one that isn't left out
    is outranked only by such. Rows with a null id, and vectors that are null,
    of another dimension, without a non-zero or with a non-finite element take
    no part. Equal vectors are searched once: a row's own copies come first, by
    id, and a class of copies answers by its k + 1 least ids, so that copies in
    any number are never gathered. Ties go by id; ids given twice count as one
    row. An empty table gives no rows; other columns are ignored whatever their
    names.
    """
    spark = df.sparkSession
    rows = written(usable_vectors(df, item, vector, dimension), "vectors")
    keyed = rows.select("id", "vector", F.xxhash64("vector").alias("h1"), F.hash("vector").alias("h2"))
    classes = keyed.groupBy("h1", "h2").agg(F.min_by("vector", "id").alias("vector"), F.min("id").alias("id"), F.count("id").alias("n"), F.max(F.expr(asking) if asking else F.lit(True)).alias("asks"))
    total, asks = rows.agg(F.count(F.lit(1)), F.count_if(F.expr(asking) if asking else F.lit(True))).first()
    index = trained_index(rows, total, dimension)
    if index is None:
        return spark.createDataFrame([], "id long, neighbor long, cosine double, rank int")
    small_batches(spark)
    several = classes.where("n > 1").select("h1", "h2", F.col("id").alias("class"))
    # every row of a class with copies, and the class's least ids, in two steps so that no class is sorted in one task
    members = written(keyed.select("id", "h1", "h2").join(several, ["h1", "h2"]).select("class", "id").distinct(), "copies")
    part = Window.partitionBy("class", "salt").orderBy("id")
    whole = Window.partitionBy("class").orderBy("id")
    least = (
        members.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS)))
        .withColumn("r", F.row_number().over(part))
        .where(F.col("r") <= k + 1)
        .withColumn("r", F.row_number().over(whole))
        .where(F.col("r") <= k + 1)
        .select("class", F.col("id").alias("member"))
    )
    scanned = probes_of(len(index.centroids)) if probes is None else probes
    best = _ranked(_searched(classes, index, total, asks, k, scanned, min_cosine), k).drop("rank")
    return _expanded(written(best, "nearest"), members, least, k, asking)


def _expanded(best: DataFrame, members: DataFrame, least: DataFrame, k: int, asking: str | None) -> DataFrame:
    """From nearest classes to nearest rows."""
    # answers: the class itself if it has no copies, else its least ids
    others = best.join(least, best["neighbor"] == least["class"], "left").select(best["id"], F.coalesce("member", best["neighbor"]).alias("neighbor"), "cosine")
    own = least.select(F.col("class").alias("id"), F.col("member").alias("neighbor"), F.lit(1.0).alias("cosine"))
    lists = _ranked(others.unionByName(own), k + 1).drop("rank")
    # askers: every class's first row, and the copies of it under salted keys
    copies = members.where("id != class").withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS)))
    shared = lists.join(members.select(F.col("class").alias("c")).distinct(), lists["id"] == F.col("c"), "left_semi")
    salted = shared.select(F.col("id").alias("class"), "neighbor", "cosine", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asked = lists.unionByName(copies.join(salted, ["class", "salt"]).select("id", "neighbor", "cosine"))
    if asking:
        asked = asked.where(F.expr(asking))
    return _ranked(asked.where("id != neighbor"), k).select("id", "neighbor", "cosine", "rank")


def similar_pairs(df: DataFrame, item: str, vector: str, min_cosine: float, k: int = K, probes: int = PROBES_NEAR) -> DataFrame:
    """(stored_id_a, stored_id_b), a < b: pairs of at least min_cosine of which one is among the other's k nearest."""
    near = nearest(df, item, vector, k, probes, min_cosine).where(F.col("cosine") >= min_cosine)
    return near.select(F.least("id", "neighbor").alias("stored_id_a"), F.greatest("id", "neighbor").alias("stored_id_b")).distinct()


def recall(df: DataFrame, item: str, vector: str, asking: str, k: int = K, dimension: int = DIMENSION) -> DataFrame:
    """One row (asked, wanted, found): of the exact k nearest rows of every asking row, how many nearest() finds.

    The asking rows meet all rows in blocks, by brute force; a neighbour as near
    as the k-th counts as one of the k. Meant for a stated set of queries. Rows
    that nearest() leaves out take no part; without any the numbers are 0.
    """
    rows = written(usable_vectors(df, item, vector, dimension).groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    asked = rows.where(asking)
    parts = F.lit(max(1, math.ceil(rows.count() / BLOCK_ROWS)))
    turns = F.lit(max(1, math.ceil(asked.count() / QUERY_ROWS)))
    stored = rows.withColumn("block", F.pmod(F.xxhash64("id"), parts)).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), turns.cast("long") - 1))).withColumn("asks", F.lit(False))
    queries = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).withColumn("turn", F.pmod(F.xxhash64("id", F.lit(1)), turns)).withColumn("asks", F.lit(True))

    def exact(group: pa.Table) -> pa.Table:
        mine, all_ = group.filter(group.column("asks")), group.filter(pa.compute.invert(group.column("asks")))
        if not mine.num_rows or not all_.num_rows:
            return _PAIRS.empty_table()
        x, ids, qids = unit(_matrix(all_.column("vector"), dimension, np.float32)).astype(np.float64), all_.column("id").to_numpy(), mine.column("id").to_numpy()
        found = []
        for at in range(0, mine.num_rows, 512):
            scores = unit(_matrix(mine.column("vector").slice(at, 512), dimension, np.float32)).astype(np.float64) @ x.T
            who = qids[at : at + 512]
            scores[who[:, None] == ids[None]] = -np.inf
            keep = min(k, len(ids))
            best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
            value = np.take_along_axis(scores, best, 1)
            row, col = np.nonzero(np.isfinite(value))
            found.append((who[row], ids[best[row, col]], value[row, col]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=_PAIRS)

    pairs = queries.unionByName(stored).groupBy("block", "turn").applyInArrow(exact, "id long, neighbor long, cosine double")
    least = _ranked(pairs, k).groupBy("id").agg(F.round(F.min("cosine"), 6).alias("least"), F.count(F.lit(1)).alias("wanted"))
    got = nearest(df, item, vector, k, asking=asking, dimension=dimension)
    met = got.join(least, "id").where(F.round("cosine", 6) >= F.col("least")).groupBy("id").agg(F.count(F.lit(1)).alias("found"))
    return least.join(met, "id", "left").agg(F.count(F.lit(1)).alias("asked"), F.coalesce(F.sum("wanted"), F.lit(0)).alias("wanted"), F.coalesce(F.sum(F.least("found", "wanted")), F.lit(0)).alias("found"))

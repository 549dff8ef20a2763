"""Problem 6: near-duplicate sections, by an exact set similarity join with set relations.

A text is the set of its runs of three words. Any order of the shingles allows
prefix filtering; here it is rarest first by a count sketch over all texts. The
index lists of the prefixes are sorted by set size and position, so that a list
falls into blocks, and a set skips all of a block, or the rest of it, from the
position on at which too few shingles are left to reach the threshold. Sets
that are equal are one set from the start. Of the others, each cluster of
candidates has a leader: the differences of its members from the leader are
computed once, and the overlap of two members is derived from the leader's
answer and those differences, without comparing the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, rows_of, small_batches, words, written

SHINGLE = 3
MIN_WORDS = 20
THRESHOLD = 0.6
#: Counters of the sketch that orders the shingles; its size doesn't depend on the data.
COUNTERS = 1 << 18
#: Lists expected longer than this are cut into blocks that meet pair by pair.
LIST_ROWS = 20_000
#: Candidates verified together at most, about, and shingles of the texts that they need.
CLUSTER_PAIRS, CLUSTER_SHINGLES = 5_000, 400_000
#: Members of a class of equal sets that are paired together.
CLASS_ROWS = 2_000
#: Most classes that are held apart as large ones, and broadcast.
LARGE_CLASSES = 10_000
#: Candidates expanded at once in memory.
SLICE = 300_000

_U = np.uint64


def hits_needed(size: np.ndarray) -> np.ndarray:
    """How many prefix shingles a pair must share, by the smaller set; prefixes are longer by as many."""
    return 1 + size // 32


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Words()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (x + _U(seed)) * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(31)
    x *= _U(0xBF58476D1CE4E5B9)
    return x ^ x >> _U(29)


def shingles(tables: list[str], texts: list[str | None], shingle: int = SHINGLE, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row indices that take part, and of all their distinct shingles the owner (index into these) and the hash."""
    bodies = [words(t) for t in texts]
    rows = np.array([i for i, w in enumerate(bodies) if len(w) >= max(min_words, shingle)], np.int64)
    if not len(rows):
        return rows, np.zeros(0, np.int64), np.zeros(0, _U)
    sizes = np.array([len(bodies[i]) for i in rows], np.int64)
    h = np.fromiter((_hashes[w] for i in rows for w in bodies[i]), _U, int(sizes.sum()))
    g = np.zeros(len(h) - shingle + 1, _U)
    for j in range(shingle):
        g = g * _U(0x9E3779B97F4A7C15) + h[j : len(g) + j]
    owner = np.repeat(np.arange(len(rows)), sizes)
    inside = owner[: len(g)] == owner[shingle - 1 :]
    tag = np.array([xxhash.xxh3_64_intdigest(tables[i]) for i in rows], _U)
    owner = owner[: len(g)][inside]
    g = mix(g[inside] ^ tag[owner])
    order = np.lexsort((g, owner))
    owner, g = owner[order], g[order]
    first = np.ones(len(g), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (g[1:] != g[:-1])
    return rows, owner[first], g[first]


def identities(owner: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit identity of each set, and its size."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    sizes = np.diff(np.r_[starts, len(g)])
    return mix(np.add.reduceat(mix(g, 11), starts) + sizes.astype(_U), 13), sizes


_FACTS = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("fp", pa.int64()), ("size", pa.int32()), ("item_table", pa.string()), ("item_id", pa.int64())])
_ENTRIES = pa.schema([("list", pa.int64()), ("fp", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("side", pa.int8())])
_CANDIDATES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hits", pa.int64()), ("needed", pa.int64())])
_VERIFIED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64())])


def _facts(items: DataFrame, shingle: int, min_words: int) -> DataFrame:
    """From one pass: counts of shingles by bucket (fp null), and the set of each item (bucket null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            tables, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows, owner, g = shingles(tables, texts, shingle, min_words)
            if not len(rows):
                continue
            counts += np.bincount((g % _U(COUNTERS)).astype(np.int64), minlength=COUNTERS)
            fp, sizes = identities(owner, g)
            taken = pa.array(rows)
            none = pa.nulls(len(rows))
            yield batch_of(_FACTS, [none.cast(pa.int32()), none.cast(pa.int64()), pa.array(fp.view(np.int64)), pa.array(sizes.astype(np.int32)), batch.column(0).take(taken), batch.column(1).take(taken)])
        used = np.flatnonzero(counts)
        none = pa.nulls(len(used))
        yield batch_of(_FACTS, [pa.array(used.astype(np.int32)), pa.array(counts[used]), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.string()), none.cast(pa.int64())])

    return items.mapInArrow(run, "bucket int, n long, fp long, size int, item_table string, item_id long")


def _entries(items: DataFrame, sketch: np.ndarray, threshold: float, shingle: int, min_words: int) -> DataFrame:
    """Index entries: each prefix shingle of each set, with the set's size, the position and a 128-bit parity sketch of the set.

    A hot list is cut into blocks, and there is a list for each pair of them:
    side says which of the two an entry is of, -1 where they are one.
    """
    held = items.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        sent: set[int] = set()
        for batch in batches:
            rows, owner, g = shingles(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle, min_words)
            if not len(rows):
                continue
            fp, sizes = identities(owner, g)
            new = np.array([x not in sent and not sent.add(x) for x in fp.tolist()], bool)
            bit = g >> _U(57)
            starts = np.cumsum(sizes) - sizes
            one = _U(1) << (bit & _U(63))
            low = np.bitwise_xor.reduceat(np.where(bit < 64, one, _U(0)), starts)
            high = np.bitwise_xor.reduceat(np.where(bit < 64, _U(0), one), starts)
            often = counts[(g % _U(COUNTERS)).astype(np.int64)]
            order = np.lexsort((g, often, owner))
            owner, g, often = owner[order], g[order], often[order]
            pos = np.arange(len(g)) - starts[owner]
            n = sizes[owner]
            take = (pos < n - np.ceil(threshold * n - 1e-9).astype(np.int64) + hits_needed(n)) & new[owner]
            owner, g, pos, often = owner[take], g[take], pos[take], often[take]
            keys, who, sides = [mix(g, 17)], [np.arange(len(g))], [np.full(len(g), -1, np.int8)]
            hot = np.flatnonzero(often > LIST_ROWS)
            if len(hot):
                cold = np.flatnonzero(often <= LIST_ROWS)
                keys, who, sides = [mix(g, 17)[cold]], [cold], [np.full(len(cold), -1, np.int8)]
                blocks = np.ceil(often[hot] / LIST_ROWS).astype(np.int64)
                mine = (mix(fp[owner[hot]], 19) % blocks.astype(_U)).astype(np.int64)
                for other in range(int(blocks.max())):
                    use = other < blocks
                    a, b = np.minimum(mine[use], other), np.maximum(mine[use], other)
                    keys.append(mix(g[hot[use]] + mix((a * 1_000_003 + b).astype(_U), 23), 29))
                    who.append(hot[use])
                    sides.append(np.where(a == b, -1, mine[use] != a).astype(np.int8))
            at = np.concatenate(who)
            own = owner[at]
            yield batch_of(_ENTRIES, [pa.array(np.concatenate(keys).view(np.int64)), pa.array(fp[own].view(np.int64)), pa.array(sizes[own].astype(np.int32)), pa.array(pos[at].astype(np.int32)), pa.array(low[own].view(np.int64)), pa.array(high[own].view(np.int64)), pa.array(np.concatenate(sides))])

    return items.mapInArrow(run, "list long, fp long, size int, pos int, low long, high long, side byte")


def block_pairs(lists: np.ndarray, size: np.ndarray, pos: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (smaller, larger set) that positions and sizes allow. Rows are sorted by list, size, position.

    A block is a list's run of one size. From the lowest size allowed on, an
    entry meets its list's blocks up to its own; with too late a position of its
    own it skips the block, else it takes the block's entries up to the last
    position that leaves enough. Enough is what lets the pair still share as many
    prefix shingles as it needs.
    """
    n = len(lists)
    opens = np.r_[True, (lists[1:] != lists[:-1]) | (size[1:] != size[:-1])]
    starts = np.flatnonzero(opens)
    block = np.cumsum(opens) - 1
    stop = np.r_[starts[1:], n]
    block_size, block_list = size[starts], lists[starts]
    first_block = np.searchsorted(starts, np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]]))
    of_list = np.repeat(first_block, np.diff(np.r_[first_block, len(starts)]))[block]
    least = np.ceil(threshold * size - 1e-9).astype(np.int64)
    wide = int(size.max()) + 2 if n else 2
    # blocks of one list rise in size, so the first allowed one is found by a sorted search over (list, size)
    rank = np.cumsum(np.r_[True, block_list[1:] != block_list[:-1]]) - 1
    low = np.maximum(np.searchsorted(rank * wide + block_size, rank[block] * wide + least), of_list)
    meets = block - low + 1
    keyed = block * wide + pos
    at = 0
    run = np.cumsum(meets)
    while at < n:
        end = max(at + 1, int(np.searchsorted(run, (run[at - 1] if at else 0) + SLICE, "right")))
        count = meets[at:end]
        y = np.repeat(np.arange(at, end), count)
        b = np.repeat(low[at:end], count) + np.arange(len(y)) - np.repeat(np.cumsum(count) - count, count)
        need = np.ceil(threshold / (1 + threshold) * (size[y] + block_size[b]) - 1e-9).astype(np.int64)
        spare = hits_needed(block_size[b]) - 1 - need
        ok = pos[y] <= size[y] + spare
        y, b, spare = y[ok], b[ok], spare[ok]
        last = np.searchsorted(keyed, b * wide + np.clip(block_size[b] + spare, -1, wide - 2), "right")
        last = np.minimum(np.minimum(last, stop[b]), np.where(b == block[y], y, last))
        many = np.maximum(last - starts[b], 0)
        done, total = 0, np.cumsum(many)
        while done < len(y):
            upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + SLICE, "right")))
            c = many[done:upto]
            left = np.repeat(starts[b[done:upto]], c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            yield left, np.repeat(y[done:upto], c)
            done = upto
        at = end


def _candidates(entries: DataFrame, threshold: float) -> DataFrame:
    def lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Column arrays that hold whole lists."""
        rest: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(now[0]):
                continue
            held = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cut = int(np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]])[-1])
            if cut:
                yield [x[:cut] for x in held]
            rest = [x[cut:] for x in held]
        if rest is not None:
            yield rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        for lists, fp, size, pos, low, high, side in lists_of(batches):
            fresh = np.r_[True, (lists[1:] != lists[:-1]) | (fp[1:] != fp[:-1])]
            lists, fp, low, high = lists[fresh], fp[fresh], low[fresh].view(_U), high[fresh].view(_U)
            size, pos, side = size[fresh].astype(np.int64), pos[fresh].astype(np.int64), side[fresh]
            for x, y in block_pairs(lists, size, pos, threshold):
                far = np.bitwise_count(low[x] ^ low[y]).astype(np.int64) + np.bitwise_count(high[x] ^ high[y])
                near = (far <= (1 - threshold) / (1 + threshold) * (size[x] + size[y]) + 1e-9) & (fp[x] != fp[y]) & ((side[x] < 0) | (side[x] != side[y]))
                x, y = x[near], y[near]
                gathered.append(np.stack([np.minimum(fp[x], fp[y]), np.maximum(fp[x], fp[y]), hits_needed(size[x])], 1))
            if sum(map(len, gathered)) > 50_000:
                yield from flush(gathered)
        yield from flush(gathered)

    def flush(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if gathered:
            pairs, hits = np.unique(np.concatenate(gathered), axis=0, return_counts=True)
            gathered.clear()
            yield batch_of(_CANDIDATES, [*(pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)), pa.array(hits), pa.array(np.ascontiguousarray(pairs[:, 2]))])

    sorted_lists = entries.repartition("list").sortWithinPartitions("list", "size", "pos", "fp")
    counted = sorted_lists.mapInArrow(run, "a long, b long, hits long, needed long").groupBy("a", "b")
    return counted.agg(F.sum("hits").alias("hits"), F.max("needed").alias("needed")).where("hits >= needed").select("a", "b")


def overlaps(sets: dict[int, set], pairs: list[tuple[int, int]], leader: int) -> Iterator[tuple[int, int, int]]:
    """(a, b, size of the overlap), each derived from the leader's overlaps and the differences to the leader."""
    lead = sets[leader]
    more = {v: s - lead for v, s in sets.items()}
    less = {v: lead - s for v, s in sets.items()}
    for a, b in pairs:
        if a == leader or b == leader:
            v = b if a == leader else a
            yield a, b, len(lead) - len(less[v])
        else:
            yield a, b, len(lead) - len(less[a]) - len(less[b]) + len(less[a] & less[b]) + len(more[a] & more[b])


def _verified(candidates: DataFrame, facts: DataFrame, items: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """Candidates with their similarity, cluster by cluster; a cluster that is large by pairs or by text is cut along both ends of its pairs."""
    ends = candidates.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(candidates.select(F.col("b").alias("v"), F.col("a").alias("w")))
    leader = ends.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("home"))
    chosen = facts.where("fp is not null").groupBy("fp").agg(F.min(F.struct("item_table", "item_id")).alias("m"), F.max("size").alias("size")).select("fp", "m.item_table", "m.item_id", "size")
    sized = chosen.select(F.col("fp").alias("b"), "size")
    homed = candidates.join(leader.withColumnRenamed("v", "a"), "a").join(sized, "b")
    crowd = homed.groupBy("home").agg(F.ceil(F.sqrt(F.greatest(F.count(F.lit(1)) / CLUSTER_PAIRS, 2 * F.sum("size") / CLUSTER_SHINGLES))).cast("int").alias("parts"))
    cut = lambda end, seed: F.pmod(F.xxhash64(end, F.lit(seed)), F.col("parts")).cast("int")
    homed = homed.join(crowd, "home").select("home", (cut("a", 1) * F.col("parts") + cut("b", 2)).alias("part"), "a", "b")
    pairs = homed.groupBy("home", "part").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    needed = homed.select("home", "part", F.explode(F.array("home", "a", "b")).alias("fp")).distinct()
    texts = needed.join(chosen.drop("size"), "fp").join(items, ["item_table", "item_id"])
    sets = texts.groupBy("home", "part").agg(F.collect_list(F.struct("fp", "text")).alias("sets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _VERIFIED]
            for home, members, asked in rows_of(batch, "home", "sets", "pairs"):
                held = {}
                for x in members:
                    w = words(x["text"])
                    held.setdefault(x["fp"], set(zip(*(w[i:] for i in range(shingle)), strict=False)))
                for a, b, both in overlaps(held, [(p["a"], p["b"]) for p in asked], home):
                    union = len(held[a]) + len(held[b]) - both
                    if both >= threshold * union - 1e-9:
                        for c, v in zip(out, (a, b, both / union), strict=True):
                            c.append(v)
            yield batch_of(_VERIFIED, out)

    return pairs.join(sets, ["home", "part"]).select("home", "sets", "pairs").mapInArrow(run, "a long, b long, jaccard double")


class NearDuplicates:
    """The join's parts: classes(item_table, item_id, fp, block) of equal sets, sizes(fp, n) of the classes, and links(a, b, jaccard) between them.

    Classes of more than CLASS_ROWS members, LARGE_CLASSES of them at most, are
    cut into blocks; those of all others have one.
    """

    def __init__(self, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, min_words: int = MIN_WORDS):
        small_batches(items.sparkSession)
        items = items.select("item_table", "item_id", "text").where("item_id is not null and item_table is not null")
        facts = written(_facts(items, shingle, min_words), "sets")
        members = facts.where("fp is not null").select("item_table", "item_id", "fp").distinct()
        self.sizes = written(members.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "classes")
        total = self.sizes.agg(F.sum("n")).first()[0] or 0
        self.large = self.sizes.where(F.col("n") > max(CLASS_ROWS, total // LARGE_CLASSES)).select("fp", F.ceil(F.col("n") / CLASS_ROWS).cast("int").alias("blocks"))  # LARGE_CLASSES rows at most
        blocked = members.join(F.broadcast(self.large), "fp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        self.classes = blocked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.col("blocks")).cast("int"))
        sketch = np.zeros(COUNTERS, np.int64)
        counted = facts.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
        sketch[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
        candidates = written(_candidates(_entries(items, sketch, threshold, shingle, min_words), threshold), "pairs")
        self.links = _verified(candidates, facts, items, threshold, shingle)

    def pairs(self) -> DataFrame:
        """(item_table, x, y), x < y: members of linked classes, and of one class, block by block."""
        classes = self.classes
        left = classes.select("item_table", F.col("item_id").alias("x"), F.col("fp").alias("a"), F.col("block").alias("i"))
        right = classes.select(F.col("item_id").alias("y"), F.col("fp").alias("b"), F.col("block").alias("j"))
        large = F.broadcast(self.large)
        links = self.links.select("a", "b").join(large.toDF("a", "na"), "a", "left").join(large.toDF("b", "nb"), "b", "left")
        for n, block in (("na", "i"), ("nb", "j")):
            links = links.withColumn(block, F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)))
        linked = links.select("a", "i", "b", "j").join(left, ["a", "i"]).join(right, ["b", "j"]).where("x != y").select("item_table", "x", "y")
        low = classes.select("item_table", F.col("item_id").alias("x"), "fp", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"))
        high = classes.select(F.col("item_id").alias("y"), "fp", F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"))
        copies = low.join(high, ["fp", "i", "j"]).where("i < j and x != y or x < y").select("item_table", "x", "y")
        return linked.unionByName(copies).select("item_table", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))

    def membership(self) -> DataFrame:
        """(item_table, item_id, class_id, copies, links): each document once, with how many more its class has, and how many other classes it is linked to."""
        ends = self.links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("links"))
        facts = self.sizes.join(ends, "fp", "left").select("fp", (F.col("n") - 1).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
        # large classes are broadcast, so that the rows of none of them meet in one task
        apart = self.classes.where("blocks > 1").join(F.broadcast(facts.join(F.broadcast(self.large), "fp", "left_semi")), "fp")
        rest = self.classes.where("blocks = 1").join(facts, "fp")
        return apart.unionByName(rest).select("item_table", "item_id", F.col("fp").alias("class_id"), "copies", "links")


def near_duplicate_pairs(items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """(item_table, id_a, id_b), id_a < id_b: pairs within a table of (item_table, item_id, text) at or above the threshold.

    Exact: no link is lost, copies included. Texts with fewer words than
    min_words, null texts and rows without table or id take no part; an id given
    twice with one text counts once; an empty table gives no rows; other columns
    are ignored. A class of many copies is paired in blocks.
    """
    return NearDuplicates(items, threshold, shingle, min_words).pairs().toDF("item_table", "id_a", "id_b").distinct()


def near_duplicate_classes(items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """(item_table, item_id, class_id, copies, links): the same join without its pairs, one row for each document that takes part.

    Documents of equal sets are one class; copies counts the others in it, links
    the classes at or above the threshold. Rows are left out as by
    near_duplicate_pairs; an id with several texts has a row for each.
    """
    return NearDuplicates(items, threshold, shingle, min_words).membership()

"""Ranked word search: BM25 within each directory, words of the question as prefixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.staging import written

K1, B = 1.2, 0.75
#: What replaces the weight of a word that stands in half of a directory's documents or more.
LEAST_WEIGHT = 1e-6
#: Words asked are broadcast while they have at most so many characters together.
BROADCAST_CHARS = 16_000_000
#: Documents of a directory, what they hold of the words asked, and words of questions that meet in one task, about.
DOCS, HOLDINGS, ASKED = 4096, 1_000_000, 4_000_000
#: Of a question's words those that more documents hold are added up once for all questions that share them.
COMMON, SHARE = 64, 64
#: Pairs of question and document that are scored at once.
PAIRS = 1_000_000


def question_parts(question: Column) -> Column:
    """A question's words, each as its folded tokens with a blank between: a word with underscores is a phrase of what they part."""
    return F.filter(F.transform(F.regexp_extract_all(question, F.lit(r"[\p{L}\p{N}\p{Mn}_]+"), F.lit(0)), lambda w: F.array_join(T.tokens(w), " ")), lambda w: w != "")


def question_words(questions: DataFrame) -> DataFrame:
    """(query_id, directory, word, times): the words of (query_id, directory, question); a repeated word counts as often."""
    return questions.select("query_id", "directory", F.explode(question_parts(F.col("question"))).alias("word")).groupBy("query_id", "directory", "word").agg(F.count(F.lit(1)).alias("times"))


def _grams(n: int) -> Column:
    """The runs of n tokens, a blank between."""
    if n == 1:
        return F.col("tokens")
    starts = F.when(F.size("tokens") >= n, F.sequence(F.lit(1), F.size("tokens") - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice("tokens", i, F.lit(n)), " "))


def _occurrences(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """(directory, doc, length, word, tf): what the documents hold of the words asked of their directory, and a row with a null word for each document.

    One narrow pass over the texts: tokens, and runs of tokens where phrases are
    asked, meet the words by their first characters, and only those that start
    with a word, counted map-side, are shuffled.
    """
    sizes = asked.agg(F.sum(F.length("word") + F.length("directory")).alias("chars"), F.min(F.least(F.length("word"), F.lit(3))).alias("width"), F.collect_set(F.size(F.split("word", " "))).alias("runs")).first()
    width, runs = sizes["width"] or 1, sorted(sizes["runs"]) or [1]
    tokens = documents.select("directory", "doc", T.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    terms = F.concat(F.array(F.lit(None).cast("string")), *(_grams(n) for n in runs))
    rows = tokens.select("directory", "doc", F.size("tokens").alias("length"), F.explode(terms).alias("term"))
    # a document's own row meets no word, and is spread where the join is by a shuffle
    head = F.coalesce(F.substring(F.col("term"), F.lit(1), F.lit(width)), F.concat(F.lit("\0"), F.pmod(F.hash("doc"), F.lit(997)).cast("string")))
    wanted = asked.select("directory", "word").distinct().select(F.col("directory").alias("of"), "word", F.substring(F.col("word"), F.lit(1), F.lit(width)).alias("opening"), F.size(F.split("word", " ")).alias("n"))
    side = F.broadcast(wanted) if (sizes["chars"] or 0) <= BROADCAST_CHARS else wanted
    met = rows.withColumn("head", head).join(side, (F.col("directory") == F.col("of")) & (F.col("head") == F.col("opening")) & F.startswith("term", "word") & (F.size(F.split("term", " ")) == F.col("n") if len(runs) > 1 else F.lit(True)), "left")
    return met.where("term is null or word is not null").groupBy("directory", "doc", "length", "word").agg(F.count("term").alias("tf"))


def bm25(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, directory, doc, score) of every document that holds a word of the question.

    documents: (directory, doc, text), null texts as empty. The words asked,
    and what they find, are written to the shared folder, as counts of documents,
    weights and scores all use them; nothing else of the texts is.
    """
    wanted = written(question_words(questions), "asked")
    counted = written(_occurrences(documents, wanted), "found")
    held = counted.where("word is null").groupBy("directory").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))
    found = counted.where("word is not null")
    seen = found.groupBy("directory", "word").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = seen.join(held, "directory").withColumn("weight", F.when(weight > 0, weight).otherwise(F.lit(LEAST_WEIGHT)))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    # the words' weights, and who asks them, are no larger than the words asked
    chars = wanted.agg(F.sum(F.length("word") + F.length("directory"))).first()[0] or 0
    near = F.broadcast if chars <= BROADCAST_CHARS else lambda side: side
    scored = found.join(near(weighted.select("directory", "word", "weight", "mean_length")), ["directory", "word"]).select("directory", "word", "doc", (F.col("weight") * gain).alias("part"))
    return scored.join(near(wanted), ["directory", "word"]).groupBy("query_id", "directory", "doc").agg(F.sum(F.col("part") * F.col("times")).alias("score"))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of several spans, one behind the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of a list array, and the place of the list that each is of."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(lists), np.repeat(np.arange(len(lists)), sizes)


def _counter(asked: pa.Table, whole: bool = False) -> Callable[[pa.Table], pa.Table]:
    """For the words asked, (directory, word, id): a function from (directory, doc, length, terms) to (directory, doc, length, ids, tfs), the words asked of its directory that open, or are, terms of a document, and how often."""
    directories = {d: i for i, d in enumerate(pc.unique(asked["directory"]).to_pylist())}
    numbers, first = np.unique(asked["id"].to_numpy(), return_index=True)
    texts = asked["word"].take(pa.array(first)).to_pylist()
    at, width = {w: j for j, w in enumerate(texts)}, max(1, len(texts))
    of = np.array([directories[d] for d in asked["directory"].to_pylist()], dtype=np.int64)
    pairs = np.unique(of * width + np.searchsorted(numbers, asked["id"].to_numpy()))
    lengths = {n: sorted({len(w) for w in texts if w.count(" ") == n}) for n in {w.count(" ") for w in texts}}
    known: dict[str, list[int]] = {}

    def opens(term: str) -> list[int]:
        if whole:
            return [at[term]] if term in at else []
        n = term.count(" ")
        found = (at.get(term[:x], -1) for x in lengths.get(n, ()) if x <= len(term))
        return [j for j in found if j >= 0 and texts[j].count(" ") == n]

    def held(docs: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        flat, row = _flat(pa.concat_arrays(docs["terms"].chunks) if docs.num_rows else pa.array([], pa.list_(pa.string())))
        coded = flat.dictionary_encode()
        vocabulary, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for term in vocabulary:
            if term not in known:
                known[term] = opens(term)
        sizes = np.array([len(known[t]) for t in vocabulary], dtype=np.int64)
        words = np.array([j for t in vocabulary for j in known[t]], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        hit = sizes[code] > 0
        pair, times = np.unique(row[hit] * max(1, len(vocabulary)) + code[hit], return_counts=True)
        row, code = np.divmod(pair, max(1, len(vocabulary)))
        n = sizes[code]
        word, row, times = words[_spans(starts[code], n)], np.repeat(row, n), np.repeat(times, n)
        directory = np.array([directories.get(d, -1) for d in docs["directory"].to_pylist()], dtype=np.int64)
        key = directory[row] * width + word
        asked_here = np.append(pairs, -1)[np.searchsorted(pairs, key)] == key
        asked_here &= directory[row] >= 0
        both, place = np.unique(row[asked_here] * width + word[asked_here], return_inverse=True)
        tf = np.bincount(place, weights=times[asked_here], minlength=len(both)).astype(np.int64)
        ends = pa.array(np.searchsorted(both, np.arange(docs.num_rows + 1) * width).astype(np.int32))
        ids = pa.ListArray.from_arrays(ends, pa.array(numbers[both % width] if len(both) else np.array([], np.int64)))
        return pa.table({"directory": docs["directory"], "doc": docs["doc"], "length": docs["length"], "ids": ids, "tfs": pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))})

    return held


def _terms(documents: DataFrame, words: DataFrame) -> DataFrame:
    """(directory, doc, length, terms): each document's tokens, and runs of them where phrases are asked."""
    runs = words.agg(F.collect_set(F.size(F.split("word", " ")))).first()[0]
    tokens = documents.select("directory", "doc", T.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return tokens.select("directory", "doc", F.size("tokens").cast("long").alias("length"), F.concat(*(_grams(n) for n in sorted(runs) or [1])).alias("terms"))


def _holdings(terms: DataFrame, words: DataFrame, whole: bool = False) -> DataFrame:
    """(directory, doc, length, ids, tfs): each document with what its terms hold of the words (directory, word, id) asked of its directory.

    A document's words stay in its row, and nothing is shuffled while the words
    are broadcast; beyond that documents and words meet by directory.
    """
    spark = terms.sparkSession
    chars = words.agg(F.sum(F.length("word") + F.length("directory"))).first()[0] or 0
    schema = "directory string, doc string, length long, ids array<long>, tfs array<long>"
    if chars <= BROADCAST_CHARS:
        asked = spark.sparkContext.broadcast(words.select("directory", "word", "id").toArrow())

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _counter(asked.value, whole)
            for batch in batches:
                yield from held(pa.Table.from_batches([batch])).to_batches()

        return terms.mapInArrow(count, schema)
    slots = terms.groupBy("directory").agg(F.ceil(F.count(F.lit(1)) / DOCS).cast("int").alias("slots"))  # one row a directory
    dealt = terms.join(slots, "directory").withColumn("slot", F.pmod(F.xxhash64("doc"), "slots").cast("int")).drop("slots")
    everywhere = words.join(slots, "directory").select("directory", "word", "id", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))

    def meet(docs: pa.Table, asked: pa.Table) -> pa.Table:
        return _counter(asked, whole)(docs)

    return dealt.groupBy("directory", "slot").cogroup(everywhere.groupBy("directory", "slot")).applyInArrow(meet, schema)


def _least(key: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest keys above 0, among equal ones the first."""
    at = np.nonzero(key > 0)[0]
    if len(at) <= k:
        return at
    edge = np.partition(key[at], -k)[-k]
    above = at[key[at] > edge]
    return np.append(above, at[key[at] == edge][: k - len(above)])


def _best(docs: pa.Table, asked: pa.Table, k: int, places: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(query_id, doc, score) of the best k among some documents of a directory, by score to so many places and document.

    The words of a question that many documents hold are added up once for all
    questions that share them. The documents that hold another of its words,
    and the k best by the shared ones, are then all that can be among its best:
    a further word only adds to a score.
    """
    order = pc.sort_indices(docs["doc"])
    docs = docs.take(order).combine_chunks()
    coded = docs["doc"].combine_chunks().dictionary_encode() if docs.num_rows else pa.array([], pa.string()).dictionary_encode()
    names, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)  # in order, a name once
    ids, row = _flat(docs["ids"].combine_chunks())
    tf, _ = _flat(docs["tfs"].combine_chunks())
    words, first = np.unique(asked["id"].to_numpy(), return_index=True)
    ids = ids.to_numpy(zero_copy_only=False)
    word = np.minimum(np.searchsorted(words, ids), len(words) - 1)
    keep = words[word] == ids
    word, row, tf = word[keep], row[keep], tf.to_numpy(zero_copy_only=False)[keep].astype(float)
    weight, mean = asked["weight"].to_numpy()[first], asked["mean_length"].to_numpy()[first]
    part = weight[word] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * docs["length"].to_numpy()[row] / mean[word])))
    by_word = np.argsort(word, kind="stable")
    held, part = number[row[by_word]], part[by_word]
    df = np.bincount(word, minlength=len(words))
    starts, n, unit = np.cumsum(df) - df, len(names), 10.0**places
    common = df > max(COMMON, n // SHARE)

    coded = asked["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    query, at, times = coded.indices.to_numpy(), np.searchsorted(words, asked["id"].to_numpy()), asked["times"].to_numpy()
    order = np.lexsort((at, query))
    query, at, times = query[order], at[order], times[order]
    asking, begin = np.unique(query, return_index=True)
    begin = np.append(begin, len(query))
    sharing: dict[bytes, list[int]] = {}
    for q in range(len(asking)):
        span = slice(begin[q], begin[q + 1])
        shared = common[at[span]]
        sharing.setdefault(np.stack([at[span][shared], times[span][shared]]).tobytes(), []).append(q)
    for said, questions in sharing.items():
        base = np.zeros(n)
        for w, m in np.frombuffer(said, dtype=np.int64).reshape(2, -1).T:
            base += np.bincount(held[starts[w] : starts[w] + df[w]], weights=part[starts[w] : starts[w] + df[w]] * m, minlength=n)
        leading = _least(np.floor(base * unit + 0.5) + (base > 0), k)
        of = np.array(questions)
        mine = _spans(begin[of], begin[of + 1] - begin[of])
        whose = np.repeat(np.arange(len(of)), begin[of + 1] - begin[of])
        rare = ~common[at[mine]]
        mine, whose = mine[rare], whose[rare]
        pairs = np.bincount(whose, weights=df[at[mine]], minlength=len(of)).astype(np.int64) + len(leading)
        group = (np.cumsum(pairs) - pairs) // PAIRS
        for low, high in zip(edges := np.unique(group, return_index=True)[1], [*edges[1:], len(of)]):
            here = (whose >= low) & (whose < high) if high - low < len(of) else slice(None)
            w, q = at[mine[here]], whose[here]
            spans = _spans(starts[w], df[w])
            key = np.append(np.repeat(q, df[w]) * n + held[spans], (np.arange(low, high)[:, None] * n + leading[None]).ravel())
            gain = np.append(part[spans] * np.repeat(times[mine[here]], df[w]), np.zeros((high - low) * len(leading)))
            met, place = np.unique(key, return_inverse=True)
            q, doc = np.divmod(met, max(1, n))
            score = base[doc] + np.bincount(place, weights=gain, minlength=len(met))
            order = np.lexsort((doc, -np.floor(score * unit + 0.5), q))
            q = q[order]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            chosen = order[nth < k]
            yield coded.dictionary.take(pa.array(asking[of[q[nth < k]]])), names.take(pa.array(doc[chosen])), score[chosen]


def best(documents: DataFrame, questions: DataFrame, k: int, places: int = 9) -> DataFrame:
    """(query_id, directory, doc, score, rank): the best k documents of each question's directory, as top() of bm25() gives them.

    For any number of questions: what documents hold, and the questions, meet
    in parts of a directory, each of which gives k rows a question; the pairs of
    questions and documents, which grow with the square, are never shuffled.
    """
    wanted = written(question_words(questions), "asked")
    numbered = written(wanted.select("word").distinct().withColumn("id", F.monotonically_increasing_id()), "words")
    words = wanted.select("directory", "word").distinct().join(numbered, "word")
    found = written(_holdings(_terms(documents, words), words), "found")
    held = found.groupBy("directory").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"), F.sum(F.size("ids")).alias("n_held"))
    seen = found.select("directory", F.explode("ids").alias("id")).groupBy("directory", "id").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = seen.join(held, "directory").select("directory", "id", "mean_length", F.when(weight > 0, weight).otherwise(F.lit(LEAST_WEIGHT)).alias("weight"))
    asked = wanted.join(numbered, "word").join(weighted, ["directory", "id"]).select("directory", "query_id", "id", "times", "weight", "mean_length")
    cuts = held.select("directory", F.greatest(F.lit(1), F.ceil(F.col("n_held") / HOLDINGS)).cast("int").alias("slots"))
    cuts = cuts.join(wanted.groupBy("directory").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("blocks")), "directory")  # one row a directory
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = found.where(F.size("ids") > 0).join(cuts, "directory").select("directory", F.pmod(F.xxhash64("doc"), "slots").cast("int").alias("slot"), every("blocks").alias("block"), "doc", "length", "ids", "tfs")
    right = asked.join(cuts, "directory").select("directory", every("slots").alias("slot"), F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), "query_id", "id", "times", "weight", "mean_length")
    schema = pa.schema([("query_id", pa.int64()), ("directory", pa.string()), ("doc", pa.string()), ("score", pa.float64())])

    def meet(key: tuple, docs: pa.Table, asked: pa.Table) -> pa.Table:
        parts = [pa.table([q, pa.repeat(key[0], len(q)), doc, pa.array(score)], schema=schema) for q, doc, score in _best(docs, asked, k, places)] if docs.num_rows and asked.num_rows else []
        return pa.concat_tables([schema.empty_table(), *parts])

    by = ["directory", "slot", "block"]
    scores = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "query_id long, directory string, doc string, score double")
    return top(scores, k, "query_id", "directory", places=places)


def _origins(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """(query_id, origin, docs) of what origins() brings together of one directory."""
    schema = pa.schema([("query_id", pa.int64()), ("directory", pa.string()), ("origin", pa.string()), ("docs", pa.list_(pa.string()))])
    kind = rows["kind"].to_numpy()
    docs, asked, ranked = (rows.take(pa.array(np.nonzero(kind == i)[0])).combine_chunks() for i in range(3))
    directory = rows["directory"][0].as_py()
    coded = pa.chunked_array([*docs["doc"].chunks, *ranked["doc"].chunks], pa.string()).combine_chunks().dictionary_encode()
    names = coded.dictionary
    number = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) % (len(names) + 1)  # a null doc is the last
    names, n = pa.concat_arrays([names, pa.nulls(1, pa.string())]), len(names) + 1
    ids, row = _flat(docs["ids"].combine_chunks() if docs.num_rows else pa.array([], pa.list_(pa.int64())))
    words, word = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
    posted, copies = np.unique(word * n + number[row], return_counts=True)  # documents of one name count together
    held, starts = posted % n, np.searchsorted(posted, np.arange(len(words) + 1) * n)

    coded = pa.chunked_array([*asked["query_id"].chunks, *ranked["query_id"].chunks], pa.int64()).combine_chunks().dictionary_encode(null_encoding="encode")
    code, asking = coded.indices.to_numpy(), coded.dictionary.to_pylist()

    def by_query(query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(query, kind="stable")
        return query[order], order

    asks, order = by_query(code[: asked.num_rows])
    wanted, times, least = (asked[c].to_numpy()[order] for c in ("id", "times", "all"))
    at = np.minimum(np.searchsorted(words, wanted), max(0, len(words) - 1))
    known = words[at] == wanted if len(words) else np.zeros(len(wanted), bool)
    logged, order = by_query(code[asked.num_rows :])
    listed = number[docs.num_rows :][order]
    edges = np.arange(len(asking) + 1)
    a, r = np.searchsorted(asks, edges), np.searchsorted(logged, edges)
    said: list[tuple[int, str]] = []
    lists: list[np.ndarray] = []

    def batch() -> pa.RecordBatch:
        ends = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
        paths = names.take(pa.array(np.concatenate(lists)))
        query, origin = zip(*said)
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array([directory] * len(said), pa.string()), pa.array(origin, pa.string()), pa.ListArray.from_arrays(ends, paths)], schema=schema)

    waiting = 0
    for i, query in enumerate(asking):
        count, most = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for j in np.arange(a[i], a[i + 1])[known[a[i] : a[i + 1]]]:
            span = slice(starts[at[j]], starts[at[j] + 1])
            count[held[span]] += copies[span] * times[j]
            most[held[span]] = np.maximum(most[held[span]], least[j])
        hit = (count > 0) & (count * 2 >= most)
        first = listed[r[i] : r[i + 1]]
        both = hit[first] & (first < n - 1) & (query is not None)  # nulls are no other's
        alone = hit.copy()
        alone[first[both]] = False
        for origin, found in (("both", first[both]), ("ranking", first[~both]), ("scan", np.nonzero(alone)[0])):
            if len(found):
                said.append((query, origin))
                lists.append(found)
                waiting += len(found)
        if waiting >= PAIRS // 8:
            yield batch()
            said, lists, waiting = [], [], 0
    if said:
        yield batch()


def origins(terms: DataFrame, wanted: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, directory, doc, origin): documents that hold half of a question's words (scan), that are ranked for it (ranking), or both.

    terms: (directory, doc, length, terms), each term of a document once; wanted:
    (query_id, directory, word, all), all the question's number of words; ranked:
    (query_id, directory, doc), once each. The three meet in parts of a directory;
    the pairs found grow with the square and are given where they are found.
    """
    asked = written(wanted.groupBy("query_id", "directory", "word").agg(F.count(F.lit(1)).alias("times"), F.max("all").cast("long").alias("all")), "asked")
    numbered = written(asked.select("word").distinct().withColumn("id", F.monotonically_increasing_id()), "words")
    found = written(_holdings(terms, asked.select("directory", "word").distinct().join(numbered, "word"), whole=True).where((F.size("ids") > 0) & F.col("directory").isNotNull()), "found")
    cuts = found.groupBy("directory").agg(F.ceil(F.sum(F.size("ids")) / HOLDINGS).cast("int").alias("slots"))  # one row a directory
    at = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(n, F.lit(1))).cast("int").alias("slot")
    no = lambda kind, c: F.lit(None).cast(kind).alias(c)
    left = found.join(cuts, "directory").select(F.lit(0).alias("kind"), "directory", at("doc", F.col("slots")), "doc", "ids", no("long", "query_id"), no("long", "id"), no("long", "times"), no("long", "all"))
    right = asked.join(numbered, "word").join(cuts, "directory").select(F.lit(1).alias("kind"), "directory", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), no("string", "doc"), no("array<long>", "ids"), "query_id", "id", "times", "all")
    listed = ranked.join(cuts, "directory", "left").select(F.lit(2).alias("kind"), "directory", at("doc", F.col("slots")), "doc", no("array<long>", "ids"), "query_id", no("long", "id"), no("long", "times"), no("long", "all"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _origins(pa.Table.from_batches(batches))

    met = left.unionByName(right).unionByName(listed).groupBy("directory", "slot").applyInArrow(meet, "query_id long, directory string, origin string, docs array<string>")
    return met.select("query_id", "directory", F.explode("docs").alias("doc"), "origin")


def top(scores: DataFrame, k: int, *by: str, places: int = 9) -> DataFrame:
    """The best k of each group, ties by document order; scores are compared to so many places."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("score", places)), "doc")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

"""A vault's files beyond its notes' links: what lies in the wrong place, what waits, what a search may see, and how well searches do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph

# Notes that belong at the root, the folders of a vault, the section of what was true once.
ROOT_NOTES = ("INDEX.md", "INSTRUCTIONS-CLAUDE.md", "BENCH.md", "LOG.md")
WIKI, LOG, INBOX, SETTINGS = "wiki", "LOG", "inbox", ".claude"
HISTORY = "Historique"
IMAGE = r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"
#: Longest quotation and longest hit that is shown, in characters.
QUOTE_CHARS, HIT_CHARS = 125, 160
#: Results of a search that count.
FIRST = 3


def _place(path: Column, n: int) -> Column:
    return F.get(F.split(path, "/"), F.lit(n))


def parasites(files: DataFrame) -> DataFrame:
    """(vault, path, kind) of files (vault, path, text) that do not belong where they are, a row for each reason.

    root_note: a note at the root that has no business there; unindexed: one
    directly in the wiki; nested: in a folder inside a layer; empty: nothing but
    front matter; settings: a machine's own configuration; log_link: a link in
    the journal. A null text is an empty one.
    """
    path, depth = F.col("path"), F.size(F.split("path", "/"))
    note, first = path.endswith(".md"), _place(path, 0)
    text = F.coalesce("text", F.lit(""))
    kinds = F.array(
        F.when(note & (depth == 1) & ~path.isin(*ROOT_NOTES), "root_note"),
        F.when(note & (depth == 2) & (first == WIKI), "unindexed"),
        F.when((depth > 3) & (first == WIKI) & _place(path, 1).isin(*graph.LAYERS) & note, "nested"),
        F.when(note & (T.strip(T.without_front_matter(text)) == ""), "empty"),
        F.when(first == SETTINGS, "settings"),
        F.when(note & (first == LOG) & text.rlike(r"\[\[[^\[\]]+\]\]"), "log_link"),
    )
    return files.select("vault", "path", F.explode(F.array_compact(kinds)).alias("kind"))


def ghosts(files: DataFrame) -> DataFrame:
    """(vault, path, target): images in the wiki's notes that are no file, neither beside the note nor from the root."""
    notes = files.where((_place(F.col("path"), 0) == WIKI) & F.col("path").endswith(".md"))
    folder = F.regexp_replace("path", "[^/]*$", "")
    shown = notes.select("vault", "path", folder.alias("folder"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(IMAGE), F.lit(1)))).alias("target")).where(~F.col("target").rlike("^[a-z][a-z0-9+.-]*:"))
    here = files.select("vault", F.col("path").alias("at"))
    beside = shown.join(here.withColumn("folder_target", F.col("at")), (shown["vault"] == here["vault"]) & (F.concat("folder", "target") == F.col("folder_target")), "left_anti")
    return beside.join(here, (beside["vault"] == here["vault"]) & (F.regexp_replace("target", "^/", "") == F.col("at")), "left_anti").select("vault", "path", "target")


def backlog(files: DataFrame) -> DataFrame:
    """(vault, path, bytes) of what waits in the inbox."""
    return files.where(_place(F.col("path"), 0) == INBOX).select("vault", "path", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))


def index_lines(texts: DataFrame) -> DataFrame:
    """(vault, slug, description) of an index's entries (vault, text): list lines that open with a link."""
    line = texts.select("vault", F.explode(T.lines(F.coalesce("text", F.lit("")))).alias("line")).where(F.col("line").rlike(r"^\s*- \[\[[^\[\]]+\]\]"))
    target = T.link_target(F.regexp_extract("line", r"\[\[([^\[\]]+)\]\]", 1))
    return line.select("vault", F.element_at(F.split(target, "/"), -1).alias("slug"), F.regexp_replace("line", r"^\s*- \[\[[^\[\]]+\]\](\s*—\s*)?", "").alias("description"))


def index_check(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """(vault, slug, gap): notes of the layers without an entry (hole), and entries without a note (dead)."""
    there = entries.select("vault", "slug").distinct().withColumn("there", F.lit(1))
    here = pages.where(F.col("layer").isin(*graph.LAYERS)).select("vault", "slug").distinct().withColumn("here", F.lit(1))
    both = here.join(there, ["vault", "slug"], "full").where("here is null or there is null")
    return both.select("vault", "slug", F.when(F.col("there").isNull(), "hole").otherwise("dead").alias("gap"))


def first_sentence(text: Column) -> Column:
    """A note's first sentence: of the first line behind front matter that is no heading and not blank."""
    body = F.filter(T.lines(T.without_front_matter(F.coalesce(text, F.lit("")))), lambda x: (T.strip(x) != "") & T.heading_title(x).isNull())
    return F.regexp_extract(F.coalesce(F.get(body, F.lit(0)), F.lit("")), r"^.*?(?:[.!?](?=\s|$)|$)", 0)


def complements(pages: DataFrame) -> DataFrame:
    """(vault, slug, parent): notes whose first sentence links to a note of the vault that does not link back."""
    opened = pages.select("vault", "slug", F.explode(F.regexp_extract_all(first_sentence(F.col("text")), F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))).alias("raw"))
    named = opened.select("vault", "slug", F.element_at(F.split(T.link_target(F.col("raw")), "/"), -1).alias("parent")).where("slug != parent").distinct()
    real = named.join(pages.select("vault", F.col("slug").alias("parent")).distinct(), ["vault", "parent"], "left_semi")
    back = graph.links(pages).select("vault", F.col("slug").alias("parent"), F.col("name").alias("slug"))
    return real.join(back, ["vault", "parent", "slug"], "left_anti").select("vault", "slug", "parent")


def current(sections: DataFrame) -> DataFrame:
    """Sections that say what holds now: what stands under the history's title is what held once."""
    return sections.where(F.lower(T.strip(F.col("section"))) != HISTORY.lower())


def in_scope(path: Column, archives: bool = False) -> Column:
    """Whether a plain search may look at a file: the wiki's, and the archives' if they are asked for; never the inbox."""
    first = _place(path, 0)
    return (first == WIKI) | (F.lit(archives) & (first == "archives"))


def neighbour(question: Column, folders: Column) -> Column:
    """(question, folder, asked): the question without its 'dans:' word, and the folder of that name, case aside; null if there is none."""
    asked = F.nullif(F.regexp_extract(question, r"(?:^|\s)dans:(\S+)", 1), F.lit(""))
    found = F.get(F.filter(folders, lambda f: F.lower(f) == F.lower(asked)), F.lit(0))
    return F.struct(T.collapse(F.regexp_replace(question, r"(?:^|\s)dans:\S+", " ")).alias("question"), found.alias("folder"), asked.alias("asked"))


def shown_quote(x: Column) -> Column:
    """Whether a quotation is short enough to be shown word for word."""
    return F.length(x) <= QUOTE_CHARS


def shown_hit(x: Column) -> Column:
    """A hit on one line, cut with an ellipsis."""
    flat = T.collapse(x)
    return F.when(F.length(flat) <= HIT_CHARS, flat).otherwise(F.concat(F.left(flat, F.lit(HIT_CHARS)), F.lit("…")))


def repair_verdict(claims: DataFrame, pieces: DataFrame) -> DataFrame:
    """(..., verdict) of claims (key, old, new) by the text of their piece (key, text).

    confirmed: the piece says the new value and not the old; stale: it says the
    old one, so what it told has changed since; undetermined: it says neither or
    both, or can't be read.
    """
    met = claims.join(pieces.select("key", T.fold(T.flat_quote(F.col("text"))).alias("_flat")), "key", "left")
    says = lambda c: F.coalesce(F.contains("_flat", T.fold(T.flat_quote(F.col(c)))), F.lit(False))
    verdict = F.when(says("new") & ~says("old"), "confirmed").when(says("old") & ~says("new"), "stale").otherwise("undetermined")
    return met.withColumn("verdict", verdict).drop("_flat")


def post_ingest(pages: DataFrame, touched: DataFrame) -> DataFrame:
    """(doc_id, kind) of what the notes touched (doc_id) have wrong, each kind once: dangling, ambiguous and false links, credentials, lessons without a sub-heading."""
    lessons = pages.where(F.col("layer") == "enseignements").where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"(?m)^[ \t]*###+( |$)"))
    checks = {"dangling": graph.dangling_links(pages), "ambiguous": graph.ambiguous_links(pages), "false": graph.false_links(pages), "secret": graph.secrets(pages), "one_block": lessons}
    found = reduce(DataFrame.unionByName, (rows.select("doc_id", F.lit(kind).alias("kind")) for kind, rows in checks.items()))
    return found.join(touched.select("doc_id"), "doc_id", "left_semi").distinct()


def existing(expected: DataFrame, pages: DataFrame) -> DataFrame:
    """Expected notes (question, vault, slug, ...) with gone: whether the note has vanished, so that its question can't count."""
    here = pages.select("vault", "slug").distinct().withColumn("_here", F.lit(1))
    return expected.join(here, ["vault", "slug"], "left").withColumn("gone", F.col("_here").isNull()).drop("_here")


def bench(expected: DataFrame, semantic: DataFrame, lexical: DataFrame, linked: DataFrame, first: int = FIRST) -> DataFrame:
    """(question, expected, semantic, lexical, hop, found): how each question fares.

    expected: (question, slug); semantic, lexical: (question, slug, nth);
    linked: (slug, to). semantic and lexical are the best ranks of an expected
    note among the first; hop tells whether one is a result or a link away from
    one; found how many of the expected ones any way finds.
    """
    best = lambda rows, name: rows.where(F.col("nth") <= first).groupBy("question", "slug").agg(F.min("nth").alias(name))
    results = semantic.where(F.col("nth") <= first).select("question", "slug")
    away = results.unionByName(results.join(linked, "slug").select("question", F.col("to").alias("slug"))).distinct().withColumn("hop", F.lit(True))
    met = expected.distinct().join(best(semantic, "semantic"), ["question", "slug"], "left").join(best(lexical, "lexical"), ["question", "slug"], "left").join(away, ["question", "slug"], "left")
    any_way = F.col("semantic").isNotNull() | F.col("lexical").isNotNull() | F.col("hop").isNotNull()
    return met.groupBy("question").agg(F.count(F.lit(1)).alias("expected"), F.min("semantic").alias("semantic"), F.min("lexical").alias("lexical"), (F.count("hop") > 0).alias("hop"), F.count_if(any_way).alias("found"))


def bench_line(by_question: DataFrame) -> DataFrame:
    """The one row of scores of what bench() gives: hits and mean ranks of both ways, one hop, coverage, and what the word search adds."""
    semantic, lexical = F.col("semantic"), F.col("lexical")
    return by_question.agg(
        F.count(F.lit(1)).alias("questions"),
        F.count("semantic").alias("semantic_hits"),
        F.round(F.avg("semantic"), 6).alias("semantic_rank"),
        F.count_if("hop").alias("hops"),
        F.count("lexical").alias("lexical_hits"),
        F.round(F.avg("lexical"), 6).alias("lexical_rank"),
        F.count_if(F.col("found") == F.col("expected")).alias("covered"),
        F.count_if(lexical.isNotNull() & semantic.isNull()).alias("lexical_only"),
        F.count_if(lexical < semantic).alias("lexical_better"),
    )


def real_line(expected: DataFrame, cited: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(questions, real, complete, empty) of answers: expected (question, slug), cited (question, slug), verdicts (question, verdict)."""
    met = expected.distinct().join(cited.distinct().withColumn("_cited", F.lit(1)), ["question", "slug"], "left")
    by_question = met.groupBy("question").agg(F.count(F.lit(1)).alias("n"), F.count("_cited").alias("found")).join(verdicts, "question", "left")
    return by_question.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("found") > 0).alias("real"), F.count_if(F.col("found") == F.col("n")).alias("complete"), F.count_if(F.col("verdict") == "rien-trouve").alias("empty"))


def worded_like(questions: DataFrame, notes: DataFrame) -> DataFrame:
    """Questions (question, slug, asked) that stand word for word in the note (slug, text) they should find: they measure nothing."""
    squeezed = lambda x: F.concat(F.lit(" "), F.array_join(T.tokens(F.coalesce(x, F.lit(""))), " "), F.lit(" "))
    return questions.join(notes.select("slug", squeezed(F.col("text")).alias("_said")), "slug").where((squeezed(F.col("asked")) != "  ") & F.contains("_said", squeezed(F.col("asked")))).select("question", "slug").distinct()

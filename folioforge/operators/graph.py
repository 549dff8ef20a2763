"""The notes as a graph: names, links, front matter, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import secrets as secrets_in
from ..functions import text as T

#: The layers in their order.
LAYERS = ("concepts", "entites", "syntheses", "enseignements", "sources")
LIVING, ORIGIN = LAYERS[:2], LAYERS[3:]
REQUIRED = ("type", "date", "auteur", "description")
FENCED = r"(?ms)^[ \t]*```.*?(?:^[ \t]*```[^\n]*|\z)"
IMPOSSIBLE = r'["{\[,]'
CONFLICT = r"( \(\d+\)\.md$)|conflit"
SECRET_PATH = r"(?i)(^|/)(\.env|\.[^/]*_token|[^/]*token[^/]*|[^/]*secret[^/]*|[^/]*credential[^/]*|[^/]*\.pem|[^/]*\.key|id_rsa[^/]*|[^/]*\.p12)$"


def notes(documents: DataFrame) -> DataFrame:
    """(doc_id, vault, layer, slug, directory, relative_path, text) of documents under <vault>/wiki/<layer>."""
    parts = F.split("directory", "/")
    return documents.select("doc_id", F.get(parts, F.lit(0)).alias("vault"), F.element_at(parts, -1).alias("layer"), T.slug(F.col("relative_path")).alias("slug"), "directory", "relative_path", "text")


def front_value(front: Column, name: str) -> Column:
    """A property's text in front matter, null without one."""
    return F.nullif(T.strip(F.regexp_extract(front, rf"(?m)^{name}:[ \t]*(.*)$", 1)), F.lit(""))


def fronts(pages: DataFrame, *names: str) -> DataFrame:
    """The notes' front matter properties; texts without closed front matter have none."""
    keep = [c for c in pages.columns if c != "text"]
    # exploding an array of one keeps an expression from being copied into each that uses it
    cut = pages.select(*keep, F.explode(F.array(T.lines(F.coalesce("text", F.lit(""))))).alias("ls"))
    front = F.array_join(F.slice("ls", 2, F.greatest(T.front_matter_lines(F.col("ls")) - 2, F.lit(0))), "\n")
    found = cut.select(*keep, F.explode(F.array(front)).alias("front"))
    return found.select(*keep, F.explode(F.array(F.struct(*(front_value(F.col("front"), n).alias(n) for n in names)))).alias("x")).select(*keep, "x.*")


def aliases(pages: DataFrame) -> DataFrame:
    """(vault, alias) of the names that front matter declares."""
    found = fronts(pages, "aliases").where("aliases is not null")
    return found.select("vault", F.explode(F.split(F.regexp_replace("aliases", r"[\[\]\"']", ""), ",")).alias("alias")).select("vault", F.trim("alias").alias("alias")).where("alias != ''").distinct()


def links(pages: DataFrame) -> DataFrame:
    """(doc_id, vault, layer, slug, raw, target, folder, name, impossible): links outside fenced code, one row each."""
    open_text = F.regexp_replace(F.coalesce("text", F.lit("")), FENCED, "")
    found = pages.select("doc_id", "vault", "layer", "slug", F.explode(F.regexp_extract_all(open_text, F.lit(r"\[\[(.*?)\]\]"), F.lit(1))).alias("raw"))
    target = found.withColumn("target", T.link_target(F.col("raw"))).withColumn("impossible", F.col("raw").rlike(IMPOSSIBLE))
    path = F.split("target", "/")
    return target.withColumn("name", F.element_at(path, -1)).withColumn("folder", F.when(F.size(path) > 1, F.element_at(path, -2)))


def names(pages: DataFrame) -> DataFrame:
    """(vault, slug, layers) of every name in a vault."""
    return pages.groupBy("vault", "slug").agg(F.array_sort(F.collect_set("layer")).alias("layers"))


def dangling_links(pages: DataFrame) -> DataFrame:
    """Links to no note and no alias of their vault; impossible targets aside."""
    real = links(pages).where(~F.col("impossible") & (F.col("target") != ""))
    known = names(pages).select("vault", F.col("slug").alias("name"), "layers")
    met = real.join(known, ["vault", "name"], "left").where(F.col("layers").isNull() | F.col("folder").isNotNull() & ~F.array_contains("layers", F.col("folder")))
    return met.join(aliases(pages).withColumnRenamed("alias", "target"), ["vault", "target"], "left_anti").select("doc_id", "vault", "target")


def ambiguous_links(pages: DataFrame) -> DataFrame:
    """Bare links to a name that several layers of the vault hold."""
    bare = links(pages).where(~F.col("impossible") & F.col("folder").isNull())
    return bare.join(names(pages).where(F.size("layers") > 1).withColumnRenamed("slug", "name"), ["vault", "name"]).select("doc_id", "vault", "name", F.array_join("layers", ",").alias("layers"))


def false_links(pages: DataFrame) -> DataFrame:
    return links(pages).where("impossible").select("doc_id", "raw")


def orphans(pages: DataFrame, layers: tuple[str, ...] = LIVING) -> DataFrame:
    """Pages of the living layers that no other note of the vault links to, by name or by folder and name."""
    inbound = links(pages).where(~F.col("impossible")).select("vault", F.col("name").alias("to_slug"), F.col("folder").alias("to_layer"), "layer", "slug")
    page = pages.where(F.col("layer").isin(*layers)).select("doc_id", F.col("vault").alias("v"), F.col("layer").alias("l"), F.col("slug").alias("s"))
    reached = (F.col("vault") == F.col("v")) & (F.col("to_slug") == F.col("s")) & (F.col("to_layer").isNull() | (F.col("to_layer") == F.col("l"))) & ~((F.col("slug") == F.col("s")) & (F.col("layer") == F.col("l")))
    return page.join(inbound, reached, "left_anti").select("doc_id", F.col("v").alias("vault"), F.col("l").alias("layer"), F.col("s").alias("slug"))


def one_way_links(pages: DataFrame) -> DataFrame:
    """Links between notes of a vault that are not returned."""
    edges = links(pages).where(~F.col("impossible")).select("vault", "slug", "name").where("slug != name").distinct()
    real = edges.join(pages.select("vault", F.col("slug").alias("name")).distinct(), ["vault", "name"], "left_semi")
    back = edges.select("vault", F.col("slug").alias("name"), F.col("name").alias("slug"))
    return real.join(back, ["vault", "slug", "name"], "left_anti").select("vault", "slug", "name")


def unpaired(pages: DataFrame) -> DataFrame:
    """Slugs of the two origin layers that have only one of their two notes."""
    sources = pages.where("layer = 'sources'").select("vault", "slug").distinct().withColumn("in_sources", F.lit(True))
    lessons = pages.where("layer = 'enseignements'").select("vault", "slug").distinct().withColumn("in_lessons", F.lit(True))
    both = sources.join(lessons, ["vault", "slug"], "full")
    return both.select("vault", "slug", F.coalesce("in_sources", F.lit(False)).alias("in_sources"), F.coalesce("in_lessons", F.lit(False)).alias("in_lessons")).where("in_sources != in_lessons")


def pairing_defects(pages: DataFrame) -> DataFrame:
    """(vault, slug, defect) of the two origin layers: no_source, no_lesson, no_origin (a source that names no piece), and source_unlinked, lesson_unlinked where both are there and one does not link to the other by folder and name."""
    both = pages.where(F.col("layer").isin(*ORIGIN)).groupBy("vault", "slug").agg(F.collect_set("layer").alias("layers"))
    across = links(pages).where(F.col("layer").isin(*ORIGIN) & F.col("folder").isin(*ORIGIN) & (F.col("layer") != F.col("folder")) & (F.col("name") == F.col("slug")))
    linked = across.groupBy("vault", "slug").agg(F.collect_set("layer").alias("linked"))
    named = fronts(pages.where("layer = 'sources'"), "origine").groupBy("vault", "slug").agg(F.max(F.col("origine").isNotNull()).alias("named"))
    met = both.join(linked, ["vault", "slug"], "left").join(named, ["vault", "slug"], "left")
    has = lambda c, layer: F.coalesce(F.array_contains(c, layer), F.lit(False))
    paired = has("layers", "sources") & has("layers", "enseignements")
    defects = F.array(
        F.when(~has("layers", "sources"), "no_source"),
        F.when(~has("layers", "enseignements"), "no_lesson"),
        F.when(paired & ~has("linked", "sources"), "source_unlinked"),
        F.when(paired & ~has("linked", "enseignements"), "lesson_unlinked"),
        F.when(has("layers", "sources") & ~F.coalesce("named", F.lit(False)), "no_origin"),
    )
    return met.select("vault", "slug", F.explode(F.array_compact(defects)).alias("defect"))


def front_defects(pages: DataFrame) -> DataFrame:
    """Notes whose front matter lacks a property, names another layer's type, or another day than the file's prefix."""
    found = fronts(pages, *REQUIRED, "origine", "question")
    lacks = [F.when(F.col(n).isNull(), n) for n in REQUIRED]
    lacks += [F.when(F.col("origine").isNull() & (F.col("layer") == "sources"), "origine"), F.when(F.col("question").isNull() & (F.col("layer") == "syntheses"), "question")]
    missing = F.array_join(F.array_compact(F.array(*lacks)), ",")
    singular = lambda c: F.regexp_replace(c, "s$", "")
    wrong_type = F.coalesce(singular(F.col("type")) != singular(F.col("layer")), F.lit(False))
    prefix = F.regexp_extract("slug", r"^(\d{4}-\d{2}-\d{2})-", 1)
    wrong_date = F.coalesce(F.col("layer").isin(*ORIGIN) & (prefix != "") & (F.col("date") != prefix), F.lit(False))
    return found.select("doc_id", "layer", missing.alias("missing"), wrong_type.alias("wrong_type"), wrong_date.alias("wrong_date"), "date").where("missing != '' or wrong_type or wrong_date")


def callouts(pages: DataFrame) -> DataFrame:
    """(doc_id, layer, kind, n, misplaced): callouts of a note by type, and whether its layer is the wrong place for them."""
    cut = pages.select("doc_id", "layer", F.explode(T.lines(F.coalesce("text", F.lit("")))).alias("line"))
    counted = cut.withColumn("kind", T.callout_type(F.col("line"))).where("kind is not null").groupBy("doc_id", "layer", "kind").agg(F.count(F.lit(1)).alias("n"))
    misplaced = (F.col("kind") == "question") & F.col("layer").isin(*ORIGIN) | (F.col("kind") == "warning") & (F.col("layer") == "sources")
    return counted.withColumn("misplaced", misplaced)


def same_names(pages: DataFrame) -> DataFrame:
    """(vault, page, other): pairs of living pages of a vault of which a name or alias is one but for case, accents, hyphens and final plural."""
    living = pages.where(F.col("layer").isin(*LIVING))
    page = F.concat_ws("/", "layer", "slug").alias("page")
    declared = fronts(living, "aliases").where("aliases is not null").select("vault", page, F.explode(F.split(F.regexp_replace("aliases", r"[\[\]\"']", ""), ",")).alias("name"))
    named = living.select("vault", page, F.col("slug").alias("name")).unionByName(declared).select("vault", "page", T.normal_name(F.trim("name")).alias("normal")).where("normal != ''").distinct()
    other = named.select("vault", "normal", F.col("page").alias("other"))
    return named.join(other, ["vault", "normal"]).where("page < other").select("vault", "page", "other").distinct()


def secrets(pages: DataFrame) -> DataFrame:
    """(doc_id, by_path, in_text): notes named like or holding credentials; values are not shown."""
    by_path, in_text = F.col("relative_path").rlike(SECRET_PATH), secrets_in.found_count(F.coalesce("text", F.lit("")))
    return pages.select("doc_id", by_path.alias("by_path"), in_text.alias("in_text")).where("by_path or in_text > 0")


def index_gaps(pages: DataFrame, index: DataFrame) -> DataFrame:
    """(directory, relative_path, gap): notes that an index lacks (hole), and entries without a note (dead)."""
    here = pages.select("directory", "relative_path").distinct().withColumn("here", F.lit(1))
    there = index.select("directory", "relative_path").distinct().withColumn("there", F.lit(1))
    both = here.join(there, ["directory", "relative_path"], "full").where("here is null or there is null")
    return both.select("directory", "relative_path", F.when(F.col("there").isNull(), "hole").otherwise("dead").alias("gap"))


def index_entries(pages: DataFrame) -> DataFrame:
    """The lines of a vault's index: '- [[slug]] — description' by layer and name."""
    found = fronts(pages, "description").where(F.col("layer").isin(*LAYERS))
    order = F.array_position(F.array(*(F.lit(x) for x in LAYERS)), F.col("layer"))
    return found.select("doc_id", "vault", order.cast("int").alias("layer_ord"), F.concat(F.lit("- [["), F.col("slug"), F.lit("]] — "), F.coalesce("description", F.lit(""))).alias("entry"))

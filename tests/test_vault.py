from pyspark.sql import functions as F

from folioforge.operators import graph as G
from folioforge.operators import vault as V

FILES = "vault string, path string, text string, kind int"


def listed(spark, *rows):
    """Files with a column whose name clashes with one inside the operators."""
    return spark.createDataFrame([("v", path, text, 1) for path, text in rows], FILES)


def test_parasites(spark):
    df = listed(spark, ("INDEX.md", "x"), ("perdue.md", "x"), ("wiki/libre.md", "x"), ("wiki/concepts/a/b.md", "x"), ("wiki/concepts/c.md", "---\nt: x\n---\n \n"), ("archives/d.md", None), (".claude/s.json", "{}"), ("LOG/2024.md", "[[a]]"), ("LOG/x.md", "a"), ("wiki/concepts/img/i.png", ""))
    want = {("perdue.md", "root_note"), ("wiki/libre.md", "unindexed"), ("wiki/concepts/a/b.md", "nested"), ("wiki/concepts/c.md", "empty"), ("archives/d.md", "empty"), (".claude/s.json", "settings"), ("LOG/2024.md", "log_link")}
    assert {(r.path, r.kind) for r in V.parasites(df).collect()} == want
    assert V.parasites(df.limit(0)).count() == V.ghosts(df.limit(0)).count() == V.backlog(df.limit(0)).count() == 0


def test_ghosts_and_backlog(spark):
    df = listed(spark, ("wiki/sources/a.md", "![](img/i.png) ![x](/m/j.png) ![y](non.png \"t\") ![z](https://x.y/k.png) ![](non.png)"), ("wiki/sources/img/i.png", None), ("m/j.png", None), ("archives/b.md", "![](q.png)"), ("inbox/c.md", "éa"), ("inbox/d.md", None))
    assert [(r.path, r.target) for r in V.ghosts(df).collect()] == [("wiki/sources/a.md", "non.png")]
    assert {(r.path, r.bytes) for r in V.backlog(df).collect()} == {("inbox/c.md", 3), ("inbox/d.md", 0)}


def pages(spark, *rows):
    return G.notes(spark.createDataFrame([(i, f"v/wiki/{layer}", f"{slug}.md", text) for i, (layer, slug, text) in enumerate(rows)], "doc_id long, directory string, relative_path string, text string"))


def test_index_and_complements(spark):
    df = pages(spark, ("concepts", "a", "Suite de [[m|mère]]. Voir [[b]]."), ("concepts", "b", "# T\n\nVoir [[a]]"), ("concepts", "m", "rien"), ("brouillon", "z", None))
    entries = V.index_lines(spark.createDataFrame([("v", "# I\n- [[concepts/a|x]] — dit\n  - [[perdu]]\n- sans\n* [[b]]"), ("v", None)], "vault string, text string"))
    assert {(r.slug, r.description) for r in entries.collect()} == {("a", "dit"), ("perdu", "")}
    assert {(r.slug, r.gap) for r in V.index_check(entries, df).collect()} == {("b", "hole"), ("m", "hole"), ("perdu", "dead")}
    assert [(r.slug, r.parent) for r in V.complements(df).collect()] == [("a", "m")]


def test_names_and_pairs(spark):
    df = pages(spark, ("concepts", "Docker", "---\naliases: [Les Conteneurs, 'x']\n---"), ("entites", "les-conteneur", None), ("concepts", "dockers", "x"), ("sources", "s", "---\norigine: p.pdf\n---\n[[enseignements/s]]"), ("enseignements", "s", "[[s]]"), ("sources", "t", None), ("enseignements", "u", ""))
    assert {(r.page, r.other) for r in G.same_names(df).collect()} == {("concepts/Docker", "concepts/dockers"), ("concepts/Docker", "entites/les-conteneur")}
    assert {(r.slug, r.defect) for r in G.pairing_defects(df).collect()} == {("s", "lesson_unlinked"), ("t", "no_lesson"), ("t", "no_origin"), ("u", "no_source")}
    assert G.same_names(df.limit(0)).count() == G.pairing_defects(df.limit(0)).count() == 0


def test_scope_and_shown(spark):
    df = spark.createDataFrame([("wiki/a.md",), ("archives/a.md",), ("inbox/a.md",), (None,)], "path string")
    assert [tuple(r) for r in df.select(V.in_scope(F.col("path")), V.in_scope(F.col("path"), True)).collect()] == [(True, True), (False, True), (False, False), (None, None)]
    asked = spark.createDataFrame([("que dit dans:VENTES le contrat",), ("dans:rien",), ("sans",)], "q string").select(V.neighbour(F.col("q"), F.array(F.lit("ventes"))).alias("n")).select("n.*").collect()
    assert [tuple(r) for r in asked] == [("que dit le contrat", "ventes", "VENTES"), ("", None, "rien"), ("sans", None, None)]
    shown = spark.createDataFrame([("a\n b",), ("x" * 200,), (None,)], "t string").select(V.shown_hit(F.col("t")).alias("t"), V.shown_quote(F.col("t")).alias("q")).collect()
    assert [(r.t and len(r.t), r.q) for r in shown] == [(3, True), (161, False), (None, None)]


def test_repair_and_bench(spark):
    claims = spark.createDataFrame([(i, "12 €", "15 €") for i in range(5)], "key int, old string, new string")
    texts = spark.createDataFrame([(0, "vaut 15 €"), (1, "vaut 12 €"), (2, "12 € ou 15 €"), (3, None)], "key int, text string")
    assert [r.verdict for r in V.repair_verdict(claims, texts).orderBy("key").collect()] == ["confirmed", "stale", "undetermined", "undetermined", "undetermined"]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    by = V.bench(frame([(1, "a"), (1, "b"), (2, "c")], "question int, slug string"), frame([(1, "x", 1), (1, "a", 4), (2, "d", 2)], "question int, slug string, nth int"), frame([(1, "a", 2), (2, "e", 1)], "question int, slug string, nth int"), frame([("x", "b")], "slug string, to string"))
    assert {r.question: (r.expected, r.semantic, r.lexical, r.hop, r.found) for r in by.collect()} == {1: (2, None, 2, True, 2), 2: (1, None, None, False, 0)}
    line = V.bench_line(by).first()
    assert (line.questions, line.semantic_hits, line.hops, line.lexical_hits, line.covered, line.lexical_only) == (2, 0, 1, 1, 1, 1)
    assert [r.question for r in V.worded_like(frame([(1, "a", "Le QUAI, nord"), (2, "a", "quai sud"), (3, "a", "")], "question int, slug string, asked string"), frame([("a", "voir le quai nord."), ("b", None)], "slug string, text string")).collect()] == [1]

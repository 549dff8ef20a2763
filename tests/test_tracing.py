from pyspark.sql import functions as F

from folioforge.operators import graph as G
from folioforge.operators import tracing as R
from folioforge.plans import tracing


def test_occurrences(spark):
    docs = spark.createDataFrame([(1, "Le Quai (a+b)\nrien\nle quai (A+B), le QUAI (a+b)"), (2, None), (3, "")], "id int, text string")
    assert [(r.key, r.line_no, r.times) for r in R.occurrences(docs, "id", "text", "quai (a+b)").orderBy("line_no").collect()] == [(1, 1, 1), (1, 3, 2)]


def test_chain(spark):
    rows = [(1, "v/wiki/sources", "a.md", "---\norigine: t.md\noriginal: p.pdf\n---"), (2, "v/wiki/sources", "b.md", "---\norigine: t.md\n---"), (3, "v/wiki/sources", "c.md", "x")]
    got = R.archive_chain(G.notes(spark.createDataFrame(rows, "doc_id long, directory string, relative_path string, text string"))).orderBy("doc_id").collect()
    assert [(r.doc_id, r.piece, r.kind) for r in got] == [(1, "p.pdf", "original"), (2, "t.md", "transcription")]


def test_in_pdf(spark):
    pages = spark.createDataFrame([("a", 1, "une première page"), ("a", 2, "la citation\nest ici"), ("b", 1, " ")], "path string, page int, text string")
    cases = [("a", "p. 2", "found"), ("a", "p. 1", "misplaced"), ("a", "p. 9", "out_of_range"), ("a", "", "unlocated"), ("b", "p. 1", "no_text"), ("z", "p. 1", "no_text")]
    found = spark.createDataFrame([(i, p, "la citation est", loc) for i, (p, loc, _) in enumerate(cases)] + [(9, "a", "jamais écrite", "p. 1")], "id int, path string, quote string, locator string")
    got = {r.id: r.status for r in R.in_pdf(found, pages, "path").collect()}
    assert got == {i: s for i, (_, _, s) in enumerate(cases)} | {9: "absent"}


def test_permutation_and_merge(spark):
    rows = lambda *xs: spark.createDataFrame([(1, x) for x in xs], "doc int, line string")
    assert R.same_lines(rows("a", "b", "b"), rows("b", "a", "b"), "doc").count() == 0
    assert [(r.line, r.missing, r.extra) for r in R.same_lines(rows("a", "b", "b"), rows("b", "a", "c"), "doc").orderBy("line").collect()] == [("b", 1, 0), ("c", 0, 1)]
    same = spark.createDataFrame([("v", "concepts/quai", "concepts/quais")], "vault string, page string, other string")
    links = spark.createDataFrame([(1, "v", "quais|les quais", "quais"), (2, "v", "quais", "quais"), (3, "v", "quai", "quai")], "doc_id long, vault string, raw string, name string")
    assert [r.replacement for r in R.merge_actions(same, links).orderBy("doc_id").collect()] == ["[[quai|les quais]]", "[[quai|quais]]"]


def test_waves(spark):
    found = [["a", "b"], ["b", "c"], ["c", "a"], ["d"]]
    search = lambda n: spark.createDataFrame([(x, 1.0) for x in found[n]], "path string, score double")
    assert sorted((r.path, r.wave) for r in R.waves(search, F.col("score") > 0.5).collect()) == [("a", 0), ("b", 0), ("c", 1)]


def test_waves_have_no_bound(spark):
    """The 23rd wave still brings a path, and the 24th none."""
    search = lambda n: spark.createDataFrame([(f"p{min(n, 22)}", 1.0)], "path string, score double")
    assert sorted((r.wave, r.path) for r in R.waves(search, F.col("score") > 0.5).collect()) == [(n, f"p{n}") for n in range(23)]


def test_living_duplicates_cross_the_indexes(spark, tmp_path):
    """No id is divisible by 100, and the pair lies in two indexes; other layers and vaults take no part."""
    places = [("v/wiki/concepts", "docker.md"), ("v/wiki/entites", "conteneurs.md"), ("v/wiki/concepts", "a.md"), ("v/wiki/concepts", "b.md"), ("v/wiki/entites", "c.md"), ("v/wiki/sources", "d.md"), ("w/wiki/entites", "e.md")]
    vectors = [[1.0, 0.0, 0.0], [0.99, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 0.99, 0.1], [0.0, 0.0, 1.0], [1.0, 0.0, 0.0], [1.0, 0.0, 0.0]]
    rows = [(101 + i, d, p, "s", v) for i, ((d, p), v) in enumerate(zip(places, vectors, strict=True))]
    spark.createDataFrame(rows, "stored_id long, directory string, path string, section string, vector array<float>").write.parquet(f"{tmp_path}/index_chunks.parquet")
    got = {(r.stored_id, r.other_id) for r in tracing.near_duplicate_living_pages(spark, str(tmp_path)).collect()}
    assert {(101, 102), (102, 101), (103, 104), (104, 103)} <= got and not {106, 107} & {x for pair in got for x in pair}

import math
import sqlite3

import duckdb
import oracle
import pytest

from folioforge.operators import lexical as L
from folioforge.plans import index as index_plans
from folioforge.plans import search as search_plans


def search(spark, files, question, k=5):
    docs = spark.createDataFrame([("d", name, text) for name, text in files], "directory string, doc string, text string")
    asked = spark.createDataFrame([(1, "d", question)], "query_id long, directory string, question string")
    return [(r.doc, r.score) for r in L.top(L.bm25(docs, asked), k, "query_id", "directory").orderBy("rank").collect()]


def test_rare_word_wins(spark):
    files = [(f"{i}.md", "projet projet projet") for i in range(5)] + [("rare.md", "projet kryptonite")]
    assert search(spark, files, "projet kryptonite")[0][0] == "rare.md"


def test_saturation_and_length(spark):
    files = [(f"f{i}.md", "autre " * 50) for i in range(5)] + [(f"k{n}.md", "kryptonite " * n + "mot " * (200 - n)) for n in (1, 10, 100)]
    s = dict(search(spark, files, "kryptonite"))
    assert s["k100.md"] - s["k10.md"] < s["k10.md"] - s["k1.md"]
    files = [("a.md", "kryptonite"), ("b.md", "kryptonite " + "mot " * 500), ("c.md", "x"), ("d.md", "y"), ("e.md", "z")]
    assert search(spark, files, "kryptonite")[0][0] == "a.md"


@pytest.mark.parametrize("text, question", [("Un dossier Élégant", "elegant"), ("des chatons partout", "chaton"), ("kryptonite", '"kryptonite" (NOT ceci) - où ?')])
def test_found(spark, text, question):
    assert [d for d, _ in search(spark, [("a.md", text), ("b.md", "rien")], question)] == ["a.md"]


def test_ties_and_top(spark):
    files = [(f"{i}.md", "kryptonite") for i in range(10)]
    assert [d for d, _ in search(spark, files, "kryptonite", 3)] == ["0.md", "1.md", "2.md"]


def test_shuffled_questions(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_CHARS", 0)
    assert [d for d, _ in search(spark, [("a.md", "un quai"), ("b.md", None), ("c.md", "quais")], "quai un_quai")] == ["a.md", "c.md"]


def test_empty(spark):
    assert search(spark, [("a.md", None), ("b.md", "")], "mot") == []
    assert search(spark, [("a.md", "mot")], "???") == []


def shuffled(spark):
    """Rows that the application's stages have shuffled so far."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(s.shuffleWriteRecords() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())))


def logged_search(spark, folder, questions=300, notes=300, word="quai"):
    """Tables in which every note holds a word of every question."""
    spark.createDataFrame([(i, "v/wiki/concepts", f"{i}.md", f"le {word} mot{i} {'mot ' * (i % 7)}") for i in range(notes)], "doc_id long, directory string, relative_path string, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, "v/wiki/concepts", f"le {word} mot{i}", f"{i}.md", 1) for i in range(questions)], "query_id long, directory string, question string, relative_path string, result_rank int").write.parquet(f"{folder}/lexical_results.parquet")
    return str(folder)


def test_pairs_are_not_shuffled(spark, tmp_path):
    folder = logged_search(spark, tmp_path)
    before = shuffled(spark)
    found = search_plans.bm25_top5(spark, folder).collect()
    assert len(found) == 1500 and {r.query_id for r in found if r["rank"] == 1 and r.doc == f"{r.query_id}.md"} >= set(range(100, 300))
    assert shuffled(spark) - before < 300 * 300 / 4


def test_bench_pairs_are_not_shuffled(spark, tmp_path):
    folder = logged_search(spark, tmp_path)
    before = shuffled(spark)
    assert index_plans.bench_scores(spark, folder).first().questions == 300
    assert shuffled(spark) - before < 300 * 300 / 4


def test_one_hop_pairs_are_not_shuffled(spark, tmp_path):
    folder = logged_search(spark, tmp_path)
    before = shuffled(spark)
    assert index_plans.bench_one_hop(spark, folder).count() >= 200
    assert shuffled(spark) - before < 300 * 300 / 4


def test_provenance_pairs_are_not_shuffled(spark, tmp_path):
    folder = logged_search(spark, tmp_path, word="relance")
    before = shuffled(spark)
    found = index_plans.provenance_both(spark, folder).groupBy("origin").count().collect()
    assert {r.origin: r["count"] for r in found} == {"both": 300, "scan": 300 * 299}
    assert shuffled(spark) - before < 300 * 300 / 4


@pytest.mark.parametrize("limits", [{}, {"BROADCAST_CHARS": 0, "HOLDINGS": 20, "PAIRS": 8}])
def test_provenance_of_odd_rows(spark, tmp_path, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(L, name, value)
    words = ["relance", "réserve", "comptable", "quai", "livraison", "dossier", "mandat"]
    notes = [(100 * len(d or "") + i, d, f"{i}.md", " ".join(words[i * j % 7] for j in range(1, i % 8)) or None) for d in ("a/b", "c/d/e", None) for i in range(25)]
    logged = [(None if i == 5 else i % 9, d, None if i == 7 else " ".join(words[(i + j) % 7] for j in range(i % 5)), None if i == 3 else f"{i}.md", i % 4) for d in ("a/b", "c/d/e", None, "absent") for i in range(28)]
    spark.createDataFrame(notes, "doc_id long, directory string, relative_path string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(logged, "query_id long, directory string, question string, relative_path string, result_rank int").write.parquet(f"{tmp_path}/lexical_results.parquet")
    base = duckdb.connect()
    for name in ("documents", "lexical_results"):
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = base.execute(index_plans.ORACLE["provenance_both"]).df()
    assert set(want["origin"]) == {"both", "scan", "ranking"}
    assert oracle.rows(index_plans.provenance_both(spark, str(tmp_path)).toPandas()) == oracle.rows(want)


@pytest.mark.parametrize("limits", [{}, {"BROADCAST_CHARS": 0, "DOCS": 7}, {"HOLDINGS": 50, "ASKED": 20}, {"COMMON": 2, "SHARE": 100, "PAIRS": 5}, {"COMMON": 10**6}])
def test_best_is_top_of_bm25(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(L, name, value)
    words = ["quai", "quais", "le", "l", "relance", "réserve", "comptable", "x1", "é"]
    docs = [(d, f"{i:02d}.md", " ".join(words[(i * j + i) % 9] for j in range(i % 11)) or None) for d in ("a", "b", None) for i in range(60)]
    asked = [(i, d, " ".join([words[i % 9], words[i * 5 % 9], "qu", "le_quai"][: 1 + i % 4])) for d in ("a", "b", "absent") for i in range(30)] + [(99, "a", "???"), (-1, "b", "l l l"), (None, "a", "quai")]
    docs, asked = spark.createDataFrame(docs, "directory string, doc string, text string"), spark.createDataFrame(asked, "query_id long, directory string, question string")
    rows = lambda df: sorted((str(r.query_id), r.directory, r["rank"], r.doc, round(r.score, 9)) for r in df.collect())
    want = rows(L.top(L.bm25(docs, asked), 3, "query_id", "directory"))
    assert len(want) > 100 and rows(L.best(docs, asked, 3)) == want


def test_best_of_nothing(spark):
    docs = spark.createDataFrame([("d", "a.md", None), ("d", "b.md", "mot")], "directory string, doc string, text string")
    for question in ("???", "absent"):
        assert L.best(docs, spark.createDataFrame([(1, "d", question)], "query_id long, directory string, question string"), 3).collect() == []


def test_same_as_fts5(spark):
    texts = ["la réserve comptable de la relance", "relance relance du quai", "le quai", "réservé au quai comptable " * 3, "", "zèbre à l'Épée", "comptabilité"] * 3
    files = [(f"{i:02d}.md", t) for i, t in enumerate(texts)]
    base = sqlite3.connect(":memory:")
    try:
        base.execute("create virtual table t using fts5(doc unindexed, body, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no fts5 here")
    base.executemany("insert into t values (?, ?)", files)
    for question in ("réserve relance", "quai comptable quai", "é z", "le la", "au_quai comp", "la_relance_du r", "_quai_ absent_x", "l_épee le"):
        match = " OR ".join(f'"{w}"*' for w in question.split())
        want = {d: -s for d, s in base.execute("select doc, bm25(t) from t where t match ?", (match,))}
        got = dict(search(spark, files, question, 100))
        assert got.keys() == want.keys()
        assert all(math.isclose(got[d], want[d], abs_tol=1e-6) for d in want)

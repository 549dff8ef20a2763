from folioforge.operators import graph as G
from folioforge.operators import hooks as H


def pages(spark, *rows):
    made = [(i, f"v/wiki/{layer}", f"{slug}.md", text) for i, (layer, slug, text) in enumerate(rows)]
    return G.notes(spark.createDataFrame(made, "doc_id long, directory string, relative_path string, text string"))


def test_links(spark):
    p = pages(
        spark,
        ("concepts", "a", '[[b]] et [[sources/s|texte]] [[nulle-part#x]] [[Alias]]\n```\n[[c]]\n```\n[[{"x": 1}]]'),
        ("entites", "b", "[[b]] rien"),
        ("sources", "s", "---\naliases: [Alias]\n---\n[[s]]"),
        ("enseignements", "s", "[[s]] [[sources/zzz]]"),
        ("concepts", "seule", None),
    )
    assert {r.target for r in G.dangling_links(p).collect()} == {"nulle-part", "sources/zzz"}
    assert [(r.name, r.layers) for r in G.ambiguous_links(p).collect()] == [("s", "enseignements,sources")] * 2
    assert G.false_links(p).count() == 1
    assert {r.slug for r in G.orphans(p).collect()} == {"a", "seule"}
    assert ("a", "b") in {(r.slug, r.name) for r in G.one_way_links(p).collect()}
    assert G.unpaired(p).count() == 0


def test_front_defects(spark):
    p = pages(
        spark,
        ("sources", "2024-01-02-x", "---\ntype: source\ndate: 2024-01-03\nauteur: A\ndescription: d\norigine: o\n---\n"),
        ("concepts", "y", "---\ntype: entite\ndate: 2024-01-03\nauteur: A\ndescription: d\n---\n"),
        ("concepts", "z", "sans"),
        ("concepts", "ok", "---\ntype: concept\ndate: d\nauteur: A\ndescription: d\n---\nx"),
    )
    got = {r.doc_id: (r.missing, r.wrong_type, r.wrong_date) for r in G.front_defects(p).collect()}
    assert got == {0: ("", False, True), 1: ("", True, False), 2: ("type,date,auteur,description", False, False)}


def test_names_secrets_callouts(spark):
    p = pages(spark, ("concepts", "Réserve-Comptables", "> [!warning] x"), ("entites", "reserve_comptable", "token: abc"), ("sources", "q", "> [!question] y\n> [!WARNING]- z"))
    assert G.same_names(p).count() == 1
    assert [(r.doc_id, r.in_text) for r in G.secrets(p).collect()] == [(1, 1)]
    assert {(r.doc_id, r.kind, r.misplaced) for r in G.callouts(p).collect()} == {(0, "warning", False), (2, "question", True), (2, "warning", True)}


def test_gate_and_map(spark):
    entries = spark.createDataFrame([("v", f"- [[n{i}]] — chantier commun") for i in range(20)] + [("v", "- [[x]] — vanne rarissime")], "vault string, entry string")
    asked = spark.createDataFrame([(1, "v", "où est la vanne ?"), (2, "v", "le chantier commun"), (3, "v", "rien de connu")], "query_id long, vault string, question string")
    assert [r.query_id for r in H.vocabulary_gate(asked, entries, "question", "vault").collect()] == [1]
    names = spark.createDataFrame([("v", 1, "concepts", f"note-{i:03d}") for i in range(300)] + [("v", 2, "sources", "seule")], "vault string, section_ord int, section string, slug string")
    text = H.condensed_map(names, 200).first()["map"]
    assert text.startswith("## concepts\nnote-000") and "autres)" in text and "seule" in text and len(text) < 240

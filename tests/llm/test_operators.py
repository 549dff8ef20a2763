import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import encode, leak, markup, neardup, neighbors, ocr, repeat, split, terms
from folioforge.llm.common import words
from folioforge.operators.chunking import ladder

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def docs(spark, *texts, ids=None):
    """Rows with columns whose names clash with those inside the operators."""
    rows = [(i if ids is None else ids[i], t, "x", 1, "y", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, term string, n long, stratum string, id double")


# 1: splitting


def test_split_equals_the_ladder_and_keeps_limits():
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a" * rng.randint(1, 30), "b" * rng.randint(1, 4000) if rng.random() < 0.03 else "c", " ", "\n", "\n\n", " d " * rng.randint(1, 40)]) for _ in range(rng.randint(1, 400))) for _ in range(150)]
    for text, pieces in zip(texts, split.split_texts(texts), strict=True):
        assert pieces == ladder(text) and all(len(p) <= 2000 for p in pieces)


def test_split_rows(spark):
    long = " ".join(f"mot{i}" for i in range(600))
    df = docs(spark, f"---\r\nx: 1\r\n---\r\navant\r\n# T\r\n{long}\r\n#pas un titre", None, "", "# seul", long, long)
    got = split.split_oversized(df, "doc_id", "text").orderBy("item_id", "section_ord", "piece_ord").collect()
    assert [(r.section_ord, r.section) for r in got if r.item_id == 0][:2] == [(0, None), (1, "T")]
    assert {r.item_id for r in got} == {0, 4, 5}
    for r in got:
        assert len(r.piece) <= 2000 and r.overlap_chars <= 201
    over = split.split_oversized(df, "doc_id", "text", oversized_only=True)
    assert {(r.item_id, r.section_ord) for r in over.collect()} == {(0, 1), (4, 0), (5, 0)}
    one = split.split_oversized(df, "doc_id", "text", "term").where("item_id = 4").collect()
    assert {r.section for r in one} == {"x"} and len(one) > 1
    assert split.split_oversized(df.limit(0), "doc_id", "text").count() == 0


# 2: markup

HAVE = [
    ("<p>a</p>", {"html"}), ("a <BR> b", {"html"}), ("x <!-- y", {"html"}), ("caf&eacute; &#39;", {"html"}), ("&amp;lt;", {"html"}),
    ("{{Note|x}}", {"wiki"}), ("== T ==", {"wiki"}), ("''x''", {"wiki"}), ("{|\n| a || b\n|}", {"wiki"}), ("[[Fichier:a.png|thumb]]", {"wiki"}), ("__TOC__", {"wiki"}),
    (r"\section{x}", {"latex"}), ("fin.\\footnote{x}", {"latex"}), ("$x_1 = 2$", {"latex"}), (r"\[ a \leq b \]", {"latex"}), (r"~\cite{x}", {"latex"}),
    ("```\n<p>a</p>\n```", set()), ("~~~\n{{x}}\n$a^2$", set()), ("voir `<br>` et ``&nbsp;``", set()), ("[[slug|texte]] [[a]]", set()), ("<https://x.example/1>", set()), ("<slug>.md <n>", set()),
    (r"C:\archives\note.md", set()), ("25 $ à 43 $", set()), ("R&D : a < 7 et b > 8, puis x == y", set()), ("**gras** _it_ # titre", set()), (None, set()), ("", set()),
    ("<b>x</b> $e^{2}$", {"html", "latex"}),
]


def test_markup_kinds_and_cleaning(spark):
    df = docs(spark, *(t for t, _ in HAVE), HAVE[0][0], ids=[*range(len(HAVE)), 0])
    items = markup.items_of(df, "documents", "doc_id", "term", "text")
    got = {(r.item_id, r.markup) for r in markup.found_markup(items).collect()}
    assert got == {(i, k) for i, (_, ks) in enumerate(HAVE) for k in ks}
    assert markup.found_markup(items).count() == len(got)
    assert markup.found_markup(items.limit(0)).count() == 0
    clean = {r.item_id: r.clean for r in markup.clean_items(items).collect()}
    assert clean[len(HAVE) - 3] is None and clean[16] == HAVE[16][0]


def test_clean_text():
    page = "<html><body><h2>Titre &amp; co</h2><ul><li>un</li><li>deux</li></ul><pre><code>x < 1\n</code></pre><table><tr><td>a</td><td>1</td></tr></table></body></html>"
    assert markup.clean_text(page) == "## Titre & co\n\n- un\n- deux\n\n```\nx < 1\n```\n\n| a | 1 |"
    assert markup.clean_text("== T ==\n'''gras''' {{Note|vu}} [[Catégorie:X]]__TOC__") == "## T\n**gras** vu"
    tex = markup.clean_text("\\section{T}\n\\begin{itemize}\n\\item a\n\\end{itemize}\n$x_1$ et \\emph{b}\\footnote{c}")
    assert "# T" in tex and "- a" in tex and "$x_1$" in tex and "*b* (c)" in tex and "\\" not in tex


def test_escaped_markup_leaves_no_tags():
    """Markup escaped once or more is markup still; comparisons, placeholders and code stay."""
    assert markup.clean_text("a &lt;p&gt;un&lt;/p&gt; &amp;lt;b&amp;gt;deux&amp;lt;/b&amp;gt; R&amp;D") == "a \n\nun\n\n **deux** R&D".replace(" \n", "\n")
    assert markup.clean_text("1 &lt; 2 et &lt;slug&gt; &amp;") == "1 < 2 et <slug> &"
    assert markup.clean_text("<code>&lt;p&gt;</code> &eacute;") == "`<p>` é"
    for text in ("&amp;" * 3 + "lt;br&gt;", "&lt;!-- x --&gt;y", "<p>&lt;div class=x&gt;z&lt;/div&gt;</p>"):
        assert not any(n[0] == "html" for n in markup.nodes(markup.Code(markup.clean_text(text)).text))


def test_importance_goes_up_the_tree(spark):
    """A frame whose parts are alike is unimportant, one that holds different texts is not, whatever its own presentation."""
    pages = [f"<div class=a><p class=b>menu</p></div><section><ul><li>{sentence(random.Random(i), 6)}</li></ul></section>" for i in range(30)]
    items = markup.items_of(docs(spark, *pages), "documents", "doc_id", "term", "text")
    tree = {r.path: r for r in markup.style_tree(markup.markup_nodes(items)).collect()}
    assert tree["div"].importance == tree["div>p"].importance == 0 and tree["div"].nodes == 30
    assert tree["section"].presentation == 0 and tree["section"].importance > 0.9 and tree["section>ul>li"].content > 0.99
    gone = markup.removed_branches(items).collect()
    assert {(r.path, r.look, r.pages) for r in gone} == {("div", "class=a", 30), ("div>p", "class=b", 30)}
    assert markup.removed_branches(items.limit(0)).count() == 0


def test_latex_content_is_the_whole_argument():
    """Long arguments with one opening differ; what follows an argument does not count."""
    same = "un long début " * 30
    digest = lambda text: markup.nodes(text)[0][5]
    assert digest(f"\\footnote{{{same}a}}") != digest(f"\\footnote{{{same}b}}")
    assert digest("\\caption{un\n{deux}}") != digest("\\caption{un\n{trois}}")
    assert digest("\\caption[c]{un} suite") == digest("\\caption[c]{un} autre")


def test_templates_over_lines_and_deep_nesting(spark):
    texts = ["{{Infobox\n| nom = x\n| lieu = y\n}}", "{{\nNote \r\n |vu}}", "{{a|" * 9 + "z" + "}}" * 9]
    items = markup.items_of(docs(spark, *texts), "documents", "doc_id", "term", "text")
    assert {(r.item_id, r.markup) for r in markup.found_markup(items).collect()} == {(i, "wiki") for i in range(3)}
    assert {r.item_id: r.clean for r in markup.clean_items(items).collect()} == {0: "x, y", 1: "vu", 2: "z"}


def test_style_tree_removes_what_all_pages_share(spark):
    pages = [f"<div>Menu du site</div><p>{sentence(random.Random(i), 9)}</p>" for i in range(20)]
    items = markup.items_of(docs(spark, *pages), "documents", "doc_id", "term", "text")
    rows = markup.clean_items(items).collect()
    assert all("Menu" not in r.clean and r.clean and r.removed_branches == 1 for r in rows)


def test_style_tree_keeps_content_at_any_size(spark):
    """Breaks, entities and commands of bounded variety stay; a frame goes, at 24 pages and at 600."""
    held = markup.clean_text(r"\documentclass{article}\begin{tabular}{lr}a & b\end{tabular}")
    for n in (24, 600):
        rng = random.Random(n)
        pages = [
            f"<div>Menu</div><p>rapport.<br>L'absence de {sentence(rng, 5)} &lt;&nbsp;x</p><section>{'oui' if i % 2 else 'non'}</section><aside>`c{i}`</aside>"
            if i % 4
            else r"\documentclass{article}\begin{tabular}{lr}a & b\end{tabular}"
            for i in range(n)
        ]
        df = docs(spark, *pages, *pages[:13])
        both = markup.items_of(df, "documents", "doc_id", "term", "text")
        rows = [r for r in markup.clean_items(both).collect() if r.item_id < n]
        framed = [r for r in rows if r.item_id % 4]
        assert all(r.removed_branches == 1 and "Menu" not in r.clean and "rapport.\nL'absence" in r.clean and "<\xa0x" in r.clean for r in framed)
        assert all(("oui" if r.item_id % 2 else "non") in r.clean and f"`c{r.item_id}`" in r.clean for r in framed)
        assert {r.clean for r in rows if not r.item_id % 4} == {held}


def test_style_tree_counts_pages_exactly(spark):
    pages = ["<div>Menu</div>"] * 11
    one = markup.items_of(docs(spark, *pages, *pages, ids=[*range(11)] * 2), "documents", "doc_id", "term", "text")
    assert all(r.removed_branches == 0 for r in markup.clean_items(one).collect())
    other = markup.items_of(docs(spark, pages[0], ids=[0]), "markdown_chunks", "doc_id", "term", "text")
    assert all(r.removed_branches == 1 for r in markup.clean_items(one.unionByName(other)).collect())


# 4: neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    x = np.concatenate([c + rng.normal(size=(12, 64)) * 0.25 for c in centres])
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]
    bad = [(2000, None), (2001, [0.0] * 64), (2002, [float("nan")] + [1.0] * 63), (2003, [1.0] * 32), (2004, [float("inf")] + [1.0] * 63), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows + bad], "stored_id long, vector array<float>, id int, cell string")
    ids = np.array([i for i, _ in rows])
    u = np.array([v for _, v in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want, near = set(), {}
    for a in range(len(u)):
        s = u @ u[a]
        s[a] = -2
        order = np.lexsort((ids, -s.round(6)))[:10]
        near[ids[a]] = set(ids[order].tolist())
        want |= {(min(ids[a], ids[b]), max(ids[a], ids[b])) for b in order if s[b] >= 0.92}
    got = {(r[0], r[1]) for r in neighbors.similar_pairs(df, "stored_id", "vector", 0.92).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    found = neighbors.nearest(df, "stored_id", "vector", asking="id % 10 = 0").collect()
    by = {}
    for r in found:
        assert r.id % 10 == 0 and r.id != r.neighbor
        by.setdefault(r.id, set()).add(r.neighbor)
    assert np.mean([len(by[i] & near[i]) / 10 for i in near if i % 10 == 0]) >= 0.9
    assert by[1010] == {7, *range(1000, 1009)}
    assert neighbors.nearest(df.limit(0), "stored_id", "vector").count() == 0


def test_dense_cells_in_blocks(spark, monkeypatch):
    """Blocks of vectors and of queries change nothing, and recall() counts what brute force wants."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=64) + rng.normal(size=(500, 64)) * 0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))] + [(7, x[7].tolist()), (900, None)], "stored_id long, vector array<float>")
    whole = {tuple(r) for r in neighbors.nearest(df, "stored_id", "vector").select("id", "neighbor").collect()}
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 9)
    monkeypatch.setattr(neighbors, "QUERY_ROWS", 200)
    cut = {tuple(r) for r in neighbors.nearest(df, "stored_id", "vector").select("id", "neighbor").collect()}
    assert len(cut) == 5000 and len(whole & cut) >= 4950
    measured = neighbors.recall(df, "stored_id", "vector", "id % 10 = 0").first()
    assert (measured.asked, measured.wanted) == (50, 500) and measured.found >= 490
    assert tuple(neighbors.recall(df.limit(0), "stored_id", "vector", "id % 10 = 0").first()) == (0, 0, 0)


def test_probes_grow_with_the_cells():
    """No fewer than 96, and more from 370 cells on."""
    assert [neighbors.probes_of(n) for n in (1, 124, 394, 1249, 3950)] == [96, 96, 100, 177, 315]


def test_quantisation_scan_is_close():
    rng = np.random.default_rng(2)
    x = neighbors.unit(rng.normal(size=(800, 64)))
    index = neighbors.Index.train(x, 8)
    home = neighbors._home(x, index.centroids)
    codes = index.encode(x, home)
    assert (neighbors.unpack_codes(neighbors.pack_codes(codes)) == codes).all()
    cell = np.flatnonzero(home == home[0])
    approx, exact = index.scan(x[:20], int(home[0]), codes[cell]), x[:20] @ x[cell].T
    assert np.corrcoef(approx.ravel(), exact.ravel())[0, 1] > 0.9


# 5: terms


def test_terms(spark):
    rare = ["zirconium " * 6 + "commun mot", "commun zirconium zirconium zirconium zirconium", *["commun mot"] * 30, None, "", "commun"]
    df = docs(spark, *rare)
    rows = {(r.doc_id, r.term): r for r in terms.term_scores(df, "doc_id", "text").collect()}
    assert rows[0, "zirconium"].tf == 6 and rows[0, "zirconium"].df == 2 and rows[0, "zirconium"].score > 0.9
    assert rows[0, "commun"].df == 33 and rows[0, "commun"].score < rows[0, "zirconium"].score
    assert {k[0] for k in rows} == {*range(32), 34}
    few = terms.term_scores(df, "doc_id", "text", min_tf=4, min_length=5, letters_only=True).collect()
    assert {(r.doc_id, r.term) for r in few} == {(0, "zirconium"), (1, "zirconium")}
    assert terms.term_scores(df.limit(0), "doc_id", "text").count() == 0


def test_two_poisson_separates():
    tf, n = np.array([1.0, 2, 8, 10]), np.array([50.0, 10, 5, 5])
    share, elite, other, score, converged = terms.fit_two_poisson(np.zeros(4, int), tf, np.zeros(4, int), n, np.ones(1), np.array([1000.0]))
    assert elite[0] > 5 > other[0] and (np.diff(score) >= 0).all() and score[0] < 0.1 < 0.9 < score[3] and converged.all()
    nothing = np.zeros(0)
    assert all(len(x) == 0 for x in terms.fit_two_poisson(nothing.astype(int), nothing, nothing.astype(int), nothing, np.ones(1), np.array([5.0])))


def test_length_weakens_a_count():
    """Of two equal counts the one in the longer record is less likely to be elite."""
    tf, at, n = np.array([1.0, 1, 5, 5, 6]), np.array([0, 1, 0, 1, 0]), np.array([60.0, 40, 4, 4, 9])
    _, exposure, records = terms.exposures([(0, 800, 800 * 60), (1, 200, 200 * 600)])
    *_, score, _ = terms.fit_two_poisson(np.zeros(5, int), tf, at, n, exposure, records)
    assert score[2] > score[3] and exposure[1] > exposure[0]


def test_only_elite_counts_are_distinctive(spark):
    """Frequent everywhere counts little by weight; without the posterior no count would be chosen."""
    df = docs(spark, *["partout " * 5 + f"mot{i}" for i in range(30)], "zirconium " * 5, "zirconium " * 4 + "fin")
    assert {tuple(r) for r in terms.distinctive_terms(df, "doc_id", "text", 4, 1, 40).collect()} == {(30, "zirconium"), (31, "zirconium")} | {(i, "partout") for i in range(30)}
    weight = {(r.doc_id, r.term): r.weight for r in terms.term_scores(df, "doc_id", "text", 4).collect()}
    assert weight[0, "partout"] < 0.5 < 2 < weight[30, "zirconium"]
    assert terms.distinctive_terms(df, "doc_id", "text", 4, 1, 40, elite=1.1).count() == 0


# 6: near duplicates


def brute_pairs(items):
    sets = {}
    for t, i, text in items:
        w = words(text)
        if i is not None and len(w) >= 20:
            sets[t, i] = set(zip(w, w[1:], w[2:]))
    return {(a[0], a[1], b[1]) for a, b in itertools.combinations(sorted(sets), 2) if a[0] == b[0] and 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}


def test_near_duplicates_are_exact(spark, monkeypatch):
    rng = random.Random(8)
    items = []
    for i in range(260):
        if i % 3 and items:
            w = rng.choice(items)[2].split()
            for _ in range(rng.randint(0, 8)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 2)] = [sentence(rng, 1)] * rng.randint(0, 2)
            text = " ".join(w) or "x"
        else:
            text = sentence(rng, rng.choice([19, 20, 30, 90, 500]))
        items.append((rng.choice("ab"), i, text))
    items += [("a", 900 + i, items[0][2].upper()) for i in range(6)] + [("a", None, items[0][2]), ("a", 950, None), ("a", 951, ""), ("a", 952, "court")]
    df = spark.createDataFrame([(*x, 1, "y") for x in items], "item_table string, item_id long, text string, fp long, list string")
    want = brute_pairs(items)
    assert {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()} == want and len(want) > 50
    assert neardup.near_duplicate_pairs(df.limit(0)).count() == 0


def test_copies_and_clusters_in_blocks(spark, monkeypatch):
    """Many copies of one text, and one text with many near copies, cut along both ends: same pairs, and each document's class."""
    rng = random.Random(2)
    base, far = sentence(rng, 60), sentence(rng, 40)
    items = [("a", i, base) for i in range(50)] + [("a", 100 + i, base + f" fin{i}") for i in range(40)] + [("a", 200, far), ("b", 1, base), ("a", 201, far + " x"), ("a", 202, "court")]
    df = spark.createDataFrame(items, "item_table string, item_id long, text string")
    for name, value in (("CLASS_ROWS", 7), ("CLUSTER_PAIRS", 20), ("CLUSTER_SHINGLES", 500), ("LIST_ROWS", 10)):
        monkeypatch.setattr(neardup, name, value)
    want = brute_pairs(items)
    assert {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()} == want
    rows = {(r.item_table, r.item_id): r for r in neardup.near_duplicate_classes(df).collect()}
    assert len(rows) == len(items) - 1 and len({r.class_id for r in rows.values()}) == 44
    assert (rows["a", 3].copies, rows["a", 3].links) == (49, 40) and (rows["a", 105].copies, rows["a", 105].links) == (0, 40)
    assert (rows["a", 200].links, rows["b", 1].copies, rows["b", 1].links) == (1, 0, 0)
    assert neardup.near_duplicate_classes(df.limit(0)).count() == 0


def test_hot_lists_in_blocks():
    rng = np.random.default_rng(1)
    lists, size = np.sort(rng.integers(0, 6, 400)), rng.integers(20, 60, 400)
    pos = rng.integers(0, 20, 400)
    order = np.lexsort((pos, size, lists))
    lists, size, pos = lists[order], size[order], pos[order]
    got = {(int(a), int(b)) for x, y in neardup.block_pairs(lists, size, pos, 0.6) for a, b in zip(x, y)}
    want = set()
    for a, b in itertools.combinations(range(400), 2):
        need, spare = math.ceil(0.375 * (size[a] + size[b]) - 1e-9), size[a] // 32
        if lists[a] == lists[b] and size[a] >= 0.6 * size[b] - 1e-9 and pos[a] <= size[a] - need + spare and pos[b] <= size[b] - need + spare:
            want.add((a, b))
    assert got == want


def test_overlaps_from_the_leader():
    rng = random.Random(4)
    sets = {i: set(rng.sample(range(60), 40)) for i in range(8)}
    pairs = list(itertools.combinations(range(8), 2))
    assert all(n == len(sets[a] & sets[b]) for a, b, n in neardup.overlaps(sets, pairs, 3))


# 7: scanned pages

PAGES = [
    "Recette technique — groupe X    7\n\nLe chantier valide la garan-\ntie du lot. Le sous-\ntraitant vient A4 en 2e.\nLa garantie du chan¬\n",
    "RECETTE TECHNIQUE — GROUPE X    8\n\ntier reste. La per1ode est finie et la garantie tient.\n",
    "Recette techniquc — groupe X    9\n\nLa periode du chantier commence. Le sous-traitant attend.\n",
    "Recette technique — groupe X    10\n\n" + "La periode technique du chantier. La recette technique. " * 12 + "\n",
]


def test_scans(spark):
    rows = [(1, PAGES, "d"), (2, [], "d"), (3, None, "d"), (4, ["", None, "  "], "d"), (5, ["[1]\n\ntexte seul"], "d"), (1, PAGES, "d"), (None, ["x"], "d")]
    df = spark.createDataFrame(rows, "response_id long, page_markdowns array<string>, word string")
    got = {tuple(r) for r in ocr.page_noise(df, "response_id", "page_markdowns").collect()}
    mine = {(p, n) for i, p, n in got if i == 1}
    assert {(p, "header") for p in range(4)} | {(p, "page_number") for p in range(4)} <= mine
    assert {p for p, n in mine if n == "hyphen"} == {0} and {p for p, n in mine if n == "misread"} == {1, 2}
    assert {(i, p, n) for i, p, n in got if i != 1} == {(5, 0, "page_number")}
    texts = ocr.repaired_responses(df, "response_id", "page_markdowns").collect()
    assert len(texts) == len(rows)
    text = next(r.text for r in texts if r.response_id == 1)
    assert "garantie du lot" in text and "sous-traitant vient A4 en 2e" in text and "chantier reste" in text and "periode est finie" in text and "groupe" not in text
    assert ocr.page_noise(df.limit(0), "response_id", "page_markdowns").count() == 0


def test_scans_split_and_merge(spark):
    """Words run together are cut, words with a blank too many joined, symbols read as letters; names and rare words stay."""
    usual = " ".join(["le contrat prévoit une garantie pour chaque livraison du chantier"] * 60)
    damaged = "Ici lecontrat pré voit une garan\ntie pour la livr@ison duchantier de Leconseil. Le sous-\ntraitant zirconium garde 0n mail a@b."
    rows = [(1, [usual, usual], "d"), (2, [usual, damaged], "d"), (3, ["le sous-traitant " * 40 + "on " * 40], "d")]
    df = spark.createDataFrame(rows, "response_id long, page_markdowns array<string>, word string")
    text = {r.response_id: r.text for r in ocr.repaired_responses(df, "response_id", "page_markdowns").collect()}[2]
    assert text.endswith("Ici le contrat prévoit une garantie pour la livraison du chantier de Leconseil. Le sous-traitant zirconium garde on mail a@b.")
    assert {(r.page_ord, r.noise) for r in ocr.page_noise(df, "response_id", "page_markdowns").collect()} == {(1, "misread")}


def test_readings_beyond_old_bounds():
    """Any number of doubtful digits, words of two letters, running lines deep in a page."""
    assert "bibliologies" in ocr.readings("6i6li0l09ie5") and ocr.doubtful("6i6li0l09ie5") and ocr.doubtful("0n")
    assert "l" * 12 + "a" in ocr.readings("1" * 12 + "a") and not any(map(ocr.doubtful, ("CO2", "3rd", "A4", "12", "x")))
    pages = [["Titre courant du rapport", "Service des archives", f"Volume trois", f"Imprimé à Lyon", "texte " + "abc"[k] * 9, "suite " + "xyz"[k] * 8, "fin " + "mno"[k], "a" + "pqr"[k], "b" + "stu"[k]] for k in range(3)]
    running = ocr.Running(pages)
    assert {i for p, i in running.header if p == 1} == {0, 1, 2, 3}


def all_readings(low):
    """A word's readings one by one, with the word itself."""
    if not low:
        return {""}
    first = ocr.LETTERS if low[0] in ocr.SYMBOLS else ocr.DIGITS.get(low[0], low[0])
    return {x + y for x in first for y in all_readings(low[1:])} | {right + y for wrong, right in ocr.SHAPES.items() if low.startswith(wrong) for y in all_readings(low[len(wrong) :])}


def test_readings_are_told_as_if_listed():
    rng = random.Random(2)
    for _ in range(400):
        low = "".join(rng.choice("crnivla10568") for _ in range(rng.randint(1, 7)))
        listed, told = all_readings(low) - {low}, ocr.readings(low)
        assert all(x in told and "".join(ocr.FOLDS.get(c, c) for c in x) == "".join(ocr.FOLDS.get(c, c) for c in low) for x in listed)
        assert not any(x in told for x in {"".join(rng.choice("crnivlaeumwdosbg") for _ in range(len(low))) for _ in range(50)} - listed)
    assert all(x in ocr.readings("a@b|c") for x in all_readings("a@b|c"))
    assert ocr.readings("rnornent").shapes("moment") == 2 and "a@b" not in ocr.readings("a@b") and "a1" not in ocr.readings("11")


@pytest.mark.parametrize("places", (ocr.BROADCAST_PLACES, 0))
def test_scans_any_number_of_confusions(spark, monkeypatch, places):
    """A dozen ones that are l and i in turn, several symbols and several shapes in a word, digits and symbols beside shapes."""
    monkeypatch.setattr(ocr, "BROADCAST_PLACES", places)
    usual = " ".join(["le chantier de commande garantie livraison moment illilliilllit"] * 40)
    damaged = "Ici 111111111111t, la g@r!ntie du ch@nt@er et la l@vr!ison au rnornent de c0rnrnande, g@r!ntic du rnorn@nt, cornrn@n!e."
    df = spark.createDataFrame([(1, [usual]), (2, [damaged])], "response_id long, page_markdowns array<string>")
    text = {r.response_id: r.text for r in ocr.repaired_responses(df, "response_id", "page_markdowns").collect()}
    assert text[1] == usual and text[2] == "Ici illilliilllit, la garantie du chantier et la livraison au moment de commande, garantie du moment, commande."


def test_steady_numbers_against_all_pairs():
    rng = random.Random(5)
    for _ in range(300):
        spots = [(rng.randrange(12), rng.randrange(14)) for _ in range(rng.randrange(14))]
        want = {(p, n) for p, n in spots if any(q != p and (v - n) * (q - p) >= 0 and abs(v - n) <= abs(q - p) and (v != n or abs(q - p) == 1) for q, v in spots)}
        assert ocr.steady_numbers(spots) == want


# 8: encoding


def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(encode.VOCABULARY)
    whole.encode_special_tokens = True
    rng = random.Random(2)
    texts = ["", None, "Bonjour l'été\r\n\t x", "<|endoftext|>", "🙂 кот 漢字  ", "a" * 5000, " " * 700 + "x", "\x1c\x85 　y"]
    texts += ["".join(rng.choice(s) for _ in range(rng.choice([9, 400, 3000]))) for s in ("ab", "eains ", "= -_", "09 ", "éàç漢к🙂")]
    df = docs(spark, *texts, texts[2])
    rows = encode.encode_texts(df, "doc_id", "text").collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = (texts + [texts[2]])[r.doc_id]
        assert r.ids == (whole.encode(t, add_special_tokens=False).ids if t else [])
    back = encode.decode_ids(encode.encode_texts(df, "doc_id", "text"), "doc_id", "ids").collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(texts + [texts[2]])}
    assert encode.encode_texts(df.limit(0), "doc_id", "text").count() == 0
    engine = encode.Encoder(encode.Merges.from_json(open(encode.VOCABULARY, "rb").read()))
    for t in texts:
        for size in (1, 7, 500):
            assert list(engine.stream([(t or "")[i : i + size] for i in range(0, len(t or ""), size)])) == engine.encode(t or "")


def test_lookahead_suffices_for_any_merge_list():
    rng = random.Random(6)
    for _ in range(400):
        tokens, merges = {0: b"a", 1: b"b", 2: b"c"}, []
        for _ in range(rng.randint(1, 12)):
            a, b = rng.choice(list(tokens)), rng.choice(list(tokens))
            if len(tokens[a] + tokens[b]) <= 8 and tokens[a] + tokens[b] not in tokens.values():
                merges.append((a, b, len(tokens)))
                tokens[len(tokens)] = tokens[a] + tokens[b]
        m = encode.Merges(tokens, merges)
        data = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 80)))
        stream, out = encode.RunStream(m), []
        stream.window = 1
        for i in range(len(data)):
            out += stream.feed(data[i : i + 1])
        assert out + stream.close() == m.whole(data)


# 9: leaks


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    items = [sentence(rng, 60) for _ in range(8)] + ["", None, "trop court"]
    texts = []
    for _ in range(80):
        body = sentence(rng, 40).split()
        w = rng.choice(items[:8]).split()
        n, at = rng.choice([11, 12, 13, 14, 30]), rng.randrange(30)
        body[20:20] = [x.upper() for x in w[at : at + n]]
        texts.append(",\n".join(body) if rng.random() < 0.5 else " ".join(body))
    texts += [None, "", texts[0], "mot " * 30000]
    df = docs(spark, *texts)
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, id int")
    grams = {}
    for i, t in enumerate(items):
        w = words(t)
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = set()
    for d, t in enumerate(texts):
        w = words(t)
        for k in range(len(w) - 12):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + 13]), ())}
    monkeypatch.setattr(leak, "HOT_ROWS", 3)
    monkeypatch.setattr(leak, "HOT_MARKS", 10**9)
    for limit in (leak.BROADCAST_CHARS, 0):
        found = leak.leaked_passages(df, "doc_id", "text", bench, "item_id", "text", broadcast_chars=limit).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want and all(r.n_words >= 13 for r in found)
    assert leak.leaked_passages(df.limit(0), "doc_id", "text", bench, "item_id", "text").count() == 0
    assert leak.leaked_passages(df, "doc_id", "text", bench.limit(0), "item_id", "text").count() == 0


# 10: repetition


def test_repetition(spark):
    rng = random.Random(3)
    texts = [sentence(rng, 200), "la même phrase revient toujours ici " * 20, sentence(rng, 40) + " " + "un deux trois quatre cinq six " * 4, None, "", "court court court", sentence(rng, 60)]
    df = docs(spark, *texts)
    rows = {r.doc_id: r for r in repeat.repetition(df, "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        w = words(t)
        grams = list(zip(*(w[k:] for k in range(5))))
        assert math.isclose(rows[i].repeated_share, 1 - len(set(grams)) / len(grams) if grams else 0.0)
    assert rows[0].compressed is None and repeat.repetition(df.limit(0), "doc_id", "text").count() == 0


def test_certified_cutoffs_decide(spark, monkeypatch):
    """Rows above the stated share come out where labels made by other measures certify it, and nowhere else."""
    rng = random.Random(3)
    monkeypatch.setattr(repeat, "COMPRESSED", 0.0)
    clean = [sentence(rng, 80) for _ in range(420)]
    again = [sentence(rng, 30) + " " + "la même phrase revient toujours ici. " * rng.randint(8, 20) for _ in range(30)]
    # repeated runs of words without sentences: these labels call them clean
    odd = [sentence(rng, 3) + " " + sentence(rng, 25) * 3 for _ in range(40)]
    rows = [(i, t, "a") for i, t in enumerate(clean + again)] + [(1000 + i, t, "b") for i, t in enumerate(clean[:370] + odd)] + [(2000, again[0], "c"), (2001, again[1], None), (2002, None, "c"), (None, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    cutoffs = {r.stratum: r for r in repeat.controlled_cutoffs(repeat.labelled_holdout(df, "doc_id", "text", "kind"), "repeated_share", "rejectable", "stratum").collect()}
    assert cutoffs["a"].cutoff == 0.30 and cutoffs["a"].bound <= repeat.RISK
    assert cutoffs["b"].cutoff is None or cutoffs["b"].cutoff > 0.30
    got = {r.doc_id for r in repeat.repetitive(df, "doc_id", "text", "kind").collect()}
    assert {i for i in got if i < 1000} == set(range(420, 450)) and not any(1000 <= i < 2000 for i in got)
    few = df.where("doc_id < 40")
    assert repeat.repetitive(few.unionByName(df.where("doc_id between 420 and 425")), "doc_id", "text", "kind").count() == 0
    assert repeat.repetitive(df.limit(0), "doc_id", "text", "kind").count() == 0


def test_exact_bounds_and_cutoffs(spark):
    assert math.isclose(repeat.upper_bound(0, 100, 0.05), 1 - 0.05**0.01, rel_tol=1e-6)
    assert repeat.upper_bound(5, 5, 0.05) == repeat.upper_bound(0, 0, 0.05) == 1.0
    n, p = 50, repeat.upper_bound(3, 50, 0.1)
    assert math.isclose(sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(4)), 0.1, rel_tol=1e-4)
    rows = [("a", i % 10 / 100, False) for i in range(1000)] + [("a", 0.5, True)] * 50 + [("b", 0.0, False)] * 5 + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "stratum string, score double, label boolean")
    got = {r.stratum: r for r in repeat.controlled_cutoffs(df, "score", "label", "stratum", (0.3, 0.2, 0.1, 0.05)).collect()}
    assert got["a"].cutoff == 0.1 and got["a"].bound <= repeat.RISK
    assert got["b"].cutoff == got[""].cutoff == got["*"].cutoff == 0.1 and got["b"].clean == 5 and got["*"].clean == 1008
    wrong = spark.createDataFrame([("a", 0.9, False)] * 50 + [("a", 0.0, False)] * 950, "stratum string, score double, label boolean")
    assert {r.cutoff for r in repeat.controlled_cutoffs(wrong, "score", "label", "stratum").collect()} == {None}
    assert repeat.controlled_cutoffs(wrong.limit(0), "score", "label", "stratum").count() == 0


def test_cutoffs_count_every_row(spark):
    """No row is left out of the labels, copies of an id included, and large counts have their exact bounds."""
    df = spark.range(21_000).select((F.col("id") % 7000).alias("doc_id"), F.concat(F.lit("mot "), F.col("id")).alias("text"), F.when(F.col("id") % 2 == 0, "*").otherwise((F.col("id") % 6).cast("string")).alias("kind"))
    held = repeat.labelled_holdout(df, "doc_id", "text", "kind")
    assert held.count() == held.where("compressed is not null").count() == 21_000
    rows = repeat.controlled_cutoffs(held, "repeated_share", "rejectable", "stratum").collect()
    assert sorted((r.stratum, r.clean) for r in rows) == [("*", 10_500), ("*", 21_000), ("1", 3500), ("3", 3500), ("5", 3500)]
    n, k = 30_000_000, 500_000
    p = repeat.upper_bound(k, n, 0.01)
    assert math.isclose(p, k / n + 2.3263 * math.sqrt(k / n * (1 - k / n) / n), rel_tol=1e-5)


def test_controlled_risk_holds():
    """Over many holdouts a cutoff rejects more than the risk hardly more often than the chance allows."""
    rng = np.random.default_rng(0)
    over = 0
    for _ in range(300):
        scores = rng.random(400) ** 3
        best = None
        for c in (0.999, 0.99, 0.98, 0.95, 0.9):
            if repeat.upper_bound(int((scores >= c).sum()), 400, 0.05) > 0.02:
                break
            best = c
        over += best is not None and 1 - best ** (1 / 3) > 0.02
    assert over / 300 <= 0.08


def test_registered_queries_run(spark, small):
    from folioforge.llm import queries

    assert set(queries.oracle_sql()) <= set(queries.queries())
    for name in ("p1_pieces", "p2_clean", "p5_model", "p7_text", "p9_passages", "p10_cutoffs"):
        assert queries.queries()[name](spark, small).count() > 0

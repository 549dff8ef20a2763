from datetime import datetime

from pyspark.sql import functions as F

from folioforge import verify
from folioforge.functions import text as T
from folioforge.operators import citations as C
from folioforge.operators import entries as E


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def anchors(spark, text):
    return [r.anchor for r in E.anchors(docs(spark, text), "id", "text").orderBy("line_no").collect()]


def test_anchor_forms(spark):
    assert anchors(spark, "- 2026-04-02 14:32 — a : x\n- vu le 2026-04-03 10:00") == [datetime(2026, 4, 2, 14, 32)]
    assert anchors(spark, "03/04/26, 9h05 x\n[25.04.2026 10:00] y") == [datetime(2026, 4, 3, 9, 5), datetime(2026, 4, 25, 10, 0)]
    assert anchors(spark, "04/13/2026 09:00 x\n04/02/2026 09:00 y") == [datetime(2026, 4, 13, 9), datetime(2026, 4, 2, 9)]
    assert anchors(spark, "## 2026-04-02\n09:30 a\n10h15 b\n# 2026-04-03\n25:00 c\n08:00 d") == [datetime(2026, 4, 2, 9, 30), datetime(2026, 4, 2, 10, 15), datetime(2026, 4, 3, 8)]
    assert anchors(spark, "2026-04-02 une entrée\n10:00 non") == [datetime(2026, 4, 2)]
    assert anchors(spark, "2026-13-45 10:00 x") == [] and anchors(spark, None) == [] and anchors(spark, "") == []


def test_order_breaks(spark):
    found = E.anchors(docs(spark, "2026-01-03 10:00 a\n2026-01-02 10:00 b\n2026-01-01 10:00 c", "2026-01-01 10:00 a\n2026-01-02 10:00 b"), "id", "text")
    rows = {r.key: r for r in E.order_breaks(found).collect()}
    assert (rows[0].breaks, rows[0].reversed) == (2, True) and (rows[1].breaks, rows[1].reversed) == (0, False)


def test_offset(spark):
    at = [datetime(2026, 1, 1, h) for h in (1, 2, 3, 5)]
    rows = lambda xs: spark.createDataFrame([(1, x) for x in xs], "key int, anchor timestamp_ntz")
    best = E.best_offset(rows(at), rows([x.replace(hour=x.hour + 2) for x in at[:3]])).first()
    assert (best.hours, best.common) == (2, 3)
    none = E.best_offset(rows(at), rows([datetime(2030, 1, 1)])).first()
    assert (none.hours, none.common) == (-12, 0)
    lost = E.difference(rows([*at, at[0]]), rows(at[1:]), "key", "anchor").collect()
    assert [(r.anchor, r.missing, r.extra) for r in lost] == [(at[0], 2, 0)]


NOTE = """### Titre
Texte.

> « La pièce modeste
> est complète. »

> [!source]- Jean Martin, 2024-01-01
> `wiki/sources/a.md` Ligne 3
> original `archives/a.pdf` p. 2

> [!warning] autre chose
"""


def test_citations(spark):
    row = C.citations(docs(spark, NOTE, None, ""), "id", "text").first()
    assert (row.line, row.quote, row.author) == (7, "La pièce modeste est complète.", "Jean Martin, 2024-01-01")
    assert (row.path, row.locator, row.original, row.original_locator) == ("wiki/sources/a.md", "Ligne 3", "archives/a.pdf", "p. 2")


def test_located(spark):
    cases = [
        ("a.md", "La pièce est complète", "Ligne 3", "found", 3),
        ("a.md", "La pièce est complète", "l. 2", "misplaced", 3),
        ("a.md", "La pièce est complète", "", "unlocated", 3),
        ("a.md", "La pièce est complète", "#titre", "anchor", 3),
        ("a.md", "jamais écrit ici", "Ligne 1", "absent", None),
        ("b.md", "La pièce est complète", "Ligne 3", "missing", None),
        ("a.md", "La pièce … suite", "Ligne 3", "found", 3),
        ("a.md", "suite de ligne … La pièce", "Ligne 4", "disordered", 4),
        ("a.md", "n° 12 | montant", "Ligne 5", "recomposed", 5),
        ("a.md", "…", "Ligne 3", "empty", None),
    ]
    found = spark.createDataFrame([(i, p, q, loc) for i, (p, q, loc, _, _) in enumerate(cases)], "id int, path string, quote string, locator string")
    pieces = spark.createDataFrame([("a.md", "# T\n\nLa “pièce” est".replace("“", "").replace("”", "") + "\ncomplète et\tsuite de ligne\nn° 12 ; total ; montant")], "path string, text string")
    pieces = pieces.withColumn("text", F.regexp_replace("text", "est\ncomplète", "est complète\nla"))
    done = {r.id: (r.status, r.start) for r in C.located(found, pieces, "path").collect()}
    for i, (_, _, _, status, start) in enumerate(cases):
        assert done[i] == (status, start), cases[i]


def test_pieces_in_decomposed_letters(spark):
    """Both forms of an accent are one; guillemets stay, typographic signs are unified."""
    found = spark.createDataFrame([(1, "a", "La réserve d’usage", ""), (2, "a", "«\u00a0mot\u00a0»", "")], "id int, path string, quote string, locator string")
    pieces = spark.createDataFrame([("a", "La re\u0301serve d'usage\n« mot »")], "path string, text string")
    assert {r.id: (r.status, r.start) for r in C.located(found, pieces, "path").collect()} == {1: ("unlocated", 1), 2: ("unlocated", 2)}
    row = spark.createDataFrame([("e\u0301\u0300 c\u0327 o\u0308 q\u0301",)], "t string").select(T.composed(F.col("t")).alias("t")).first()
    assert row.t == "é\u0300 ç ö q\u0301"


def test_recomposed_moves_on(spark):
    """A part that stands once answers once, and parts do not overlap."""
    cases = [("abcd;abcd;abcd", "un abcd ici", "absent"), ("prix du lot;lot de bois;bois brut", "le prix du lot de bois", "absent"), ("abcd;efgh", "efgh puis abcd", "recomposed"), ("abcd;efgh;ijkl", "abcd et ijkl", "recomposed")]
    found = spark.createDataFrame([(i, str(i), q, "") for i, (q, _, _) in enumerate(cases)], "id int, path string, quote string, locator string")
    pieces = spark.createDataFrame([(str(i), t) for i, (_, t, _) in enumerate(cases)], "path string, text string")
    assert {r.id: r.status for r in C.located(found, pieces, "path").collect()} == {i: s for i, (_, _, s) in enumerate(cases)}


def test_plain_attributions(spark):
    text = "**2024-01-02 — Anne Roy** — note\n\n> premier\n> second\n\n`sources/a.md` L12, original : `archives/a.pdf` p. 3\n\nphrase avec `code` sans citation\n> cité\n`sources/b.md` #titre"
    rows = C.citations(docs(spark, text, "> a\n> b > `x`\n`` ` ``"), "id", "text").orderBy("key", "line").collect()
    assert [(r.line, r.form, r.quote, r.author, r.path, r.locator, r.original, r.original_locator) for r in rows if r.key == 0] == [
        (6, "plain", "premier second", "Anne Roy", "sources/a.md", "L12", "archives/a.pdf", "p. 3"),
        (10, "plain", "cité", "", "sources/b.md", "#titre", None, ""),
    ]


def test_export_moments(spark):
    day = datetime(2024, 5, 1, 9, 30)
    assert E.export_moments('[{"Date": "2024-05-01T09:30:11Z", "in": {"date": "2020-01-01 10:00"}}, {"x": 1}, "2021-01-01 10:00"]') == [day]
    assert E.export_moments('{"a": {"b": [{"ts": "01/05/2024 9h30"}]}, "c": [[{"time": "n/a", "ts": "vu le 2024-05-01 09:30"}]]}') == [day, day]
    assert E.export_moments('{"timestamp": 17, "date": "2024-05-01"}') == [] and E.export_moments("{x") is None and E.export_moments("3") == []
    assert E.moment_of("05/13/2024 10:00") == datetime(2024, 5, 13, 10) and E.moment_of("2024-05-01 suite") == datetime(2024, 5, 1) and E.moment_of("2024-02-31 10:00") is None
    pieces = spark.createDataFrame([(1, "a.JSON", '[{"ts": "2024-05-01 09:30"}]'), (2, "b.json", '{"ts": 1}\n2024-05-01 09:30 a'), (3, "c.md", "2024-05-01 09:30 a"), (4, "d.json", None)], "id int, path string, text string")
    assert {(r.key, r.anchor, r.whole) for r in E.anchors_of(pieces, "id", "path", "text").collect()} == {(1, day, True), (2, day, True), (3, day, True)}


def test_continuity_and_projection(spark):
    at = [datetime(2024, 1, d) for d in range(1, 8)]
    rows = [("s", 1, "A", at[0], at[1]), ("s", 2, None, at[1], at[2]), ("s", 5, "B", at[0], at[1]), ("s", 6, None, at[5], at[6])]
    got = E.continuity(spark.createDataFrame(rows, "serie string, number int, author string, first timestamp_ntz, last timestamp_ntz"), "serie").orderBy("number").collect()
    assert [(r.missing, r.author, r.backward, r.overlap) for r in got] == [(0, "A", False, False), (0, "A", False, True), (2, "B", True, True), (0, "B", False, False)]
    entry = spark.createDataFrame([(at[0], "A", "un\n deux", ["x.png", None]), (at[0], None, None, None)], "m timestamp_ntz, a string, t string, f array<string>")
    assert [r[0] for r in entry.select(E.projected_entry(*map(F.col, "matf"))).collect()] == ["- 2024-01-01 00:00 — A : un deux [x.png]", "- 2024-01-01 00:00 —  : "]


def test_verifiers(spark, tmp_path):
    """Reports and codes of both verifiers over a vault on disk."""
    vault = tmp_path / "v"
    for folder in ("wiki/enseignements", "references", "sources", "archives/captures"):
        (vault / folder).mkdir(parents=True)
    (vault / "sources" / "a+b é.md").write_text("titre\nLa pièce est complète.\n", encoding="utf-8")
    (vault / "archives" / "a.txt").write_text("\n\nLa pièce est complète.\n", encoding="utf-8")
    good = "> « La pièce est complète. »\n\n> [!source] Jean\n> `sources/a+b é.md` Ligne 2\n> original `archives/a.txt` Ligne 3\n"
    note = vault / "wiki" / "enseignements" / "n.md"
    note.write_text(good, encoding="utf-8")
    assert verify.verify_citations(spark, str(vault)).code == verify.WELL
    note.write_text(good + "\n" + good.replace("Ligne 3", "Ligne 2") + "\n" + good.replace("archives/a.txt", "archives/captures") + "\n" + good.replace("a.txt", "../../hors.txt"), encoding="utf-8")
    report = verify.verify_citations(spark, str(vault))
    assert report.code == verify.FAULTS and [x.rpartition(" ")[2] for x in report.lines[:-1]] == ["misplaced", "series", "missing"]
    assert verify.verify_citations(spark, str(tmp_path / "z")).code == verify.WRONG and verify.verify_citations(spark, str(vault), [str(vault / "no.md")]).code == verify.UNCHECKED
    source, copy = tmp_path / "s.json", tmp_path / "c.md"
    source.write_text('[{"ts": "2024-05-01 08:30"}, {"ts": "2024-05-01 09:30"}]')
    copy.write_text("- 2024-05-01 10:30 a\n- 2024-05-01 11:30 b\n")
    whole = verify.verify_entries(spark, [str(source)], [str(copy)])
    assert whole.code == verify.WELL and any("+2 h" in x for x in whole.lines)
    copy.write_text("- 2024-05-01 10:30 a\n")
    assert verify.verify_entries(spark, [str(source)], [str(copy)]).code == verify.FAULTS
    assert verify.verify_entries(spark, [str(copy)], [str(source)], "2024-05-0[19]").code == verify.FAULTS
    assert [verify.verify_entries(spark, *x).code for x in (([],), ([str(tmp_path / "none")],), ([str(copy)], [], "("), ([str(copy)], [], "zzz"))] == [verify.WRONG, verify.WRONG, verify.WRONG, verify.UNCHECKED]


def test_derived(spark):
    rows = spark.createDataFrame([("wiki/sources/a.md",), ("x/A.OCR.md",), ("b.transcription.txt",), ("c.standardise.md",), ("archives/d.pdf",)], "p string")
    assert [r[0] for r in rows.select(C.derived(F.col("p"))).collect()] == ["note", "ocr", "transcription", "standardised", None]

import json
import zlib

import pytest
from pyspark.sql import functions as F

from folioforge.sources import corpus, pdf, transcripts, vault


def stream(data, extra=b""):
    packed = zlib.compress(data)
    return b"<< /Length %d /Filter /FlateDecode %s >> stream\n" % (len(packed), extra) + packed + b"\nendstream"


def make_pdf(objects):
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in objects.items()) + b"%%EOF"


CMAP = b"1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0003> <0062> endbfrange"
PDF = make_pdf(
    {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [4 0 R 3 0 R] /Count 2 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /X 9 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 8 0 R >>",
        4: b"<< /Type /Page /Parent 2 0 R /Contents 7 0 R >>",
        5: b"<< /Type /Font /Subtype /Type1 >>",
        6: b"<< /Type /Font /Subtype /Type0 /ToUnicode 10 0 R >>",
        7: stream(b"BT /F1 12 Tf 0 700 Td (Bonjour \\(vous\\)) Tj 0 -14 Td [(deux) -300 (mots)] TJ ET"),
        8: stream(b"q BT /F2 12 Tf <000100020003FFFF> Tj ET Q /X Do"),
        9: stream(b"BT /F1 9 Tf 0 10 Td (forme) Tj ET", b"/Type /XObject /Subtype /Form"),
        10: stream(CMAP),
        11: stream(bytes(200 * 200 * 3), b"/Subtype /Image /Width 200 /Height 200 /BitsPerComponent 8 /ColorSpace /DeviceRGB"),
        12: b"<< /Subtype /Image /Width 300 /Height 300 /Filter /DCTDecode >> stream\nJPEGDATA\nendstream",
        13: stream(b"x", b"/Subtype /Image /Width 10 /Height 10"),
        14: b"<< /Type /Sig /Name (Jean) /Reason (Accord) /M (D:20240102030405Z) /ByteRange [0 10 20 30] >>",
        15: b"<< /FT /Sig /T (vide) >>",
    }
)


def files(spark, *raws):
    return spark.createDataFrame([(f"{i}.pdf", len(r) if r else 0, r) for i, r in enumerate(raws)], "path string, length long, content binary")


def test_pdf(spark):
    pages = pdf.pdf_pages(files(spark, bytearray(PDF), bytearray(b"no pdf"), None)).orderBy("path", "page").collect()
    assert [(p.path, p.page, p.text) for p in pages] == [("0.pdf", 1, "Bonjour (vous)\ndeux mots"), ("0.pdf", 2, "Abc�\nforme")]
    assert (pages[1].drawn, pages[1].known) == (9, 8)
    pics = pdf.pdf_images(files(spark, bytearray(PDF))).orderBy("object").collect()
    assert [(p.object, p.kind) for p in pics] == [(11, "png"), (12, "jpg"), (13, "small")] and bytes(pics[0].file[:4]) == b"\x89PNG"
    signed = pdf.pdf_signatures(files(spark, bytearray(PDF))).orderBy("object").collect()
    assert [(s.object, s.signed, s.name, s.date, s.whole) for s in signed] == [(14, True, "Jean", "2024-01-02 03:04:05 UTC", False), (15, False, "", "", False)]


def test_pdf_matrices_and_maps(spark):
    """Lines by the page's and the text's scale, ranges that list their texts, objects inside object streams, images of other colour spaces."""
    inner = b"20 0 21 40 << /Type /Font /Subtype /Type1 >>         << /Subtype /Type0 /ToUnicode 22 0 R >>"
    first = inner.index(b"<<")
    packed = zlib.compress(inner.replace(b"20 0 21 40 ", b"20 0 21 %d " % (inner.index(b"<< /Subtype") - first)))
    file = make_pdf(
        {
            1: b"<< /Type /Catalog /Pages 2 0 R >>",
            2: b"<< /Type /Pages /Kids [3 0 R 3 0 R] >>",
            3: b"<< /Type /Page /Contents [4 0 R] /Resources << /Font << /A 20 0 R /B 21 0 R >> >> >>",
            4: stream(b"0.1 0 0 0.1 0 0 cm BT /A 1 Tf 1 0 0 1 0 700 Tm (un) Tj 0 -4 Td (e) Tj 0 -90 Td (deux % \\(x\\) \\351) Tj T* ET BI /W 1 ID (z) Tj EI q 1 0 0 5 0 0 cm BT /B 2 Tf 1 0 0 3 0 50 Tm <00010002> Tj 0 -1 Td <0003> Tj ET Q"),
            5: b"<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >> stream\n" % (first, len(packed)) + packed + b"\nendstream",
            22: stream(b"2 beginbfrange <0001> <0002> [<0058> <00590059>] <0003> <0003> <005A> endbfrange"),
            30: stream(bytes(300 * 200), b"/Subtype /Image /Width 300 /Height 200 /ColorSpace [/ICCBased 31 0 R]"),
            31: b"<< /N 1 >>",
            32: stream(bytes(300 * 200 * 4), b"/Subtype /Image /Width 300 /Height 200 /ColorSpace /DeviceCMYK"),
            33: b"<< /Subtype /Image /Width 300 /Height 200 /ImageMask true >> stream\nx\nendstream",
            34: b"<< /Type /Sig /SubFilter /adbe.x /ByteRange [0 1 2 9999999] /M (D:2024) >>",
            35: b"<< /Type /Sig /ByteRange [0 1 2 3] /Name <FEFF00C9> >>",
        }
    )
    pages = pdf.page_texts(file)
    assert [p[0] for p in pages] == ["une\ndeux % (x) é\nXYY\nZ"]
    assert [(n, kind) for n, kind, *_ in pdf.images(file)] == [(30, "png"), (32, "failed")]
    assert [(s[0], s[2], s[6], s[7], s[8]) for s in pdf.signatures(file)] == [(34, "", "2024-01-01 00:00:00", "adbe.x", True), (35, "É", "", "", True)]
    for cut in range(0, len(file), 97):
        pdf.page_texts(file[:cut]), pdf.images(file[:cut]), pdf.signatures(file[:cut])


def test_text_status(spark):
    rows = [("a", "x" * 500, 100, 100), ("b", "x" * 100, 10, 10), ("c", "x" * 250, 9, 9), ("c", "", 0, 0), ("d", "x" * 900, 100, 90)]
    pages = spark.createDataFrame(rows, "path string, text string, drawn int, known int")
    assert {r.path: r.status for r in pdf.text_status(pages).collect()} == {"a": "ok", "b": "no_text", "c": "sparse", "d": "glyphs"}


def test_turns(spark):
    lines = [
        {"type": "user", "message": {"role": "user", "content": "bonjour token: abc"}},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "un"}, {"type": "tool_use"}, {"type": "text", "text": "deux"}]}},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use"}]}},
        {"type": "user", "message": {"role": "user", "content": "<system-reminder>x"}},
        {"type": "summary", "message": None},
    ]
    raw = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)] + [(9, "{broken"), (10, None)], "line_no int, value string")
    got = transcripts.turns(raw).orderBy("line_no").collect()
    assert [(r.role, r.said) for r in got] == [("user", "bonjour token: [secret masqué par le hook]"), ("assistant", "un\ndeux")]
    note = transcripts.session_notes(transcripts.turns(raw).withColumn("session", F.lit("s"))).first()
    assert note.turns == 2 and note.note.startswith("## user\n\nbonjour")


def test_corpus_order_and_routes(spark, tmp_path):
    for name in ("a-b.md", "a/b.md", "c.md", "d.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("corps", encoding="utf-8")
    assert [r.relative_path for r in corpus.read_corpus(spark, str(tmp_path)).orderBy("doc_ord").collect()] == ["a/b.md", "a-b.md", "c.md"]
    rows = spark.createDataFrame([("x.pdf", "ok"), ("x.pdf", "no_text"), ("scan.JPG", None), ("capture-1.png", None), ("t.csv", None), ("t.docx", None), ("a.zip", None), ("v.mp4", None), ("quoi.xyz", None)], "n string, s string")
    assert [r[0] for r in rows.select(corpus.route(F.col("n"), F.col("s"))).collect()] == ["text_layer", "ocr", "ocr", "visual", "as_is", "convert", "expand", "out_of_scope", "unknown"]
    asked = corpus.ocr_requests(spark.createDataFrame([("a.pdf", 3, bytearray(b"abc")), ("b.doc", 1, bytearray(b"x"))], "path string, length long, content binary")).orderBy("path").collect()
    assert asked[0].payload.type == "document_url" and asked[0].payload.uri == "data:application/pdf;base64,YWJj" and asked[1].refusal == "kind"
    sliced = corpus.sliced(spark.createDataFrame([(1, i, "x" * 9) for i in range(30)], "k int, n int, t string"), "k", "n", "t", 100)
    assert sliced.groupBy("slice").count().orderBy("slice").collect()[0]["count"] == 10


def test_vault_resolution(tmp_path):
    """The nearest configuration above counts; what is missing is named; a scaffold changes nothing that is there."""
    made = vault.scaffold(str(tmp_path / "v"), {"INDEX.md": "# INDEX", vault.MARKER: "x"})
    assert "wiki/sources" in made and vault.scaffold(str(tmp_path / "v"), {"INDEX.md": "autre"}) == []
    assert (tmp_path / "v" / "INDEX.md").read_text() == "# INDEX"
    with pytest.raises(vault.VaultError):
        vault.scaffold(str(tmp_path / "v"), {"../x.md": ""})
    deep = tmp_path / "p" / "a" / "b"
    deep.mkdir(parents=True)
    with pytest.raises(vault.VaultError):
        vault.resolve(str(deep), "nirgends/x")
    config = tmp_path / "p" / vault.CONFIG
    config.parent.mkdir()
    for text, good in (("", False), (str(tmp_path / "none"), False), (str(tmp_path), False), (f"\ufeff{tmp_path / 'v'} \r\nreste", True)):
        config.write_text(text, encoding="utf-8")
        if good:
            assert vault.resolve(str(deep)) == str((tmp_path / "v").resolve())
        else:
            with pytest.raises(vault.VaultError):
                vault.resolve(str(deep))

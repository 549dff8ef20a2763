import json
import math
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge import api, providers
from folioforge.operators import semantic as V
from folioforge.sources import index_store


def stored(spark, *rows):
    return spark.createDataFrame([("d", p, s, i, [x, math.sqrt(1 - x * x)]) for i, (p, s, x) in enumerate(rows)], "directory string, path string, section string, ord long, vector array<float>")


def asked(spark):
    return spark.createDataFrame([(1, [1.0, 0.0])], "query long, vector array<float>")


def test_ranking(spark):
    rows = stored(spark, ("a", "1", 0.9), ("a", "2", 0.8), ("b", "1", 0.7), ("c", "1", 0.6))
    got = lambda k, per: [(r.path, r.section) for r in V.ranked(rows, asked(spark), k, per).orderBy("rank").collect()]
    assert got(2, True) == [("a", "1"), ("b", "1")]
    assert got(3, True) == [("a", "1"), ("b", "1"), ("c", "1")]
    assert got(2, False) == [("a", "1"), ("a", "2")]


def test_ties_nulls_and_lengths(spark):
    rows = spark.createDataFrame([("d", f"p{i}", "s", i, v) for i, v in enumerate([[1.0, 0.0], [2.0, 0.0], None, [0.0, 0.0], [float("nan"), 1.0], [1.0], []])], "directory string, path string, section string, ord long, vector array<float>")
    best = V.ranked(rows, asked(spark), 9).orderBy("rank").collect()
    assert [(r.ord, r.score) for r in best] == [(0, 1.0), (1, 1.0), (5, 1.0), (3, 0.0), (6, 0.0)]


def test_more_queries_than_a_block(spark):
    """No number of queries is refused: 10,001 of them over two directories, more than one block of each."""
    angle = lambda a: [math.cos(a), math.sin(a)]
    rows = spark.createDataFrame([(f"d{i % 2}", f"p{i // 4}", "s", i, angle(i / 3000)) for i in range(4600)], "directory string, path string, section string, ord long, vector array<float>")
    many = spark.range(10_001).selectExpr("id as query", "array(float(cos(id % 4600 / 3000)), float(sin(id % 4600 / 3000))) as vector")
    best = V.ranked(rows, many, 2).cache()
    assert best.count() == 10_001 * 2 * 2 and best.select("query", "directory").distinct().count() == 10_001 * 2
    x = np.array([angle(i / 3000) for i in range(4600)], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    for q in (0, 17, 2301, 9999):
        s = (x @ x[q % 4600]).round(4)
        for d in (0, 1):
            of = {}
            for i in sorted(range(d, 4600, 2), key=lambda i: (-s[i], i)):
                of.setdefault(i // 4, (i, s[i]))
            want = sorted(of.values(), key=lambda v: (-v[1], v[0]))[:2]
            assert [(r.ord, r.score) for r in best.where(f"query = {q} and directory = 'd{d}'").orderBy("rank").collect()] == want
    one = V.ranked(rows, many.withColumn("directory", F.lit("d1")), 2)
    assert one.exceptAll(best.where("directory = 'd1'")).count() == 0 and one.count() == 10_001 * 2


def test_contract(spark):
    meta = spark.createDataFrame([("a", "p", "m", 64, 1), ("b", "p", "m2", 64, 1), ("c", "p", "m", 64, 2)], "directory string, provider string, model string, dimension int, version int")
    assert V.require_contract(meta, ["a"]) == {"provider": "p", "model": "m", "dimension": 64}
    for wrong, word in ((["a", "b"], "m2"), (["c"], "version"), (["x"], "x"), ([], "no directory")):
        with pytest.raises(V.SemanticIndexError, match=word):
            V.require_contract(meta, wrong)
    assert [r.directory for r in V.contract_divergence(meta).orderBy("directory").collect()] == ["b", "c"]


@pytest.fixture
def notes(tmp_path):
    for name, text in {"sous/b.md": "# Quai\nla vanne du quai\n", "a.md": "---\ntype: x\n---\n# Budget\nle budget du module\n\n> [!source] z\n> y", "c.txt": "non"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_build_search_and_rebuild(spark, notes):
    with pytest.raises(V.SemanticIndexError):
        api.semantic_search(spark, "quai", [notes])
    first = api.semantic_index_build(spark, notes, excluded_callouts=["Source"])
    assert (first["files"], first["chunks"], first["embedded_chunks"], first["dimension"]) == (2, 2, 2, 64)
    again = api.semantic_index_build(spark, notes, excluded_callouts=["source"])
    assert (again["embedded_chunks"], again["reused_chunks"]) == (0, 2)
    hit = api.semantic_search(spark, "la vanne du quai", [notes])[0]["results"][0]
    assert hit["relative_path"] == "sous/b.md" and hit["section"] == "Quai" and hit["score"] > 0.8
    assert api.semantic_info(spark, notes)["excluded_callouts"] == ["source"]
    meta, rows = index_store.read_index(spark, notes)
    assert [r.path for r in rows.orderBy("ord").collect()] == ["a.md", "sous/b.md"]
    index_store.index_path(notes).write_text("{broken", encoding="utf-8")
    assert index_store.read_index(spark, notes) is None
    assert api.semantic_info(spark, notes)["index"] is None


def test_lexical_call(spark, notes, tmp_path):
    empty = tmp_path / "vide"
    empty.mkdir()
    got = api.lexical_search(spark, "vannes quai", [str(empty), notes])
    assert [g["directory"] for g in got] == [str(empty), notes] and got[0]["results"] == []
    assert got[1]["results"][0]["relative_path"] == "sous/b.md" and "quai" in got[1]["results"][0]["excerpt"]
    for question, where in (("??? !!!", [notes]), ("mot", []), ("mot", [notes + "/absent"])):
        with pytest.raises(api.LexicalIndexError):
            api.lexical_search(spark, question, where)


class _Service(BaseHTTPRequestHandler):
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.headers["Authorization"] != "Bearer geheim":
            body, code = b"x" * 900, 429
        elif self.path.endswith("/ocr"):
            body, code = json.dumps({"pages": [{"index": 1, "markdown": "deux ![a](b)"}, {"index": 0, "markdown": asked["document"]["type"]}], "model": "m"}).encode(), 200
        else:
            body, code = json.dumps({"data": [{"index": i, "embedding": [float(len(t)), 0.0]} for i, t in reversed(list(enumerate(asked["input"])))]}).encode(), 200
        self.send_response(code)
        self.send_header("Retry-After", "7")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_hosted_provider(spark, tmp_path, monkeypatch):
    """Answers in the order of their index, refusals before any call, failures as errors and never another provider."""
    server = HTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setattr(providers, "PROVIDERS", dict(providers.PROVIDERS))
    monkeypatch.setattr(api, "PROVIDERS", providers.PROVIDERS)
    hosted = providers.HttpProvider("hosted", f"http://127.0.0.1:{server.server_port}/v1/", "FOLIO_TEST_KEY", "m", 2, "o")
    providers.register(hosted)
    with pytest.raises(providers.ProviderError):
        providers.resolve("hosted")
    monkeypatch.setenv("FOLIO_TEST_KEY", "faux")
    with pytest.raises(providers.ProviderError) as refused:
        hosted.embed(["a"])
    assert (refused.value.status, refused.value.retry_after) == (429, 7.0) and len(str(refused.value)) < 320
    monkeypatch.setenv("FOLIO_TEST_KEY", "geheim")
    assert hosted.embed(["a", "bbb"]) == [[1.0, 0.0], [3.0, 0.0]] and providers.retry_seconds("Wed, 21 Oct") is None
    document = tmp_path / "scan.pdf"
    document.write_bytes(b"%PDF")
    done = hosted.ocr({"type": "document_url", "document_url": "data:"})
    assert done["pages"] == ["document_url", "deux ![a](b)"]
    monkeypatch.setattr(hosted, "base_url", "http://127.0.0.1:9/none")
    with pytest.raises(providers.ProviderError):
        hosted.embed(["a"])

    class Reader:
        name, ocr_model, model = "reader", "o", None

        def configuration_issue(self):
            return None

        def ocr(self, payload):
            return {"pages": [payload["type"], "deux ![a](b)"], "model": "m", "pages_processed": 2}

    providers.register(Reader())
    done = api.ocr_convert(spark, str(document), provider="reader")
    assert done == {"source_path": str(document), "output_path": str(tmp_path / "scan.md"), "pages": 2, "model": "m"}
    assert (tmp_path / "scan.md").read_text() == "document_url\n\ndeux [figure 1 — non extraite]\n"
    with pytest.raises(api.DocumentOcrError):
        api.ocr_convert(spark, str(document), provider="hosted")
    with pytest.raises(api.DocumentOcrError):
        api.ocr_convert(spark, str(tmp_path / "none.pdf"))
    (tmp_path / "x.doc").write_bytes(b"x")
    with pytest.raises(api.DocumentOcrError):
        api.ocr_convert(spark, str(tmp_path / "x.doc"))
    assert {x["name"]: x["base_url"] for x in api.llm_check()}["hosted"] == "http://127.0.0.1:9/none"
    server.shutdown()

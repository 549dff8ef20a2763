import json
from pathlib import Path

from pyspark.sql import functions as F

from folioforge.streaming import jobs


def drop(folder: Path, name: str, rows: list[dict]) -> None:
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_changed_chunks_over_restarts(spark, tmp_path):
    schema = "directory string, hash string"
    start = lambda: jobs.changed_chunks(spark, spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination()
    drop(tmp_path / "in", "1.json", [{"directory": "d", "hash": "A"}, {"directory": "d", "hash": "sha256:a "}, {"directory": "d", "hash": None}])
    start()
    drop(tmp_path / "in", "2.json", [{"directory": "d", "hash": "a"}, {"directory": "d", "hash": "b"}])
    start()
    start()
    assert sorted(r.hash for r in spark.read.parquet(str(tmp_path / "store")).collect()) == ["a", "b"]


def test_session_memory(spark, tmp_path):
    schema = "session string, query_id long, note string, score double"
    hits = lambda q, *notes: [{"session": "s", "query_id": q, "note": n, "score": 1.0 - i / 10} for i, n in enumerate(notes)]
    drop(tmp_path / "in", "1.json", hits(1, "a", "b", "c", "d"))
    run = lambda: jobs.unseen_hits(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start().awaitTermination(60)
    run()
    drop(tmp_path / "in", "2.json", hits(2, "a", "d", "e", "f"))
    run()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("query_id", F.desc("score")).collect()
    assert [(r.query_id, r.note) for r in got] == [(1, "a"), (1, "b"), (1, "c"), (2, "d"), (2, "e")]


def test_latest_transcripts_log_and_inbox(spark, tmp_path):
    schema = "day string, session string, turns int, note string"
    start = lambda: jobs.latest_transcripts(spark.readStream.schema(schema).json(str(tmp_path / "t")), str(tmp_path / "tv"), str(tmp_path / "tck")).awaitTermination()
    drop(tmp_path / "t", "1.json", [{"day": "x", "session": "s", "turns": 2, "note": "court"}])
    start()
    drop(tmp_path / "t", "2.json", [{"day": "x", "session": "s", "turns": 5, "note": "long"}, {"day": "y", "session": "s", "turns": 1, "note": "z"}])
    start()
    assert sorted(r.note for r in spark.read.parquet(str(tmp_path / "tv" / "version=1")).collect()) == ["long", "z"]
    drop(tmp_path / "l", "1.json", [{"at": "2026-01-02T10:00:00", "action": "ajout", "title": "t"}])
    jobs.daily_log(spark.readStream.schema("at timestamp, action string, title string").json(str(tmp_path / "l")), str(tmp_path / "log"), str(tmp_path / "lck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).first().entry == "## [2026-01-02] ajout | t"
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "n.md").write_text("deux\nlignes")
    jobs.drained_inbox(spark, str(tmp_path / "inbox"), str(tmp_path / "archive"), str(tmp_path / "drained"), str(tmp_path / "ick")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "drained")).first().text == "deux\nlignes"


def test_prompts(spark, tmp_path):
    drop(tmp_path / "p", "1.json", [{"query_id": 1, "directory": "d", "question": "/commande longue assez"}, {"query_id": 2, "directory": "d", "question": "quelle vanne du quai"}])
    corpus = spark.createDataFrame([("d", "a", "la vanne"), ("d", "b", "autre chose")], "directory string, doc string, text string")
    jobs.answered_prompts(spark.readStream.schema("query_id long, directory string, question string").json(str(tmp_path / "p")), corpus, str(tmp_path / "o"), str(tmp_path / "pk")).awaitTermination()
    assert [(r.query_id, r.doc) for r in spark.read.parquet(str(tmp_path / "o" / "batch=*")).collect()] == [(2, "a")]

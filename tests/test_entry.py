import __spark_entry__ as entry


def test_registry():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and "bm25_top5" in queries and "p3_found" in queries


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["query_id", "directory", "doc", "score", "rank"] and rows.count() > 0


def test_core_queries_run(spark, small):
    for name in ("chunk_ladder", "citation_locate", "citation_pointers", "condensed_map", "secret_mask", "figure_markers", "lint_counters"):
        assert entry.queries()[name](spark, small).count() >= 0

from oracle import differing

from folioforge.llm import queries, sql


def test_queries_equal_their_sql(spark, small):
    # a hundred notes are too few to certify a cutoff, so that p10_found gives no rows here; its rule is compared
    names = sorted(set(sql.ORACLE) - {"p10_found"})
    assert not differing(queries.queries(), sql.ORACLE, spark, small, names)[0]
    assert queries.p10_found(spark, small).count() == 0

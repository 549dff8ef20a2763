import pytest
from oracle import differing

from folioforge import plans

NAMES = sorted(plans.oracle_sql())


@pytest.mark.parametrize("part", range(4))
def test_queries_equal_their_sql(spark, small, part):
    wrong, empty = differing(plans.queries(), plans.oracle_sql(), spark, small, NAMES[part::4])
    assert not wrong and len(empty) <= 3

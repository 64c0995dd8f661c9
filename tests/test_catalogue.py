import pytest

from sourcelens import queries as Q
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, data, name):
    """The others are in test_no_twin.py."""
    same(Q.queries()[name](spark, data), Q.oracle_sql()[name], data)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

import pytest

from tests.oracle import SF, agree
from tracewarden.plans import engine, reduction, services, serving, texts

OWN = (reduction, texts, serving, engine, services)
QUERIES, SQL = {k: v for m in OWN for k, v in m.QUERIES.items()}, {k: v for m in OWN for k, v in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    agree(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    QUERIES[name](spark, SF).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

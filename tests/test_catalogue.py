import pytest

import __spark_entry__ as contract
from plumbline.plans import catalogue, stand_ins

QUERIES, SQL = catalogue.QUERIES | stand_ins.QUERIES, catalogue.ORACLE_SQL | stand_ins.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())

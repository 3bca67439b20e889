import pytest

from lodestone.plans import catalog
from tests.conftest import DATA
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_oracle(spark, name):
    assert not differences(spark, catalog.QUERIES[name], catalog.ORACLES[name], f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_oracle_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

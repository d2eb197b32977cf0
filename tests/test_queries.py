"""Each query with SQL gives what the SQL gives; the others run and keep their columns."""

import pytest

from srclake.plans.queries import ORACLES, QUERIES
from tests.compare import same
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    same(spark, SMALL, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_every_candidate_is_explained(spark):
    found = QUERIES["bug_explanations"](spark, SMALL).toPandas()
    assert found["place"].max() > 1 and found[found["place"] > 1]["explanation"].notna().all()
    assert (found["root_cause"].notna() == ~(found["place"] > 1)).all()

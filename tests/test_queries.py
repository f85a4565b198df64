import pytest
from compare import connect, difference

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_like_sql(spark, db, name):
    assert difference(contract.queries()[name](spark, FOLDER), db, contract.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_has_rows(spark, name):
    assert contract.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "meanVelocity" in df.columns

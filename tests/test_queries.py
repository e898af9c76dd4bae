import pytest

from tests.compare import connect, rows
from tidemark.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SLOW = {"ml1_ml6_stacked_ensemble"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = con.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_models_rank_better_than_chance(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.metrics import roc_auc

    s = QUERIES["ml1_ml6_stacked_ensemble"](spark, SF).withColumn("y", F.col("is_fraud"))
    assert s.where("p < 0 or p > 1 or p is null").count() == 0 and 0.3 < roc_auc(s).first()[0] <= 1.0

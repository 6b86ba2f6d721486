"""The registered queries against their SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from ionweave.plans.oracles import ORACLES
from ionweave.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def rows(df):
    clean = lambda v: None if v is None or str(v) in ("nan", "<NA>") else round(float(v), 7) if isinstance(v, float) else v if isinstance(v, str) else int(v)
    return sorted((tuple(clean(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    got = QUERIES[name](spark, SF).toPandas()
    assert rows(got) == rows(con.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_dense_assignment_never_exceeds_one(spark):
    got = QUERIES["cosine_assignment_dense"](spark, SF).toPandas()
    assert ((got.distance >= 0) & (got.distance <= 1)).all() and not math.isnan(got.distance.sum())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

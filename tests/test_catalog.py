"""Every registered query against its oracle on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry
from quietband.plans.catalog import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="benchmark tables are absent")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def _rows(frame: pd.DataFrame) -> list[tuple]:
    ordered = frame[sorted(frame.columns)]
    return sorted(
        tuple("NULL" if pd.isna(v) else str(v) for v in row) for row in ordered.itertuples(index=False)
    )


@pytest.fixture(scope="module")
def oracle():
    base = duckdb.connect()
    for name in TABLES:
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return base


@pytest.mark.parametrize("name", [name for name, query in REGISTRY.items() if query.sql])
def test_query_matches_its_oracle(spark, oracle, name):
    mine = REGISTRY[name].run(spark, SF_DIR).toPandas()
    truth = oracle.execute(REGISTRY[name].sql).df()
    assert sorted(mine.columns) == sorted(truth.columns)
    assert _rows(mine) == _rows(truth)


def test_entry_flags_the_known_orders(spark):
    table = entry(spark)
    assert table.count() == 1473 and table.where("is_anomaly").count() == 57

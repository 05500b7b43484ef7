"""Every registered query against its SQL twin on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from check import TABLES, compare  # noqa: E402
from conftest import SF  # noqa: E402

from knownat import plans  # noqa: E402

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    text, good = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert good, text


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

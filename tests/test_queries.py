"""Every registered query against its SQL in DuckDB on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from loam.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.sql(registry.ORACLES[name])
    assert columns == sorted(rel.columns)
    got = Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    at = [rel.columns.index(c) for c in columns]
    assert got == Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0


def test_entry_points(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "idx", "text", "offset", "length", "tokens"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

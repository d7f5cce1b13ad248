"""Every registered query runs; those with an SQL equivalent agree with DuckDB."""
import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, compare

SF = "/root/testdata/sf0.001"
SLOW = {"density_clusters_embeddings", "full_analysis_part", "auto_clean_metrics_customer"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query(spark, con, name):
    _, verdict = compare(spark, con, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert verdict in ("ok", "rows only"), verdict


def test_entry(spark):
    row = entry.entry(spark).first()
    assert 0 <= row["trust_score"] <= 100


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())

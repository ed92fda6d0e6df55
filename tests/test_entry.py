"""The registered queries against their SQL on the smallest test tables, where they are there."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables here")


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() == 60


@needs_data
@pytest.mark.parametrize("name", ["qc_filter", "label_parse", "diversity_curves", "entropy_explained", "ivm_cell_rollup", "anova_f", "ari_pair", "wasserstein_pairs", "hash_folds"])
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{SMALL}/{file}')")
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    key = lambda row: tuple(str(plain(v)) for v in row)
    got = entry.queries()[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(key, got)) == sorted(map(key, want.project(", ".join(f'"{c}"' for c in columns)).fetchall()))

"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from factloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, (bool, np.bool_, int, np.integer)):
        return int(value)
    return float(f"{value:.9g}") if isinstance(value, (float, np.floating)) else str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    found = duckdb.connect()
    for table in TABLES:
        found.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    assert rows(got) == rows(duck.execute(registry.oracle_sql()[name]).df())


def test_entry_registers_all(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert set(registry.queries()) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)
    assert __spark_entry__.entry(spark).count() == 5

"""Every query of the engine against its SQL in DuckDB, over the smallest driver tables."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from skein.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(value):
    if pd.api.types.is_scalar(value) and pd.isna(value):
        return "None"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))  # whole numbers beside nulls
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(plain(v.item() if isinstance(v, np.generic) else v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_is_its_sql(spark, tables, name):
    assert rows(registry.QUERIES[name](spark, str(DATA)).toPandas()) == rows(tables.execute(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_is_the_same_however_it_is_dealt(spark, name):
    """Rows, and the same ones from one partition as from several."""
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for number in (before, "1"):
        spark.conf.set("spark.sql.shuffle.partitions", number)
        found.append(rows(registry.QUERIES[name](spark, str(DATA)).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and (found[0][1] or name in EMPTY)


#: On the smallest tables these have nothing to report.
EMPTY = {"l13_outliers"}

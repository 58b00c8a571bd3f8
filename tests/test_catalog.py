"""Every query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from docloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def bag(df: pd.DataFrame) -> Counter:
    def told(v):
        if pd.isna(v):
            return "null"
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return Counter(tuple(map(told, row)) for row in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    found = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        expected = con.execute(catalog.ORACLES[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert bag(found) == bag(expected)
    else:
        assert len(found)

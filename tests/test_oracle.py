import math
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lamina.plans import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{float(v):.6f}" if isinstance(v, float) or type(v).__name__.startswith("float") else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    mine = catalog.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(catalog.SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert len(mine) and len(mine) == len(theirs)
    kinds = lambda d: {c: "i" if d[c].dtype.kind in "iu" else d[c].dtype.kind for c in d}
    a, b = kinds(mine), kinds(theirs)
    assert {c: (a[c], b[c]) for c in a if a[c] != b[c] and {a[c], b[c]} - {"i", "f"}} == {}
    assert plain(mine) == plain(theirs)

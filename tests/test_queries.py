"""Every bound query against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from diffquarry.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="tables are absent")


def plain(df: pd.DataFrame) -> list:
    show = lambda v: "null" if v is None or v is pd.NA or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    assert plain(queries.QUERIES[name](spark, SF).toPandas()) == plain(db.execute(queries.ORACLE[name]).df())


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(e.queries())

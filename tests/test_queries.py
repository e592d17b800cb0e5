"""Every query with SQL equals that SQL on the small tables; the flagship runs."""

from pathlib import Path

import duckdb
import pytest

from lodestar.plans import catalog

D = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(D).is_dir(), reason="no tables here")


def key(row):
    return tuple("" if x is None else round(x, 6) if isinstance(x, float) else x for x in row)


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, name):
    df = catalog.QUERIES[name](spark, D)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({catalog.SQL[name]})").fetchall()
    assert sorted(map(key, df.select(*cols).collect()), key=repr) == sorted(map(key, want), key=repr)


@needs_data
def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0

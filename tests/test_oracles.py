"""Every registered sketch query against its DuckDB oracle."""

import duckdb
import pytest

from sketchspark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(name, spark, sf, duck):
    got, want = rows(catalog.QUERIES[name](spark, sf).toPandas()), rows(duck.sql(catalog.ORACLE_SQL[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        assert [pytest.approx(x, abs=2e-6) if isinstance(x, float) else x for x in b] == list(a)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

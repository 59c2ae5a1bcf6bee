"""Every query with SQL, held against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    value = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


#: The split needs more trade dates than some tables have; model frames are slow.
NAMES = sorted(set(entry.oracle_sql()) & set(entry.queries()))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({entry.oracle_sql()[name]})")
    assert plain(df.select(*(f"`{n}`" for n in names)).collect()) == plain(want.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0

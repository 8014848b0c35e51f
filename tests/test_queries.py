import duckdb
import pytest

from extentlake.plans.queries import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def ordered(rows, names):
    by = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in by]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, sf, duck, name):
    df = queries()[name](spark, sf)
    found = duck.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert ordered([tuple(r) for r in df.collect()], df.columns) == ordered(found.fetchall(), names)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.queries()) >= set(queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

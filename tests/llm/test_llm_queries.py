import duckdb
import pytest

from extentlake.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(oracle_sql()[name])
    names = sorted(d[0] for d in found.description)
    df = queries()[name](spark, sf)
    assert sorted(df.columns) == names
    expected = [dict(zip((d[0] for d in found.description), r)) for r in found.fetchall()]
    key = lambda r: repr([r[n] for n in names])
    assert sorted(map(key, (r.asDict() for r in df.collect()))) == sorted(map(key, expected))


@pytest.mark.parametrize("name", sorted(queries()))
def test_one_row_for_each_input_row(spark, sf, name):
    table = "pages" if name.startswith(("op2_", "op4_")) else "documents"
    assert queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()

"""Every query against its SQL in DuckDB, on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from lectern import plans


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(map(plain, v.values())) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_rows_equal_sql(name, spark, data, duck):
    df = plans.QUERIES[name](spark, data)
    cursor = duck.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", ["r04_hierarchical", "r04_hierarchical_strict"])
def test_nearest_summaries_without_chapters(name, spark, tmp_path):
    rows = [(i, [1.0, i / 100], 9 if i % 7 == 0 else i % 3) for i in range(40)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    df = plans.QUERIES[name](spark, str(tmp_path))
    cursor = con.execute(plans.ORACLE_SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_queries_without_sql_run(name, spark, data):
    df = plans.QUERIES[name](spark, data)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_entry_returns_rows(spark, data):
    import __spark_entry__ as e

    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every registered query of the grammar against its SQL in DuckDB, and its printed forms against both."""

import duckdb
import pytest
from plainframe import queries, run
from plainframe.api import checked
from plainframe.plans import pyspark_code, sql
from plainframe.plans.diagnostics import PlainError

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    out = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in queries.TABLES}
    for n, df in out.items():
        df.createOrReplaceTempView(n)
    return out


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in queries.TABLES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([round(r[k], 4) if isinstance(r[k], float) else r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.sentences()))
def test_query(spark, tables, duck, name):
    sentence = queries.sentences()[name]
    df = run(sentence, **tables)
    got = plain(df.columns, df.collect())
    r = duck.execute(queries.oracle_sql()[name])
    assert got == plain([c[0] for c in r.description], r.fetchall())
    plan = checked(sentence, tables)
    try:
        r = duck.execute(sql.sql(plan, "sql"))
        assert got == plain([c[0] for c in r.description], r.fetchall())
        scope = {"spark": spark}
        exec(pyspark_code.code(plan), scope)
        assert got == plain(scope["df"].columns, scope["df"].collect())
    except PlainError as e:
        assert e.diagnostic.kind == "not built yet"

"""Rows worked out by hand, from shuffled input."""

import pytest
from plainframe import PlainError, run
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def t(spark):
    rows = [("W", "a", 10.0, 4, 1), ("W", "b", 30.0, 6, 2), ("E", "a", 20.0, None, 3), ("E", None, None, 8, 4), ("W", "a", 10.0, 2, 5), (None, "c", 5.0, 9, 6)]
    df = spark.createDataFrame(rows, "region string, product string, revenue double, cost long, id long")
    other = spark.createDataFrame([("a", "Acme"), ("b", "Bell"), ("z", "Zed"), (None, "None")], "product string, maker string")
    areas = spark.createDataFrame([("W", "Ann"), ("N", "Nat")], "area string, head string")
    return {"sales": df.repartition(5), "makers": other.repartition(3), "areas": areas}


def rows(sentence, t):
    return [tuple(r) for r in run(sentence, **t).collect()]


CASES = [
    ('sales then keep where [region] is "W" then sort [id] then pick [id]', [(1,), (2,), (5,)]),
    ('sales then keep where [region] is not "W" then sort [id] then pick [id]', [(3,), (4,)]),
    ('sales then keep where [product] not in {"a"} then sort [id] then pick [id]', [(2,), (6,)]),
    ("sales then sort [cost] then pick [id]", [(5,), (1,), (2,), (4,), (6,), (3,)]),
    ("sales then sort [cost] descending then pick [id]", [(6,), (4,), (2,), (1,), (5,), (3,)]),
    ("sales then sort [cost] descending missing first then take 2 then pick [id]", [(3,), (6,)]),
    ("sales then sort [cost] then take_last 2 then pick [id]", [(6,), (3,)]),
    ("sales then sort [cost] then pick [id] then take 2", [(5,), (1,)]),
    ("sales then sort [id] then add [id] as 0 - [id] then take 2 then pick [id]", [(-1,), (-2,)]),
    ("sales then sort [id] descending then take 1 by [region] then pick [region, id]", [(None, 6), ("W", 5), ("E", 4)]),
    ("sales then sort [revenue] descending then take 3 with ties then sort [id] then pick [id]", [(1,), (2,), (3,), (5,)]),
    ("sales then sort [revenue] then take 0 with ties then pick [id]", []),
    ("sales then sort [revenue] missing first then take 1 with ties then pick [id]", [(4,)]),
    ("sales then summarize [n] as row_count(), [x] as total([revenue]), [k] as unique_count([product]) by [region]", [("E", 2, 20.0, 1), ("W", 3, 50.0, 2), (None, 1, 5.0, 1)]),
    ("sales then keep where [id] > 99 then summarize [n] as row_count(), [x] as total([revenue])", [(0, None)]),
    ("sales then keep where [id] > 99 then summarize [n] as row_count() by [region]", []),
    ("sales then sort [id] descending then summarize [a] as first([product]), [b] as last([cost]) by [region]", [("E", None, None), ("W", "a", 4), (None, "c", 9)]),
    ("sales then sort [region] descending, [id] then summarize [a] as first([id]), [b] as last([id])", [(1, 6)]),
    ('sales then sort [id] then summarize [x] as join_rows([product], "+") by [region]', [("E", "a"), ("W", "a+b+a"), (None, "c")]),
    ('sales then sort [id] descending then summarize [x] as join_rows([product], "+") by [region]', [("E", "a"), ("W", "a+b+a"), (None, "c")]),
    ("sales then add [s] as [revenue] / total([revenue]) by [region] then sort [id] then pick [s]", [(0.2,), (0.6,), (1.0,), (None,), (0.2,), (1.0,)]),
    ("sales then add [m] as largest([id]) then sort [id] then take 1 then pick [id, m]", [(1, 6)]),
    ("sales then sort [id] then add [r] as running_total([cost]), [p] as previous([id]), [l] as latest([cost]) by [region] then pick [id, r, p, l]", [(1, 4, None, 4), (2, 10, 1, 6), (3, None, None, None), (4, 8, 3, 8), (5, 12, 2, 2), (6, 9, None, 9)]),
    ("sales then add [r] as rank([revenue] descending) then sort [id] then pick [r]", [(3,), (1,), (2,), (6,), (3,), (5,)]),
    ("sales then sort [id] then add [r] as rolling(total([id]), 2) then pick [r]", [(None,), (3,), (5,), (7,), (9,), (11,)]),
    ("sales then add [id] as [cost], [cost] as [id] then sort [cost] then take 1 then pick [id, cost]", [(4, 1)]),
    ("sales then join makers by [product] then sort [id] then pick [id, maker]", [(1, "Acme"), (2, "Bell"), (3, "Acme"), (4, None), (5, "Acme"), (6, None)]),
    ('sales then join makers unmatched "none" then summarize [n] as row_count()', [(4,)]),
    ('sales then join makers by [product] unmatched "both" then summarize [n] as row_count()', [(8,)]),
    ("sales then join areas by [region] is [area] then sort [id] then take 1 then pick [region, head]", [("W", "Ann")]),
    ("sales then keep where matching(areas, by [region] is [area]) then sort [id] then pick [id]", [(1,), (2,), (5,)]),
    ("sales then keep where not matching(areas, by [region] is [area]) then sort [id] then pick [id]", [(3,), (4,), (6,)]),
    ("sales then add_rows sales then summarize [n] as row_count()", [(12,)]),
    ("sales then pick [region] then drop_duplicates", [("E",), ("W",), (None,)]),
    ("sales then pick [region, product] then add_combinations [region, product] then summarize [n] as row_count() by [region]", [("E", 4), ("W", 4), (None, 1)]),
    ("sales then drop_missing [cost] then summarize [n] as row_count()", [(5,)]),
    ("sales then drop_missing then summarize [n] as row_count()", [(3,)]),
    ("sales then fill_missing [cost] as [id] * 10 then sort [id] then pick [cost]", [(4,), (6,), (30,), (8,), (2,), (9,)]),
    ('sales then keep where [id] is 1 then lengthen [cost, id] as name [k], value [v] then pick [k, v]', [("cost", 4), ("id", 1)]),
    ('sales then keep where [id] < 3 then lengthen [cost, id] as name [k], value [v] then widen name [k], value [v] by [region, product, revenue] giving [id, cost]', [("W", "a", 10.0, 1, 4), ("W", "b", 30.0, 2, 6)]),
    ('sales then drop_missing [product] then widen name [product], value total([id]) by [region] missing 0 giving [a, b, c]', [("E", 3, 0, 0), ("W", 6, 2, 0), (None, 0, 0, 6)]),
    ("sales then keep where between([id], 2, 3) then sort [id] then add [r] as remainder(0 - [id], 3) then pick [r]", [(1,), (0,)]),
    ('sales then sort [id] then take 1 then add [x] as when([cost] > 5, 1), [y] as look_up([region], "W", "west", otherwise missing) then pick [x, y]', [(None, "west")]),
    ("sales then keep where any name is \"revenue\" or name is \"cost\" as value > 8 then sort [id] then pick [id]", [(1,), (2,), (3,), (5,), (6,)]),
    ("sales then keep where every name is \"revenue\" or name is \"cost\" as value > 5 then sort [id] then pick [id]", [(2,)]),
]


@pytest.mark.parametrize("sentence,expected", CASES, ids=[c[0][:90] for c in CASES])
def test_rows(t, sentence, expected):
    got = rows(sentence, t)
    if "sort" in sentence and "by [region]" not in sentence or "summarize" in sentence:
        assert got == expected
    else:
        assert sorted(got, key=str) == sorted(expected, key=str)


def test_names_that_spark_confuses(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["A", "a", "a.b", "order date"])
    assert rows("x then add [A] as [a] + [a.b] then rename [then] as [order date] then pick [A, a, a.b, then]", {"x": df}) == [(5, 2, 3, 4)]


def test_order_survives_shuffles_and_dropped_keys(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("g"), F.xxhash64("id").alias("k")).repartition(13)
    got = rows("x then sort [k] then add [t] as total([id]) by [g] then pick [id, t] then take 5", {"x": df})
    expected = [r.id for r in df.orderBy("k").limit(5).collect()]
    assert [r[0] for r in got] == expected


def test_two_rows_for_a_cell_stop_the_query(t):
    with pytest.raises(Exception, match="two rows fall into one cell"):
        rows("sales then drop_missing [product] then widen name [product], value [id] by [region] giving [a, b, c] then pick [region]", t)


def test_a_name_outside_giving_stops_the_query(t):
    with pytest.raises(Exception, match="none of the columns"):
        rows("sales then widen name [product], value total([id]) by [region] giving [a, b, c] then pick [region]", t)


def test_open_widen_makes_sorted_columns(t):
    out = run("sales then drop_missing [product] then widen name [product], value row_count() by [region]", **t)
    assert out.columns == ["region", "a", "b", "c"]


def test_nan_of_pandas_is_missing(spark):
    pd = pytest.importorskip("pandas")
    assert rows("x then keep where [v] is missing then pick [n]", {"x": pd.DataFrame({"n": [1, 2], "v": [1.0, float("nan")]})}) == [(2,)]


def test_spark_and_local_tables_do_not_mix(t):
    pd = pytest.importorskip("pandas")
    with pytest.raises(PlainError, match="local"):
        run("sales then add_rows x", sales=t["sales"], x=pd.DataFrame({"a": [1]}))


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") * 2).alias("x"), F.lit("t").alias("unused")).write.parquet(str(tmp_path / "p"))
    plan = run("p then keep where [id] > 50 then add [y] as [x] + 1 then summarize [s] as total([y])", p=spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,50)]" in plan and "unused" not in plan


def test_taken_rows_are_not_sorted_again(spark):
    df = spark.range(1000).selectExpr("id", "id * 7919 % 1000 AS k").repartition(5)
    out = run("x then sort [k] descending then take 9 then pick [id, k] then rename [n] as [id]", x=df)
    assert [r.k for r in out.collect()] == list(range(999, 990, -1)) and "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    for more in ("take_last 9", "take 9 then keep where [k] > 0", "take 9 then add [m] as row_number() then sort [m]", "take 9 with ties"):
        got = [r.k for r in run(f"x then sort [k] descending then {more}", x=df).collect()]
        assert len(got) == 9 and got == sorted(got, reverse=True), more


def test_grouped_take_limits_before_the_shuffle(t):
    plan = run("sales then sort [id] then take 1 by [region]", **t)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_catalog_table(spark, t):
    t["sales"].createOrReplaceTempView("in_catalog")
    assert run("in_catalog then summarize [n] as row_count()").collect()[0].n == 6


@pytest.mark.parametrize("keys", ["[k] descending, [id]", "[k], [id] missing first", "[d], [id]"])
def test_windows_over_the_whole_table_in_parts(spark, monkeypatch, keys):
    from plainframe.operators import global_windows

    k = F.when(F.col("id") % 11 != 0, F.col("id") * 7 % 90)
    df = spark.range(500).select("id", k.alias("k"), F.date_add(F.lit("2026-01-01"), (F.col("id") % 40).cast("int")).alias("d"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("v")).repartition(6)
    sentence = f"x then sort {keys} then add [n] as row_number(), [t] as running_total([v]), [r] as rank([k] descending), [s] as rank([d]) then sort [id]"
    plain = rows(sentence, {"x": df})
    monkeypatch.setattr(global_windows, "LEAST_BYTES", 0)
    out = run(sentence, x=df)
    assert [tuple(r) for r in out.collect()] == plain
    assert out.dtypes == run("x then sort [id] then take 1", x=out).dtypes


@pytest.mark.parametrize("chunk", [1, 7, 1000])
@pytest.mark.parametrize("keys", ["[name], [id]", "[name] descending, [id] missing first", "[id] descending"])
def test_windows_that_look_around_in_chunks(spark, monkeypatch, keys, chunk):
    from plainframe.operators import global_windows

    names = F.when(F.col("id") % 13 != 0, F.concat(F.element_at(F.array(*map(F.lit, ["", "é", "prefix-1", "prefix-2", "Z", "a"])), (F.col("id") % 6 + 1).cast("int")), (F.col("id") % 17).cast("string")))
    df = spark.range(300).select("id", names.alias("name"), F.when(F.col("id") % 4 != 0, F.col("id")).alias("v")).repartition(5)
    sentence = (
        f"x then sort {keys} then add [p] as previous([v]), [p3] as previous([v], 3), [f] as following([v]), [f9] as following([id], 9), [l] as latest([v]),"
        " [r] as rolling(total([id]), 5), [m] as rolling(average([v]), 2), [n] as row_number() then sort [id]"
    )
    plain = rows(sentence, {"x": df})
    monkeypatch.setattr(global_windows, "LEAST_BYTES", 0)
    monkeypatch.setattr(global_windows, "CHUNK", chunk)
    out = run(sentence, x=df)
    assert [tuple(r) for r in out.collect()] == plain
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "chunk" in plan and dict(out.dtypes)["n"] == "bigint"


def test_medians_of_large_tables(spark, monkeypatch):
    """Sketches of an accuracy far under the rows' number, ties, missing values and keys, one hot group."""
    from plainframe.operators import global_windows, medians

    v = F.when(F.col("id") % 7 != 0, (F.col("id") * 7919 % 10007) / 10)
    g = F.when(F.col("id") % 10 < 7, 0).when(F.col("id") % 10 == 7, F.col("id") % 300)
    df = spark.range(30_000).select("id", v.alias("v"), (F.col("id") % 3).alias("t"), g.alias("g")).repartition(6)
    sentences = [
        "x then summarize [m] as median([v]), [t] as median([t]), [n] as row_count() by [g]",
        "x then summarize [m] as median([v]) + total([t]), [k] as median([id])",
        "x then keep where [v] is missing then summarize [m] as median([v]) by [t]",
    ]
    plain = [rows(s, {"x": df}) for s in sentences]
    monkeypatch.setattr(global_windows, "LEAST_BYTES", 0)
    monkeypatch.setattr(medians, "CUTS", (0.48, 0.52))
    monkeypatch.setattr(medians, "ACCURACY", 100)
    assert [rows(s, {"x": df}) for s in sentences] == plain
    plan = run(sentences[0], x=df)._jdf.queryExecution().executedPlan().toString()
    assert "percentile_approx" in plan and "percentile(" not in plan


def test_example_tables_are_found_above(spark, tmp_path):
    from plainframe import example_table

    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "codes.csv").write_text("code,n,on\n007,1,2026-01-02\nNA,NA,NA\n")
    (tmp_path / "a" / "b").mkdir(parents=True)
    df = example_table("codes", text=["code"], start=tmp_path / "a" / "b", spark=spark)
    assert [tuple(r) for r in df.select("code", "n").collect()] == [("007", 1), (None, None)]
    with pytest.raises(PlainError, match="no data/none.csv"):
        example_table("none", start=tmp_path)
    for name in ("../codes", "a/b", "codes.csv", "", 3):
        with pytest.raises(PlainError, match="is no table name"):
            example_table(name, start=tmp_path)


def test_example_tables_are_fetched_from_an_address(spark, tmp_path):
    from plainframe import example_table

    (tmp_path / "published").mkdir()
    (tmp_path / "published" / "more.csv").write_text("a,b\n1,x\nNA,y\n")
    address = (tmp_path / "published").as_uri()
    assert [tuple(r) for r in example_table("more", start=tmp_path, spark=spark, address=address).collect()] == [(1, "x"), (None, "y")]
    with pytest.raises(PlainError, match="can't be read"):
        example_table("none", start=tmp_path, spark=spark, address=address)


def test_arrow_tables(spark):
    pa = pytest.importorskip("pyarrow")
    assert rows("x then summarize [n] as total([v])", {"x": pa.table({"v": [1, 2, None]})}) == [(3,)]


def test_tables_of_the_callers_scope(spark):
    numbers = spark.range(5)
    assert run("numbers then summarize [n] as row_count()").collect()[0].n == numbers.count()


def test_catalog_names_in_parts(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS parts_of_names")
    spark.sql("CREATE OR REPLACE TEMP VIEW one_part AS SELECT 1 AS a")
    with pytest.raises(PlainError, match="there is no table `parts_of_names.nothing`"):
        run("parts_of_names.nothing then take 1")
    spark.sql("DROP DATABASE parts_of_names")


def test_add_over_rows_taken_without_an_order_reads_them_once(spark):
    df = spark.range(1000).repartition(7)
    out = rows("x then take 10 then add [t] as total([id]), [n] as row_count()", {"x": df})
    assert len(out) == 10 and {r[2] for r in out} == {10} and {r[1] for r in out} == {sum(r[0] for r in out)}

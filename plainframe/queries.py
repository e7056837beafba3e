"""The grammar's operators as queries over the driver's tables, each with the SQL that must agree.

Sums of doubles depend on their order in the last digits, so both sides round them to cents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .api import run_in

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def cents(x: str) -> str:
    return f"round_below(({x}) * 100 + 0.5) / 100"


def sql_cents(x: str) -> str:
    return f"CAST(floor(({x}) * 100 + 0.5) AS BIGINT) / 100"


def _all() -> dict[str, tuple[str, str]]:
    c, q = cents, sql_cents
    out: dict[str, tuple[str, str]] = {}

    def put(name: str, sentence: str, sql: str) -> None:
        out[name] = sentence, sql

    # keep
    put("keep_compare", "part then keep where [p_size] >= 10 and [p_size] < 30 and not ([p_brand] is \"Brand#11\")", "SELECT * FROM part WHERE p_size >= 10 AND p_size < 30 AND NOT p_brand = 'Brand#11'")
    put("keep_in", 'orders then keep where [o_orderstatus] in {"F", "P"}', "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P')")
    put("keep_not_in", 'orders then keep where [o_orderstatus] not in {"F", "P"}', "SELECT * FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
    put("keep_text", 'customer then keep where [c_mktsegment] starts "B" or [c_mktsegment] ends "Y" or [c_name] contains "99"', "SELECT * FROM customer WHERE starts_with(c_mktsegment, 'B') OR ends_with(c_mktsegment, 'Y') OR contains(c_name, '99')")
    put("keep_between", "part then keep where between([p_size], 5, 15)", "SELECT * FROM part WHERE p_size BETWEEN 5 AND 15")
    put("keep_missing", "orders then add [x] as when([o_totalprice] > 200000, [o_totalprice]) then keep where [x] is missing or [x] > 400000", "SELECT * FROM (SELECT *, CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS x FROM orders) WHERE x IS NULL OR x > 400000")
    put("keep_not_missing", "orders then add [x] as when([o_totalprice] > 200000, [o_totalprice]) then keep where [x] is not missing", "SELECT *, o_totalprice AS x FROM orders WHERE o_totalprice > 200000")
    put("keep_any", 'lineitem then keep where any name ends "discount" or name ends "tax" as value > 0.07', "SELECT * FROM lineitem WHERE l_discount > 0.07 OR l_tax > 0.07")
    put("keep_every", 'lineitem then keep where every name ends "discount" or name ends "tax" as value > 0.05', "SELECT * FROM lineitem WHERE l_discount > 0.05 AND l_tax > 0.05")
    put("join_self", "nation then pick [n_nationkey, n_regionkey] then rename [key] as [n_nationkey], [region] as [n_regionkey] then join nation by [region] is [n_regionkey]", "SELECT a.n_nationkey AS key, a.n_regionkey AS region, b.* EXCLUDE (n_regionkey) FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_regionkey")
    put("semi", "customer then keep where matching(orders, by [c_custkey] is [o_custkey])", "SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
    put("anti", "part then keep where not matching(supplier, by [p_partkey] is [s_suppkey])", "SELECT * FROM part WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey)")
    # pick
    put("pick_list", "customer then pick [c_name, c_custkey]", "SELECT c_name, c_custkey FROM customer")
    put("pick_all_but", "customer then pick all_but [c_acctbal, c_name]", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
    put("pick_kind", 'customer then pick where kind is "number"', "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
    put("pick_name", 'part then pick where lower(name) starts "p_" and not (name contains "type") and kind is "text"', "SELECT p_name, p_brand FROM part")
    # add
    put("add_plain", f"lineitem then add [net] as {c('[l_extendedprice] * (1 - [l_discount])')} then pick [l_orderkey, l_linenumber, net]", f"SELECT l_orderkey, l_linenumber, {q('l_extendedprice * (1 - l_discount)')} AS net FROM lineitem")
    put("add_swap", "nation then add [n_nationkey] as [n_regionkey], [n_regionkey] as [n_nationkey]", "SELECT n_regionkey AS n_nationkey, n_name, n_nationkey AS n_regionkey FROM nation")
    put("add_sweep", 'nation then add where kind is "number" as value * 2', "SELECT CAST(n_nationkey * 2 AS INTEGER) AS n_nationkey, n_name, CAST(n_regionkey * 2 AS INTEGER) AS n_regionkey FROM nation")
    put("add_share", f"orders then add [s] as {c('[o_totalprice] * 1000000 / total([o_totalprice])')} then pick [o_orderkey, s]", f"SELECT o_orderkey, {q('o_totalprice * 1000000 / sum(o_totalprice) OVER ()')} AS s FROM orders")
    put("add_share_by", f"orders then add [s] as {c('[o_totalprice] * 100 / total([o_totalprice])')} by [o_custkey] then pick [o_orderkey, s]", f"SELECT o_orderkey, {q('o_totalprice * 100 / sum(o_totalprice) OVER (PARTITION BY o_custkey)')} AS s FROM orders")
    put("add_group_count", "events then add [n] as row_count(), [k] as unique_count([event_type]) by [user_id] then pick [event_id, n, k]", "SELECT event_id, count(*) OVER g AS n, k FROM events JOIN (SELECT user_id, count(DISTINCT event_type) AS k FROM events GROUP BY user_id) USING (user_id) WINDOW g AS (PARTITION BY user_id)")
    # summarize
    for fn, sql in (("total", "sum"), ("average", "avg"), ("median", "median"), ("smallest", "min"), ("largest", "max"), ("standard_deviation", "stddev_samp")):
        put(f"sum_{fn}", f"orders then summarize [x] as {c(f'{fn}([o_totalprice])')} by [o_orderpriority]", f"SELECT o_orderpriority, {q(f'{sql}(o_totalprice)')} AS x FROM orders GROUP BY o_orderpriority")
    put("sum_unique_count", "orders then summarize [x] as unique_count([o_custkey]) by [o_orderpriority]", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS x FROM orders GROUP BY o_orderpriority")
    put("sum_row_count", "lineitem then summarize [x] as row_count() by [l_returnflag, l_linestatus]", "SELECT l_returnflag, l_linestatus, count(*) AS x FROM lineitem GROUP BY ALL")
    put("sum_first", "orders then sort [o_orderdate] descending, [o_orderkey] then summarize [x] as first([o_orderkey]) by [o_custkey]", "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate DESC, o_orderkey) AS x FROM orders GROUP BY o_custkey")
    put("sum_last", "orders then sort [o_totalprice], [o_orderkey] then summarize [x] as last([o_orderkey]) by [o_custkey]", "SELECT o_custkey, last(o_orderkey ORDER BY o_totalprice, o_orderkey) AS x FROM orders GROUP BY o_custkey")
    put("sum_join_rows", 'orders then sort [o_orderkey] descending then summarize [x] as join_rows([o_orderstatus], ", ") by [o_custkey]', "SELECT o_custkey, string_agg(o_orderstatus, ', ' ORDER BY o_orderkey DESC) AS x FROM orders GROUP BY o_custkey")
    put("sum_composed", f"lineitem then summarize [x] as {c('total([l_extendedprice]) / row_count() - smallest([l_extendedprice])')} by [l_shipdate]", f"SELECT l_shipdate, {q('sum(l_extendedprice) / count(*) - min(l_extendedprice)')} AS x FROM lineitem GROUP BY l_shipdate")
    put("sum_sweep", 'part then summarize where kind is "number" as largest(value) by [p_brand]', "SELECT p_brand, max(p_partkey) AS p_partkey, max(p_size) AS p_size, max(p_retailprice) AS p_retailprice FROM part GROUP BY p_brand")
    put("sum_global", "orders then keep where [o_totalprice] < 0 then summarize [n] as row_count(), [x] as largest([o_orderkey])", "SELECT count(*) AS n, max(o_orderkey) AS x FROM orders WHERE o_totalprice < 0")
    put("having", "orders then summarize [n] as row_count() by [o_custkey] then keep where [n] > 10", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10")
    # sort and take
    put("sort_missing_last", "orders then add [x] as when([o_totalprice] > 300000, [o_totalprice]) then sort [x] descending, [o_orderkey] then add [place] as row_number() then pick [o_orderkey, x, place]", "SELECT o_orderkey, x, row_number() OVER (ORDER BY x DESC NULLS LAST, o_orderkey) AS place FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN o_totalprice END AS x FROM orders)")
    put("sort_missing_first", "orders then add [x] as when([o_totalprice] > 300000, [o_totalprice]) then sort [x], [o_orderkey] missing first then add [place] as row_number() then pick [o_orderkey, x, place]", "SELECT o_orderkey, x, row_number() OVER (ORDER BY x NULLS FIRST, o_orderkey) AS place FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN o_totalprice END AS x FROM orders)")
    put("sort_dropped_key", "orders then sort [o_totalprice] descending, [o_orderkey] then pick [o_orderkey] then take 20", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
    put("take_n", "orders then sort [o_totalprice] descending, [o_orderkey] then take 25", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
    put("take_by", "orders then sort [o_totalprice] descending, [o_orderkey] then take 3 by [o_custkey]", "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
    put("take_ties", "part then sort [p_size] descending then take 10 with ties", "SELECT * FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 10")
    put("take_ties_by", "part then sort [p_size] then take 2 by [p_brand] with ties", "SELECT * FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_size) <= 2")
    put("take_last", "orders then sort [o_orderdate], [o_orderkey] then take_last 30", "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30")
    put("take_last_by", "orders then sort [o_orderdate], [o_orderkey] then take_last 2 by [o_custkey]", "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 2")
    put("take_last_ties", "part then sort [p_size] then take_last 5 with ties", "SELECT * FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 5")
    # windows
    by = "PARTITION BY user_id ORDER BY ts, event_id"

    def win(name: str, e: str, sql: str, rounded: bool = False) -> None:
        more = f" then add [x] as {c('[x]')}" if rounded else ""
        put(f"win_{name}", f"events then sort [ts], [event_id] then add [x] as {e} by [user_id]{more} then pick [event_id, x]", f"SELECT event_id, {q('x') if rounded else 'x'} AS x FROM (SELECT event_id, {sql} AS x FROM events)")

    put("win_rank", "orders then add [x] as rank([o_orderdate] descending) by [o_custkey] then pick [o_orderkey, x]", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST) AS x FROM orders")
    put("win_rank_all", "supplier then add [x] as rank([s_nationkey]) then pick [s_suppkey, x]", "SELECT s_suppkey, rank() OVER (ORDER BY s_nationkey) AS x FROM supplier")
    win("row_number", "row_number()", f"row_number() OVER ({by})")
    win("running_total", "running_total([value])", f"sum(value) OVER ({by} ROWS UNBOUNDED PRECEDING)", True)
    win("previous", "previous([value])", f"lag(value) OVER ({by})")
    win("previous_2", "previous([value], 2)", f"lag(value, 2) OVER ({by})")
    win("following", "following([event_type])", f"lead(event_type) OVER ({by})")
    put("win_latest", "events then add [v] as when([value] > 50, [value]) then sort [ts], [event_id] then add [x] as latest([v]) by [user_id] then pick [event_id, x]", f"SELECT event_id, last_value(v IGNORE NULLS) OVER ({by} ROWS UNBOUNDED PRECEDING) AS x FROM (SELECT *, CASE WHEN value > 50 THEN value END AS v FROM events)")
    for fn, sql in (("total", "sum"), ("average", "avg"), ("median", "median"), ("smallest", "min"), ("largest", "max"), ("standard_deviation", "stddev_samp")):
        frame = f"({by} ROWS 3 PRECEDING)"
        win(f"rolling_{fn}", f"rolling({fn}([value]), 4)", f"CASE WHEN count(value) OVER {frame} = 4 THEN {sql}(value) OVER {frame} END", True)
    # join
    put("join_left", "orders then join customer by [o_custkey] is [c_custkey] then pick [o_orderkey, o_custkey, c_name]", "SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
    put("join_inner", 'customer then join orders by [c_custkey] is [o_custkey] unmatched "none" then pick [c_custkey, o_orderkey]', "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey")
    put("join_full", 'customer then keep where [c_custkey] > 50 then join orders by [c_custkey] is [o_custkey] unmatched "both" then pick [c_custkey, c_name, o_orderkey]', "SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey > 50) FULL JOIN orders ON o_custkey = c_custkey")
    put("join_two_keys", "lineitem then add [o_custkey] as [l_suppkey] then join orders by [l_orderkey] is [o_orderkey], [o_custkey] then pick [l_orderkey, l_linenumber, o_totalprice]", "SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND l_suppkey = o_custkey")
    put("join_inferred", "nation then rename [r_regionkey] as [n_regionkey] then join region", "SELECT n_nationkey, n_name, n_regionkey AS r_regionkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
    # rows
    put("add_rows", "supplier then add_rows supplier then summarize [n] as row_count() by [s_nationkey]", "SELECT s_nationkey, CAST(2 * count(*) AS BIGINT) AS n FROM supplier GROUP BY s_nationkey")
    put("drop_duplicates", "orders then pick [o_orderstatus, o_orderpriority] then drop_duplicates", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
    every = "SELECT s_nationkey, s_suppkey, NULL AS s_name FROM (SELECT DISTINCT s_nationkey FROM t) CROSS JOIN (SELECT DISTINCT s_suppkey FROM t)"
    put("add_combinations", "supplier then pick [s_nationkey, s_suppkey, s_name] then add_combinations [s_nationkey, s_suppkey]", f"WITH t AS (SELECT s_nationkey, s_suppkey, s_name FROM supplier) SELECT * FROM t UNION ALL SELECT * FROM ({every}) ANTI JOIN t USING (s_nationkey, s_suppkey)")
    put("add_combinations_by", "orders then pick [o_custkey, o_orderstatus, o_orderpriority, o_orderkey] then add_combinations [o_orderstatus, o_orderpriority] by [o_custkey]", "WITH t AS (SELECT o_custkey, o_orderstatus, o_orderpriority, o_orderkey FROM orders), g AS (SELECT * FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM t) JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM t) USING (o_custkey)) SELECT * FROM t UNION ALL SELECT o_custkey, o_orderstatus, o_orderpriority, NULL FROM g ANTI JOIN t USING (o_custkey, o_orderstatus, o_orderpriority)")
    # columns
    put("rename", "region then rename [key] as [r_regionkey], [label] as [r_name]", "SELECT r_regionkey AS key, r_name AS label FROM region")
    put("drop_missing", "orders then add [x] as when([o_totalprice] > 100000, 1), [y] as when([o_totalprice] < 300000, 1) then drop_missing [x] then drop_missing then pick [o_orderkey]", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_totalprice < 300000")
    put("fill_missing", "orders then add [x] as when([o_totalprice] > 100000, [o_custkey]) then fill_missing [x] as 0 - [o_orderkey] then pick [o_orderkey, x]", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_custkey ELSE -o_orderkey END AS x FROM orders")
    # reshaping
    put("lengthen_one", "part then pick [p_partkey, p_size, p_retailprice] then lengthen [p_size, p_retailprice] as name [measure], value [amount]", "SELECT p_partkey, 'p_size' AS measure, CAST(p_size AS DOUBLE) AS amount FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
    put("lengthen_pattern", 'nation then rename [a_1] as [n_nationkey], [b_2] as [n_regionkey] then lengthen where kind is "number" as name "{letter}_{number}", value [x]', "SELECT n_name, 'a' AS letter, '1' AS number, n_nationkey AS x FROM nation UNION ALL SELECT n_name, 'b', '2', n_regionkey FROM nation")
    put("lengthen_value", 'lineitem then summarize [price_low] as smallest([l_extendedprice]), [price_high] as largest([l_extendedprice]), [size_low] as smallest([l_quantity]), [size_high] as largest([l_quantity]) by [l_shipdate] then lengthen all_but [l_shipdate] as name "{value}_{end}"', "WITH t AS (SELECT l_shipdate, min(l_extendedprice) AS pl, max(l_extendedprice) AS ph, min(l_quantity) AS sl, max(l_quantity) AS sh FROM lineitem GROUP BY l_shipdate) SELECT l_shipdate, 'low' AS \"end\", pl AS price, sl AS size FROM t UNION ALL SELECT l_shipdate, 'high', ph, sh FROM t")
    counts = "orders then summarize [n] as row_count() by [o_custkey, o_orderstatus]"
    wide = "SELECT o_custkey, {} FROM orders GROUP BY o_custkey"
    cell = "CASE WHEN count(*) FILTER (o_orderstatus = '{0}') > 0 THEN count(*) FILTER (o_orderstatus = '{0}') END AS {0}"
    put("widen_giving", f"{counts} then widen name [o_orderstatus], value [n] by [o_custkey] giving [F, O, P]", wide.format(", ".join(cell.format(x) for x in "FOP")))
    put("widen_missing", f"{counts} then widen name [o_orderstatus], value [n] by [o_custkey] missing 0 giving [F, O, P] then add [d] as [F] - [O]", wide.format(", ".join(f"count(*) FILTER (o_orderstatus = '{x}') AS {x}" for x in "FOP") + ", count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'O') AS d"))
    put("widen_aggregate", "orders then pick [o_custkey, o_orderstatus, o_orderkey] then widen name [o_orderstatus], value largest([o_orderkey]) - smallest([o_orderkey]) by [o_custkey] giving [F, O, P]", wide.format(", ".join(f"max(o_orderkey) FILTER (o_orderstatus = '{x}') - min(o_orderkey) FILTER (o_orderstatus = '{x}') AS {x}" for x in "FOP")))
    put("widen_open", f"{counts} then widen name [o_orderstatus], value [n]", wide.format(", ".join(cell.format(x) for x in "FOP")))
    put("round_trip", "part then pick [p_partkey, p_size, p_retailprice] then lengthen [p_size, p_retailprice] then widen name [name], value [value] by [p_partkey] giving [p_size, p_retailprice]", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part")
    # scalars
    put("text", 'customer then add [a] as lower([c_name]), [b] as upper([c_mktsegment]), [d] as trim(join_text("  ", [c_name], " ")), [e] as replace_text([c_name], "#", "-"), [f] as split_text([c_name], "#", 2), [g] as characters([c_name]), [h] as join_text([c_mktsegment], "/", to_text([c_custkey])) then pick [c_custkey, a, b, d, e, f, g, h]', "SELECT c_custkey, lower(c_name) AS a, upper(c_mktsegment) AS b, trim('  ' || c_name || ' ') AS d, replace(c_name, '#', '-') AS e, split_part(c_name, '#', 2) AS f, CAST(length(c_name) AS INTEGER) AS g, c_mktsegment || '/' || CAST(c_custkey AS VARCHAR) AS h FROM customer")
    put("numbers", 'orders then add [low] as round_below([o_totalprice] / 7), [high] as round_above([o_totalprice] / 7), [r] as remainder([o_orderkey] - 100, 7), [s] as remainder([o_orderkey], 0 - 7), [n] as to_number(to_text([o_orderkey])) then pick [o_orderkey, low, high, r, s, n]', "SELECT o_orderkey, CAST(floor(o_totalprice / 7) AS BIGINT) AS low, CAST(ceil(o_totalprice / 7) AS BIGINT) AS high, ((o_orderkey - 100) % 7 + 7) % 7 AS r, (o_orderkey % -7 + -7) % -7 AS s, CAST(o_orderkey AS DOUBLE) AS n FROM orders")
    put("dates", "events then add [y] as year([ts]), [m] as month([ts]), [d] as day([ts]), [w] as weekday([ts]), [h] as hour([ts]), [t] as to_date([ts]) then pick [event_id, y, m, d, w, h, t]", "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(isodow(ts) AS INTEGER) AS w, CAST(hour(ts) AS INTEGER) AS h, CAST(ts AS DATE) AS t FROM events")
    put("when", 'orders then add [size] as when([o_totalprice] >= 300000, "big", [o_totalprice] >= 100000, "medium", otherwise "small"), [flag] as when([o_orderstatus] is "F", yes) then pick [o_orderkey, size, flag]', "SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'big' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'small' END AS size, CASE WHEN o_orderstatus = 'F' THEN true END AS flag FROM orders")
    put("look_up", 'orders then add [x] as look_up([o_orderstatus], "F", "filled", "O", "open", otherwise missing) then pick [o_orderkey, x]', "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS x FROM orders")
    put("first_present", "orders then add [a] as when([o_totalprice] > 300000, 1), [b] as when([o_totalprice] > 100000, 2) then add [x] as first_present([a], [b], 3) then pick [o_orderkey, x]", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 1 WHEN o_totalprice > 100000 THEN 2 ELSE 3 END AS x FROM orders")
    # whole pipelines, after the published benchmark's six
    net = "[l_extendedprice] * (1 - [l_discount])"
    put("flagship", f"lineitem then keep where [l_quantity] > 10 then add [net] as {net} then summarize [net] as {c('total([net])')}, [lines] as row_count() by [l_returnflag, l_linestatus] then sort [net] descending then take 10", f"SELECT l_returnflag, l_linestatus, {q('sum(l_extendedprice * (1 - l_discount))')} AS net, count(*) AS lines FROM lineitem WHERE l_quantity > 10 GROUP BY ALL ORDER BY net DESC LIMIT 10")
    put("b1_filter_group", f"lineitem then keep where [l_quantity] > 5 and [l_discount] < 0.08 and [l_tax] > 0.01 then summarize [x] as {c('average([l_extendedprice])')} by [l_returnflag]", f"SELECT l_returnflag, {q('avg(l_extendedprice)')} AS x FROM lineitem WHERE l_quantity > 5 AND l_discount < 0.08 AND l_tax > 0.01 GROUP BY l_returnflag")
    put("b2_big_group", "lineitem then summarize [n] as row_count(), [q] as total([l_quantity]) by [l_partkey, l_suppkey] then sort [q] descending, [l_partkey], [l_suppkey] then take 5", "SELECT l_partkey, l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL ORDER BY q DESC, l_partkey, l_suppkey LIMIT 5")
    put("b3_derive_median", f"lineitem then add [share] as [l_tax] * [l_extendedprice] / [l_quantity] then summarize [x] as {c('median([share])')} by [l_linenumber]", f"SELECT l_linenumber, {q('median(l_tax * l_extendedprice / l_quantity)')} AS x FROM lineitem GROUP BY l_linenumber")
    put("b4_join_group", f"orders then join customer by [o_custkey] is [c_custkey] then summarize [x] as {c('total([o_totalprice])')} by [c_mktsegment]", f"SELECT c_mktsegment, {q('sum(o_totalprice)')} AS x FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
    put("b5_top_per_group", "lineitem then sort [l_extendedprice] descending, [l_orderkey], [l_linenumber] then take 3 by [l_suppkey]", "SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
    put("b6_capstone", f'lineitem then keep where [l_quantity] > 2 then add [net] as {net} then join supplier by [l_suppkey] is [s_suppkey] then join nation by [s_nationkey] is [n_nationkey] then summarize [net] as {c("total([net])")} by [n_regionkey, n_name] then add [place] as rank([net] descending) by [n_regionkey] then keep where [place] <= 2', f"SELECT * FROM (SELECT *, rank() OVER (PARTITION BY n_regionkey ORDER BY net DESC NULLS LAST) AS place FROM (SELECT n_regionkey, n_name, {q('sum(l_extendedprice * (1 - l_discount))')} AS net FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity > 2 GROUP BY ALL)) WHERE place <= 2")
    return out


def _query(sentence: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .plans.parser import parse

        tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in parse(sentence).tables()}
        return run_in(sentence, tables, {}, spark)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(sentence) for name, (sentence, _) in _all().items()}


def sentences() -> dict[str, str]:
    return {name: sentence for name, (sentence, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items()}

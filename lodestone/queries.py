"""The registered T-SQL queries: name, T-SQL text, and DuckDB text (None: the T-SQL text itself)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.session import Session

NOW = dt.datetime(2024, 1, 20, 10, 30)
CATALOGUE: dict[str, tuple[str, str | None]] = {}


def _add(name: str, tsql: str, duck: str | None = None) -> None:
    CATALOGUE[name] = (tsql, tsql if duck is None else duck)


DEC = "CAST({} AS DECIMAL(18,4))"
PRICE, DISC = DEC.format("l_extendedprice"), DEC.format("l_discount")

# scans, projection, predicates
_add("select_star_region", "SELECT * FROM region")
_add("project_expr", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS q2, l_extendedprice - l_tax AS net FROM lineitem")
_add("where_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.05")
_add("where_in_list", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey NOT IN (1, 2, 3)")
_add("where_like_class", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '[a-f]%'", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-f].*$')")
_add("like_escape", "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%!_%' ESCAPE '!' AND p_name LIKE '%w_d%'", "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%!_%' ESCAPE '!' AND p_name LIKE '%w_d%'")
_add("is_distinct_from", "SELECT n_nationkey FROM nation WHERE NULLIF(n_regionkey, 1) IS NOT DISTINCT FROM NULL OR n_regionkey IS DISTINCT FROM 2")
_add("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS s FROM orders")
_add("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS s FROM orders")
_add("coalesce_nullif_iif", "SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), -1) AS r, IIF(n_regionkey > 2, 'hi', 'lo') AS h, ISNULL(NULLIF(n_regionkey, 2), 99) AS i FROM nation", "SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), -1) AS r, CASE WHEN n_regionkey > 2 THEN 'hi' ELSE 'lo' END AS h, COALESCE(NULLIF(n_regionkey, 2), 99) AS i FROM nation")
_add("int_division_modulo", "SELECT p_partkey, p_partkey / 7 AS q, p_partkey % 7 AS r, (p_size + 1) / 2 AS h FROM part", "SELECT p_partkey, p_partkey // 7 AS q, p_partkey % 7 AS r, (p_size + 1) // 2 AS h FROM part")
_add("bitwise_ops", "SELECT p_partkey, p_size & 5 AS a, p_size | 8 AS o, p_size ^ 3 AS x, ~p_size AS n FROM part", "SELECT p_partkey, p_size & 5 AS a, p_size | 8 AS o, xor(p_size, 3) AS x, ~p_size AS n FROM part")
_add("unary_ops", "SELECT n_nationkey, -n_regionkey AS m, +n_regionkey AS p FROM nation")
_add("col_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = l_suppkey OR l_quantity !< 49 AND l_linenumber !> 2", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = l_suppkey OR l_quantity >= 49 AND l_linenumber <= 2")
_add("string_concat", "SELECT n_nationkey, n_name + '-' + CAST(n_regionkey AS varchar(10)) AS s, '1' + 2 AS three FROM nation", "SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS varchar) AS s, 3 AS three FROM nation")
_add("collate_ci", "SELECT n_nationkey FROM nation WHERE n_name COLLATE Latin1_General_CI_AS = 'nation_3' COLLATE Latin1_General_CI_AS OR n_name = 'x'", "SELECT n_nationkey FROM nation WHERE lower(n_name) = 'nation_3'")
_add("decimal_scale", "SELECT l_orderkey, l_linenumber, " + PRICE + " * (1 - " + DISC + ") AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(" + PRICE + " * (1 - " + DISC + ") AS DECIMAL(38,8)) AS d FROM lineitem")
# joins
_add("join_inner", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
_add("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000")
_add("join_right", "SELECT o_orderkey, c_name FROM orders RIGHT OUTER JOIN customer ON o_custkey = c_custkey")
_add("join_full", "SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey")
_add("join_full_theta", "SELECT r_regionkey, n_nationkey FROM region FULL OUTER JOIN nation ON r_regionkey > n_regionkey + 3")
_add("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_add("join_comma_where", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
_add("join_multi_key", "SELECT a.l_orderkey, a.l_linenumber FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE b.l_quantity > 45")
_add("join_expr_key", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_partkey % 10 = s_suppkey")
_add("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
_add("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey")
_add("join_residual_outer", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 20")
_add("join_nested_on", "SELECT c_custkey, o_orderkey, n_name FROM customer JOIN nation JOIN region ON n_regionkey = r_regionkey ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE r_regionkey = 1")
_add("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
_add("anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_add("semi_exists_corr", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
_add("anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
_add("exists_or", "SELECT c_custkey FROM customer c WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 300000)")
_add("exists_uncorrelated", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3)")
_add("cross_apply_topn", "SELECT c.c_custkey, x.o_orderkey FROM customer c CROSS APPLY (SELECT TOP 2 o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey) x", "SELECT c.c_custkey, x.o_orderkey FROM customer c, LATERAL (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 2) x")
_add("outer_apply", "SELECT c.c_custkey, x.o_orderkey FROM customer c OUTER APPLY (SELECT TOP 1 o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_orderkey) x", "SELECT c.c_custkey, x.o_orderkey FROM customer c LEFT JOIN LATERAL (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_orderkey LIMIT 1) x ON true")
# subqueries
_add("scalar_uncorrelated", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)")
_add("scalar_correlated", "SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer")
_add("subquery_in_select", "SELECT n_name, (SELECT COUNT(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation")
_add("subquery_in_on", "SELECT r_regionkey, n_nationkey FROM region LEFT JOIN nation ON r_regionkey = n_regionkey AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
_add("derived_table", "SELECT x.k, x.n FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey) AS x WHERE x.n > 2")
_add("values_table", "SELECT t.a, t.b FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) AS t(a, b)")
# aggregates
_add("agg_scalar", f"SELECT COUNT(*) AS n, COUNT(l_tax) AS t, MIN(l_quantity) AS lo, MAX(l_shipdate) AS hi, SUM({PRICE}) AS s FROM lineitem")
_add("agg_group", f"SELECT l_returnflag, l_linestatus, SUM({PRICE}) AS s, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
_add("agg_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS p, SUM(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_returnflag")
_add("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10 AND MAX(o_totalprice) > 100000")
_add("agg_expr_key", "SELECT YEAR(o_orderdate) AS y, DATEPART(quarter, o_orderdate) AS q, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate), DATEPART(quarter, o_orderdate)", "SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, COUNT(*) AS n FROM orders GROUP BY 1, 2")
_add("avg_int_trunc", "SELECT p_brand, AVG(p_size) AS a FROM part GROUP BY p_brand", "SELECT p_brand, SUM(p_size) // COUNT(p_size) AS a FROM part GROUP BY p_brand")
_add("string_agg_ordered", "SELECT n_regionkey, STRING_AGG(n_name, ', ') WITHIN GROUP (ORDER BY n_name DESC) AS s FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, STRING_AGG(n_name, ', ' ORDER BY n_name DESC) AS s FROM nation GROUP BY n_regionkey")
_add("group_by_only", "SELECT p_type FROM part GROUP BY p_type")
_add("agg_empty_input", "SELECT COUNT(*) AS n, SUM(p_size) AS s, MIN(p_name) AS m FROM part WHERE p_size < 0")
_add("cube_bonus", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)")
_add("flagship", f"SELECT TOP 10 c.c_mktsegment, YEAR(o.o_orderdate) AS y, COUNT(*) AS n, SUM({PRICE} * (1 - {DISC})) AS rev FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity BETWEEN 10 AND 40 GROUP BY c.c_mktsegment, YEAR(o.o_orderdate) HAVING COUNT(*) > 10 ORDER BY rev DESC", f"SELECT c.c_mktsegment, year(o.o_orderdate) AS y, COUNT(*) AS n, SUM({PRICE} * (1 - {DISC})) AS rev FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity BETWEEN 10 AND 40 GROUP BY 1, 2 HAVING COUNT(*) > 10 ORDER BY rev DESC LIMIT 10")
# windows
_add("row_number", "SELECT n_nationkey, ROW_NUMBER() OVER (ORDER BY n_name DESC, n_nationkey) AS r FROM nation")
_add("row_number_partition", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders")
_add("rank", "SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part")
_add("dense_rank", "SELECT p_partkey, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part")
_add("sum_over_partition", "SELECT p_partkey, SUM(p_size) OVER (PARTITION BY p_brand) AS s, COUNT(*) OVER (PARTITION BY p_brand) AS n FROM part")
_add("rows_rolling_avg", "SELECT o_orderkey, AVG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING) AS a FROM orders", "SELECT o_orderkey, AVG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a FROM orders")
_add("rows_cumulative", "SELECT p_partkey, SUM(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM part")
_add("rows_following", "SELECT p_partkey, MAX(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m FROM part")
_add("multi_window", "SELECT p_partkey, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r, SUM(p_size) OVER (PARTITION BY p_type) AS s FROM part")
_add("window_named", "SELECT p_partkey, RANK() OVER w AS r FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
_add("lag_lead_bonus", "SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders")
# order and limits
_add("top_n", "SELECT TOP 5 o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
_add("top_percent", "SELECT TOP 3 PERCENT o_orderkey FROM orders ORDER BY o_orderkey", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) r, count(*) OVER () n FROM orders) WHERE r <= ceil(n * 3 / 100.0)")
_add("top_with_ties", "SELECT TOP 5 WITH TIES p_partkey, p_size FROM part ORDER BY p_size DESC", "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) r FROM part) WHERE r <= 5")
_add("top_with_ties_agg", "SELECT TOP 2 WITH TIES n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey ORDER BY COUNT(*)", "SELECT n_regionkey, n FROM (SELECT n_regionkey, COUNT(*) AS n, rank() OVER (ORDER BY COUNT(*)) r FROM nation GROUP BY 1) WHERE r <= 2")
_add("offset_fetch", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 10 ROWS FETCH NEXT 7 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7 OFFSET 10")
_add("order_by_alias", "SELECT TOP 4 n_nationkey * 2 AS d FROM nation ORDER BY d DESC", "SELECT n_nationkey * 2 AS d FROM nation ORDER BY d DESC LIMIT 4")
_add("order_by_ordinal", "SELECT TOP 4 n_name, n_nationkey FROM nation ORDER BY 2 DESC", "SELECT n_name, n_nationkey FROM nation ORDER BY 2 DESC LIMIT 4")
_add("distinct", "SELECT DISTINCT p_brand, p_type FROM part")
# set operations
_add("union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
_add("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
_add("intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
_add("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
_add("except_nulls", "SELECT a, b FROM (VALUES ('a', 'b'), ('b', NULL), ('c', 'd')) AS t(a, b) EXCEPT SELECT a, b FROM (VALUES ('b', NULL)) AS u(a, b)")
_add("union_type_widening", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT 1.5", "SELECT CAST(n_nationkey AS DECIMAL(11,1)) AS k FROM nation UNION ALL SELECT 1.5")
# common table expressions
_add("cte_simple", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey")
_add("cte_multi_ref", "WITH t(k, n) AS (SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey) SELECT a.k, a.n FROM t a JOIN t b ON a.k = b.k + 1 WHERE a.n > b.n")
_add("cte_recursive_counter", "WITH c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 50) SELECT n FROM c", "WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 50) SELECT n FROM c")
_add("cte_recursive_hierarchy", "WITH h(k, lvl) AS (SELECT s_suppkey, 0 FROM supplier WHERE s_suppkey = 1 UNION ALL SELECT s.s_suppkey, h.lvl + 1 FROM supplier s JOIN h ON s.s_suppkey / 2 = h.k WHERE s.s_suppkey > 1) SELECT k, lvl FROM h", "WITH RECURSIVE h(k, lvl) AS (SELECT s_suppkey, 0 FROM supplier WHERE s_suppkey = 1 UNION ALL SELECT s.s_suppkey, h.lvl + 1 FROM supplier s JOIN h ON s.s_suppkey // 2 = h.k WHERE s.s_suppkey > 1) SELECT k, lvl FROM h")
_add("cte_factorial", "WITH f(n, v) AS (SELECT 1, 1 UNION ALL SELECT n + 1, v * (n + 1) FROM f WHERE n < 5) SELECT n, v FROM f OPTION (MAXRECURSION 10)", "WITH RECURSIVE f(n, v) AS (SELECT 1, 1 UNION ALL SELECT n + 1, v * (n + 1) FROM f WHERE n < 5) SELECT n, v FROM f")

# scalar functions: one query for each, over a table's column
for _name, _table, _key, _tsql, _duck in (
    ("left_right", "part", "p_partkey", "LEFT(p_name, 3) + RIGHT(p_name, 2)", "left(p_name, 3) || right(p_name, 2)"),
    ("replace", "part", "p_partkey", "REPLACE(p_name, 'WIDGET', 'gear')", "regexp_replace(p_name, 'widget', 'gear', 'gi')"),
    ("len", "part", "p_partkey", "LEN(p_name + '  ')", "length(rtrim(p_name || '  '))"),
    ("datalength", "part", "p_partkey", "DATALENGTH(p_name)", "length(p_name) * 2"),
    ("substring", "part", "p_partkey", "SUBSTRING(p_name, 0, 4)", "substring(p_name, 1, 4)"),
    ("trim", "part", "p_partkey", "TRIM('  ' + p_name + ' ') + LTRIM(' x') + RTRIM('y ')", "trim('  ' || p_name || ' ') || 'x' || 'y'"),
    ("trim_chars", "part", "p_partkey", "TRIM(LEADING 'cb' FROM p_name)", "ltrim(p_name, 'cb')"),
    ("charindex", "part", "p_partkey", "CHARINDEX('W', p_name)", "instr(lower(p_name), 'w')"),
    ("patindex", "part", "p_partkey", "PATINDEX('%[e-i]%', p_name)", "CASE WHEN regexp_matches(p_name, '(?i)[e-i]') THEN length(regexp_extract(p_name, '^(?i)([^e-iE-I]*)', 1)) + 1 ELSE 0 END"),
    ("char_ascii", "part", "p_partkey", "CHAR(ASCII(p_name) + 1)", "chr(ascii(p_name) + 1)"),
    ("unicode_nchar", "part", "p_partkey", "NCHAR(UNICODE(p_name))", "chr(unicode(p_name))"),
    ("upper_lower", "part", "p_partkey", "UPPER(p_name) + LOWER(p_brand)", "upper(p_name) || lower(p_brand)"),
    ("stuff", "part", "p_partkey", "STUFF(p_name, 2, 3, '--')", "CASE WHEN 2 > length(p_name) THEN NULL ELSE substring(p_name, 1, 1) || '--' || substring(p_name, 5) END"),
    ("format_date", "orders", "o_orderkey", "FORMAT(o_orderdate, 'yyyy/MM/dd')", "strftime(o_orderdate, '%Y/%m/%d')"),
    ("format_number", "part", "p_partkey", "FORMAT(p_partkey * 1000, 'N0')", "format('{:,}', p_partkey * 1000)"),
    ("formatmessage", "part", "p_partkey", "FORMATMESSAGE('%s has %d', p_name, p_size)", "printf('%s has %d', p_name, p_size)"),
    ("dateadd_month", "orders", "o_orderkey", "DATEADD(month, 1, o_orderdate)", "o_orderdate + INTERVAL 1 MONTH"),
    ("dateadd_hour", "events", "event_id", "DATEADD(hour, -5, ts)", "ts - INTERVAL 5 HOUR"),
    ("datediff_month", "orders", "o_orderkey", "DATEDIFF(month, o_orderdate, '2001-09-15')", "date_diff('month', o_orderdate, TIMESTAMP '2001-09-15')"),
    ("datediff_week", "orders", "o_orderkey", "DATEDIFF(wk, '1995-01-01', o_orderdate)", "date_diff('day', DATE '1995-01-01' - dayofweek(DATE '1995-01-01')::INT, o_orderdate::DATE - dayofweek(o_orderdate)::INT) // 7"),
    ("datediff_day", "orders", "o_orderkey", "DATEDIFF(dd, o_orderdate, '2001-09-15')", "date_diff('day', o_orderdate, TIMESTAMP '2001-09-15')"),
    ("datediff_minute", "events", "event_id", "DATEDIFF(minute, '2024-01-01', ts)", "date_diff('minute', TIMESTAMP '2024-01-01', ts)"),
    ("datetrunc_week", "orders", "o_orderkey", "CAST(DATETRUNC(week, o_orderdate) AS date)", "o_orderdate::DATE - dayofweek(o_orderdate)::INT"),
    ("datetrunc_month", "orders", "o_orderkey", "CAST(DATETRUNC(month, o_orderdate) AS date)", "date_trunc('month', o_orderdate)::DATE"),
    ("datepart_weekday", "orders", "o_orderkey", "DATEPART(weekday, o_orderdate)", "dayofweek(o_orderdate) + 1"),
    ("datepart_isoweek", "orders", "o_orderkey", "DATEPART(iso_week, o_orderdate)", "weekofyear(o_orderdate)"),
    ("day_month_year", "orders", "o_orderkey", "DAY(o_orderdate) + MONTH(o_orderdate) * 100 + YEAR(o_orderdate) * 10000", "day(o_orderdate) + month(o_orderdate) * 100 + year(o_orderdate) * 10000"),
    ("convert_style", "orders", "o_orderkey", "CONVERT(varchar(10), o_orderdate, 103)", "strftime(o_orderdate, '%d/%m/%Y')"),
    ("abs_sign", "customer", "c_custkey", "ABS(c_custkey - 50) * SIGN(c_custkey - 50)", "c_custkey - 50"),
    ("ceiling_floor", "orders", "o_orderkey", "CEILING(o_totalprice) - FLOOR(o_totalprice)", "ceil(o_totalprice) - floor(o_totalprice)"),
    ("round_decimal", "lineitem", "l_orderkey, l_linenumber", f"ROUND({PRICE}, 1)", f"CAST(round({PRICE}, 1) AS DECIMAL(18,4))"),
    ("round_trunc", "part", "p_partkey", "ROUND(p_size * 10 + 7, -1, 1)", "(p_size * 10 + 7) // 10 * 10"),
    ("json_value", "events", "event_id", "JSON_VALUE(props, '$.k')", "json_extract_string(props, '$.k')"),
    ("json_query", "events", "event_id", "JSON_QUERY('{\"a\":' + props + '}', '$.a')", "replace(props, ' ', '')"),
    ("json_path_exists", "events", "event_id", "JSON_PATH_EXISTS(props, '$.k') + JSON_PATH_EXISTS(props, '$.zz')", "CASE WHEN json_exists(props, '$.k') THEN 1 ELSE 0 END"),
    ("isjson", "events", "event_id", "ISJSON(props) + ISJSON('[1') * 10", "1"),
    ("xml_value", "part", "p_partkey", "CAST('<a><b>' + p_name + '</b></a>' AS xml).value('/a/b', 'varchar(100)')", "p_name"),
):
    _add(f"fn_{_name}", f"SELECT {_key}, {_tsql} AS v FROM {_table}", f"SELECT {_key}, {_duck} AS v FROM {_table}")

# native filters, at the fixed clock
_today = "TIMESTAMP '2024-01-20'"
for _name, _tsql, _low, _high in (
    ("yesterday", "yesterday()", "TIMESTAMP '2024-01-19'", _today), ("today", "today()", _today, "TIMESTAMP '2024-01-21'"), ("tomorrow", "tomorrow()", "TIMESTAMP '2024-01-21'", "TIMESTAMP '2024-01-22'"),
    ("lastsevendays", "lastsevendays()", "TIMESTAMP '2024-01-13'", "TIMESTAMP '2024-01-20 10:30:00'"), ("nextsevendays", "nextsevendays()", "TIMESTAMP '2024-01-20 10:30:00'", "TIMESTAMP '2024-01-28'"),
    ("lastweek", "lastweek()", "TIMESTAMP '2024-01-07'", "TIMESTAMP '2024-01-14'"), ("thisweek", "thisweek()", "TIMESTAMP '2024-01-14'", "TIMESTAMP '2024-01-21'"),
    ("thismonth", "thismonth()", "TIMESTAMP '2024-01-01'", "TIMESTAMP '2024-02-01'"), ("thisyear", "thisyear()", "TIMESTAMP '2024-01-01'", "TIMESTAMP '2025-01-01'"),
    ("on", "[on]('2024-01-05')", "TIMESTAMP '2024-01-05'", "TIMESTAMP '2024-01-06'"), ("onorbefore", "onorbefore('2024-01-05')", None, "TIMESTAMP '2024-01-06'"), ("onorafter", "onorafter('2024-01-25')", "TIMESTAMP '2024-01-25'", None),
    ("lastxhours", "lastxhours(6)", "TIMESTAMP '2024-01-20 04:00:00'", "TIMESTAMP '2024-01-20 10:30:00'"), ("nextxdays", "nextxdays(3)", "TIMESTAMP '2024-01-20 10:30:00'", "TIMESTAMP '2024-01-24'"),
    ("lastxdays", "lastxdays(7)", "TIMESTAMP '2024-01-13'", "TIMESTAMP '2024-01-20 10:30:00'"), ("lastxmonths", "lastxmonths(2)", "TIMESTAMP '2023-11-20'", "TIMESTAMP '2024-01-20 10:30:00'"),
    ("olderthanxdays", "olderthanxdays(10)", None, "TIMESTAMP '2024-01-10 10:30:00'"), ("olderthanxhours", "olderthanxhours(30)", None, "TIMESTAMP '2024-01-19 04:30:00'"),
    ("thisfiscalperiod", "thisfiscalperiod()", "TIMESTAMP '2024-01-01'", "TIMESTAMP '2024-04-01'"), ("infiscalyear", "infiscalyear(2024)", "TIMESTAMP '2024-01-01'", "TIMESTAMP '2025-01-01'"),
    ("infiscalperiodandyear", "infiscalperiodandyear(1, 2024)", "TIMESTAMP '2024-01-01'", "TIMESTAMP '2024-04-01'"),
):
    _bounds = " AND ".join([f"ts >= {_low}"] * (_low is not None) + [f"ts < {_high}"] * (_high is not None))
    _add(f"filter_{_name}", f"SELECT event_id FROM events WHERE ts = {_tsql}", f"SELECT event_id FROM events WHERE {_bounds}")
_add("filter_beginswith", "SELECT p_partkey FROM part WHERE p_name = beginswith('c') AND p_name = notendwith('x')", "SELECT p_partkey FROM part WHERE p_name LIKE 'c%' AND p_name NOT LIKE '%x'")
_add("filter_containvalues", "SELECT p_partkey FROM part WHERE p_size = containvalues(3, 7)", "SELECT p_partkey FROM part WHERE p_size IN (3, 7)")
_add("filter_under", "SELECT s_suppkey FROM supplier WHERE s_suppkey = under(2)", "WITH RECURSIVE h(k) AS (SELECT s_suppkey FROM supplier WHERE s_suppkey // 2 = 2 UNION ALL SELECT s_suppkey FROM supplier JOIN h ON s_suppkey // 2 = k) SELECT k AS s_suppkey FROM h")
_add("filter_eqorabove", "SELECT s_suppkey FROM supplier WHERE s_suppkey = eqorabove(9)", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (9, 4, 2, 1, 0)")

# table-valued functions, JSON, XML
_add("string_split_apply", "SELECT p_partkey, s.value, s.ordinal FROM part CROSS APPLY STRING_SPLIT(p_name, ' ', 1) s", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS value, generate_subscripts(string_split(p_name, ' '), 1) AS ordinal FROM part")
_add("openjson_default", "SELECT e.event_id, j.[key], j.value, j.type FROM events e CROSS APPLY OPENJSON(e.props) j", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value, 2 AS type FROM events")
_add("openjson_schema", "SELECT e.event_id, j.k FROM events e CROSS APPLY OPENJSON(e.props) WITH (k int '$.k') j", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
_add("openjson_array", "SELECT j.n, j.q FROM OPENJSON('[{\"Order\":{\"Number\":\"S1\"},\"Item\":{\"Quantity\":3}},{\"Order\":{\"Number\":\"S2\"},\"Item\":{\"Quantity\":5}}]') WITH (n varchar(10) '$.Order.Number', q int '$.Item.Quantity') j", "SELECT * FROM (VALUES ('S1', 3), ('S2', 5)) t(n, q)")
_add("for_xml_raw", "SELECT r_regionkey AS k, r_name AS n FROM region ORDER BY r_regionkey FOR XML RAW", "SELECT string_agg('<row k=\"' || r_regionkey || '\" n=\"' || r_name || '\" />', '' ORDER BY r_regionkey) AS xml FROM region")
_add("for_xml_path", "SELECT r_regionkey AS [@k], r_name AS [a/n] FROM region ORDER BY r_regionkey FOR XML PATH('r'), ROOT('all')", "SELECT '<all>' || string_agg('<r k=\"' || r_regionkey || '\"><a><n>' || r_name || '</n></a></r>', '' ORDER BY r_regionkey) || '</all>' AS xml FROM region")

# scripts
_add("proc_while_sum", "DECLARE @i int = 1, @s int = 0; WHILE @i <= 10 BEGIN SET @s += @i; SET @i = @i + 1; IF @i = 8 BREAK; END; SELECT @s AS s, @i AS i", "SELECT 28 AS s, 8 AS i")
_add("proc_try_catch", "BEGIN TRY SELECT 1 / (n_nationkey - n_nationkey) AS x FROM nation END TRY BEGIN CATCH SELECT ERROR_NUMBER() AS n, ERROR_SEVERITY() AS s END CATCH", "SELECT 8134 AS n, 16 AS s")
_add("proc_goto", "DECLARE @n int = 0; again: SET @n += 1; IF @n < 3 GOTO again; SELECT @n AS n", "SELECT 3 AS n")
_add("proc_cursor", "DECLARE @k int, @t int = 0; DECLARE c CURSOR FOR SELECT r_regionkey FROM region ORDER BY r_regionkey; OPEN c; FETCH NEXT FROM c INTO @k; WHILE @@FETCH_STATUS = 0 BEGIN SET @t = @t * 10 + @k; FETCH NEXT FROM c INTO @k; END; CLOSE c; DEALLOCATE c; SELECT @t AS t", "SELECT 1234 AS t")
_add("select_assign", "DECLARE @m bigint; SELECT @m = MAX(o_orderkey) FROM orders; SELECT @m AS m, @@ROWCOUNT AS n", "SELECT MAX(o_orderkey) AS m, 1 AS n FROM orders")
_add("temp_table_dml", "CREATE TABLE #t (id int, name nvarchar(100)); INSERT INTO #t (id, name) VALUES (1, 'Hello'), (2, 'World'), (3, 'x'); UPDATE #t SET name = name + '!' WHERE id < 3; DELETE FROM #t WHERE id = 3; SELECT id, name FROM #t", "SELECT * FROM (VALUES (1, 'Hello!'), (2, 'World!')) t(id, name)")
_add("update_from_join", "CREATE TABLE #n (k int, r varchar(50)); INSERT INTO #n SELECT n_nationkey, NULL FROM nation; UPDATE t SET r = region.r_name FROM #n t JOIN nation ON nation.n_nationkey = t.k JOIN region ON r_regionkey = n_regionkey; SELECT k, r FROM #n", "SELECT n_nationkey AS k, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
_add("delete_duplicates_cte", "CREATE TABLE #d (a int, b int); INSERT INTO #d SELECT n_regionkey, n_nationkey FROM nation; WITH x AS (SELECT a, b, ROW_NUMBER() OVER (PARTITION BY a ORDER BY b) AS rn FROM #d) DELETE FROM x WHERE rn > 1; SELECT a, b FROM #d", "SELECT n_regionkey AS a, MIN(n_nationkey) AS b FROM nation GROUP BY 1")
_add("sp_executesql", "DECLARE @n bigint; EXEC sp_executesql N'SELECT @c = COUNT(*) FROM nation WHERE n_regionkey = @r', N'@r int, @c bigint OUTPUT', @r = 2, @c = @n OUTPUT; SELECT @n AS n", "SELECT COUNT(*) AS n FROM nation WHERE n_regionkey = 2")
CATALOGUE["metadata_entity"] = ("SELECT logicalname, attributecount FROM metadata.entity WHERE logicalname = 'nation'", "SELECT 'nation' AS logicalname, 3 AS attributecount")
CATALOGUE["metadata_attribute_join"] = ("SELECT e.logicalname, a.logicalname AS attribute FROM metadata.entity e JOIN metadata.attribute a ON a.entitylogicalname = e.logicalname WHERE e.logicalname = 'region'", "SELECT * FROM (VALUES ('region', 'r_regionkey'), ('region', 'r_name')) t(logicalname, attribute)")

# the same predicates over rows of which some are kept and some are not
_shifted = "(SELECT event_id, DATEADD(day, event_id % 900 - 450, ts) AS d FROM events) AS e"
_moved = "(SELECT event_id, ts + to_days(CAST(event_id % 900 - 450 AS INTEGER)) AS d FROM events) AS e"
for _name, _tsql, _low, _high in (
    ("thismonth", "thismonth()", "2024-01-01", "2024-02-01"), ("lastmonth", "lastmonth()", "2023-12-01", "2024-01-01"), ("nextmonth", "nextmonth()", "2024-02-01", "2024-03-01"),
    ("thisyear", "thisyear()", "2024-01-01", "2025-01-01"), ("lastyear", "lastyear()", "2023-01-01", "2024-01-01"), ("nextyear", "nextyear()", "2025-01-01", "2026-01-01"),
    ("nextweek", "nextweek()", "2024-01-21", "2024-01-28"), ("thisfiscalperiod", "thisfiscalperiod()", "2024-01-01", "2024-04-01"), ("lastfiscalperiod", "lastfiscalperiod()", "2023-10-01", "2024-01-01"),
    ("thisfiscalyear", "thisfiscalyear()", "2024-01-01", "2025-01-01"), ("lastfiscalyear", "lastfiscalyear()", "2023-01-01", "2024-01-01"), ("infiscalyear", "infiscalyear(2023)", "2023-01-01", "2024-01-01"),
    ("infiscalperiodandyear", "infiscalperiodandyear(2, 2024)", "2024-04-01", "2024-07-01"),
):
    _add(f"filter_{_name}_some", f"SELECT event_id FROM {_shifted} WHERE d = {_tsql}", f"SELECT event_id FROM {_moved} WHERE d >= TIMESTAMP '{_low}' AND d < TIMESTAMP '{_high}'")
_add("anti_not_in_some", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
_add("anti_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 1) FROM region)")
_add("anti_not_exists_some", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
_add("except_some", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
_add("like_empty_sets", "SELECT p_partkey, CASE WHEN p_name LIKE '%[z-a]%' THEN 1 ELSE 0 END AS a, CASE WHEN p_name LIKE '%[^a-m ]' THEN 1 ELSE 0 END AS b FROM part", "SELECT p_partkey, 0 AS a, CASE WHEN regexp_matches(p_name, '[^a-m ]$') THEN 1 ELSE 0 END AS b FROM part")
_add("cast_tinyint", "SELECT p_partkey, TRY_CAST(p_partkey * 3 AS tinyint) AS t FROM part", "SELECT p_partkey, CASE WHEN p_partkey * 3 BETWEEN 0 AND 255 THEN p_partkey * 3 END AS t FROM part")
_add("replace_marks", "SELECT p_partkey, REPLACE(p_name + '\\E.$1', '\\E.$', p_brand + '$') AS s, REPLACE(p_name, '', 'x') AS t FROM part", "SELECT p_partkey, p_name || p_brand || '$1' AS s, p_name AS t FROM part")
_add("json_path_exists_null", "SELECT event_id, JSON_PATH_EXISTS(CASE WHEN event_id % 3 = 0 THEN '{\"a\":null}' WHEN event_id % 3 = 1 THEN '{\"a\":1}' ELSE '{\"b\":1}' END, '$.a') AS x FROM events", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE 1 END AS x FROM events")
_add("isjson_kinds", "SELECT event_id, ISJSON(props, OBJECT) AS o, ISJSON(props, ARRAY) AS a, ISJSON(event_type) AS n FROM events", "SELECT event_id, 1 AS o, 0 AS a, 0 AS n FROM events")
_add("json_value_bracket", "SELECT p_partkey, JSON_VALUE('{\"a\":\"[' + p_name + '\",\"b\":[1]}', '$.a') AS a, JSON_VALUE('{\"a\":\"[' + p_name + '\",\"b\":[1]}', '$.b') AS b FROM part", "SELECT p_partkey, '[' || p_name AS a, CAST(NULL AS VARCHAR) AS b FROM part")
_add("format_currency", "SELECT n_nationkey, FORMAT(n_nationkey * 1234.5, 'C') AS us, FORMAT(n_nationkey * 1234.5, 'C2', 'de-DE') AS de, FORMAT(n_regionkey - 2, 'N1', 'es-ES') AS es FROM nation", "SELECT n_nationkey, '$' || format('{:,.2f}', n_nationkey * 1234.5) AS us, translate(format('{:,.2f}', n_nationkey * 1234.5), ',.', '.,') || ' €' AS de, translate(format('{:.1f}', CAST(n_regionkey - 2 AS DOUBLE)), '.', ',') AS es FROM nation")
_add("fn_datename_words", "SELECT event_id, DATENAME(month, ts) AS m, DATENAME(weekday, ts) AS w, DATENAME(year, ts) AS y FROM events", "SELECT event_id, monthname(ts) AS m, dayname(ts) AS w, CAST(year(ts) AS VARCHAR) AS y FROM events")
_add("select_accumulate", "DECLARE @n bigint = 0, @s varchar(max) = ''; SELECT @n = @n + n_nationkey * n_regionkey, @s += n_name + ';' FROM nation ORDER BY n_nationkey DESC; SELECT @n AS n, @s AS s", "SELECT CAST(sum(n_nationkey * n_regionkey) AS BIGINT) AS n, string_agg(n_name || ';', '' ORDER BY n_nationkey DESC) AS s FROM nation")
_add("set_dateformat", "SET DATEFORMAT dmy; SELECT o_orderkey, CAST('13/02/1999' AS date) AS d FROM orders WHERE o_orderdate < CAST('13 Feb 1999' AS datetime)", "SELECT o_orderkey, DATE '1999-02-13' AS d FROM orders WHERE o_orderdate < TIMESTAMP '1999-02-13'")
_add("temp_table_appends", "CREATE TABLE #a (k int); DECLARE @i int = 0; WHILE @i < 3 BEGIN INSERT INTO #a SELECT n_nationkey + @i FROM nation; SET @i += 1 END; SELECT k, COUNT(*) AS n FROM #a GROUP BY k", "SELECT n_nationkey + i AS k, COUNT(*) AS n FROM nation, range(3) r(i) GROUP BY 1")


def session(spark: SparkSession, sf_dir: str) -> Session:
    found = Session.over(spark, sf_dir, now=NOW)
    view, _ = found.table(["supplier"])
    found.register("supplier", spark.sql(f"SELECT *, s_suppkey div 2 AS s_parent FROM {view}"))
    found.register_hierarchy("supplier", "s_suppkey", "s_parent")
    return found


def _query(tsql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session(spark, sf_dir).query(tsql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .streaming.windows import queries as streaming

    return {name: _query(tsql) for name, (tsql, _) in CATALOGUE.items()} | streaming()


def oracle_sql() -> dict[str, str]:
    from .streaming.windows import oracle_sql as streaming

    return {name: duck for name, (_, duck) in CATALOGUE.items()} | streaming()

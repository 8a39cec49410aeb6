"""Behaviour that the DuckDB comparison doesn't cover: errors, messages, options, plan shapes."""

import datetime as dt
import math

import duckdb
import pytest
from hypothesis import example, given
from hypothesis import strategies as st

from lodestone import queries as catalogue
from lodestone.functions.filters import Context, date_range
from lodestone.functions.scalar import like_regex
from lodestone.plans.errors import TSqlError
from lodestone.plans.parser import parse
from lodestone.plans.session import Session
from lodestone.plans.types import arithmetic, common


@pytest.fixture()
def session(spark, sf_dir):
    return Session.over(spark, sf_dir, now=dt.datetime(2024, 1, 20, 10, 30))


def rows(session, text, **kw):
    return [tuple(r) for r in session.query(text, **kw).collect()]


def test_decimal_rules():
    assert arithmetic("+", "decimal(10,2)", "decimal(12,4)") == "decimal(13,4)"
    assert arithmetic("/", "decimal(10,2)", "decimal(12,4)") == "decimal(27,15)"
    assert common("int", "string") == "int"
    assert common("null", "date") == "date"


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("SELECT nope FROM region", 207),
        ("SELECT * FROM nowhere", 208),
        ("SELECT n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey", 209),
        ("SELECT n_name, COUNT(*) FROM nation GROUP BY n_regionkey", 8120),
        ("SELECT n_name FROM nation WHERE ROW_NUMBER() OVER (ORDER BY n_name) = 1", 4108),
        ("SELECT n_name FROM nation WHERE COUNT(*) > 1", 147),
        ("SELECT ROW_NUMBER() OVER (PARTITION BY n_name) FROM nation", 4112),
        ("SELECT nofunc(1)", 195),
        ("SELECT 1 UNION ALL SELECT 1, 2", 205),
        ("SELECT n_name FROM nation ORDER BY n_name OFFSET -1 ROWS FETCH NEXT 1 ROWS ONLY", 10742),
        ("SELECT n_name FROM nation ORDER BY n_name OFFSET 1 ROWS FETCH NEXT 0 ROWS ONLY", 10744),
        ("SELECT TOP 1 WITH TIES n_name FROM nation", 1062),
        ("SELECT @x", 137),
        ("BREAK", 135),
        ("GOTO nowhere", 133),
        ("WITH c AS (SELECT 1 AS n UNION ALL SELECT DISTINCT n + 1 FROM c) SELECT * FROM c", 460),
        ("WITH c AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM c) SELECT * FROM c OPTION (MAXRECURSION 40000)", 310),
        ("SELECT * FROM STRING_SPLIT('a', 'bc')", 214),
        ("SELECT CAST(1 AS nosuch)", 243),
        ("THROW 51000, 'own', 3", 51000),
        ("SELECT * FROM nation FOR JSON PATH", 40517),
    ],
)
def test_errors(session, text, number):
    with pytest.raises(TSqlError) as found:
        session.sql(text)
    assert found.value.number == number


def test_blocked_changes(spark):
    s = Session(spark, block_delete_without_where=True, block_update_without_where=True)
    s.sql("CREATE TABLE #a (x int); INSERT INTO #a VALUES (1)")
    for text in ("DELETE FROM #a", "UPDATE #a SET x = 2"):
        with pytest.raises(TSqlError):
            s.sql(text)


def test_script_results(session):
    found = session.sql("PRINT 'hi'; CREATE TABLE #t (x int NOT NULL, y varchar(3)); INSERT INTO #t VALUES (1, 'abcdef'), (2, NULL); DELETE FROM #t WHERE x = 1; SELECT * FROM #t")
    assert found.messages == ["hi"] and found.rowcounts == [2, 1]
    assert [tuple(r) for r in found.frame.collect()] == [(2, None)]


def test_varchar_truncates(session):
    assert rows(session, "DECLARE @a varchar(3) = 'abcdef', @b varchar = 'xyz'; SELECT @a AS a, @b AS b") == [("abc", "x")]


def test_parameters_and_rethrow(session):
    assert rows(session, "SELECT @p + 1 AS x", params={"p": 4}) == [(5,)]
    with pytest.raises(TSqlError) as found:
        session.sql("BEGIN TRY SELECT 1/0 AS x END TRY BEGIN CATCH THROW END CATCH")
    assert found.value.number == 8134


def test_scroll_cursor(session):
    text = "DECLARE @a int, @b int, @c int; DECLARE c CURSOR FOR SELECT n_nationkey FROM nation ORDER BY 1; OPEN c; FETCH LAST FROM c INTO @a; FETCH PRIOR FROM c INTO @b; FETCH ABSOLUTE 3 FROM c INTO @c; SELECT @a AS a, @b AS b, @c AS c"
    assert rows(session, text) == [(24, 23, 2)]


def test_case_insensitive_option(spark, sf_dir):
    s = Session.over(spark, sf_dir, case_insensitive=True)
    n = rows(s, "SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'f'")[0][0]
    assert n == rows(s, "SELECT COUNT(*) FROM orders WHERE o_orderstatus LIKE 'F'")[0][0] > 0


def test_null_functions(spark):
    s = Session(spark)
    assert rows(s, "SELECT SUBSTRING('abc', 0, 2) AS a, STUFF('abc', 9, 1, 'x') AS b, PATINDEX('%b%', NULL) AS c, CHARINDEX('z', 'abc') AS d, LEN('a  ') AS e") == [("ab", None, 0, 0, 1)]
    assert rows(s, "SELECT DATEDIFF(month, '2024-01-31', '2024-02-01') AS a, DATEDIFF(week, '2024-01-06', '2024-01-07') AS b, DATEPART(weekday, '2024-01-07') AS c") == [(1, 1, 1)]
    assert rows(s, "SELECT 7 / 2 AS a, -7 / 2 AS b, 7 % 3 AS c, ROUND(2.5, 0) AS d")[0][:3] == (3, -3, 1)


def test_openrowset(spark, tmp_path):
    (tmp_path / "a1.csv").write_text("Name,Lat\nx,1.5\n\"y,z\",2.5\n")
    (tmp_path / "a2.csv").write_text("Name,Lat\nw,3.5\n")
    s = Session(spark)
    text = f"SELECT Name, Lat, filepath(1) AS f FROM OPENROWSET(BULK '{tmp_path}/a*.csv', FORMAT = 'CSV', FIRSTROW = 2) WITH (Name varchar(100), Lat float) AS r"
    assert sorted(rows(s, text)) == [("w", 3.5, "2"), ("x", 1.5, "1"), ("y,z", 2.5, "1")]
    assert rows(s, f"SELECT BulkColumn FROM OPENROWSET(BULK '{tmp_path}/a2.csv', SINGLE_CLOB) AS r") == [("Name,Lat\nw,3.5\n",)]


def test_pushdown(session):
    plan = session.explain("SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "l_comment" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_hints_reach_spark(session):
    assert "SortMergeJoin" in session.explain("SELECT c_custkey FROM customer INNER MERGE JOIN nation ON c_nationkey = n_nationkey")


def test_stream_and_batch_agree(spark, sf_dir, tmp_path):
    from lodestone.streaming.windows import per_window

    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in" / "a"))
    run = per_window(stream, late="365 days").writeStream.format("memory").queryName("per_window").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(map(tuple, spark.table("per_window").collect())) == sorted(map(tuple, per_window(batch).collect()))


@example("[^]", "a")
@example("[z-a]", "a")
@example("[^z-a]", "a")
@given(st.text("ab[]%_^-.\\", max_size=6), st.text("ab-.", max_size=5))
def test_like_regex_is_valid(pattern, text):
    import re

    found = re.fullmatch(like_regex(pattern), text)
    if pattern in ("[^]", "[z-a]"):
        assert not found


@given(st.datetimes(dt.datetime(2000, 1, 1), dt.datetime(2030, 1, 1)), st.integers(1, 12))
def test_fiscal_ranges_nest(now, month):
    c = Context(now=now, fiscal_month=month)
    low, high = date_range("thisfiscalyear", [], c)
    a, b = date_range("thisfiscalperiod", [], c)
    assert low <= a <= now < b <= high
    assert date_range("lastfiscalyear", [], c)[1] == low


def test_parser_brackets():
    (s,) = parse("SELECT 1 WHERE ((1 = 1) OR (2 > 1 AND NOT (3 = 3))) AND (1 + 2) * 3 > 4")
    assert s.query.body.where[0] == "and"


@pytest.mark.parametrize("name", [*(n for n in catalogue.queries() if n.endswith(("_some", "_marks", "_kinds", "_bracket", "_currency", "_words", "_accumulate", "_dateformat", "_appends", "_null", "_sets", "_tinyint"))), "flagship", "join_full_theta", "top_with_ties", "except_nulls", "cte_recursive_hierarchy", "for_xml_path", "delete_duplicates_cte", "proc_cursor"])
def test_against_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = catalogue.queries()[name](spark, sf_dir)
    want = con.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    a = sorted((tuple(str(float(x)) if isinstance(x, (int, float)) or hasattr(x, "quantize") else str(x) for x in r) for r in got.collect()))
    b = sorted((tuple(str(float(r[i])) if isinstance(r[i], (int, float)) or hasattr(r[i], "quantize") else str(r[i]) for i in order) for r in want.fetchall()))
    assert a == b or all(math.isclose(float(x), float(y), rel_tol=1e-9) for p, q in zip(a, b) for x, y in zip(p, q) if x != y)


def test_cross_apply_takes_its_first_rows_in_order(session):
    text = "SELECT c.c_custkey, x.o_orderkey FROM customer c CROSS APPLY (SELECT TOP 2 o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey) x"
    plan = session.explain(text)
    # rows sorted before the shuffle by key arrive in any order on a cluster
    assert "DESC NULLS LAST" in next(line for line in plan.splitlines() if "[row_number() windowspecdefinition" in line) and "rangepartitioning" not in plan
    found = {}
    for customer, price, order in sorted(rows(session, "SELECT o_custkey, -o_totalprice AS p, o_orderkey FROM orders")):
        found.setdefault(customer, []).append((customer, order))
    assert sorted(rows(session, text)) == sorted(r for own in found.values() for r in own[:2])


@pytest.mark.parametrize(
    "text",
    [
        "SELECT c_custkey AS k, x.o_orderkey AS o FROM {} OUTER APPLY (SELECT TOP 1 o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_orderkey) x",
        "SELECT c_custkey AS k, x.a AS o FROM {} OUTER APPLY (SELECT o.o_orderkey, o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_orderkey OFFSET 0 ROWS FETCH NEXT 1 ROWS ONLY) AS x(a, b)",
        "SELECT c_custkey AS k, (SELECT TOP 1 o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderkey) AS o FROM {}",
    ],
)
def test_outer_apply_takes_its_first_row_in_order(session, text):
    # customers without orders, without a key and twice; by a join, as Spark 4.1.2 fails on a correlated MAX or TOP 1 over a UNION
    source = "(SELECT NULLIF(a.c_custkey - 2, b.r_regionkey + 9) AS c_custkey FROM customer a LEFT JOIN region b ON a.c_custkey < 20) AS c"
    text = text.format(source)
    plan = session.explain(text)
    assert "ASC NULLS FIRST" in next(line for line in plan.splitlines() if "[row_number() windowspecdefinition" in line) and "rangepartitioning" not in plan
    first = dict(rows(session, "SELECT o_custkey, MIN(o_orderkey) AS o FROM orders GROUP BY o_custkey"))
    customers = [k for (k,) in rows(session, f"SELECT c_custkey FROM {source}")]
    assert {None, -1} < set(customers) and len(set(customers)) < len(customers)
    assert sorted(rows(session, text), key=str) == sorted(((k, first.get(k)) for k in customers), key=str)

"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "flagship", "agg_group", "agg_distinct", "agg_having", "join_inner", "join_residual_outer", "join_multi_key", "semi_exists_corr", "anti_not_exists",
    "cross_apply_topn", "scalar_correlated", "row_number_partition", "rows_cumulative", "top_n", "top_with_ties", "distinct", "except",
    "string_agg_ordered", "cte_multi_ref", "fn_datediff_month", "filter_lastxdays", "openjson_schema", "string_split_apply",
]


def duckdb_times(folder: str, cpus: int) -> dict[str, float]:
    """The same queries' oracle texts in DuckDB on the same files, second round; none where it is missing."""
    try:
        import duckdb
    except ModuleNotFoundError:
        return {}
    from lodestone.queries import oracle_sql

    con = duckdb.connect(config={"threads": cpus})
    for name in sorted(os.listdir(folder)):
        con.sql(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    known = oracle_sql()
    times = {}
    for _ in range(2):
        for name in HEADLINE:
            began = time.time()
            con.execute(known[name]).fetchall()
            times[name] = round(time.time() - began, 3)
    return times


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lodestone.queries import queries

    found = queries()
    times = {}
    for round_ in range(2):  # the first one warms the JVM up
        for name in HEADLINE:
            began = time.time()
            found[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
    print(json.dumps({"duckdb": duckdb_times(folder, int(cpus)), "metric": "total time of the headline T-SQL queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()

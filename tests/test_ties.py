"""Amounts of projects and densities at a rounding tie are the oracle's."""

import duckdb
from pyspark.sql import functions as F

from takeoff_spark.functions import numbers
from takeoff_spark.sources.fixtures import fixture, with_sql


def test_areas_at_ties(spark, tmp_path):
    prices = [i * 125 / 8 for i in range(1, 4000)]
    rows = [(25 * i, i, "F", p, "2-HIGH") for i, p in enumerate(prices)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").selectExpr("*", "timestamp '1995-01-01' AS o_orderdate")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in fixture(spark, str(tmp_path), "projects").select("job_id", "total_area", "layout_area").collect())
    c = duckdb.connect()
    c.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert got == sorted(c.sql(f"{with_sql('projects', materialized=True)} SELECT job_id, total_area, layout_area FROM projects").fetchall())


def test_density_at_ties(spark):
    rows = [(i / 8, 12.5 * k) for i in range(1, 400) for k in (1, 2, 7, 320, 4000)]
    got = spark.createDataFrame(rows, "q double, area double").select("q", "area", numbers.density_ratio(F.col("q"), F.col("area")).alias("d")).collect()
    c = duckdb.connect()
    assert [r.d for r in got if r.d is not None] == [c.execute("SELECT round(?::DOUBLE / ?::DOUBLE, 6)", [r.q, r.area]).fetchone()[0] for r in got if r.d is not None]

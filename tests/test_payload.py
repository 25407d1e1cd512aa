"""p39 gives what the parser gives, for every row."""

import duckdb
from pyspark.sql import functions as F

from takeoff_spark.plans import queries

DIR = "/root/testdata/sf0.001"


def test_parser_decides_every_row(spark, monkeypatch):
    order = lambda rows: sorted(rows, key=repr)
    names = ["job_id", "sheet_seq", "description", "quantity", "broken"]
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    want = duck.sql(f"select {', '.join(names)} from ({queries.ORACLE_SQL['p39_parse_items_json']})").fetchall()
    assert order(tuple(r) for r in queries.QUERIES["p39_parse_items_json"](spark, DIR).select(*names).collect()) == order(want)
    one = F.array(F.struct(F.lit("Viga").alias("description"), F.lit(1.0).alias("quantity")))
    monkeypatch.setattr(queries.payload, "items", lambda block: one)
    assert {r.description for r in queries.QUERIES["p39_parse_items_json"](spark, DIR).collect()} == {"Viga"}

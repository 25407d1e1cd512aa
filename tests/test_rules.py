"""Quirks of single rules."""

import os
import time

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from takeoff_spark.functions import classify, geometry, numbers, text
from takeoff_spark.operators.density import density_alerts, sequence_ratio
from takeoff_spark.streaming.messages import posts_due


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_keys(spark):
    assert one(spark, text.item_type_key(F.lit("Forro mineral modular Geometrone"))) == "forro_mineral_modular_geometrone"
    assert one(spark, text.item_type_key(F.lit(None).cast("string"))) == ""
    assert one(spark, text.fold_accents(F.lit("m²x a—b"), True)) == "mx ab"
    assert one(spark, text.description_key(F.lit("Painel divisório - contabilidade"))) == "divisorio painel"


def test_numbers(spark):
    assert one(spark, numbers.parse_decimal(F.lit("1.234,56"))) == 0.0
    assert one(spark, numbers.clean_quantity(F.lit("1,5"))) == 15.0
    assert one(spark, numbers.normalize_unit(F.lit("Rodapé"), F.lit("m²"))) == "ml"
    assert one(spark, numbers.count_quantity(F.lit("un"), F.lit(9.0001))) == 9.0
    assert one(spark, numbers.count_quantity(F.lit("un"), F.lit(222.11))) == 0.0


def test_names(spark):
    assert one(spark, classify.categories(F.lit("04-PAREDES_DRYWALL"))) == ["paredes", "portas"]
    assert one(spark, classify.sheet_type(F.lit("det forro-1.pdf"))) == "forro"


def test_half_circle(spark):
    p = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("bulge")), F.struct(F.lit(2.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("bulge")))
    assert abs(one(spark, geometry.polyline_length(p, F.lit(False))) - 3.14159265) < 1e-6


def test_low_alert(spark):
    bench = spark.createDataFrame([("office", "familia", 1, "m²", 10.0, 0.0, 10.0, 3)], "typology string, level string, level_id long, unit string, mean double, stddev double, max_value double, n_projects long")
    items = spark.createDataFrame([("office", 1, "m²", 1.0, 1.0, "confirmado")], "typology string, familia_id long, unit string, quantity double, ref_area double, confidence string")
    catalog = spark.createDataFrame([(1, 2, 3)], "familia_id long, grupo_id long, capitulo_id long")
    got = density_alerts(items, bench, catalog).first()
    assert (got.alert, got.confidence) == ("low", "estimado")


def test_ratio_and_posts(spark):
    assert spark.range(1).select(sequence_ratio(F.lit("abcd"), F.lit("ABCD")).alias("r")).first().r == 1.0
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 12:00:00"), (1, "2024-01-02 00:00:00")], "sender_id long, t string").select("sender_id", F.col("t").cast("timestamp").alias("ts"))
    assert posts_due(df).count() == 2


def test_keys_and_classes_are_found_once_a_distinct_text(spark):
    calls = text.per_value(lambda t: f"{os.getpid()} {time.monotonic_ns()}", StringType(), pa.string())
    rows = spark.range(1000, numPartitions=1).select((F.col("id") % 4).cast("string").alias("t")).select("t", calls("t").alias("x"))
    assert rows.distinct().count() == 4
    names = [None, "", "A-WALL-INT", "xref1|A-PISO", "drywall\tLUM", "0", "ÁPISO", "piso_forro.tom"]
    got = [r.c for r in spark.createDataFrame([(n,) for n in names], "n string").select(classify.categories(F.col("n")).alias("c")).collect()]
    assert got == [[], [], ["paredes"], ["piso"], ["luminarias", "paredes", "portas"], [], [], ["forro", "piso", "eletrica"]]

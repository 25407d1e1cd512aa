"""Texts of alerts; stored density rows classified anew."""

import pytest
from pyspark.sql import functions as F

from takeoff_spark.operators import density

CATALOG = "familia_id long, familia_code string, grupo_id long, capitulo_id long"
RAW = "job_id long, seq long, typology string, description string, item_type string, unit string, density double, familia_id long, project_label string"


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([(7, "f7", 1, 9), (8, "f8", 1, 9)], CATALOG)


def test_alert_texts(spark, catalog):
    bench = spark.createDataFrame([("office", "familia", 7, "m²", 0.1, 0.01, 0.2, 3), ("office", "grupo", 1, "un", 0.5, 0.0, 0.6, 2), ("office", "capitulo", 9, "m", 0.0, 0.0, 0.0, 5), ("office", "familia", 8, "vb", 1.0, 0.1, 1.0, 1)], "typology string, level string, level_id long, unit string, mean double, stddev double, max_value double, n_projects long")
    cases = [(1, "m² ", 7, 13.0, "visto |"), (2, "m²", 7, 7.0, None), (3, "un", 8, 126.0, ""), (4, "un", 8, 19.0, "x"), (5, "m", 7, 99.0, "x"), (6, "vb", 8, 999.0, None), (7, "m²", 7, 10.0, "x"), (8, "m²", None, 99.0, None), (9, "m²", 7, None, "x"), (10, None, 7, 99.0, "x")]
    items = spark.createDataFrame([("office", s, u, f, q, 100.0, "confirmado", o) for s, u, f, q, o in cases], "typology string, seq long, unit string, familia_id long, quantity double, ref_area double, confidence string, observations string")
    got = {r.seq: r for r in density.density_alerts(items, bench, catalog).collect()}
    high = "densidade 0.130 m²/m² é 1.3× maior que o típico (nível família: 0.100 ± 0.010, n=3 projetos) — possível dupla contagem"
    assert got[1].reason == high and got[1].observations == "visto | | ⚠ Calibração: " + high and got[1].confidence == "estimado"
    assert got[2].observations == "⚠ Calibração: densidade 0.070 m²/m² é 1.4× menor que o típico (nível família: 0.100 ± 0.010, n=3 projetos) — possível subcontagem"
    assert (got[3].alert, got[4].alert, got[4].level) == ("high", "low", "grupo") and "0.500 ± 0.000, n=2" in got[4].reason
    assert all(got[i].alert is None and got[i].reason is None and got[i].confidence == "confirmado" for i in range(5, 11))
    assert [got[i].observations for i in range(5, 11)] == ["x", None, "x", None, "x", "x"]
    assert density.density_alerts(items.limit(0), bench, catalog).count() == 0


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(1, 1, "office", "porta", None), (1, 2, "office", "", None), (1, 3, "retail", "porta", 7), (2, 1, "retail", "nada", None), (2, 2, "office", None, None), (2, 5, "hotel", "porta", None), (3, 4, "office", "nada", 8)]
    return spark.createDataFrame([(j, s, t, d, d, "un", 0.5, f, f"job_{j}") for j, s, t, d, f in rows], RAW)


def classify(rows):
    return rows.withColumn("familia_code", F.when(F.col("description") == "porta", "f8").when(F.col("description") == "nada", "unknown"))


def test_classified_anew(raw, catalog):
    def run(**how):
        out = density.reclassified(raw, catalog, classify, **how)
        row = density.reclassify_summary(out, catalog).first()
        return {(r.job_id, r.seq): r.familia_id for r in out.collect()}, (row.raws_total, row.classified, row.skipped, row.typologies, row.benchmarks)

    ids, said = run()
    assert ids == {(1, 1): 8, (1, 2): None, (1, 3): 7, (2, 1): None, (2, 2): None, (2, 5): 8, (3, 4): 8}
    assert said == (5, 2, 2, "hotel,office", 6)  # office: job 1 and job 3 share the three benchmarks
    ids, said = run(only_unclassified=False)
    assert ids[1, 3] == 8 and ids[3, 4] == 8 and said == (7, 3, 2, "hotel,office,retail", 9)
    assert run(typology="retail")[1] == (1, 0, 0, "", 0)
    ids, said = run(limit=2)
    assert (ids[1, 1], ids[2, 5], said[0]) == (8, None, 2)
    none = density.reclassified(raw.limit(0), catalog, classify)
    assert none.count() == 0 and tuple(density.reclassify_summary(none, catalog).first()) == (0, 0, 0, "", 0)


def test_ingest_summary(raw, catalog):
    got = density.ingest_summary(raw, density.benchmarks(raw, catalog)).first()
    assert (got.parsed, got.classified, got.typologies) == (7, 2, "hotel,office,retail")
    assert (got.benchmarks_familia, got.benchmarks_grupo, got.benchmarks_capitulo, got.benchmarks) == (2, 2, 2, 6)

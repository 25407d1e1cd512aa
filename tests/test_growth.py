"""Steps whose cost must not grow faster than their input."""

import pytest

from takeoff_spark.llm import source_audit
from takeoff_spark.operators.catalog import classify_items
from takeoff_spark.operators.density import density_rows, raw_densities
from takeoff_spark.plans.queries import QUERIES
from takeoff_spark.sources.io import read_history_rows

DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


def test_similar_items_are_shuffled_once(spark):
    text = plan(spark, "a05_consolidate_similar")
    assert text.count("Exchange") == 1 and "SortMergeJoin" not in text


def test_familias_of_the_same_words_are_one_candidate(spark):
    """Ten times the familias, the same rows where descriptions meet familias; the first code wins, a null unit meets none."""
    items = spark.createDataFrame([(1, "Porta de madeira", "un"), (2, "Forro de madeira", "m"), (3, "Porta", None), (4, "xx", "un")], "seq long, description string, unit string")

    def run(n):
        catalog = spark.createDataFrame([(f"fam_{i}", "un" if i % 2 else "m", ["porta", "madeira"] if i % 3 else ["forro"], "nome") for i in range(n, 0, -1)], "familia_code string, typical_unit string, keywords array<string>, familia_name string")
        df = classify_items(items, catalog).orderBy("seq")
        got = [tuple(r) for r in df.select("seq", "familia_code", "confidence_score").collect()]
        return got, "=[words#" in df._jdf.queryExecution().executedPlan().toString()

    small, large = run(30), run(300)
    assert small == large and large[1]
    assert large[0] == [(1, "fam_1", 1.0), (2, "fam_1", 0.25), (3, None, 0.0), (4, None, 0.0)]


@pytest.mark.parametrize("name", ["a21_run_summary", "t04_rank_benchmarks"])
def test_densities_are_rounded_once_and_upserted_without_a_sort(spark, name):
    text = plan(spark, name)
    assert "SortAggregate(key=[typology" not in text and text.count("E15") == 1


def test_densities_at_the_edges(spark):
    rows = [(1, 1, 1.0, 2.0), (1, 2, 1e-6, 2.0), (1, 3, 0.9e-6, 2.0), (1, 4, 200.0, 2.0), (1, 5, 201.0, 2.0), (1, 6, 1.0, 0.0), (1, 7, None, 2.0), (1, 8, 1.0, None), (1, 9, -1.0, 2.0)]
    items = spark.createDataFrame(rows, "job_id long, seq long, quantity double, ref_area double").selectExpr("*", "'x' typology", "concat('d', seq) description", "'un' unit", "1L familia_id")
    got = {r.seq: r.density for r in density_rows(items).collect()}
    assert got == {1: 0.5, 2: 1e-6, 4: 100.0}
    assert {r.seq: (r.job_id, r.qty, r.description) for r in raw_densities(items).collect()} == {1: (1, 1.0, "d1"), 2: (1, 0.0, "d2"), 4: (1, 200.0, "d4")}


def test_history_cells_are_built_once(spark):
    assert plan(spark, "s03_read_history_rows").count("array_position") == 1


def test_history_rows_at_the_edges(spark):
    cells = {1: [("1.1", None), ("Porta de vidro", None), (" UN ", None), ("kg", None), (None, 2.0)], 2: [("Subtotal", None), (None, 9.0)], 3: [("Total geral das obras de reforma", None), (None, 3.0)], 4: [("abc", 1.0)], 5: [("Forro liso", None), ("m2", 0.0)], 6: [], 7: [("Rodapé", None), ("m2", None), (None, -1.0), (None, 4.0)], 8: None}
    rows = spark.createDataFrame([(1, k, v) for k, v in cells.items()], "job_id long, seq long, cells array<struct<s:string,d:double>>")
    got = {r.seq: (r.description, r.unit, r.quantity) for r in read_history_rows(rows).collect()}
    assert got == {1: ("Porta de vidro", "kg", 2.0), 3: ("Total geral das obras de reforma", None, 3.0), 7: ("Rodapé", "m²", 4.0)}


def test_digest_counts_blocks_once_and_repeats_no_names(spark):
    text = plan(spark, "a22_cad_digest")
    assert text.count("partial_percentile") == 2  # width and height, in one pass
    assert not [line for line in text.splitlines() if "Filter" in line and ("lum-R4" in line or "regexp_replace" in line)]


def test_pairs_of_sources_are_counted_one_way_round(spark, monkeypatch):
    kept, save = {}, source_audit.materialise
    monkeypatch.setattr(source_audit, "materialise", lambda df, name: kept.setdefault(name, save(df, name)))
    rows = [("en", s, f"one two three {'four ' * i}") for i, s in enumerate("abc")] * 2
    got = source_audit.audit(spark.createDataFrame(rows, "lang string, source string, text string")).where("part = 'pair'").collect()
    assert {(r.source, r.item) for r in kept["both"].select("source", "item").distinct().collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert len(got) == 6

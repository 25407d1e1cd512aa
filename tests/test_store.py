"""Stored tables under changes by key; benchmarks of rows that were upserted."""

from takeoff_spark.operators import density
from takeoff_spark.sources import io, store


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    path = f"{tmp_path}/t"
    store.create(spark.createDataFrame([(i, f"a{i}", i) for i in range(50)], "k long, a string, b long"), path, ["k"], 8)
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    for _ in range(2):  # again: nothing changes
        store.upsert_stored(spark, path, spark.createDataFrame([(3, "x", 1), (3, "y", 2), (99, "z", 1)], "k long, a string, o long"), ["k"], "o", 8)
    rows = {r.k: (r.a, r.b) for r in store.stored(spark, path).collect()}
    assert rows == {**{i: (f"a{i}", i) for i in range(50)}, 3: ("y", 3), 99: ("z", None)}
    kept = [f for f in before if f.exists()]
    assert 0 < len(before) - len(kept) <= 2


def test_patch_and_append(spark, tmp_path):
    store.create(spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k long, a string, b string"), f"{tmp_path}/t", ["k"], 4)
    store.patch_stored(spark, f"{tmp_path}/t", spark.createDataFrame([(1, "z"), (2, None), (7, "q")], "k long, a string"), "k", 4)
    assert sorted(map(tuple, store.stored(spark, f"{tmp_path}/t").collect())) == [(1, "z", "b"), (2, "c", "d")]
    facts = spark.createDataFrame([(1, "q" * 3000, "")], "id long, question string, error string")
    for run in ("r1", "r2", "r2"):
        store.append_stored(facts, f"{tmp_path}/log", run, {"user_id": "u"})
    got = spark.read.parquet(f"{tmp_path}/log").orderBy("run").collect()
    assert [(r.run, len(r.question), r.error, r.user_id) for r in got] == [("r1", 2000, None, "u"), ("r2", 2000, None, "u")]


def test_rows_of_one_key_are_upserted_before_the_sum(spark):
    item = "job_id long, seq long, typology string, description string, unit string, quantity double, ref_area double, familia_id long"
    rows = [(1, 1, "office", "Porta x", "un", 30.0, 100.0, 1), (1, 2, "office", "Porta x", "un", 10.0, 100.0, 1), (2, 1, "office", "Porta y", "un", 10.0, 100.0, 1)]
    catalog = spark.createDataFrame([(1, 1, 1)], "familia_id long, grupo_id long, capitulo_id long")
    got = density.benchmarks(density.raw_densities(spark.createDataFrame(rows, item)), catalog, ("familia",)).first()
    assert (got.mean, got.n_projects, got.max_value) == (0.1, 2, 0.1)


def test_budgets_lie_in_few_folders_however_many_jobs(spark, tmp_path):
    rows = [(j, i, f"{i}.{j}") for j in range(300) for i in (2, 1)]
    io.write_budget(spark.createDataFrame(rows, "job_id long, seq long, item_num string"), f"{tmp_path}/b", buckets=8)
    assert len([*tmp_path.glob("b/*=*")]) == 8
    assert sorted((r.job_id, r.seq, r.item_num) for r in io.read_budget(spark, f"{tmp_path}/b", buckets=8).collect()) == sorted(rows)
    assert [r.seq for r in io.read_budget(spark, f"{tmp_path}/b", 7, buckets=8).collect()] == [1, 2]

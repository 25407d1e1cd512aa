"""Revision compare, answers in JSON, counts and take-off against small cases."""

import difflib
import random

from pyspark.sql import functions as F

from takeoff_spark.functions import numbers, payload
from takeoff_spark.operators import density, takeoff
from takeoff_spark.plans import queries

DIR = "/root/testdata/sf0.001"
ITEM = "job_id long, seq long, item_num string, description string, quantity double, unit string, discipline string"


def test_a_matched_number_is_taken_and_only_from_its_turn_on(spark):
    original = [(1, 1, "1", "Parede azul do fundo", 2.0, "m", ""), (1, 2, "2", "Parede azul do fundo b", 3.0, "m", ""), (1, 3, "3", "Porta de correr nova", 1.0, "un", ""), (1, 4, "4", None, 1.0, "un", "")]
    revised = [(1, 1, "9.1", "Parede azul do fundo", 4.0, "m", ""), (1, 2, "9.2", "Porta de correr novo", 1.0, "un", "")]
    got = density.fuzzy_match(spark.createDataFrame(original, ITEM), spark.createDataFrame(revised, ITEM)).collect()
    assert [(r.seq, r.revised_num) for r in got] == [(3, "9.2")]


def test_fuzzy_match_against_brute_force(spark):
    it, rev = queries.items(spark, DIR), queries.fixture(spark, DIR, "budget_revised").withColumn("item_num", F.concat(F.lit("9"), "item_num"))
    rev = rev.withColumn("description", F.concat("description", F.lit(" rev")))
    want = []
    keyed = lambda df: df.withColumn("k", density.item_type_key(F.col("description"))).orderBy("job_id", "seq").collect()
    orig, revised = keyed(it), keyed(rev)
    for job in {r.job_id for r in orig}:
        pool = [r for r in revised if r.job_id == job]
        by_num, by_key, taken = {r.item_num: r for r in pool}, {r.k: r for r in pool if r.k}, set()
        for o in (r for r in orig if r.job_id == job):
            m = by_num.get(o.item_num) or by_key.get(o.k)
            if m:
                taken.add(m.item_num)
                continue
            best, ratio = None, 0
            for r in pool:
                if r.item_num not in taken and (x := difflib.SequenceMatcher(None, o.description.lower(), r.description.lower()).ratio()) > ratio:
                    best, ratio = r, x
            if best and ratio > 0.7:
                taken.add(best.item_num)
                want.append((job, o.seq, best.item_num, round(ratio, 6)))
    got = sorted((r.job_id, r.seq, r.revised_num, r.ratio) for r in density.fuzzy_match(it, rev).collect())
    assert got == sorted(want) and got


def test_count_without_unit_keeps_its_quantity(spark):
    rows = spark.createDataFrame([(None, 222.11), ("un", 222.11), ("un", 9.0001), ("m", 1.5)], "unit string, q double")
    assert [r[0] for r in rows.select(numbers.count_quantity(F.col("unit"), F.col("q"))).collect()] == [222.11, 0.0, 9.0, 1.5]


def test_last_json_of_an_answer(spark):
    cases = {
        'a ```json\n{"a":1}\n``` b ```json\n{"items":[]}\n``` c': '{"items":[]}', "```\n{}\n``` x ```\n{\"b\":2}\n```": '{"b":2}', '{"x":1} then {"items":[{"q":1}]} end {"y":2}': '{"items":[{"q":1}]}',
        '[{"description":"a"}]': '[{"description":"a"}]', "plain": "plain", '```json\n[1]\n``` {"project_data":{"name":"n"}}': '{"project_data":{"name":"n"}}', None: "",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert [(r.got, r.want) for r in rows.select(payload.json_block(F.col("t")).alias("got"), "want").collect() if r.got != r.want] == []


def test_takeoff_takes_areas_dimensions_and_null_layers(spark):
    blocks = spark.createDataFrame([(1, 1, "porta_1", None, 0.0, 0.0, 1.0), (1, 2, "porta_1", "X", 1.0, 0.0, 1.0), (1, 3, "zzz", "X", 1.0, 0.0, 1.0)], "file_id long, seq long, name string, layer string, x double, y double, xscale double")
    lines = spark.createDataFrame([], "file_id long, seq long, layer string, x1 double, y1 double, x2 double, y2 double")
    files = spark.createDataFrame([(1, 6, 1)], "file_id long, insunits int, measurement int")
    areas = spark.createDataFrame([(1, "A-PISO", 2.5), (1, "A-PISO", 1.0)], "file_id long, layer string, area double")
    dims = spark.createDataFrame([(1, 1, "cota", 3.25)], "file_id long, seq long, label string, metres double")
    got = {(r.description, r.quantity, r.unit, r.confidence) for r in takeoff.takeoff_items(blocks, lines, files, areas, dims).collect()}
    assert ("porta_1", 2.0, "un", "confirmado") in got and ("zzz", 1.0, "un", "verificar") in got
    assert any(u == "m²" and q == 3.5 for _, q, u, _ in got) and ("Cota: cota", 0.0, "m", "verificar") in got


def test_similar_texts_against_all_pairs(spark):
    draw = random.Random(6)
    texts = sorted({"".join(draw.choices("abcde é", k=draw.randint(0, 12))) for _ in range(120)} | {"porta de vidro", "porta de vidro azul", "aaaa", "aaaaaaa", "abab" * 60, "abab" * 61})
    rows = [(i % 3, t) for i, t in enumerate(texts)]
    for least in (0.7, 0.5):
        want = {(j, a, b, x) for j, a in rows for k, b in rows if j == k and a and b and (x := difflib.SequenceMatcher(None, a, b).ratio()) > least}
        got = density.similar_texts(spark.createDataFrame(rows, "job long, a string"), spark.createDataFrame(rows * 2, "job long, b string"), "job", least)
        found = [tuple(r) for r in got.select("job", "a", "b", "ratio").collect()]
        assert len(found) == len(want) and {*found} == want


def test_fuzzy_match_by_job_equals_over_all_texts(spark):
    it, rev = queries.items(spark, DIR), queries.fixture(spark, DIR, "budget_revised").withColumns({"item_num": F.concat(F.lit("9"), "item_num"), "description": F.concat("description", F.lit(" rev"))})
    few, by_job = ([tuple(r) for r in density.fuzzy_match(it, rev, n).orderBy("job_id", "seq").collect()] for n in (2_000, 3))
    assert few == by_job and few
    plan = density.fuzzy_match(it, rev)._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" not in plan  # a group a job took milliseconds for each

"""Masks, reasons, answers, predictors, openings and digests against small cases."""

import pytest
from pyspark.sql import functions as F

from takeoff_spark.functions import numbers, payload, text
from takeoff_spark.operators import catalog, report, takeoff


def test_letters_and_marks_apart(spark):
    cases = {"Instalação elétrica": "instalacao eletrica", "Šaş ő Ǘ": "sas o u", "m² — ½": "m² — ½", "ßøł": "ßøł", None: None}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert all(r.got == r.want for r in rows.select(text.fold_accents(F.col("t")).alias("got"), "want").collect())
    assert spark.createDataFrame([("Instalação elétrica",)], "t string").select(text.description_key(F.col("t"))).first()[0] == "eletrica"


def test_reasons(spark):
    rows = spark.createDataFrame([("un", 6000.0, "", 0.0), ("", 2.0, None, 0.0), ("un", -1.0, "", 0.0), ("m²", 1.0, "Iluminação", 0.0), ("m²", 200.0, "Forros", 100.0), ("m", None, "", 0.0)], "u string, q double, d string, a double")
    got = [r[0] for r in rows.select(numbers.implausible_text(*map(F.col, "uqda"))).collect()]
    assert got == ["6000 un é alto demais pro tipo (max típico 5000)", "2 vb é alto demais pro tipo (max típico 1)", "-1.0 un é negativo", "luminárias se contam em 'un', não em área", "área 200.0 m² é maior que 1.5× área da laje (100 m²) — possível dupla contagem", None]


def test_masks_and_expiry(spark):
    people = spark.createDataFrame([(1, "55 (11) 91234", "123.456.789-01", " ab "), (2, "5", "12345678000199", "cd"), (3, None, "1", None), (4, "119123456789", "", "ef")], "user_id long, whatsapp string, tax_id string, beta_code string")
    codes = spark.sql("SELECT * FROM VALUES ('AB', true, 0, 1, timestamp'2024-01-02'), ('CD', true, 0, 1, CAST(NULL AS TIMESTAMP)), ('EF', true, 0, 1, timestamp'2023-12-31') AS t(code, active, used_projects, max_projects, expires_at)")
    got = {r.user_id: r for r in report.invite_check(people, codes, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert [got[i].phone_masked for i in (1, 2, 3, 4)] == ["(55) 11912-34", "(5", None, "(11) 91234-5678"]
    assert [got[i].tax_masked for i in (1, 2, 3, 4)] == ["123.456.789-01", "12.345.678/0001-99", None, None]
    assert [got[i].invite_ok for i in (1, 2, 3, 4)] == [True, True, False, False]


def test_answers(spark):
    cases = [('{"project_data":{"total_area":"1,200 m²","workstations":"12 un","new_rooms":["a",{"b":1}]},"items":[{"description":"x","quantity":"3 m²"}]}', None), ('[{"description":"y","quantity":2}]', None), ('{"items":[', "broken"), ("nada", "broken"), ("", "broken"), ('{"other":1}', None)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i long, t string").select("i", payload.answer(F.col("t")).alias("a")).orderBy("i").collect()
    assert [r.a.error is not None for r in rows] == [e is not None for _, e in cases]
    assert [len(r.a["items"]) for r in rows] == [1, 1, 0, 0, 0, 0]
    p = rows[0].a.project
    assert (p.total_area, p.workstations, p.new_rooms, rows[0].a["items"][0].quantity) == (1200.0, 12, ["a", '{"b":1}'], 3.0)
    assert rows[1].a.project is None and rows[1].a["items"][0].quantity == 2.0


def test_predictor_gets_batches_and_may_be_unsure(spark, tmp_path):
    def predict(batch):
        assert len(batch) <= 3
        (tmp_path / batch[0]["key"]).touch()
        return [{"key": b["key"], "familia_code": "f1" if "a" in b["description"] else "unknown", "confidence": -1} for b in batch if b["description"] != "leave out"] + [{"key": "not asked"}]

    tree = spark.createDataFrame([("f1", 7, 1, 1)], "familia_code string, familia_id long, grupo_id long, capitulo_id long")
    codes = spark.createDataFrame([(str(i), t, None, f) for i, (t, f) in enumerate([("aa", None), ("b", None), ("leave out", None), ("a", 3), ("ca", None), ("da", None)])], "codigo string, descricao string, unidade string, familia_id long").coalesce(1)
    got = {r.codigo: r.familia_id for r in catalog.classify_codes(codes, tree, predict, 3).collect()}
    assert got == {"0": 7, "1": None, "2": None, "3": 3, "4": 7, "5": 7} and len(list(tmp_path.iterdir())) == 2
    items = spark.createDataFrame([(1, "Ab ", "UN"), (2, "ab", "un"), (3, "aba", "m"), (4, " Aba", "M"), (5, None, None)], "seq long, description string, unit string")
    out = {r.seq: r for r in catalog.classify_with(items, tree, predict, 3).collect()}
    assert [out[i].familia_id for i in range(1, 6)] == [None, None, 7, 7, None] and out[3].confidence == 0 and out[5].attributes == {}


def test_openings_and_digest(spark):
    files = spark.createDataFrame([(1, 4, 1)], "file_id long, insunits int, measurement int")  # millimetres
    blocks = spark.createDataFrame([(1, i, n, "A", 0.126, 1.0, s, 1.0) for i, (n, s) in enumerate([("PM1", 1.0), ("PM1", -1.2), ("PM1", 100.0), ("mesa", 1.0), ("*U1", 1.0), ("JN9", 0.0)])], "file_id long, seq long, name string, layer string, x double, y double, xscale double, yscale double")
    ext = spark.createDataFrame([("PM1", 800.0, 2100.0), ("mesa", 800.0, 800.0)], "block string, w double, h double")
    counts = takeoff.block_counts(blocks, ext, files)
    got = {r.name: (r.n, r.width_m, r.height_m) for r in counts.collect()}
    assert got == {"PM1": (3, 0.88, 2.1), "mesa": (1, 0.0, 0.0), "JN9": (1, 0.0, 0.0)}
    empty = lambda c: spark.createDataFrame([], f"file_id long, layer string, {c}")
    dims = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", 1.5)], "file_id long, seq long, label string, metres double")
    text = takeoff.digest(blocks.select("file_id", "layer"), counts, empty("length double"), spark.createDataFrame([(1, "P", 1.005), (1, "P", 2.0)], "file_id long, layer string, area double"), empty("text string"), dims).first().digest
    assert text == "Layers\n  A\nEsquadrias\n  PM1: 3 un | 0.88 m × 2.10 m = 1.85 m²\nBlocos\n  JN9: 1 un\n  mesa: 1 un\nÁreas por layer\n  P: 3.01 m²\nCotas\n  a: 1.500 m\n  b"
    assert [(r.x, r.seq) for r in takeoff.block_positions(blocks).orderBy("seq").collect()][0] == (0.13, 0)


@pytest.mark.parametrize("names", [["plan.PDF", "a.dxf", "b.dxf", "none"], []])
def test_lists_of_files(spark, names):
    files = spark.createDataFrame([(1, i, n, 3, ["Model", "A1"]) for i, n in enumerate(names)], "job_id long, seq long, filename string, pages int, layouts array<string>")
    rows = report.price_estimate(files).collect()
    assert [(r.sheets, r.files, [(b.type, b.sheets) for b in r.breakdown]) for r in rows] == ([(6, 4, [("pdf", 3), ("dxf", 1), ("dxf", 1), ("?", 1)])] if names else [])
    kinds = report.file_type_counts(files.where("filename LIKE '%.%'")).collect()
    assert [(r.summary, dict(r.file_types)) for r in kinds] == ([("2 DXF, 1 PDF", {"dxf": 2, "pdf": 1})] if names else [])


def test_digest_has_every_text_of_a_layer(spark):
    said = [f"texto {i:03d}" for i in range(120)]
    texts = spark.createDataFrame([(1, "A", t) for t in said] + [(1, "A", " texto 007 "), (1, "A", "ab"), (1, None, "sem layer"), (2, "B", None)], "file_id long, layer string, text string")
    none = {k: spark.createDataFrame([], f"file_id long, {v}") for k, v in {"layers": "layer string", "counts": "name string, n long, width_m double, height_m double", "lengths": "layer string, length double", "areas": "layer string, area double", "dims": "seq long, label string, metres double"}.items()}
    got = {r.file_id: r.digest for r in takeoff.digest(texts=texts, **none).collect()}
    assert got == {1: "\n".join(["Textos", *(f"  [A] {t}" for t in said)])}

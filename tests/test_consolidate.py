"""The published consolidation cases."""

import random

import pytest
from pyspark.sql import functions as F

from takeoff_spark.functions.text import description_key, primary_noun
from takeoff_spark.operators.consolidate import consolidate_exact, consolidate_similar

SCHEMA = "job_id long, seq long, item_num string, description string, unit string, quantity double, observations string, ref_sheet string, confidence string, discipline string"


def rows(*items):
    return [(1, i, "", d, u, float(q), "", "", "confirmado", c) for i, (d, u, q, c) in enumerate(items, 1)]


# The published cases.
CASES = {
    "walls": (rows(("Alvenaria tijolo cerâmico 9x14x19", "ml", 491.84, "Alvenaria"), ("Execução de alvenaria nova", "ml", 491.84, "Alvenaria")), 1),
    "departments": (rows(*[(f"Demarcação de área departamento {x}", "m²", 0.72, "Complementares") for x in ("Contabilidade", "Financeira", "Livres", "Marketing", "RH")]), 1),
    "units": (rows(("LED LINE pendurada tipo A", "m²", 222.11, "Iluminação"), ("LED LINE tipo A encastrada", "m²", 222.11, "Iluminação"), ("LED LINE linear tipo A", "ml", 222.11, "Iluminação")), 1),
    "doors": (rows(*[(x, "un", 1, "Portas e Ferragens") for x in ("Porta de madeira PM-01 80x210", "Porta de vidro PV-01 90x210", "Porta de emergência P-EM 100x210")]), 3),
    "unrelated": (rows(("Rodapé de madeira natural", "ml", 150, "Pisos e Rodapés"), ("Carpete de parede em salas fechadas", "ml", 150, "Pisos e Rodapés")), 2),
}


@pytest.mark.parametrize("case", CASES)
def test_published_cases(spark, case):
    data, n = CASES[case]
    got = consolidate_similar(consolidate_exact(spark.createDataFrame(data, SCHEMA))).collect()
    assert len(got) == n
    if case == "walls":
        assert got[0].confidence == "estimado" and "Fundido" in got[0].observations
    if case == "departments":
        assert got[0].quantity == 3.6 and "variantes" in got[0].description
    if case == "units":
        assert (got[0].unit, got[0].quantity) == ("ml", 222.11)


def greedy(items):
    """Item by item: the first family of its bucket whose first item shares the noun or two words."""
    buckets: dict = {}
    for seq, discipline, q, noun, words in items:
        heads = buckets.setdefault((discipline or "", q) if q >= 2 else ("one", seq), [])
        for head in heads:
            if (noun and noun == head[0][1]) or len(words & head[0][2]) >= 2:
                head.append((seq, noun, words))
                break
        else:
            heads.append([(seq, noun, words)])
    return [[x[0] for x in f] for heads in buckets.values() for f in heads]


def test_families_against_brute_force(spark):
    draw, words = random.Random(4), ["porta", "madeira", "vidro", "azul", "piso", "forro", "de", "x1", "led", "tipo"]
    data = [(j, i, "", " ".join(draw.choices(words, k=draw.randint(0, 4))), draw.choice(["un", "m", None]), draw.choice([1.0, 2.0, 3.004, 3.0, None]), draw.choice(["", None]), "", "confirmado", draw.choice(["A", None])) for j in (1, 2) for i in range(1, 150)]
    df = spark.createDataFrame(data, SCHEMA)
    keyed = df.select("job_id", "seq", "discipline", F.round(F.coalesce("quantity", F.lit(0.0)), 2).alias("q"), primary_noun(F.col("description")).alias("noun"), description_key(F.col("description")).alias("key")).orderBy("job_id", "seq").collect()
    got = consolidate_similar(df).orderBy("job_id", "seq").collect()
    by_seq = {(r[0], r[1]): r for r in data}
    for job in (1, 2):
        want = greedy([(r.seq, r.discipline, r.q, r.noun, {*r.key.split()}) for r in keyed if r.job_id == job])
        mine = [r for r in got if r.job_id == job]
        assert [r.seq for r in mine] == list(range(1, len(want) + 1))
        for r, family in zip(mine, want, strict=True):
            longest = max(family, key=lambda s: (len(by_seq[job, s][3]), -s))
            assert r.description == by_seq[job, longest][3] and r.discipline == by_seq[job, longest][9]
            assert (r.confidence == "estimado") == (len(family) > 1)
            if len(family) > 1:
                assert f"Fundido de {len(family)} entradas" in r.observations


def test_empty_items(spark):
    assert consolidate_similar(spark.createDataFrame([], SCHEMA)).count() == 0

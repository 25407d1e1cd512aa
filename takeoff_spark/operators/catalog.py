"""Catalog tree, classification, code suggestions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold_accents, search_keywords
from .report import patch

def denormalize_catalog(familia: DataFrame, grupo: DataFrame, capitulo: DataFrame) -> DataFrame:
    """One row per familia with its grupo and capitulo (left joins)."""
    g = grupo.select(F.col("id").alias("grupo_id"), F.col("code").alias("grupo_code"), F.col("name").alias("grupo_name"), "capitulo_id")
    c = capitulo.select(F.col("id").alias("capitulo_id"), F.col("code").alias("capitulo_code"), F.col("name").alias("capitulo_name"))
    return familia.select(F.col("id").alias("familia_id"), F.col("code").alias("familia_code"), F.col("name").alias("familia_name"), "typical_unit", "keywords", "grupo_id").join(g, "grupo_id", "left").join(c, "capitulo_id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def resolve_classification(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds the ids of the three levels to rows with a familia_code; unknown codes keep null ids."""
    return items.join(catalog.select("familia_code", "familia_id", "grupo_id", "capitulo_id"), "familia_code", "left")


def ancestors(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds grupo_id and capitulo_id to rows with a familia_id; unknown ids keep null parents."""
    return items.join(catalog.select("familia_id", "grupo_id", "capitulo_id"), "familia_id", "left")


def suggest_codes(items: DataFrame, catalog: DataFrame, top_k: int = 1, per_keyword: int = 20) -> DataFrame:
    """The top_k catalog rows for each distinct (description, unit): rows whose text contains its search words.

    Each word takes its first ``per_keyword`` rows by codigo; a hit counts 1, and 0.5 more if the row's unit
    contains the item's; ties go to the shorter text, then codigo. Distinct tokens of the catalog give their distinct
    substrings, which meet the words in an equi-join: no product of words and tokens arises. A frequent word's rows
    are cut to ``per_keyword`` by salt before they meet in one task.
    """
    wanted = items.select("description", "unit").distinct().select("description", "unit", F.explode(search_keywords(F.col("description"))).alias("word"))
    rows = catalog.select("codigo", "descricao", "unidade")
    tokens = rows.select("codigo", "descricao", "unidade", F.explode(F.array_distinct(F.split(F.lower("descricao"), "[^\\p{L}\\p{N}]+"))).alias("token"))
    words, known = wanted.select("word").distinct(), tokens.select("token").distinct()
    n = F.length("token")
    starts = F.sequence(F.lit(1), n)
    inside = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(F.col("token"), i, k)))))
    pairs = known.where(n > 0).select("token", F.explode(inside).alias("word")).join(words, "word")
    hits = pairs.join(tokens, "token").select("word", "codigo", "descricao", "unidade").distinct().withColumn("salt", F.pmod(F.xxhash64("codigo", "descricao"), F.lit(32)))
    least = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy("codigo", "descricao", "unidade"))
    first = hits.withColumn("r", least(["word", "salt"])).where(F.col("r") <= per_keyword).withColumn("r", least(["word"])).where(F.col("r") <= per_keyword).drop("r", "salt")
    scored = wanted.join(first, "word").groupBy("description", "unit", "codigo", "descricao").agg(F.sum(1 + F.when(F.contains(F.lower("unidade"), F.lower("unit")) & (F.col("unit") != ""), 0.5).otherwise(0.0)).alias("score"))
    w = Window.partitionBy("description", "unit").orderBy(F.desc("score"), F.length("descricao"), "codigo")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def codes_for_family(catalog: DataFrame, queries: DataFrame, top_k: int = 5, most: int = 50) -> DataFrame:
    """Per query row (familia_id, query): the family's codes ranked by shared words of four letters or more."""
    w = Window.partitionBy("familia_id").orderBy("codigo")
    rows = catalog.where("familia_id is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), "[^\\p{L}\\p{N}_]+")), lambda t: F.length(t) >= 4)
    joined = rows.join(queries, "familia_id").withColumn("score", F.size(F.array_intersect(words("descricao"), words("query"))))
    return joined.withColumn("rank", F.row_number().over(Window.partitionBy("familia_id", "query").orderBy(F.desc("score"), "codigo"))).where(F.col("rank") <= top_k).select("familia_id", "query", "codigo", "score", "rank")


def catalog_outline(catalog: DataFrame, most_keywords: int = 6) -> DataFrame:
    """One text line per chapter: its groups and families in code order, with units and first keywords."""
    line = F.concat_ws(" ", F.coalesce("familia_code", F.lit("—")), F.col("familia_name"), F.concat(F.lit("["), F.coalesce("typical_unit", F.lit("?")), F.lit("]")), F.array_join(F.slice("keywords", 1, most_keywords), ", "))
    groups = catalog.groupBy("capitulo_code", "capitulo_name", "grupo_code", "grupo_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("familia_code", line.alias("l")))), lambda x: x["l"]), "\n").alias("families"))
    text = F.concat(F.coalesce("grupo_code", F.lit("—")), F.lit(" "), F.coalesce("grupo_name", F.lit("")), F.lit("\n"), F.col("families"))
    return groups.groupBy("capitulo_code", "capitulo_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("grupo_code", text.alias("t")))), lambda x: x["t"]), "\n").alias("outline"))


def classify_items(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds familia_code and confidence by keyword overlap; the work runs once for each distinct description.

    Hits: description words found among a familia's keywords and name words. Most hits win, then the code.
    Confidence: hits by words, halved for another unit. No hit: null and 0. Familias that have the same of the asked words
    are one candidate, of which only the first code can win: descriptions meet as many candidates as there are such sets of words.
    """
    tokens = lambda c: F.filter(F.array_distinct(F.split(F.regexp_replace(fold_accents(c, True), "[^a-z0-9 ]", " "), " +")), lambda t: F.length(t) >= 4)
    texts = items.where(F.col("unit").isNotNull() & (F.length(F.trim("description")) >= 3)).select("description").distinct().withColumn("tokens", tokens(F.col("description"))).withColumn("n", F.size("tokens"))
    asked = texts.select("description", "n", F.explode("tokens").alias("token"))
    known = catalog.select("familia_code", "typical_unit", F.explode(F.array_distinct(F.concat(tokens(F.array_join("keywords", " ")), tokens(F.col("familia_name"))))).alias("token"))
    sets = known.join(asked.select("token").distinct(), "token", "left_semi").groupBy("familia_code", "typical_unit").agg(F.array_sort(F.collect_set("token")).alias("words"))
    place = (-F.regexp_extract("familia_code", "([0-9]+)$", 1).try_cast("bigint")).alias("o")
    first = sets.groupBy("words").agg(F.max(F.struct(place, "familia_code", "typical_unit")).alias("f"))
    hits = asked.join(first.select("f", F.explode("words").alias("token")), "token").groupBy("description", "n", "f").agg(F.count("*").alias("hits"))
    best = hits.groupBy("description", "n").agg(F.max(F.struct("hits", "f")).alias("b"))
    said = best.select("description", F.struct("b.f.familia_code", "b.f.typical_unit", F.round(F.col("b.hits") / F.col("n"), 4).alias("share")).alias("said"))
    conf = F.col("said.share") * F.when(F.col("unit") == F.col("said.typical_unit"), 1.0).otherwise(0.5)
    known_unit = lambda c: F.when(F.col("unit").isNotNull(), c)
    return items.join(said, "description", "left").withColumns({"familia_code": known_unit(F.col("said.familia_code")), "confidence_score": F.coalesce(known_unit(conf), F.lit(0.0))}).drop("said")


PREDICTED = "key string, familia_code string, confidence double, attributes map<string,string>, reasoning string"


def predict_in_batches(rows: DataFrame, predict: Callable[[list[dict]], list[dict]], size: int = 20) -> DataFrame:
    """What ``predict`` says of rows (key, description, unit), ``size`` of them a call.

    ``predict`` takes a list of dicts and gives dicts with key, familia_code, confidence and, if it likes, attributes and
    reasoning, in any order. Keys that it leaves out, and what isn't asked for, count as unsure: null family, confidence
    0. Confidence is kept within 0 to 1, reasoning cut to 200 characters. An error of the predictor fails the task, which is tried again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), size):
                batch = f.iloc[at : at + size].to_dict("records")
                said = {str(r.get("key", "")).strip(): r for r in predict(batch)}
                out = []
                for b in batch:
                    r = said.get(b["key"].strip(), {})
                    code = r.get("familia_code") or None
                    out.append((b["key"], code, min(1.0, max(0.0, float(r.get("confidence") or 0))), {str(k): str(v) for k, v in (r.get("attributes") or {}).items()}, str(r.get("reasoning") or "")[:200]))
                yield pd.DataFrame(out, columns=["key", "familia_code", "confidence", "attributes", "reasoning"])

    return rows.select("key", "description", "unit").mapInPandas(run, PREDICTED)


def classify_with(items: DataFrame, catalog: DataFrame, predict: Callable[[list[dict]], list[dict]], size: int = 20) -> DataFrame:
    """Adds what a predictor says of each distinct description (first 200 characters) and unit, and the ids of its familia; an unknown code has none.

    Descriptions of fewer than three characters aren't asked about: null, 0, no attributes.
    """
    d, u = F.substring(F.lower(F.trim(F.coalesce("description", F.lit("")))), 1, 200), F.lower(F.coalesce("unit", F.lit("")))
    rows = items.withColumn("key", F.sha2(F.concat_ws("|", d, u), 256)).withColumn("asked", F.length(d) >= 3)
    distinct = rows.where("asked").groupBy("key").agg(F.min("description").alias("description"), F.min("unit").alias("unit"))
    ids = catalog.select("familia_code", "familia_id", "grupo_id", "capitulo_id")
    said = predict_in_batches(distinct, predict, size).join(ids, "familia_code", "left")
    none = F.create_map().cast("map<string,string>")
    return rows.join(said, "key", "left").drop("key", "asked").withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "attributes": F.coalesce("attributes", none), "reasoning": F.coalesce("reasoning", F.lit(""))})


def classify_codes(codes: DataFrame, catalog: DataFrame, predict: Callable[[list[dict]], list[dict]], size: int = 20) -> DataFrame:
    """Price rows (codigo, descricao, unidade, familia_id) of which those without a familia were asked about, in batches; what is unsure or unknown stays open."""
    asked = codes.where("familia_id IS NULL").select(F.col("codigo").alias("key"), F.col("descricao").alias("description"), F.coalesce("unidade", F.lit("")).alias("unit"))
    said = predict_in_batches(asked, predict, size).join(catalog.select("familia_code", "familia_id"), "familia_code").select(F.col("key").alias("codigo"), "familia_id")
    return patch(codes, said, "codigo")


def pending(rows: DataFrame, order: Column, n: int | None = None) -> DataFrame:
    """Rows without a familia, oldest first; ``n`` limits the batch."""
    out = rows.where("familia_id is null").orderBy(order)
    return out.limit(n) if n else out

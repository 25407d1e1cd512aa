"""Cleaning and consolidation of budget items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import best_unit, count_quantity, implausible, normalize_unit
from ..functions.text import description_key, primary_noun
from ..rules import CONFIDENCES, DISCIPLINES, VARIANT_SEPARATORS


def clean_items(items: DataFrame, policy: str = "cad") -> DataFrame:
    """Extracted rows to valid items. Policies: cad, pdf (unknown discipline becomes Complementares), batch (no unit rule, missing quantity 1)."""
    out = items.where(F.length(F.trim("description")) >= 3)
    conf = F.when(F.col("confidence").isin(*CONFIDENCES), F.col("confidence")).otherwise("estimado")
    q = F.greatest(F.coalesce("quantity", F.lit(0.0)), F.lit(0.0))
    if policy == "batch":
        return out.select(*[c for c in items.columns if c not in ("confidence", "quantity")], conf.alias("confidence"), F.when(q > 0, q).otherwise(1.0).alias("quantity"))
    q = F.when((q == 0) & (conf == "confirmado"), 1.0).otherwise(q)
    unit = normalize_unit(F.col("description"), F.col("unit"))
    out = out.withColumns({"new_unit": unit, "quantity": q, "confidence": conf})
    changed = F.col("new_unit") != F.col("unit")
    out = out.withColumns({"confidence": F.when(changed, "estimado").otherwise(F.col("confidence")), "observations": F.when(changed, F.concat_ws(" | ", F.nullif("observations", F.lit("")), F.concat(F.lit("Unidade corrigida: "), "unit", F.lit(" → "), "new_unit"))).otherwise(F.col("observations")), "unit": F.col("new_unit")}).drop("new_unit")
    if policy == "pdf":
        out = out.withColumn("discipline", F.when(F.col("discipline").isin(*DISCIPLINES), F.col("discipline")).otherwise("Complementares"))
    return out


def consolidate_exact(items: DataFrame) -> DataFrame:
    """First pass per (job, description key, unit), one shuffle: department replicas become one summed row, equal quantities keep the longest description."""
    w = Window.partitionBy("job_id", "key", "unit")
    q = F.round(F.coalesce("quantity", F.lit(0.0)), 2)
    rows = items.withColumn("key", description_key(F.col("description"))).withColumns({"n": F.count("*").over(w), "most": F.max(q).over(w), "least": F.min(q).over(w), "total": F.round(F.sum(q).over(w), 2), "head": F.min("seq").over(w), "place": F.row_number().over(w.orderBy(F.desc(F.length("description")), "seq"))})
    replica = (F.col("n") >= 4) & (F.col("most") < 2)
    rows = rows.withColumn("replica", replica).where((F.col("place") == 1) | (~F.col("replica") & (F.col("most") != F.col("least"))))
    short = F.col("description")
    for sep in VARIANT_SEPARATORS:
        short = F.substring_index(short, sep, 1)
    note = F.format_string("Consolidado de %d entradas replicadas por departamento/variante — soma de qtys: %s %s", "n", F.col("total").cast("string"), F.col("unit"))
    pick = lambda c, other: F.when(F.col("replica"), other).otherwise(F.col(c)).alias(c)
    rows = rows.select("job_id", "item_num", pick("description", F.concat(F.trim(short), F.lit(" (várias variantes)"))), "unit", pick("quantity", F.col("total")), pick("observations", note), "ref_sheet", pick("confidence", F.lit("estimado")), "discipline", "head", F.col("seq").alias("old"))
    order = Window.partitionBy("job_id").orderBy("head", "old")
    return rows.withColumn("seq", F.row_number().over(order).cast("bigint")).drop("head", "old")


#: One bucket's descriptions in order, each to the first family whose first description shares its noun or two of its words, else to a new one: its head's place in the list.
FAMILIES = """aggregate(transform(found, (x, i) -> struct(i + 1 AS at, x.noun AS noun, array_distinct(split(x.key, ' ')) AS words)), struct(cast(array() AS array<struct<at:int,noun:string,words:array<string>>>) AS heads, cast(array() AS array<int>) AS heads_of),
    (s, x) -> struct(
        if(exists(s.heads, h -> (x.noun <> '' AND h.noun = x.noun) OR size(array_intersect(h.words, x.words)) >= 2), s.heads, concat(s.heads, array(x))) AS heads,
        concat(s.heads_of, array(coalesce(get(filter(s.heads, h -> (x.noun <> '' AND h.noun = x.noun) OR size(array_intersect(h.words, x.words)) >= 2), 0).at, x.at))) AS heads_of),
    s -> s.heads_of)"""
#: The lists of one bucket's families; ``found`` and ``heads`` say which entries there are and to which of them each belongs.
SPLIT = "transform(array_distinct(heads), h -> filter(found, (x, i) -> heads[i] = h))"


def families(rows: DataFrame) -> DataFrame:
    """Greedy first-fit families in (job, bucket), bucket being discipline and quantity: a row each, as the list ``family`` of its entries in order.

    Rows of equal noun, key and unit are one entry here, as they join the same family; so a fold holds the distinct descriptions
    of a bucket and their units, however often they repeat. An entry has its number of rows, their first seq and the best row.
    What can't match anything (less than 2, or no noun and no two words) is a family for itself and in no list.
    All groups lie within a job: rows that are dealt by job aren't shuffled again.
    """
    keys = ["job_id", "bucket", "q", "alone"]
    match = (F.col("q") >= 2) & ((F.col("noun") != "") | (F.size(F.array_distinct(F.split("key", " "))) >= 2))
    entries = rows.withColumn("alone", F.when(~match, F.col("seq"))).groupBy(*keys, "noun", "key", "unit").agg(F.min("seq").alias("first"), F.count("*").alias("n"), F.max(F.struct(F.length("description").alias("size"), (-F.col("seq")).alias("place"), "row")).alias("best"))
    lists = entries.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "noun", "key", "unit", "n", "best"))).alias("found"))
    many = F.size("found") > 1
    lists = lists.withColumn("heads", F.when(many, F.expr(FAMILIES)))
    return lists.select("job_id", "bucket", "q", F.explode(F.when(many, F.expr(SPLIT)).otherwise(F.array("found"))).alias("family"))


def consolidate_similar(items: DataFrame) -> DataFrame:
    """Second pass: items of one job, discipline and quantity (2 or more) that share a noun or two key words become one row.

    Families come in the order of their bucket's first item, then of their own. No task holds a job or a family as a whole, and
    after ``consolidate_exact``, whose rows are dealt by job, nothing is shuffled.
    """
    row = F.struct("item_num", "description", "quantity", "observations", "ref_sheet", "confidence", "discipline")
    rows = items.select("job_id", "seq", "unit", "description", F.coalesce("discipline", F.lit("")).alias("bucket"), F.round(F.coalesce("quantity", F.lit(0.0)), 2).alias("q"), description_key(F.col("description")).alias("key"), primary_noun(F.col("description")).alias("noun"), row.alias("row"))
    entry = lambda c: F.transform("family", lambda x: x[c])
    merged = families(rows).select("job_id", "bucket", "q", F.aggregate(entry("n"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"), F.array_min(entry("first")).alias("head"), F.array_distinct(entry("unit")).alias("units"), F.array_max(entry("best"))["row"].alias("row"))
    start = F.when(F.col("q") >= 2, F.min("head").over(Window.partitionBy("job_id", "bucket", "q"))).otherwise(F.col("head"))
    merged = merged.withColumn("start", start).select("job_id", "start", "head", "n", "q", "units", "row.*")
    one = F.col("n") == 1
    different = F.array_sort(F.array_compact("units"))
    chosen = best_unit(F.col("units"), F.col("description"))
    note = F.when(F.size(different) > 1, F.concat(F.lit("Fundido de "), F.col("n").cast("string"), F.lit(" entradas com units divergentes ("), F.array_join(different, "/"), F.lit(")"))).otherwise(F.concat(F.lit("Fundido de "), F.col("n").cast("string"), F.lit(" entradas com mesma qty")))
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("start", "head")).cast("bigint")
    return merged.select("job_id", "item_num", "description", F.when(one, F.get("units", F.lit(0))).otherwise(chosen).alias("unit"), F.when(one, F.col("quantity")).otherwise(F.col("q")).alias("quantity"), F.when(one, F.col("observations")).otherwise(F.concat_ws(" | ", F.nullif("observations", F.lit("")), note)).alias("observations"), "ref_sheet", F.when(one, F.col("confidence")).otherwise("estimado").alias("confidence"), "discipline", place.alias("seq"))


def check_counts(items: DataFrame) -> DataFrame:
    """Counts that aren't whole are rounded or set to 0, marked estimado."""
    q = count_quantity(F.col("unit"), F.col("quantity"))
    return items.withColumns({"flagged": q != F.col("quantity"), "quantity": q}).withColumn("confidence", F.when(F.col("flagged"), "estimado").otherwise(F.col("confidence")))


def check_plausibility(items: DataFrame, area: str = "total_area") -> DataFrame:
    reason = implausible(F.col("unit"), F.col("quantity"), F.col("discipline"), F.col(area))
    return items.withColumn("reason", reason).withColumn("confidence", F.when(F.col("reason").isNotNull(), "estimado").otherwise(F.col("confidence")))


def first_description_wins(items: DataFrame) -> DataFrame:
    """Per job, the first row of each description's first 50 characters; no discipline becomes Complementares."""
    w = Window.partitionBy("job_id", F.substring(F.lower(F.trim("description")), 1, 50)).orderBy("seq")
    return items.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place").withColumn("discipline", F.coalesce(F.nullif("discipline", F.lit("")), F.lit("Complementares")))


def number_items(items: DataFrame) -> DataFrame:
    """Numbers d.i: disciplines present in fixed order, unknown ones after them as first seen; items in order."""
    fixed = F
    for i, d in enumerate(DISCIPLINES):
        fixed = fixed.when(F.col("discipline") == d, i)
    fixed = fixed.otherwise(len(DISCIPLINES))
    rows = items.withColumn("fixed", fixed).withColumn("seen", F.when(F.col("fixed") == len(DISCIPLINES), F.min("seq").over(Window.partitionBy("job_id", "discipline"))).otherwise(0))
    d = F.dense_rank().over(Window.partitionBy("job_id").orderBy("fixed", "seen"))
    i = F.row_number().over(Window.partitionBy("job_id", "discipline").orderBy("seq"))
    return rows.withColumns({"discipline_no": d, "line_no": i}).withColumn("item_num", F.concat_ws(".", "discipline_no", "line_no")).drop("fixed", "seen")

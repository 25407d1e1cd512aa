"""Quantity-per-area benchmarks and alerts; correction factors; revision compare."""

from __future__ import annotations

import difflib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions.numbers import rounded, rounded_product
from ..functions.text import item_type_key
from ..rules import ALERT_NOTE, ALERT_TEXT, ALERT_WORDS, BDI, CONTINGENCY, LEVEL_LABELS

LEVELS = ("familia", "grupo", "capitulo")


def density_rows(item_areas: DataFrame) -> DataFrame:
    """A density row of each item with its project's area, as parsed: quantity by area above 0 at 6 places, at most 100."""
    ratio = F.col("quantity") / F.col("ref_area")
    rows = item_areas.where((F.col("ref_area") > 0) & (ratio * 1e6 >= 0.5) & (ratio <= 100))
    rows = rows.select("job_id", "seq", "typology", "description", item_type_key(F.col("description")).alias("item_type"), F.when(F.coalesce("unit", F.lit("")) == "", "vb").otherwise(F.col("unit")).alias("unit"), F.round("quantity", 4).alias("qty"), "ref_area", ratio.alias("density"), "familia_id", F.col("job_id").cast("string").alias("project_label"))
    return rows.withColumn("density", rounded_product(F.col("density"), 6))


def raw_densities(item_areas: DataFrame) -> DataFrame:
    """Density rows as stored: upserted by typology, item type, unit and project, of which the last row by seq stays.

    The project is the job here, so rows that are dealt by job aren't shuffled again. Each column has its own state: numbers need no sort.
    """
    rows = density_rows(item_areas)
    keys = ["typology", "item_type", "unit", "project_label"]
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy("job_id", *keys).agg(*[F.max_by(c, "seq").alias(c) for c in rest if c != "job_id"]).select(*keys, *rest)


def benchmarks(raw: DataFrame, catalog: DataFrame, levels: tuple = LEVELS) -> DataFrame:
    """Per typology, level, id and unit over projects: mean, deviation, least, most and number of the projects' summed densities."""
    rows = raw.where("familia_id is not null and density > 0").join(catalog.select("familia_id", "grupo_id", "capitulo_id"), "familia_id", "left")
    ids = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"{x}_id").alias("level_id")) for x in levels]))
    sums = rows.select("typology", F.trim("unit").alias("unit"), F.coalesce("project_label", F.lit("")).alias("project"), "density", ids.alias("k")).where("k.level_id is not null").groupBy("typology", "k.level", "k.level_id", "unit", "project").agg(F.sum("density").alias("d"))
    stats = sums.groupBy("typology", "level", "level_id", "unit").agg(rounded(F.avg("d"), 6).alias("mean"), rounded(F.coalesce(F.stddev_samp("d"), F.lit(0.0)), 6).alias("stddev"), rounded(F.min("d"), 6).alias("min_value"), rounded(F.max("d"), 6).alias("max_value"), F.count("*").alias("n_projects"))
    return stats.withColumn("item_type", F.concat_ws(":", "level", "level_id"))


def density_alerts(items: DataFrame, bench: DataFrame, catalog: DataFrame, least_projects: int = 2) -> DataFrame:
    """Adds level, mean, stddev, n_projects, density, alert (high, low or null) and its reason as text, from the most specific benchmark with enough projects.

    items: typology, familia_id, unit, quantity, ref_area, confidence and, if there are any, observations. An alert sets the confidence
    to estimado and is noted after what the observations say. One join on exploded levels would multiply the items;
    three joins with the benchmark table don't; Spark broadcasts it where its measured size allows.
    """
    rows = items.join(catalog.select("familia_id", "grupo_id", "capitulo_id"), "familia_id", "left").withColumn("u", F.trim("unit"))
    good = bench.where(F.col("n_projects") >= least_projects)
    for level in LEVELS:
        side = good.where(F.col("level") == level).select("typology", F.col("unit").alias("u"), F.col("level_id").alias(f"{level}_id"), F.struct("level", "mean", "stddev", "max_value", "n_projects").alias(f"b_{level}"))
        rows = rows.join(side, ["typology", "u", f"{level}_id"], "left")
    rows = rows.withColumn("b", F.coalesce(*[F.col(f"b_{x}") for x in LEVELS]))
    density = F.when((F.col("ref_area") > 0) & (F.col("quantity") > 0), F.col("quantity") / F.col("ref_area"))
    mean, sd, top = F.col("b.mean"), F.col("b.stddev"), F.col("b.max_value")
    high = F.when(sd == 0, 2.5 * mean).otherwise(mean + 2 * sd)
    low = F.when(sd == 0, mean / 2.5).otherwise(mean - 2 * sd)
    alert = F.when(~(mean > 0), None).when((F.col("density") > high) | ((top > 0) & (F.col("density") > 1.5 * top)), "high").when((low > 0) & (F.col("density") < low), "low")
    rows = rows.withColumns({"density": density, "alert": alert, "level": F.col("b.level"), "mean": mean, "stddev": sd, "n_projects": F.col("b.n_projects")})
    rows = rows.withColumn("reason", alert_reason()).drop("b", "u", *[f"b_{x}" for x in LEVELS])
    found = F.col("alert").isNotNull()
    rows = rows.withColumn("confidence", F.when(found, "estimado").otherwise(F.col("confidence")))
    if "observations" not in items.columns:
        return rows
    note = F.trim(F.concat(F.coalesce("observations", F.lit("")), F.lit(ALERT_NOTE), F.col("reason")), F.lit(" |"))
    return rows.withColumn("observations", F.when(found, note).otherwise(F.col("observations")))


def alert_reason() -> Column:
    """The text of an alert, from the columns that ``density_alerts`` adds; null without one."""
    fixed = lambda c, n: F.format_string(f"%.{n}f", rounded(c, n))
    d, m = F.col("density"), F.col("mean")
    label = F.element_at(F.create_map(*[F.lit(x) for kv in LEVEL_LABELS.items() for x in kv]), F.col("level"))
    text = {k: F.format_string(ALERT_TEXT, fixed(d, 3), F.coalesce(F.trim("unit"), F.lit("")), fixed(d / m if k == "high" else m / d, 1), F.lit(more), label, fixed(m, 3), fixed(F.col("stddev"), 3), F.col("n_projects").cast("string"), F.lit(cause)) for k, (more, cause) in ALERT_WORDS.items()}
    return F.when(F.col("alert") == "high", text["high"]).when(F.col("alert") == "low", text["low"])


def _typologies(where: Column | None = None) -> Column:
    kept = F.col("typology") if where is None else F.when(where, F.col("typology"))
    return F.array_join(F.array_sort(F.collect_set(kept)), ",").alias("typologies")


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two results of one row each as one row."""
    return a.unionByName(b, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in (*a.columns, *b.columns)])


def ingest_summary(parsed: DataFrame, bench: DataFrame) -> DataFrame:
    """One row: density rows parsed and classified, their typologies, and the benchmarks of each level and together."""
    rows = parsed.agg(F.count("*").alias("parsed"), F.count("familia_id").alias("classified"), _typologies())
    counts = bench.agg(*[F.count_if(F.col("level") == x).alias(f"benchmarks_{x}") for x in LEVELS], F.count("*").alias("benchmarks"))
    return _side_by_side(rows, counts)


def reclassified(raw: DataFrame, catalog: DataFrame, classify: Callable[[DataFrame], DataFrame], typology: str | None = None, only_unclassified: bool = True, limit: int | None = None) -> DataFrame:
    """Stored density rows with the familia that ``classify`` finds for those picked; adds picked and found.

    Picked: rows of ``typology`` (null: any), without a familia if ``only_unclassified``, the first ``limit`` by seq if given.
    ``classify`` takes rows with description and unit and adds familia_code. Rows without a description are picked, but
    not classified; a row of which no familia is found keeps what it had. Each picked row is classified once, the others aren't read for it.
    """
    wanted = F.lit(True)
    if typology:
        wanted = wanted & F.coalesce(F.col("typology") == typology, F.lit(False))
    if only_unclassified:
        wanted = wanted & F.col("familia_id").isNull()
    rows = raw.withColumn("picked", wanted)
    if limit:
        first = rows.where("picked").orderBy("seq", "job_id").limit(limit).select("job_id", "seq", F.lit(True).alias("among"))
        rows = rows.join(first, ["job_id", "seq"], "left").withColumn("picked", F.coalesce("among", F.lit(False))).drop("among")
    asked = F.col("picked") & (F.coalesce("description", F.lit("")) != "")
    ids = catalog.select("familia_code", F.col("familia_id").alias("new_id"))
    said = classify(rows.where(asked)).join(ids, "familia_code", "left").withColumn("found", F.col("new_id").isNotNull())
    said = said.withColumn("familia_id", F.coalesce("new_id", "familia_id"))
    return said.select(*rows.columns, "found").unionByName(rows.where(~asked).withColumn("found", F.lit(False)))


def reclassify_summary(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row about ``reclassified`` rows: picked, classified, skipped, typologies with new familias, and how many benchmarks these have now."""
    empty = F.coalesce("description", F.lit("")) == ""
    sums = rows.agg(F.count_if("picked").alias("raws_total"), F.count_if("found").alias("classified"), F.count_if(F.col("picked") & empty).alias("skipped"), _typologies(F.col("found")))
    touched = rows.where("found").select("typology").distinct()
    return _side_by_side(sums, benchmarks(rows.join(touched, "typology", "left_semi"), catalog).agg(F.count("*").alias("benchmarks")))


def _last(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """The last row by order of each key."""
    return rows.groupBy("job_id", key).agg(F.max_by(F.struct("item_num", "quantity", "unit", "discipline", "seq"), "seq").alias(prefix))


def compare_budgets(original: DataFrame, revised: DataFrame) -> DataFrame:
    """Matched pairs whose quantities differ: by item number, else by description key (last revised row of a key wins)."""
    o = original.withColumn("item_type", item_type_key(F.col("description")))
    r = revised.withColumn("item_type", item_type_key(F.col("description")))
    joined = o.join(_last(r, "item_num", "m1"), ["job_id", "item_num"], "left").join(_last(r.where("item_type <> ''"), "item_type", "m2"), ["job_id", "item_type"], "left")
    joined = joined.withColumn("m", F.coalesce("m1", "m2")).withColumn("stage", F.when(F.col("m1").isNotNull(), 1).when(F.col("m2").isNotNull(), 2))
    return joined


def calibration(matched: DataFrame) -> DataFrame:
    """Deviation and factor of matched pairs with differing quantities above 0."""
    ai, real = F.col("quantity"), F.col("m.quantity")
    rows = matched.where((ai != real) & (ai > 0) & (real > 0))
    return rows.select("job_id", "seq", "item_type", F.coalesce(F.nullif("discipline", F.lit("")), F.col("m.discipline")).alias("discipline"), F.coalesce(F.nullif("unit", F.lit("")), F.col("m.unit")).alias("unit"), F.round(ai, 4).alias("ai_quantity"), F.round(real, 4).alias("real_quantity"), rounded((ai - real) / real * 100, 2).alias("deviation_pct"), rounded(real / ai, 4).alias("correction_factor"), "stage")


@lru_cache(50_000)
def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Gestalt similarity of two lower-cased texts, a batch at a time."""
    return pd.Series([_ratio((x or "").lower(), (y or "").lower()) for x, y in zip(a, b, strict=True)], dtype="float64")


def prefix_marks(texts: pd.Series, least: float = 0.7) -> list[list[str]]:
    """For each text the rarest of its marks, of which two texts with a ratio above ``least`` share one for sure.

    Marks are a character and how often it was seen in the text so far. A ratio above ``least`` asks for more common marks
    than least / 2 of both lengths, so for at least that share of either text, as the other one has that many characters; in
    one order for all (late occurrences first, as they are rare), the first marks beyond the others must meet.
    """
    out = []
    for t in texts:
        seen: dict[str, int] = {}
        marks = []
        for c in t:
            seen[c] = n = seen.get(c, 0) + 1
            marks.append((-n, c))
        common = int(len(t) * least / (2 - least)) + 1  # more than that share
        out.append([f"{c}{-n}" for n, c in sorted(marks)[: max(0, len(t) - common + 1)]])
    return out


def similar_texts(left: DataFrame, right: DataFrame, key: str, least: float = 0.7) -> DataFrame:
    """(key, a, b, ratio) of the distinct lower-cased texts of one key whose gestalt similarity is above ``least``.

    left: key, a; right: key, b. Candidates come from an equi-join on key and rare marks (``prefix_marks``), are bounded by
    their lengths, and are scored once a key (a worker remembers pairs that other keys have, too). Empty texts are no candidates.
    """

    @F.pandas_udf("array<string>")
    def marks(t: pd.Series) -> pd.Series:
        return pd.Series(prefix_marks(t, least))

    def marked(rows: DataFrame, c: str) -> DataFrame:
        return rows.select(key, c).where(F.length(c) > 0).distinct().select(key, c, F.explode(marks(F.col(c))).alias("mark"))

    n, m = F.length("a"), F.length("b")
    pairs = marked(left, "a").join(marked(right, "b"), [key, "mark"]).where(2 * F.least(n, m) > least * (n + m)).select(key, "a", "b").distinct()
    return pairs.withColumn("ratio", sequence_ratio(F.col("a"), F.col("b"))).where(F.col("ratio") > least)


def _by_rank(similar: list[tuple[float, str]]) -> list[tuple[float, list[str]]]:
    """Texts in groups of one ratio, the best first."""
    ranks: dict[float, list[str]] = {}
    for ratio, text in sorted(similar, reverse=True):
        ranks.setdefault(ratio, []).append(text)
    return list(ranks.items())


def _greedy(known: dict[str, list[tuple[float, str]]] | None):
    """A fold over the jobs of a partition, each as its similar texts (step 0; without ``known``), revised rows (1) and own rows (2), in order.

    A matched row takes its number; another one takes the best revised row whose number isn't taken yet, of equals the first.
    A task holds the revised rows of one job.
    """
    ranks_of = {a: _by_rank(found) for a, found in (known or {}).items()}
    wanted = {b for found in (known or {}).values() for _, b in found}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, similar, ranks, pool, taken = None, {}, {}, {}, set()
        for batch in batches:
            out = []
            for j, step, place, text, number, amount, matched in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if j != job:
                    job, similar, ranks, pool, taken = j, {}, {} if known is None else ranks_of, {}, set()
                if step == 0:
                    similar.setdefault(text, []).append((amount, number))
                elif step == 1:
                    if known is None or text in wanted:
                        pool.setdefault(text, deque()).append((place, number, amount))
                elif matched:
                    taken.add(number)
                else:
                    if known is None and text in similar:
                        ranks[text] = _by_rank(similar.pop(text))
                    for ratio, texts in ranks.get(text, ()):
                        best = None
                        for b in texts:
                            rows = pool.get(b)
                            while rows and rows[0][1] in taken:  # a number that is taken stays taken
                                rows.popleft()
                            if rows and (best is None or rows[0][0] < best[0]):
                                best = rows[0]
                        if best:
                            taken.add(best[1])
                            out.append((job, place, best[1], best[2], round(ratio, 6)))
                            break
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, MATCHED.values(), strict=True)], names=list(MATCHED))

    return fold


MATCHED = {"job_id": pa.int64(), "seq": pa.int64(), "revised_num": pa.string(), "revised_quantity": pa.float64(), "ratio": pa.float64()}


def _few_similar(a: DataFrame, b: DataFrame, most: int) -> dict[str, list[tuple[float, str]]] | None:
    """Similar texts of two tables of distinct texts, whatever their job, if either has at most ``most``; else null, and a job's own are found in its job."""
    if a.limit(most + 1).count() > most or b.limit(most + 1).count() > most:
        return None
    rows = similar_texts(a.withColumn("all", F.lit(1)), b.withColumn("all", F.lit(1)), "all").limit(20 * most + 1).collect()
    known: dict[str, list[tuple[float, str]]] = {}
    for r in rows:
        known.setdefault(r.a, []).append((r.ratio, r.b))
    return known if len(rows) <= 20 * most else None


def fuzzy_match(original: DataFrame, revised: DataFrame, few: int = 2_000) -> DataFrame:
    """Third stage, per project: leftovers by text similarity above 0.7, each revised number once.

    Similar texts are found and scored by joins: among all texts, if they are ``few``, else in each project. The order-dependent step
    then only looks up, as a fold over partitions sorted by project: no project is a group of its own in Python.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    matched = compare_budgets(original, revised).where("job_id is not null")
    rows = matched.select("job_id", "seq", low(F.col("description")).alias("a"), F.col("stage").isNotNull().alias("matched"), F.col("m.item_num").alias("matched_num"))
    pool = revised.where("job_id is not null").select("job_id", "item_num", low(F.col("description")).alias("b"), "quantity", F.col("seq").alias("rev_seq"))
    known = _few_similar(original.select(low(F.col("description")).alias("a")).distinct(), revised.select(low(F.col("description")).alias("b")).distinct(), few)

    def step(df: DataFrame, n: int, place, text, number, amount, matched=False) -> DataFrame:
        c = lambda x: F.col(x) if isinstance(x, str) else F.lit(x)
        return df.select(F.col("job_id").cast("long").alias("job_id"), F.lit(n).alias("step"), c(place).cast("long").alias("place"), c(text).alias("text"), c(number).cast("string").alias("number"), c(amount).cast("double").alias("amount"), c(matched).alias("matched"))

    whole = step(pool, 1, "rev_seq", "b", "item_num", "quantity").unionByName(step(rows, 2, "seq", "a", "matched_num", None, "matched"))
    if known is None:
        whole = whole.unionByName(step(similar_texts(rows.where("NOT matched"), pool, "job_id"), 0, None, "a", "b", "ratio"))
    ordered = whole.repartition("job_id").sortWithinPartitions("job_id", "step", "place", "number")
    return ordered.mapInArrow(_greedy(known), "job_id long, seq long, revised_num string, revised_quantity double, ratio double")


def calibration_factors(rows: DataFrame) -> DataFrame:
    return rows.groupBy("item_type", "discipline", "unit").agg(rounded(F.avg("correction_factor"), 6).alias("avg_factor"), F.count("*").alias("data_points"), rounded(F.avg("deviation_pct"), 6).alias("avg_deviation"), rounded(F.coalesce(F.stddev_samp("correction_factor"), F.lit(0.0)), 6).alias("stddev_factor"), F.min("correction_factor").alias("min_factor"), F.max("correction_factor").alias("max_factor"))


def apply_factors(items: DataFrame, factors: DataFrame) -> DataFrame:
    """Quantities times the learned factor where it rests on two points or more and lies outside [0.98, 1.02]."""
    f = factors.where("data_points >= 2 and not avg_factor between 0.98 and 1.02").groupBy("item_type").agg(F.max_by("avg_factor", F.struct("data_points", "avg_factor")).alias("factor"))
    rows = items.withColumn("item_type", item_type_key(F.col("description"))).join(f, "item_type", "left")
    note = F.concat(F.lit("Fator "), F.round("factor", 2).cast("string"))
    return rows.withColumns({"observations": F.when(F.col("factor").isNotNull(), F.concat_ws(" | ", F.nullif("observations", F.lit("")), note)).otherwise(F.col("observations")), "quantity": F.when(F.col("factor").isNotNull(), rounded(F.col("quantity") * F.col("factor"), 2)).otherwise(F.col("quantity"))})


def budget_totals(items: DataFrame, price: str = "price") -> DataFrame:
    """Subtotals by discipline and, with a null discipline, the job: direct, contingency, BDI, grand total; % rows don't count."""
    amount = F.when(F.coalesce("unit", F.lit("")) == "%", 0.0).otherwise(F.col("quantity") * F.col(price))
    sums = items.withColumn("amount", amount).rollup("job_id", "discipline").agg(F.sum("amount").alias("direct")).where("job_id is not null")
    job = F.col("discipline").isNull()
    contingency = F.when(job, F.col("direct") * CONTINGENCY)
    bdi = F.when(job, F.col("direct") * (1 + CONTINGENCY) * BDI)
    return sums.select("job_id", "discipline", rounded(F.col("direct"), 2).alias("direct"), rounded(contingency, 2).alias("contingency"), rounded(bdi, 2).alias("bdi"), rounded(F.col("direct") + contingency + bdi, 2).alias("total"))


def fill_section(cells: DataFrame) -> DataFrame:
    """Section rows (a = 'n. name', empty b) set the discipline of the rows after them."""
    name = F.regexp_extract("a", r"^\d+\.\s+(.+)$", 1)
    section = F.when((name != "") & (F.coalesce("b", F.lit("")) == ""), F.array_join(F.transform(F.split(F.lower(name), "-"), F.initcap), "-"))
    w = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumn("section", section).withColumn("discipline", F.last("section", ignorenulls=True).over(w)).where("section is null").drop("section")

"""Take-off from drawing entities: lengths, areas, counts per file and layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify, geometry
from ..functions.numbers import rounded
from ..functions.text import layer_base_name
from ..rules import AREA_NAMES, LENGTH_NAMES


def with_factor(entities: DataFrame, files: DataFrame) -> DataFrame:
    """Adds the file's metres per drawing unit."""
    return entities.join(files.select("file_id", geometry.unit_factor(F.col("insunits"), F.col("measurement")).alias("factor")), "file_id")


def line_lengths(lines: DataFrame, files: DataFrame) -> DataFrame:
    length = geometry.line_length(*map(F.col, ("x1", "y1", "x2", "y2"))) * F.col("factor")
    return with_factor(lines, files).select("file_id", "seq", "layer", length.alias("length")).where("length > 0")


def arc_lengths(arcs: DataFrame, files: DataFrame) -> DataFrame:
    length = geometry.arc_length(F.col("radius"), F.col("start_deg"), F.col("end_deg"), F.lit(False)) * F.col("factor")
    return with_factor(arcs, files).select("file_id", "seq", "layer", length.alias("length"))


def dimension_rows(dims: DataFrame, files: DataFrame) -> DataFrame:
    """Label and metres of each dimension; without a measurement its label alone, if it says something."""
    v = F.col("measurement") * F.col("factor")
    rows = with_factor(dims, files).withColumn("metres", v)
    label = F.nullif("label", F.lit(""))
    measured = F.col("measurement").isNotNull()
    keep = F.when(measured, F.abs("metres") >= 0.001).otherwise(label.isNotNull() & (label != "0"))
    return rows.where(keep).select("file_id", "seq", F.when(measured, F.coalesce(label, F.lit("cota"))).otherwise(label).alias("label"), F.round("metres", 3).alias("metres"))


def sum_by_layer(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("file_id", "layer").agg(rounded(F.sum(value), 3).alias(value), F.count("*").alias("n"))


def countable(blocks: DataFrame) -> DataFrame:
    """Blocks that are items. As a list of none or one: a condition would be moved below, and into what is joined by name, with all that makes up a name written out for each mention."""
    return blocks.select("*", F.explode(F.when(classify.is_countable(F.col("name"), F.col("layer")), F.array(F.lit(True)))).alias("kept")).drop("kept")


def block_counts(blocks: DataFrame, extents: DataFrame, files: DataFrame) -> DataFrame:
    """Per file and countable block: number, first layer and, of openings, median width and height in metres.

    extents: block, w, h in drawing units (``block_bbox``). A size is its extent times the insert's scale and the file's factor, and
    counts where both sides lie between 0.1 and 10 m; without one both are 0. Positions: ``block_positions``.
    """
    rows = with_factor(countable(blocks), files).join(extents.select(F.col("block").alias("name"), F.col("w").alias("bw"), F.col("h").alias("bh")), "name", "left")
    scale = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, 1.0).otherwise(F.col(c))
    w, h = F.abs(F.col("bw") * scale("xscale") * F.col("factor")), F.abs(F.col("bh") * scale("yscale") * F.col("factor"))
    sized = classify.is_opening(F.col("name")) & (w > 0.1) & (w < 10) & (h > 0.1) & (h < 10)
    middle = lambda c: rounded(F.coalesce(F.median(F.when(sized, c)), F.lit(0.0)), 2)
    return rows.groupBy("file_id", "name").agg(F.count("*").alias("n"), F.min_by("layer", "seq").alias("layer"), middle(w).alias("width_m"), middle(h).alias("height_m"))


def block_positions(blocks: DataFrame) -> DataFrame:
    """Where each countable block of a file stands, in order: a row each, as a name may stand anywhere a million times."""
    rows = countable(blocks)
    return rows.select("file_id", "name", "seq", rounded(F.col("x"), 2).alias("x"), rounded(F.col("y"), 2).alias("y"))


def block_bbox(points: DataFrame) -> DataFrame:
    """Extent of each block definition from its points (x, y, r: radius or 0)."""
    return points.groupBy("block").agg((F.max(F.col("x") + F.col("r")) - F.min(F.col("x") - F.col("r"))).alias("w"), (F.max(F.col("y") + F.col("r")) - F.min(F.col("y") - F.col("r"))).alias("h"))


def texts_by_layer(texts: DataFrame, most: int = 50) -> DataFrame:
    """Distinct trimmed texts of more than two characters per layer, the first ``most`` in order."""
    t = texts.withColumn("text", F.trim("text")).where(F.length("text") > 2).select("file_id", "layer", "text").distinct()
    first = t.withColumn("r", F.row_number().over(Window.partitionBy("file_id", "layer").orderBy("text"))).where(F.col("r") <= most)
    return first.groupBy("file_id", "layer").agg(F.array_join(F.array_sort(F.collect_list("text")), " | ").alias("texts"), F.count("*").alias("n"))


def unit_sanity(lines: DataFrame, files: DataFrame, most: int = 200) -> DataFrame:
    """Longest of a file's first lines, with a warning beyond 500 m or below 5 cm."""
    first = lines.withColumn("r", F.row_number().over(Window.partitionBy("file_id").orderBy("seq"))).where(F.col("r") <= most)
    out = line_lengths(first, files).groupBy("file_id").agg(F.round(F.max("length"), 4).alias("longest"))
    return out.withColumn("warning", F.when(F.col("longest") > 500, "large").when(F.col("longest") < 0.05, "small"))


def distinct_layers(entities: DataFrame) -> DataFrame:
    drawn = entities.select("file_id", "layer").distinct()
    named = F.filter(F.array(layer_base_name(F.col("layer"))), lambda x: x.isNotNull())
    return drawn.select("file_id", F.explode(named).alias("layer")).distinct()


def categories_of(layer, name):
    """Categories of the layer, then those of the name that the layer lacks; a null counts as an empty name."""
    return F.array_union(classify.categories(layer), classify.categories(name))


def categorize(entities: DataFrame) -> DataFrame:
    """One row per entity and category of its layer or name."""
    found = entities.withColumn("found", categories_of(F.col("layer"), F.col("name")))
    return found.select(*entities.columns, F.explode("found").alias("category"))


def named_blocks(blocks: DataFrame) -> DataFrame:
    """Countable blocks of a file by name: how many, and the layer of the first."""
    ok = countable(blocks)
    return ok.groupBy("file_id", "name").agg(F.count("*").alias("n"), F.min_by("layer", "seq").alias("layer"))


def uncategorized(blocks: DataFrame) -> DataFrame:
    """Countable blocks that are in no category, by their name or first layer: to verify."""
    rows = named_blocks(blocks).where(F.size(categories_of(F.col("layer"), F.col("name"))) == 0)
    return rows.select("file_id", "name", "layer", "n", F.lit("verificar").alias("confidence"))


def _by_category(rows: DataFrame, value: str, names: tuple, unit: str) -> DataFrame:
    """Sums of a value by the categories of the layer, with the names that rows of the budget have."""
    prefix, special = names
    word = F
    for k, v in special.items():
        word = word.when(F.col("category") == k, v)
    sums = rows.select("file_id", value, F.explode(classify.categories(F.col("layer"))).alias("category")).groupBy("file_id", "category").agg(rounded(F.sum(value), 2).alias("quantity"))
    return sums.select("file_id", "category", word.otherwise(F.concat(F.lit(prefix), "category")).alias("description"), "quantity", F.lit(unit).alias("unit"))


def takeoff_items(blocks: DataFrame, lines: DataFrame, files: DataFrame, areas: DataFrame | None = None, dims: DataFrame | None = None) -> DataFrame:
    """Budget rows of a file: blocks (un) by the categories of their name and first layer, lengths (m) and areas (m²) by
    category of the layer, dimensions with quantity 0, blocks of no category to verify.

    areas: file_id, layer, area in square metres; dims: file_id, label.
    """
    counted = named_blocks(blocks).select("file_id", F.explode_outer(categories_of(F.col("layer"), F.col("name"))).alias("category"), F.col("name").alias("description"), F.col("n").cast("double").alias("quantity"), F.lit("un").alias("unit"))
    out = counted.unionByName(_by_category(line_lengths(lines, files), "length", LENGTH_NAMES, "m"))
    if areas is not None:
        out = out.unionByName(_by_category(areas.where("area > 0"), "area", AREA_NAMES, "m²"))
    out = out.withColumn("confidence", F.when(F.col("category").isNull(), "verificar").otherwise("confirmado"))
    if dims is not None:
        out = out.unionByName(dims.select("file_id", F.lit(None).cast("string").alias("category"), F.concat(F.lit("Cota: "), "label").alias("description"), F.lit(0.0).alias("quantity"), F.lit("m").alias("unit"), F.lit("verificar").alias("confidence")))
    return out.withColumn("discipline", F.when(F.col("category").isNotNull(), classify.category_discipline(F.col("category"))).otherwise(""))


def prefer_new_phase(layers: DataFrame) -> DataFrame:
    """Layers without the existing phase (LEV-) of a suffix whose new phase (FOR-, NOV-, ARQ-) is there in the same file."""
    suffix = F.regexp_extract("layer", "^[A-Za-z]+-(.*)$", 1)
    rows = layers.withColumn("suffix", suffix)
    new = rows.where(F.col("layer").rlike("^(FOR|NOV|ARQ)-")).select("file_id", "suffix").distinct()
    old = rows.where(F.col("layer").startswith("LEV-"))
    return old.join(new, ["file_id", "suffix"], "left_anti").unionByName(rows.where(~F.col("layer").startswith("LEV-"))).drop("suffix")


def digest(layers: DataFrame, counts: DataFrame, lengths: DataFrame, areas: DataFrame, texts: DataFrame, dims: DataFrame) -> DataFrame:
    """One text per file, in seven sections: layers, openings with their sizes, other blocks, lengths, areas, texts (every distinct one of a layer) and dimensions.

    layers: file_id, layer as drawn; counts: ``block_counts``; lengths and areas: file_id, layer and length or area;
    texts: file_id, layer, text; dims: file_id, seq, label, metres. A section without rows is left out.
    """
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    two = lambda c: F.format_string("%.2f", rounded(c, 2))

    def section(rows: DataFrame, place, title, order, text) -> DataFrame:
        """text: a column, or a function of what ``order`` names, so that nothing is held twice."""
        held = F.struct(*order) if callable(text) else F.struct(*order, text.alias("line"))
        lists = rows.groupBy("file_id", F.lit(place).alias("place") if isinstance(place, int) else place.alias("place")).agg(F.array_sort(F.collect_list(held)).alias("found"))
        of = text if callable(text) else lambda x: x["line"]
        return lists.select("file_id", "place", line(title, "\n", F.array_join(F.transform("found", lambda x: line("  ", of(x))), "\n")).alias("section"))

    sized = F.col("width_m") > 0
    by_count = [(-F.col("n")).alias("o"), F.col("name")]
    area = rounded(F.col("width_m") * F.col("height_m"), 2)
    opening = line(F.col("name"), ": ", F.col("n").cast("string"), " un | ", two(F.col("width_m")), " m × ", two(F.col("height_m")), " m = ", two(area), " m²")
    per_layer = lambda rows, value: rows.groupBy("file_id", "layer").agg(F.sum(value).alias("v"))
    said = texts.withColumn("text", F.trim("text")).where(F.length("text") > 2).select("file_id", "layer", "text").distinct()
    parts = [
        section(distinct_layers(layers), 1, "Layers", [], F.col("layer")),
        section(counts.where("width_m is not null"), F.when(sized, 2).otherwise(3), F.when(F.col("place") == 2, "Esquadrias").otherwise("Blocos"), by_count, F.when(sized, opening).otherwise(line(F.col("name"), ": ", F.col("n").cast("string"), " un"))),
        section(per_layer(lengths, "length"), 4, "Comprimentos por layer", [F.col("layer")], line(F.col("layer"), ": ", two(F.col("v")), " m")),
        section(per_layer(areas, "area"), 5, "Áreas por layer", [F.col("layer")], line(F.col("layer"), ": ", two(F.col("v")), " m²")),
        section(said, 6, "Textos", [F.col("layer"), F.col("text")], lambda x: line("[", x["layer"], "] ", x["text"])),
        section(dims, 7, "Cotas", [F.col("seq")], line(F.col("label"), F.when(F.col("metres").isNotNull(), line(": ", F.format_string("%.3f", "metres"), " m")).otherwise(""))),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "section"))), lambda x: x["section"]), "\n").alias("digest"))

"""JSON inside response texts (Column to Column)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import NESTED_OBJECT
from .numbers import clean_count, clean_quantity

ITEM = "struct<description:string,unit:string,quantity:double,discipline:string,confidence:string>"
ITEMS = f"struct<items:array<{ITEM}>>"
#: An answer with everything as text where models write numbers with units, and what doesn't parse.
ANSWER = (
    "project_data struct<name:string,address:string,architect:string,total_area:string,layout_area:string,no_intervention_area:string,workstations:string,"
    "departments:array<struct<name:string,positions:string>>,demolition_notes:array<string>,new_rooms:array<string>,kept_elements:array<string>>, "
    "items array<struct<description:string,unit:string,quantity:string,discipline:string,confidence:string,observations:string>>, broken string"
)
CLASSIFICATION = "struct<familia_code:string,confidence:double,attributes:map<string,string>,reasoning:string>"
FENCE = "```"


def json_block(text: Column) -> Column:
    """The JSON of an answer: the last fence marked as JSON, else the last fence; unless that is an object, the last object that
    names items or project_data (one object inside another is seen); else the fence as it is, else the text."""
    t = F.coalesce(text, F.lit(""))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    marked = bare(F.substring_index(F.substring_index(t, FENCE + "json", -1), FENCE, 1))
    parts = F.split(t, FENCE)
    fenced = F.nullif(F.when(t.contains(FENCE + "json"), marked).when(F.size(parts) >= 3, bare(F.get(parts, F.size(parts) - 2))), F.lit(""))
    objects = F.filter(F.regexp_extract_all(t, F.lit(f"({NESTED_OBJECT})"), F.lit(1)), lambda x: x.contains('"items"') | x.contains('"project_data"'))
    last = F.get(F.reverse(objects), F.lit(0))
    return F.when(F.coalesce(fenced.startswith("{"), F.lit(False)), fenced).otherwise(F.coalesce(last, fenced, bare(t)))


def first_block(text: Column) -> Column:
    """The first fence marked as JSON, else the first fence, else the text; white space around it goes."""
    t = F.coalesce(text, F.lit(""))
    inside = lambda mark: F.regexp_replace(F.get(F.split(F.get(F.split(t, mark), F.lit(1)), FENCE), F.lit(0)), r"^\s+|\s+$", "")
    return F.when(t.contains(FENCE + "json"), inside(FENCE + "json")).when(t.contains(FENCE), inside(FENCE)).otherwise(F.regexp_replace(t, r"^\s+|\s+$", ""))


def json_object(text: Column) -> Column:
    """The widest object of a text; null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*\})", 1), F.lit(""))


def answer(block: Column) -> Column:
    """struct<project, items, error> of an answer's JSON; a bare array counts as its items.

    Quantities and areas may carry units; rooms may be texts or objects (as JSON). ``error`` holds what isn't JSON
    (its first 500 characters), with null project and no items; an answer without items has none.
    """
    whole = F.when(block.startswith("["), F.concat(F.lit('{"items":'), block, F.lit("}"))).otherwise(block)
    p = F.from_json(whole, ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    d = p["project_data"]
    plain = ("name", "address", "architect", "demolition_notes", "new_rooms", "kept_elements")
    project = F.struct(*[d[c].alias(c) for c in plain], *[clean_quantity(d[c]).alias(c) for c in ("total_area", "layout_area", "no_intervention_area")], clean_count(d["workstations"]).alias("workstations"), F.transform(d["departments"], lambda x: F.struct(x["name"].alias("name"), clean_count(x["positions"]).alias("positions"))).alias("departments"))
    rows = F.transform(p["items"], lambda x: F.struct(*[x[c].alias(c) for c in ("description", "unit")], clean_quantity(x["quantity"]).alias("quantity"), *[x[c].alias(c) for c in ("discipline", "confidence", "observations")]))
    bad = p["broken"].isNotNull() | p.isNull()
    empty = F.array().cast("array<struct<description:string,unit:string,quantity:double,discipline:string,confidence:string,observations:string>>")
    return F.struct(F.when(~bad & d.isNotNull(), project).alias("project"), F.when(bad, empty).otherwise(F.coalesce(rows, empty)).alias("items"), F.when(bad, F.substring(F.coalesce(p["broken"], block), 1, 500)).alias("error"))


def json_array(text: Column) -> Column:
    """The widest array of a text; null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\[.*\])", 1), F.lit(""))


def items(block: Column) -> Column:
    """The items of an object with ``items``, or of an array; null for broken JSON."""
    return F.when(block.startswith("["), F.from_json(block, f"array<{ITEM}>")).otherwise(F.from_json(block, ITEMS)["items"])


def classification(block: Column) -> Column:
    c = F.from_json(block, CLASSIFICATION)
    return F.struct(c["familia_code"].alias("familia_code"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c["confidence"], F.lit(0.0)))).alias("confidence"), c["attributes"].alias("attributes"), F.substring(c["reasoning"], 1, 200).alias("reasoning"))


def classifications(array: Column) -> Column:
    """Code, family and confidence (0 to 1) of each entry of an array of classified codes; null for broken JSON."""
    entries = F.from_json(array, "array<struct<codigo:string,familia_code:string,confidence:double>>")
    return F.transform(entries, lambda x: F.struct(F.trim(F.coalesce(x["codigo"], F.lit(""))).alias("codigo"), x["familia_code"].alias("familia_code"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x["confidence"], F.lit(0.0)))).alias("confidence")))

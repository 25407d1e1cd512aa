"""Name classes: sheets, layers, blocks (Column to Column)."""

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..rules import ANNOTATION_NAMES, ANNOTATION_PATTERN, CATEGORIES, CATEGORY_DISCIPLINE, NAME_SEPARATORS, OPENING_PATTERN, SHEET_PATTERNS, SHEET_PRIORITY, UTILITY_LAYERS, XREF_PATTERN
from .text import per_value


def sheet_type(name: Column) -> Column:
    """Sheet type by file name, first pattern in table order."""
    out = F
    for kind, pattern in SHEET_PATTERNS:
        out = out.when(name.rlike(f"(?i){pattern}"), kind)
    return out.otherwise("desconhecido")


def sheet_priority(kind: Column) -> Column:
    out = F
    for name, p in SHEET_PRIORITY.items():
        out = out.when(kind == name, p)
    return out.otherwise(99)


#: Where a token of an upper-cased name starts with one of a category's keywords.
TOKEN_STARTS = {c: re.compile(f"(?:^|{NAME_SEPARATORS.removesuffix('+')})(?:{'|'.join(keys.split())})", re.ASCII) for c, keys in CATEGORIES.items()}


_categories = per_value(lambda name: [c for c, p in TOKEN_STARTS.items() if p.search(name.upper())], ArrayType(StringType()), pa.list_(pa.string()))


def categories(name: Column) -> Column:
    """All categories of which a token of the name starts with a keyword, in table order."""
    return _categories(F.coalesce(name, F.lit("")))


def category_discipline(category: Column) -> Column:
    out = F
    for c, d in CATEGORY_DISCIPLINE.items():
        out = out.when(category == c, d)
    return out.otherwise(F.initcap(category))


def is_opening(name: Column) -> Column:
    return F.upper(F.coalesce(name, F.lit(""))).rlike(OPENING_PATTERN)


def is_countable(name: Column, layer: Column) -> Column:
    """Whether a block is an item: not anonymous, bound, on a utility layer, an annotation or a reference."""
    n = F.coalesce(name, F.lit(""))
    return ~(n.startswith("*") | n.contains("$") | F.upper(F.coalesce(layer, F.lit(""))).isin(*UTILITY_LAYERS) | n.rlike(f"(?i){ANNOTATION_PATTERN}") | n.rlike(f"(?i){XREF_PATTERN}") | F.upper(n).isin(*ANNOTATION_NAMES))

"""Text and key expressions (Column to Column)."""

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType

from ..rules import GENERIC_WORDS, KEY_SEPARATORS, MTEXT_CODES, SEARCH_STOP_WORDS


@cache
def letters_with_marks() -> tuple[str, str]:
    """All letters that decompose into one letter and marks, and these letters."""
    found = {}
    for code in range(128, sys.maxunicode + 1):
        if unicodedata.decomposition(c := chr(code)):
            plain = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
            if len(plain) == 1 and plain[0] != c:
                found[c] = plain[0]
    return "".join(found), "".join(found.values())


def fold_accents(c: Column, ascii_only: bool = False) -> Column:
    """Lower case without marks, whether a letter and its marks are one character or several; ``ascii_only`` deletes what is still not ASCII."""
    out = F.regexp_replace(F.translate(F.lower(c), *letters_with_marks()), "\\p{Mn}", "")
    return F.regexp_replace(out, "[^\\x00-\\x7F]", "") if ascii_only else out


def per_value(f: Callable, kind: DataType, arrow: pa.DataType):
    """A function of a text as a column function that calls it once for each distinct text of a batch. Null stays null."""

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        coded = values.dictionary_encode()
        return pa.array([f(v) for v in coded.dictionary.to_pylist()], arrow).take(coded.indices)

    return run


@cache
def _ascii() -> Callable[[str], str]:
    """``fold_accents`` with ``ascii_only`` of one text."""
    letters = str.maketrans(*letters_with_marks())
    return lambda t: t.lower().translate(letters).encode("ascii", "ignore").decode()


@cache
def _item_type_key():
    fold = _ascii()
    return per_value(lambda t: re.sub("[^a-z0-9]+", "_", fold(t.strip(" "))).strip("_")[:50], StringType(), pa.string())


def item_type_key(c: Column) -> Column:
    """Folded description with runs of other characters as ``_``, first 50 characters; null becomes ''."""
    return _item_type_key()(F.coalesce(c, F.lit("")))


def _tokens(s: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")), " ")


def description_tokens(c: Column) -> Column:
    """First six meaningful tokens of a description before any variant suffix, in text order."""
    s = fold_accents(F.coalesce(c, F.lit("")))
    for sep in KEY_SEPARATORS:
        s = F.substring_index(s, sep, 1)
    return F.slice(F.filter(_tokens(s), lambda t: ~t.isin(GENERIC_WORDS) & (F.length(t) > 1)), 1, 6)


def description_key(c: Column) -> Column:
    return F.array_join(F.array_sort(description_tokens(c)), " ")


def primary_noun(c: Column) -> Column:
    """First token of more than three letters that isn't generic, else ''."""
    words = F.filter(_tokens(fold_accents(F.coalesce(c, F.lit("")))), lambda t: ~t.isin(GENERIC_WORDS) & (F.length(t) > 3))
    return F.coalesce(F.get(words, F.lit(0)), F.lit(""))


@cache
def _search_keywords():
    fold = _ascii()

    def words(t: str) -> list[str]:
        found = [w for w in re.sub("[^a-z0-9 ]", " ", fold(t)).split(" ") if len(w) >= 4 and w not in SEARCH_STOP_WORDS]
        return found[:5] if len(t.strip(" ")) >= 4 else []

    return per_value(words, ArrayType(StringType()), pa.list_(pa.string()))


def search_keywords(c: Column) -> Column:
    """Up to five search words of four or more letters; none for descriptions below four characters."""
    return _search_keywords()(F.coalesce(c, F.lit("")))


def strip_mtext(c: Column) -> Column:
    """Drawing text without its format codes, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), MTEXT_CODES, " "), "[ \\t]+", " "))


def layer_base_name(c: Column) -> Column:
    """Layer name after the first ``|``; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, "^[^|]*[|]", "")), F.lit(""))


def preview(c: Column, most: int, ellipsis: bool = False) -> Column:
    """First ``most`` characters; with ``ellipsis`` longer texts end in three dots."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c) if ellipsis else F.substring(c, 1, most)


def month_from_filename(c: Column) -> Column:
    """First day of the month written as yyyy-mm or yyyy_mm in a name, else null."""
    y, m = (F.regexp_extract(c, r"(\d{4})[_-](\d{2})", i) for i in (1, 2))
    return F.try_to_date(F.concat_ws("-", F.nullif(y, F.lit("")), F.nullif(m, F.lit("")), F.lit("01")), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.expr("null").cast("date")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def token_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))

"""Numbers, units and plausibility (Column to Column)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import COUNT_WORDS, FIXED_UNITS, LINEAR_WORDS, MISMATCH_REASONS, PRICE_LEAST, PRICE_SHEET, SURFACE_WORDS, UNIT_MISMATCHES, UNIT_PRIORITY, UNIT_RANGES


def rounded(c: Column, n: int) -> Column:
    """Half up at n places of the value at n + 6 places, so that neither the order of a sum nor a binary tail decides."""
    return F.round(F.round(c, n + 6), n)


def rounded_product(c: Column, n: int) -> Column:
    """Half up at n places of c * 10 ** n as a double, as SQL's round has it elsewhere; Spark's own takes the digits that c is written with. c: 0 or more."""
    y = c * float(10**n)
    return F.when(y < 2.0**52, (F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)) / float(10**n)).otherwise(c)


def has_word(c: Column, words: str) -> Column:
    """Whether one of the words stands free; letters and digits of any script count as word characters."""
    return c.rlike(f"(?iu)(^|[^\\p{{L}}\\p{{N}}_])({words})($|[^\\p{{L}}\\p{{N}}_])")


def _double(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def parse_decimal(c: Column) -> Column:
    """Comma as point, other characters dropped; 0 where that is no number."""
    return _double(F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), "[^0-9.-]", ""))


def _without(c: Column, *parts: str) -> Column:
    for p in parts:
        c = F.replace(c, F.lit(p), F.lit(""))
    return F.trim(c)


def clean_quantity(c: Column) -> Column:
    return _double(_without(c, "m²", "m2", "cm", ","))


def clean_count(c: Column) -> Column:
    return _double(_without(c, "un", ",")).cast("int")


def normalize_unit(description: Column, unit: Column) -> Column:
    """The unit that the description's words ask for (count, linear, surface in this order), else the given one."""
    d = F.coalesce(description, F.lit(""))
    return F.when(unit.isin(*FIXED_UNITS), unit).when(has_word(d, COUNT_WORDS), "un").when(has_word(d, LINEAR_WORDS), "ml").when(has_word(d, SURFACE_WORDS), "m²").otherwise(unit)


def count_quantity(unit: Column, q: Column) -> Column:
    """A count must be whole: nearly whole ones are rounded, others become 0. Other units stay."""
    near = F.abs(q - F.rint(q))
    return F.when((F.coalesce(unit, F.lit("")) != "un") | (near == 0), q).when(near < 0.01, F.rint(q)).otherwise(0.0)


def implausible(unit: Column, q: Column, discipline: Column, area: Column) -> Column:
    """Code of the first failing rule: high, negative, mismatch, area; null where all hold."""
    u = F.when(F.coalesce(unit, F.lit("")) == "", "vb").otherwise(unit)
    amount = F.coalesce(q, F.lit(0.0))
    high = F.lit(False)
    low = F.lit(False)
    for name, (least, most) in UNIT_RANGES.items():
        high |= (u == name) & (amount > most)
        low |= (u == name) & (amount < least)
    odd = F.lit(False)
    for d, name in UNIT_MISMATCHES:
        odd |= (F.coalesce(discipline, F.lit("")) == d) & (u == name)
    large = (u == "m²") & (F.coalesce(area, F.lit(0.0)) > 0) & (amount > area * 1.5)
    return F.when(high, "high").when(low, "negative").when(odd, "mismatch").when(large, "area")


def best_unit(units: Column, description: Column) -> Column:
    """One unit of a list for a merged item (see normalize_unit and UNIT_PRIORITY)."""
    first = F.coalesce(F.get(units, F.lit(0)), F.lit("vb"))
    asked = normalize_unit(description, first)
    out = F.when(asked != first, asked)
    for u in UNIT_PRIORITY:
        out = out.when(F.array_contains(units, u), u)
    return out.otherwise(first)


def clamp_confidence(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))


def density_ratio(q: Column, area: Column) -> Column:
    """Quantity by area rounded to 6 places, null outside (0, 100]."""
    d = F.when(area > 0, q / area)
    return rounded_product(F.when((d > 0) & (d <= 100), d), 6)


def sheet_price_cents(sheets: Column) -> Column:
    return F.greatest(F.lit(PRICE_LEAST), F.lit(PRICE_SHEET) * F.greatest(sheets, F.lit(1)))


def line_total(q: Column, material: Column, labour: Column) -> Column:
    return F.nullif(q, F.lit(0.0)) * (F.coalesce(material, F.lit(0.0)) + F.coalesce(labour, F.lit(0.0)))


def implausible_text(unit: Column, q: Column, discipline: Column, area: Column) -> Column:
    """What is said of the first failing rule; null where all hold."""
    u = F.when(F.coalesce(unit, F.lit("")) == "", "vb").otherwise(unit)
    code, amount = implausible(unit, q, discipline, area), F.coalesce(q, F.lit(0.0))
    most = F
    for name, (_, top) in UNIT_RANGES.items():
        most = most.when(u == name, str(top))
    odd = F
    for (name, wrong), reason in MISMATCH_REASONS.items():
        odd = odd.when((discipline == name) & (u == wrong), reason)
    whole = lambda c: F.bround(c, 0).cast("decimal(38,0)").cast("string")
    large = F.concat(F.lit("área "), F.format_string("%.1f", amount), F.lit(" m² é maior que 1.5× área da laje ("), whole(area), F.lit(" m²) — possível dupla contagem"))
    return (
        F.when(code == "high", F.concat(whole(amount), F.lit(" "), u, F.lit(" é alto demais pro tipo (max típico "), most, F.lit(")")))
        .when(code == "negative", F.concat(amount.cast("string"), F.lit(" "), u, F.lit(" é negativo"))).when(code == "mismatch", odd.otherwise("")).when(code == "area", large)
    )


def sheets_of_file(name: Column, pages: Column, layouts: Column) -> Column:
    """Sheets by file type: PDF pages, DXF paper layouts other than the model, else one."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(ext == "pdf", F.greatest(F.lit(1), pages)).when(ext == "dxf", F.greatest(F.lit(1), F.size(F.filter(layouts, lambda x: F.lower(x) != "model")))).otherwise(1)

"""One query for each operator, over its whole tables, and the SQL that should give the same rows."""

from __future__ import annotations

import tempfile
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import classify, geometry, numbers, payload, text
from ..operators import catalog as cat
from ..operators import consolidate as con
from ..operators import density as den
from ..operators import report as rep
from ..operators import takeoff as take
from ..sources import io, store
from ..sources.fixtures import DESCRIPTIONS, ITEMS_A_TASK, fixture, with_sql
from ..streaming import messages as msg
from ..streaming import sink

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, needs: str = "", sql: str = "", recursive: bool = False):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (with_sql(*needs.split(), materialized=True) + ("," if needs and sql.lstrip().startswith("+") else "") + sql.lstrip().removeprefix("+")) if needs else sql
        if recursive:
            ORACLE_SQL[name] = ORACLE_SQL[name].replace("WITH ", "WITH RECURSIVE ", 1)
        return f

    return keep


# SQL pieces. DuckDB's strip_accents keeps signs such as m² that are no letters with marks.
FOLD = "strip_accents(lower({0}))"
KEY = "regexp_replace(regexp_replace(strip_accents(lower(trim(coalesce({0}, '')))), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '_', 'g')"
ITEM_KEY = f"substring(trim({KEY}, '_'), 1, 50)"
GENERIC = "(" + ", ".join(f"'{w}'" for w in rules.GENERIC_WORDS) + ")"


def key_tokens(c: str) -> str:
    s = f"strip_accents(lower(coalesce({c}, '')))"
    for sep in rules.KEY_SEPARATORS:
        s = f"split_part({s}, '{sep}', 1)"
    return f"list_filter(string_split(trim(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t NOT IN {GENERIC} AND length(t) > 1)[1:6]"


def key_sql(c: str) -> str:
    return f"coalesce(array_to_string(list_sort({key_tokens(c)}), ' '), '')"


def noun_sql(c: str) -> str:
    return f"coalesce(list_filter(string_split(trim(regexp_replace(strip_accents(lower(coalesce({c}, ''))), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t NOT IN {GENERIC} AND length(t) > 3)[1], '')"


def word_sql(c: str, words: str) -> str:
    return f"regexp_matches({c}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({words})($|[^\\p{{L}}\\p{{N}}_])')"


def unit_sql(d: str, u: str) -> str:
    fixed = ", ".join(f"'{x}'" for x in rules.FIXED_UNITS)
    return f"CASE WHEN {u} IN ({fixed}) THEN {u} WHEN {word_sql(d, rules.COUNT_WORDS)} THEN 'un' WHEN {word_sql(d, rules.LINEAR_WORDS)} THEN 'ml' WHEN {word_sql(d, rules.SURFACE_WORDS)} THEN 'm²' ELSE {u} END"


def implausible_sql(area: str) -> str:
    u = "CASE WHEN coalesce(unit, '') = '' THEN 'vb' ELSE unit END"
    high = " OR ".join(f"({u} = '{n}' AND quantity > {b})" for n, (_, b) in rules.UNIT_RANGES.items())
    odd = " OR ".join(f"(discipline = '{d}' AND {u} = '{n}')" for d, n in rules.UNIT_MISMATCHES)
    return f"CASE WHEN {high} THEN 'high' WHEN quantity < 0 THEN 'negative' WHEN {odd} THEN 'mismatch' WHEN {u} = 'm²' AND {area} > 0 AND quantity > {area} * 1.5 THEN 'area' END"


def implausible_text_sql(area: str) -> str:
    u = "CASE WHEN coalesce(unit, '') = '' THEN 'vb' ELSE unit END"
    most = f"CASE {u} " + " ".join(f"WHEN '{n}' THEN '{b}'" for n, (_, b) in rules.UNIT_RANGES.items()) + " END"
    odd = "CASE " + " ".join(f"WHEN discipline = '{d}' AND {u} = '{n}' THEN '{t.replace(chr(39), chr(39) * 2)}'" for (d, n), t in rules.MISMATCH_REASONS.items()) + " END"
    return f"""CASE {implausible_sql(area)} WHEN 'high' THEN concat(printf('%.0f', quantity), ' ', {u}, ' é alto demais pro tipo (max típico ', {most}, ')') WHEN 'negative' THEN concat(CAST(quantity AS VARCHAR), ' ', {u}, ' é negativo') WHEN 'mismatch' THEN {odd}
        WHEN 'area' THEN concat('área ', printf('%.1f', quantity), ' m² é maior que 1.5× área da laje (', printf('%.0f', {area}), ' m²) — possível dupla contagem') END"""


CATALOG_SQL = """+ catalog AS (SELECT f.id AS familia_id, f.code AS familia_code, f.name AS familia_name, typical_unit, string_split(words, ' ') AS keywords, grupo_id, g.code AS grupo_code, g.name AS grupo_name, capitulo_id, c.code AS capitulo_code, c.name AS capitulo_name
    FROM catalog_familia f LEFT JOIN catalog_grupo g ON f.grupo_id = g.id LEFT JOIN catalog_capitulo c ON g.capitulo_id = c.id)"""
CATALOG = "catalog_familia catalog_grupo catalog_capitulo"


def full_catalog(s: SparkSession, d: str) -> DataFrame:
    fam = fixture(s, d, "catalog_familia").withColumn("keywords", F.split("words", " "))
    return cat.denormalize_catalog(fam, fixture(s, d, "catalog_grupo"), fixture(s, d, "catalog_capitulo"))


def items(s: SparkSession, d: str) -> DataFrame:
    return fixture(s, d, "budget_items")


def scalar(name: str, needs: str, make: Callable[[], dict], sql: dict, keys: str = "job_id, seq") -> None:
    """A query of expressions over one adapter."""
    src = needs.split()[-1]

    def run(s: SparkSession, d: str) -> DataFrame:
        return fixture(s, d, src).select(*[k.strip() for k in keys.split(",")], *[v.alias(k) for k, v in make().items()])

    query(name, needs, f" SELECT {keys}, " + ", ".join(f"{v} AS {k}" for k, v in sql.items()) + f" FROM {src}" if sql else "")(run)


# Scalars

#: The descriptions with letters and marks apart, as file names of some systems have them, and letters of other languages.
DECOMPOSED = "concat(description, ' \u0161a\u015f \u0151 \u01d7 a\u0308\u0301')"
for _letter in "áãâéêíóôõúç":
    DECOMPOSED = f"replace({DECOMPOSED}, '{_letter}', '{unicodedata.normalize('NFD', _letter)}')"
scalar("p01_fold_accents", "budget_items", lambda: {"marks": text.fold_accents(F.col("description")), "plain": text.fold_accents(F.concat("description", F.lit(" m²x a—b")), True), "apart": text.fold_accents(F.expr(DECOMPOSED))}, {"marks": "strip_accents(lower(description))", "apart": f"strip_accents(lower({DECOMPOSED}))", "plain": "regexp_replace(strip_accents(lower(concat(description, ' m²x a—b'))), '[^\\x00-\\x7F]', '', 'g')"})
scalar("p02_item_type_key", "budget_items", lambda: {"item_type": text.item_type_key(F.col("description")), "apart": text.item_type_key(F.expr(DECOMPOSED))}, {"item_type": ITEM_KEY.format("description"), "apart": ITEM_KEY.format(DECOMPOSED)})


@query("p03_description_key", "budget_items", f"""+ t AS MATERIALIZED (SELECT DISTINCT description, {DECOMPOSED} AS other FROM budget_items), k AS MATERIALIZED (SELECT description, {key_sql('description')} AS key, {key_sql('other')} AS apart FROM t) SELECT job_id, seq, key, apart FROM budget_items JOIN k USING (description)""")
def p03(s, d):
    return items(s, d).select("job_id", "seq", text.description_key(F.col("description")).alias("key"), text.description_key(F.expr(DECOMPOSED)).alias("apart"))


scalar("p04_primary_noun", "budget_items", lambda: {"noun": text.primary_noun(F.col("description")), "apart": text.primary_noun(F.expr(DECOMPOSED))}, {"noun": noun_sql("description"), "apart": noun_sql(DECOMPOSED)})
STOP = "(" + ", ".join(f"'{w}'" for w in rules.SEARCH_STOP_WORDS) + ")"
KEYWORDS = "list_filter(string_split_regex(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda t: length(t) >= 4 AND t NOT IN " + STOP + ")[1:5]"
scalar("p05_search_keywords", "budget_items", lambda: {"words": F.array_join(text.search_keywords(F.col("description")), " "), "apart": F.array_join(text.search_keywords(F.expr(DECOMPOSED)), " ")}, {"words": f"coalesce(array_to_string({KEYWORDS.format('description')}, ' '), '')", "apart": f"coalesce(array_to_string({KEYWORDS.format(DECOMPOSED)}, ' '), '')"})
scalar("p06_strip_mtext", "cad_texts", lambda: {"plain": text.strip_mtext(F.concat(F.lit("{\\fArial|b0;\\C256; "), "text", F.lit("\\P\\H1.5x;x}")))}, {"plain": f"trim(regexp_replace(regexp_replace(concat('{{\\fArial|b0;\\C256; ', text, '\\P\\H1.5x;x}}'), '{rules.MTEXT_CODES}', ' ', 'g'), '[ \\t]+', ' ', 'g'))"}, "file_id, seq")
scalar("p07_layer_base_name", "cad_blocks", lambda: {"base": text.layer_base_name(F.col("layer"))}, {"base": "nullif(trim(regexp_replace(layer, '^[^|]*[|]', '')), '')"}, "file_id, seq")
scalar("p08_preview_text", "sender_log", lambda: {"short": text.preview(F.col("text"), 80), "reply": text.preview(F.col("text"), 1000, True)}, {"short": "substring(text, 1, 80)", "reply": "CASE WHEN length(text) > 1000 THEN concat(substring(text, 1, 997), '...') ELSE text END"}, "sender_id, seq")
scalar("p09_month_from_filename", "sheets", lambda: {"month": text.month_from_filename(F.concat(F.lit("ref_20"), F.lpad((10 + F.col("seq") % 15).cast("string"), 2, "0"), F.lit("-"), F.lpad((1 + F.col("seq") % 12).cast("string"), 2, "0"), F.lit(".xlsx")))}, {"month": "make_date(2010 + seq % 15, 1 + seq % 12, 1)"}, "job_id, seq")
scalar("p12_parse_decimal", "budget_items", lambda: {"v": numbers.parse_decimal(F.concat(F.lit("R$ "), F.format_string("%.2f", "quantity"))), "w": numbers.parse_decimal(F.lit("1.234,56"))}, {"v": "round(quantity, 2)", "w": "CAST(0 AS DOUBLE)"})
scalar("p13_clean_quantity", "budget_items", lambda: {"v": numbers.clean_quantity(F.concat(F.format_string("%.2f", "quantity"), F.lit(" m²"))), "w": numbers.clean_quantity(F.lit("1,5"))}, {"v": "round(quantity, 2)", "w": "CAST(15 AS DOUBLE)"})
scalar("p14_clean_count", "budget_items", lambda: {"v": numbers.clean_count(F.concat(F.format_string("%.2f", "quantity"), F.lit(" un")))}, {"v": "CAST(trunc(round(quantity, 2)) AS INTEGER)"})
scalar("p15_normalize_unit", "budget_items", lambda: {"new_unit": numbers.normalize_unit(F.col("description"), F.col("unit")), "corrected": ~numbers.normalize_unit(F.col("description"), F.nullif("unit", F.lit("vb"))).eqNullSafe(F.nullif("unit", F.lit("vb")))}, {"new_unit": unit_sql("description", "unit"), "corrected": f"({unit_sql('description', "nullif(unit, 'vb')")}) IS DISTINCT FROM nullif(unit, 'vb')"})
scalar("p16_validate_count_qty", "budget_items", lambda: {"q": numbers.count_quantity(F.nullif("unit", F.lit("vb")), F.col("quantity"))}, {"q": "CASE WHEN coalesce(nullif(unit, 'vb'), '') <> 'un' OR quantity = round(quantity) THEN quantity WHEN abs(quantity - round(quantity)) < 0.01 THEN round(quantity) ELSE 0.0 END"})
scalar("p17_check_plausibility", "item_areas", lambda: {"reason": numbers.implausible(F.col("unit"), F.col("quantity"), F.col("discipline"), F.col("total_area")), "reason_text": numbers.implausible_text(F.col("unit"), F.col("quantity"), F.col("discipline"), F.col("total_area"))}, {"reason": implausible_sql("total_area"), "reason_text": implausible_text_sql("total_area")})
scalar("p18_pick_best_unit", "budget_items", lambda: {"best": numbers.best_unit(F.array(F.col("unit"), F.lit("m²"), F.lit("ml")), F.col("description"))}, {"best": f"CASE WHEN ({unit_sql('description', 'unit')}) <> unit THEN {unit_sql('description', 'unit')} WHEN unit = 'un' THEN 'un' ELSE 'ml' END"})
scalar("p20_clamp_confidence", "budget_items", lambda: {"c": numbers.clamp_confidence(F.when(F.col("seq") % 7 != 0, (F.col("quantity") - 10) / 20))}, {"c": "greatest(0.0, least(1.0, coalesce(CASE WHEN seq % 7 <> 0 THEN (quantity - 10) / 20 END, 0.0)))"})
scalar("p21_density_ratio", "item_areas", lambda: {"density": numbers.density_ratio(F.col("quantity"), F.col("ref_area"))}, {"density": "CASE WHEN ref_area > 0 AND quantity / ref_area > 0 AND quantity / ref_area <= 100 THEN round(quantity / ref_area, 6) END"})
scalar("p22_sheet_price", "sheets", lambda: {"cents": numbers.sheet_price_cents(F.col("seq") % 20)}, {"cents": "greatest(9700, 2000 * greatest(seq % 20, 1))"})
scalar("p23_line_total", "budget_items", lambda: {"total": F.round(numbers.line_total(F.col("quantity"), F.lit(2.5), F.when(F.col("seq") % 2 == 0, 1.5)), 4)}, {"total": "round(nullif(quantity, 0) * (2.5 + CASE WHEN seq % 2 = 0 THEN 1.5 ELSE 0 END), 4)"})
scalar("p24_file_type_count", "sheets", lambda: {"n": numbers.sheets_of_file(F.when(F.col("seq") % 3 == 0, "a.DXF").otherwise(F.col("filename")), (F.col("seq") % 5).cast("int"), F.array(F.lit("Model"), F.lit("A1"), F.lit("A2")))}, {"n": "CAST(CASE WHEN seq % 3 = 0 THEN 2 ELSE greatest(1, seq % 5) END AS INTEGER)"})
SHEET_SQL = "CASE " + " ".join(f"WHEN regexp_matches(filename, '(?i){p}') THEN '{k}'" for k, p in rules.SHEET_PATTERNS) + " ELSE 'desconhecido' END"
scalar("p25_sheet_type", "sheets", lambda: {"kind": classify.sheet_type(F.col("filename"))}, {"kind": SHEET_SQL})


def categories_sql(c: str) -> str:
    tokens = f"string_split_regex(upper({c}), '[-_\\s./\\\\|:]+')"
    return "list_filter([" + ", ".join(f"CASE WHEN len(list_filter({tokens}, lambda t: regexp_matches(t, '^({'|'.join(k.split())})'))) > 0 THEN '{n}' END" for n, k in rules.CATEGORIES.items()) + "], lambda x: x IS NOT NULL)"


scalar("p26_layer_categories", "cad_blocks", lambda: {"categories": F.array_join(classify.categories(F.col("layer")), ",")}, {"categories": f"coalesce(array_to_string({categories_sql('layer')}, ','), '')"}, "file_id, seq")
scalar("p27_opening_block", "cad_blocks", lambda: {"opening": classify.is_opening(F.col("name"))}, {"opening": f"regexp_matches(upper(name), '{rules.OPENING_PATTERN}')"}, "file_id, seq")
COUNTABLE = f"NOT (starts_with(name, '*') OR contains(name, '$') OR upper(layer) IN {rules.UTILITY_LAYERS} OR regexp_matches(name, '(?i){rules.ANNOTATION_PATTERN}') OR regexp_matches(name, '(?i){rules.XREF_PATTERN}') OR upper(name) IN {rules.ANNOTATION_NAMES})"
scalar("p28_countable_block", "cad_blocks", lambda: {"countable": classify.is_countable(F.col("name"), F.col("layer"))}, {"countable": COUNTABLE}, "file_id, seq")
DISCIPLINE_SQL = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.CATEGORY_DISCIPLINE.items()) + " END"
FACTOR = "CASE " + " ".join(f"WHEN insunits = {k} THEN {v!r}" for k, v in rules.UNIT_METRES.items()) + " WHEN measurement = 0 THEN 0.3048 ELSE 0.001 END"
scalar("p30_unit_factor", "cad_files", lambda: {"factor": geometry.unit_factor(F.col("insunits"), F.col("measurement"))}, {"factor": f"CAST({FACTOR} AS DOUBLE)"}, "file_id")
scalar("p35_opening_area", "cad_blocks", lambda: {"area": F.round(geometry.opening_area(F.col("xscale"), F.col("y") / 10), 4)}, {"area": "CASE WHEN xscale > 0.1 AND xscale < 10 AND y / 10 > 0.1 AND y / 10 < 10 THEN round(xscale * (y / 10), 4) END"}, "file_id, seq")
scalar("p36_opening_deduction", "cad_blocks", lambda: {"deducted": F.round(geometry.opening_deduction(F.col("xscale") * F.col("y") / 10, F.lit(2)), 4)}, {"deducted": "round(greatest(xscale * y / 10 - 2, 0.0) * 2, 4)"}, "file_id, seq")


@query("p10_profile_contact_check", "profiles", """ SELECT user_id, length(whatsapp) >= 10 AS phone_ok, regexp_replace(substring(whatsapp, 1, 11), '^(.{2})(.{5})(.*)$', '(\\1) \\2-\\3') AS phone_masked, length(tax_id) IN (11, 14) AS tax_ok,
    CASE length(tax_id) WHEN 11 THEN regexp_replace(tax_id, '^(.{3})(.{3})(.{3})(.{2})$', '\\1.\\2.\\3-\\4') WHEN 14 THEN regexp_replace(tax_id, '^(.{2})(.{3})(.{3})(.{4})(.{2})$', '\\1.\\2.\\3/\\4-\\5') END AS tax_masked FROM profiles""")
def p10(s, d):
    return rep.invite_check(fixture(s, d, "profiles"), fixture(s, d, "invite_codes")).drop("invite_ok")


@query("p11_invite_code_valid", "profiles invite_codes", " SELECT user_id, coalesce(active AND used_projects < max_projects AND (expires_at IS NULL OR expires_at >= TIMESTAMP '2025-01-01'), FALSE) AS invite_ok FROM profiles LEFT JOIN invite_codes ON code = upper(trim(beta_code))")
def p11(s, d):
    return rep.invite_check(fixture(s, d, "profiles"), fixture(s, d, "invite_codes"), F.lit("2025-01-01").cast("timestamp")).select("user_id", "invite_ok")


def cleaned_sql(discipline: str) -> str:
    u = unit_sql("description", "unit")
    return f""" SELECT job_id, seq, {u} AS unit, CASE WHEN ({u}) <> unit OR confidence = 'talvez' THEN 'estimado' ELSE confidence END AS confidence,
        quantity, {discipline} AS discipline, CASE WHEN ({u}) <> unit THEN concat('Unidade corrigida: ', unit, ' → ', {u}) ELSE observations END AS observations FROM budget_items"""


CLEANED = ("job_id", "seq", "unit", "confidence", "quantity", "discipline", "observations")


@query("p19_clean_item", "budget_items", cleaned_sql(f"CASE WHEN discipline IN {rules.DISCIPLINES} THEN discipline ELSE 'Complementares' END"))
def p19(s, d):
    return con.clean_items(items(s, d), "pdf").select(*CLEANED)


@query("p19_clean_item_cad", "budget_items", cleaned_sql("discipline"))
def p19_cad(s, d):
    return con.clean_items(items(s, d), "cad").select(*CLEANED)


@query("p19_clean_item_batch", "budget_items", " SELECT job_id, seq, unit, CASE WHEN confidence = 'verificar' THEN 'estimado' ELSE confidence END AS confidence, CASE WHEN seq % 3 = 0 THEN 1.0 ELSE quantity END AS quantity, discipline, observations FROM budget_items")
def p19_batch(s, d):
    raw = items(s, d).withColumns({"confidence": F.when(F.col("confidence") == "verificar", "talvez").otherwise(F.col("confidence")), "quantity": F.when(F.col("seq") % 6 == 0, -2.0).when(F.col("seq") % 3 != 0, F.col("quantity"))})
    return con.clean_items(raw, "batch").select(*CLEANED)


@query("p29_category_discipline", "cad_blocks", f""" SELECT DISTINCT category, {DISCIPLINE_SQL} AS discipline FROM (SELECT unnest({categories_sql('layer')}) AS category FROM cad_blocks)""")
def p29(s, d):
    return fixture(s, d, "cad_blocks").select(F.explode(classify.categories(F.col("layer"))).alias("category")).distinct().withColumn("discipline", classify.category_discipline(F.col("category")))


LENGTH_SQL = f"sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) * ({FACTOR})"


@query("p31_line_length", "cad_lines cad_files", f" SELECT file_id, seq, round({LENGTH_SQL}, 6) AS length, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + radius * radius) * ({FACTOR}), 6) AS in_space FROM cad_lines JOIN cad_files USING (file_id) WHERE {LENGTH_SQL} > 0")
def p31(s, d):
    lines, files = fixture(s, d, "cad_lines"), fixture(s, d, "cad_files")
    space = geometry.line_length(*map(F.col, ("x1", "y1", "x2", "y2", "radius"))) * F.col("factor")
    return take.line_lengths(lines, files).join(take.with_factor(lines, files).select("file_id", "seq", F.round(space, 6).alias("in_space")), ["file_id", "seq"]).select("file_id", "seq", F.round("length", 6).alias("length"), "in_space")


def polylines(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet")
    i = F.sequence(F.lit(0), F.lit(31))
    x = lambda k: F.get("embedding", k).cast("double") * 1000
    points = F.transform(i, lambda k: F.struct(x(2 * k).alias("x"), x(2 * k + 1).alias("y"), F.when(k % 4 == 0, 0.5).otherwise(0.0).alias("bulge")))
    return e.select((F.col("vec_id") % 20).alias("file_id"), F.col("vec_id").alias("seq"), points.alias("points"), (F.col("vec_id") % 2 == 0).alias("closed"))


POINTS = "poly AS (SELECT vec_id % 20 AS file_id, vec_id AS seq, i, CAST(embedding[2 * i + 1] AS DOUBLE) * 1000 AS x, CAST(embedding[2 * i + 2] AS DOUBLE) * 1000 AS y, CASE WHEN i % 4 = 0 THEN 0.5 ELSE 0.0 END AS bulge, vec_id % 2 = 0 AS closed FROM embeddings, range(32) t(i))"


@query("p32_polyline_length", "", f"""WITH {POINTS}, steps AS (SELECT p.file_id, p.seq, p.bulge, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS chord FROM poly p JOIN poly q ON p.seq = q.seq AND q.i = (p.i + 1) % 32 WHERE p.i < 31 OR p.closed)
    SELECT file_id, seq, round(sum(CASE WHEN bulge = 0 THEN chord ELSE chord / (2 * sin(2 * atan(bulge))) * (4 * atan(bulge)) END), 4) AS length FROM steps GROUP BY ALL""")
def p32(s, d):
    return polylines(s, d).select("file_id", "seq", F.round(geometry.polyline_length(F.col("points"), F.col("closed")), 4).alias("length"))


@query("p33_arc_length", "cad_lines cad_files", f""" SELECT file_id, seq, round(radius * CASE WHEN end_deg < start_deg THEN radians(end_deg) - radians(start_deg) + 2 * pi() ELSE radians(end_deg) - radians(start_deg) END * ({FACTOR}), 6) AS length FROM cad_lines JOIN cad_files USING (file_id)""")
def p33(s, d):
    return take.arc_lengths(fixture(s, d, "cad_lines"), fixture(s, d, "cad_files")).select("file_id", "seq", F.round("length", 6).alias("length"))


@query("p34_polygon_area", "", f"""WITH {POINTS} SELECT p.file_id, p.seq, round(abs(sum(p.x * q.y - q.x * p.y)) / 2, 4) AS area FROM poly p JOIN poly q ON p.seq = q.seq AND q.i = (p.i + 1) % 32 GROUP BY ALL""")
def p34(s, d):
    return polylines(s, d).select("file_id", "seq", F.round(geometry.polygon_area(F.array("points")), 4).alias("area"))


@query("p37_dimension_rows", "cad_dims cad_files", f""" SELECT file_id, seq, CASE WHEN d.measurement IS NOT NULL THEN coalesce(nullif(label, ''), 'cota') ELSE label END AS label, round(d.measurement * factor, 3) AS metres FROM cad_dims d JOIN (SELECT file_id, {FACTOR} AS factor FROM cad_files) USING (file_id)
    WHERE CASE WHEN d.measurement IS NOT NULL THEN abs(d.measurement * factor) >= 0.001 ELSE coalesce(label, '') NOT IN ('', '0') END""")
def p37(s, d):
    return take.dimension_rows(fixture(s, d, "cad_dims"), fixture(s, d, "cad_files").withColumnRenamed("measurement", "m").select("file_id", "insunits", F.col("m").alias("measurement")))


def responses(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet")
    obj = F.format_string('{"items":[{"description":"Porta %d","unit":"un","quantity":%d},{"description":"Piso","unit":"m²","quantity":2.5}]}', F.col("doc_id"), F.col("doc_id") % 9)
    k = F.col("doc_id") % 5
    t = F.when(k == 0, F.concat(F.lit("texto ```json\n"), obj, F.lit("\n``` fim"))).when(k == 1, F.concat(F.lit("```\n"), obj, F.lit("\n```"))).when(k == 2, F.concat(F.lit("segue: "), obj, F.lit(" ok"))).when(k == 3, F.concat(F.lit("["), F.substring_index(F.substring_index(obj, "[", -1), "]", 1), F.lit("]"))).otherwise(F.lit('{"items":[{"desc'))
    return docs.select((F.col("doc_id") % 50).alias("job_id"), F.col("doc_id").alias("sheet_seq"), t.alias("text"))


OBJECT = """concat('{"items":[{"description":"Porta ', doc_id, '","unit":"un","quantity":', doc_id % 9, '},{"description":"Piso","unit":"m²","quantity":2.5}]}')"""


@query("p38_extract_json_block", "", f"""SELECT doc_id % 50 AS job_id, doc_id AS sheet_seq, CASE WHEN doc_id % 5 < 3 THEN {OBJECT} WHEN doc_id % 5 = 3 THEN concat('[{{"description":"Porta ', doc_id, '","unit":"un","quantity":', doc_id % 9, '}},{{"description":"Piso","unit":"m²","quantity":2.5}}]') ELSE '{{"items":[{{"desc' END AS block FROM documents""")
def p38(s, d):
    return responses(s, d).select("job_id", "sheet_seq", payload.json_block(F.col("text")).alias("block"))


@query("p38_extract_json_modes", "", f"""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN concat('segue: ', {OBJECT}, ' ok [1]') WHEN doc_id % 3 = 1 THEN '{{{{"a":1}}}}' ELSE {OBJECT} END AS first, CASE WHEN doc_id % 3 = 1 THEN '{{{{"a":1}}}}' || chr(10) || '```' || chr(10) || '```' || chr(10) || '{{{{"b":2}}}}' ELSE {OBJECT} END AS object FROM documents""".replace("{{", "{").replace("}}", "}"))
def p38_modes(s, d):
    obj = F.format_string('{"items":[{"description":"Porta %d","unit":"un","quantity":%d},{"description":"Piso","unit":"m²","quantity":2.5}]}', F.col("doc_id"), F.col("doc_id") % 9)
    two = F.lit('```\n{"a":1}\n```\n```\n{"b":2}\n```')
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("texto ```json\n"), obj, F.lit("\n``` fim"))).when(F.col("doc_id") % 3 == 1, two).otherwise(F.concat(F.lit("segue: "), obj, F.lit(" ok [1]")))
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", payload.first_block(t).alias("first"), payload.json_object(t).alias("object"))


def answers(s: SparkSession, d: str) -> DataFrame:
    """Answers with a project and items, of which every fifth is broken off."""
    text = F.format_string('{"project_data":{"name":"Obra %d","total_area":"%d m²","layout_area":%d.5,"workstations":"%d un","departments":[{"name":"RH","positions":3}],"demolition_notes":["n%d"],"new_rooms":["sala",{"name":"copa"}],"kept_elements":[]},"items":[{"description":"Porta %d","unit":"un","quantity":"%d un"},{"description":"Piso","unit":"m²","quantity":2.5}]}', *[F.col("doc_id")] * 2, F.col("doc_id") % 7, F.col("doc_id") % 5, *[F.col("doc_id")] * 2, F.col("doc_id") % 9)
    broken = F.when(F.col("doc_id") % 5 == 4, F.substring(text, 1, 40)).otherwise(text)
    rows = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit("a\n```json\n"), broken, F.lit("\n```")).alias("text"))
    return rows.select("doc_id", payload.answer(payload.first_block(F.col("text"))).alias("a"))


@query("p39_parse_project_json", "", """SELECT doc_id, CASE WHEN doc_id % 5 <> 4 THEN concat('Obra ', doc_id) END AS name, CASE WHEN doc_id % 5 <> 4 THEN CAST(doc_id AS DOUBLE) END AS total_area, CASE WHEN doc_id % 5 <> 4 THEN CAST(doc_id % 7 AS DOUBLE) + 0.5 END AS layout_area, CASE WHEN doc_id % 5 <> 4 THEN CAST(doc_id % 5 AS INTEGER) END AS workstations,
    CASE WHEN doc_id % 5 <> 4 THEN 'RH:3' END AS departments, CASE WHEN doc_id % 5 <> 4 THEN concat('n', doc_id, '|sala|{"name":"copa"}') END AS lists, CASE WHEN doc_id % 5 <> 4 THEN CAST(2 AS INTEGER) ELSE 0 END AS n_items, CASE WHEN doc_id % 5 = 4 THEN substring(concat('{"project_data":{"name":"Obra ', doc_id, '","total_area":"', doc_id, ' m²","layout'), 1, 40) END AS error FROM documents""")
def p39_project(s, d):
    p = lambda c: F.col(f"a.project.{c}")
    lists = F.array_join(F.concat(p("demolition_notes"), p("new_rooms"), p("kept_elements")), "|")
    return answers(s, d).select("doc_id", p("name").alias("name"), p("total_area").alias("total_area"), p("layout_area").alias("layout_area"), p("workstations").alias("workstations"), F.array_join(F.transform(p("departments"), lambda x: F.concat(x["name"], F.lit(":"), x["positions"].cast("string"))), ",").alias("departments"), lists.alias("lists"), F.size("a.items").alias("n_items"), F.col("a.error").alias("error"))


@query("p39_parse_items_json", "", """SELECT doc_id % 50 AS job_id, doc_id AS sheet_seq, k.description AS description, k.quantity AS quantity, k.description IS NULL AS broken FROM documents LEFT JOIN LATERAL (
    SELECT concat('Porta ', doc_id) AS description, CAST(doc_id % 9 AS DOUBLE) AS quantity UNION ALL SELECT 'Piso', 2.5) k ON doc_id % 5 < 4""")
def p39(s, d):
    rows = responses(s, d).withColumn("items", payload.items(payload.json_block(F.col("text"))))
    return rows.select("job_id", "sheet_seq", F.explode_outer("items").alias("x")).select("job_id", "sheet_seq", "x.description", "x.quantity", F.col("x.description").isNull().alias("broken"))


@query("p40_parse_classification_array", "", """SELECT doc_id, k.codigo AS codigo, k.familia_code AS familia_code, k.confidence AS confidence FROM documents LEFT JOIN LATERAL (
    SELECT concat('c', doc_id) AS codigo, concat('fam_', doc_id % 10) AS familia_code, least(1.0, (doc_id % 15) / 10) AS confidence UNION ALL SELECT 'd', NULL, 0.0) k ON doc_id % 3 <> 0""")
def p40_array(s, d):
    entry = F.concat(F.lit('[{"codigo":" c'), F.col("doc_id"), F.lit('","familia_code":"fam_'), F.col("doc_id") % 10, F.lit('","confidence":'), (F.col("doc_id") % 15) / 10, F.lit('},{"codigo":"d"}]'))
    t = F.when(F.col("doc_id") % 3 == 0, F.lit("nada")).otherwise(F.concat(F.lit("segue: "), entry, F.lit(" fim")))
    rows = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode_outer(payload.classifications(payload.json_array(t))).alias("x"))
    return rows.select("doc_id", "x.codigo", "x.familia_code", "x.confidence")


@query("p40_parse_classification_json", "", "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN concat('fam_', doc_id % 10) END AS familia_code, CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE least(1.0, (doc_id % 15) / 10) END AS confidence FROM documents")
def p40(s, d):
    t = F.when(F.col("doc_id") % 4 == 0, F.lit("nada")).otherwise(F.concat(F.lit('```json\n{"familia_code":"fam_'), F.col("doc_id") % 10, F.lit('","confidence":'), (F.col("doc_id") % 15) / 10, F.lit(',"attributes":{"a":"b"},"reasoning":"x"}\n```')))
    c = payload.classification(payload.json_block(t))
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", c["familia_code"].alias("familia_code"), c["confidence"].alias("confidence"))


# Sources and sinks


def cells(s: SparkSession, d: str) -> DataFrame:
    it = items(s, d)
    body = it.select("job_id", (F.col("seq") * 2).alias("seq"), F.col("item_num").alias("a"), F.concat(F.lit(" "), "description").alias("b"), F.col("unit").alias("c"), F.col("quantity").cast("string").alias("d"), F.col("observations").alias("h"), F.col("ref_sheet").alias("i"))
    heads = it.where("seq % 10 = 1").select("job_id", (F.col("seq") * 2 - 1).alias("seq"), F.concat(F.lit("3. "), F.upper("discipline")).alias("a"), *[F.lit(None).cast("string").alias(x) for x in "bcdhi"])
    return body.unionByName(heads)


@query("s01_read_budget_rows", "budget_items", " SELECT job_id, seq * 2 AS seq, item_num, description, unit, quantity, ref_sheet FROM budget_items")
def s01(s, d):
    return io.read_budget_rows(cells(s, d)).drop("observations")


@query("s02_read_price_catalog", "price_catalog", """ SELECT codigo, substring(descricao, 1, 400) AS descricao, substring(unidade, 1, 20) AS unidade, familia_id FROM (
    SELECT *, row_number() OVER (PARTITION BY codigo ORDER BY seq) AS r FROM price_catalog WHERE coalesce(tipo_item, '-') IN ('', '-') AND regexp_matches(codigo, '^-*[0-9]+$') AND codigo <> '0') WHERE r = 1""")
def s02(s, d):
    return io.read_price_catalog(fixture(s, d, "price_catalog"))


@query("s03_read_history_rows", "budget_items", " SELECT job_id, seq, description, CASE WHEN unit = 'm²' THEN unit WHEN seq % 7 = 0 THEN 'kg' ELSE unit END AS unit, quantity FROM budget_items WHERE seq % 20 <> 0 AND quantity > 0")
def s03(s, d):
    cell = lambda t=None, v=None: F.struct((t if t is not None else F.lit(None).cast("string")).alias("s"), (v if v is not None else F.lit(None).cast("double")).alias("d"))
    row = F.array(cell(F.substring("item_num", 1, 4)), cell(F.when(F.col("seq") % 20 == 0, "Subtotal").otherwise(F.col("description"))), cell(F.when(F.col("unit") == "m²", "m2").when(F.col("seq") % 7 == 0, " KG").otherwise(F.col("unit"))), cell(v=F.col("quantity")))
    return io.read_history_rows(items(s, d).select("job_id", "seq", row.alias("cells")))


@query("s04_upsert_by_key", "price_catalog", """ SELECT codigo, CASE WHEN max(seq) >= 100000000 THEN 'repetido' ELSE max_by(descricao, seq) END AS descricao, max_by(unidade, seq) AS unidade FROM price_catalog GROUP BY codigo""")
def s04(s, d):
    rows = fixture(s, d, "price_catalog").select("codigo", "descricao", "unidade", "seq")
    path = f"{work_folder(s)}/catalog"
    store.create(rows.where("seq % 2 = 0 and seq < 100000000").drop("seq"), path, ["codigo"])
    store.upsert_stored(s, path, rows, ["codigo"], "seq")
    return store.stored(s, path)


@query("s05_patch_by_key", "catalog_familia", " SELECT id, CASE WHEN id % 3 = 0 THEN 'novo' ELSE name END AS name, grupo_id FROM catalog_familia")
def s05(s, d):
    fam = fixture(s, d, "catalog_familia").select("id", "name", "grupo_id")
    path = f"{work_folder(s)}/familia"
    store.create(fam, path, ["id"])
    store.patch_stored(s, path, fam.where("id % 2 = 1 OR id % 3 = 0").select("id", F.when(F.col("id") % 3 == 0, "novo").alias("name")), "id")
    return store.stored(s, path)


@query("s06_append_facts", "sender_log", " SELECT sender_id, seq, substring(text, 1, 2000) AS question, nullif(CASE WHEN role = 'user' THEN '' ELSE role END, '') AS error, 'user' AS source, 'p1' AS project_id, CASE WHEN seq % 2 = 0 THEN 'a' ELSE 'b' END AS run FROM sender_log")
def s06(s, d):
    log = fixture(s, d, "sender_log").select("sender_id", "seq", F.col("text").alias("question"), F.when(F.col("role") == "user", "").otherwise(F.col("role")).alias("error"))
    path, stamps = f"{work_folder(s)}/facts", {"source": "user", "project_id": "p1"}
    for run, rest in (("a", 0), ("b", 1), ("b", 1)):  # the second run twice
        store.append_stored(log.where(F.col("seq") % 2 == rest), path, run, stamps)
    return s.read.parquet(path)


def work_folder(s: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one stands in for it in local mode only."""
    root = s.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not s.sparkContext.master.startswith("local") or s.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="takeoff-")
    return f"{root.rstrip('/')}/{tempfile.mktemp(dir='', prefix='takeoff-')}"


RANK = "CASE discipline " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(rules.DISCIPLINES)) + f" ELSE {len(rules.DISCIPLINES)} END"
NUMBERED_SQL = f"""+ f AS (SELECT *, {RANK} AS fixed FROM budget_items QUALIFY row_number() OVER (PARTITION BY job_id, substring(lower(trim(description)), 1, 50) ORDER BY seq) = 1),
    g AS (SELECT *, CASE WHEN fixed = 16 THEN min(seq) OVER (PARTITION BY job_id, discipline) ELSE 0 END AS seen FROM f)"""
ITEM_NUM_SQL = "concat(dense_rank() OVER (PARTITION BY job_id ORDER BY fixed, seen), '.', row_number() OVER (PARTITION BY job_id, discipline ORDER BY seq)) AS item_num"


@query("s07_write_budget", "budget_items", NUMBERED_SQL + f" SELECT job_id, seq, {ITEM_NUM_SQL}, description, quantity FROM g")
def s07(s, d):
    folder = work_folder(s)
    io.write_budget(con.number_items(con.first_description_wins(items(s, d))), folder)
    return io.read_budget(s, folder).select("job_id", "seq", "item_num", "description", "quantity")


def payloads(s: SparkSession, d: str) -> DataFrame:
    m = fixture(s, d, "messages")
    e = F.struct(F.array(F.struct(F.array(F.struct(F.struct(F.col("sender_id").cast("string").alias("id")).alias("sender"), F.struct("mid", "text").alias("message"))).alias("messaging"))).alias("entry"))
    return m.select("seq", "ts", F.to_json(e).alias("payload"))


@query("s08_read_message_events", "messages", " SELECT seq, ts, CAST(sender_id AS VARCHAR) AS sender_id, mid, text FROM messages")
def s08(s, d):
    return io.read_message_events(payloads(s, d))


# Joins


@query("j01_denormalize_catalog", CATALOG, CATALOG_SQL + " SELECT familia_id, familia_code, array_to_string(keywords, ' ') AS keywords, grupo_code, capitulo_code FROM catalog")
def j01(s, d):
    return full_catalog(s, d).select("familia_id", "familia_code", F.array_join("keywords", " ").alias("keywords"), "grupo_code", "capitulo_code")


@query("j02_resolve_classification", "budget_items " + CATALOG, CATALOG_SQL + " SELECT job_id, seq, concat('fam_', l_suppkey * 2) AS familia_code, familia_id, grupo_id, capitulo_id FROM budget_items LEFT JOIN catalog ON familia_code = concat('fam_', l_suppkey * 2)")
def j02(s, d):
    return cat.resolve_classification(items(s, d).select("job_id", "seq", F.concat(F.lit("fam_"), F.col("l_suppkey") * 2).alias("familia_code")), full_catalog(s, d))


@query("j03_ancestors", "budget_items " + CATALOG, CATALOG_SQL + " SELECT job_id, seq, l_suppkey * 2 AS familia_id, grupo_id, capitulo_id FROM budget_items LEFT JOIN catalog ON familia_id = l_suppkey * 2")
def j03(s, d):
    return cat.ancestors(items(s, d).select("job_id", "seq", (F.col("l_suppkey") * 2).alias("familia_id")), full_catalog(s, d))


MATCH_SQL = f"""+ o AS (SELECT *, {ITEM_KEY.format('description')} AS item_type FROM budget_items), r AS (SELECT *, {ITEM_KEY.format('description')} AS item_type FROM budget_revised),
    r1 AS (SELECT job_id, item_num, max_by(quantity, seq) AS q1, max(seq) AS s1 FROM r GROUP BY ALL), r2 AS (SELECT job_id, item_type, max_by(quantity, seq) AS q2, max(seq) AS s2 FROM r WHERE item_type <> '' GROUP BY ALL),
    m AS (SELECT o.*, CASE WHEN s1 IS NOT NULL THEN q1 ELSE q2 END AS real, CASE WHEN s1 IS NOT NULL THEN 1 WHEN s2 IS NOT NULL THEN 2 END AS stage FROM o LEFT JOIN r1 ON o.job_id = r1.job_id AND o.item_num = r1.item_num LEFT JOIN r2 ON o.job_id = r2.job_id AND o.item_type = r2.item_type),
    calib AS (SELECT job_id, seq, item_type, discipline, unit, round(quantity, 4) AS ai_quantity, round(real, 4) AS real_quantity, CAST(round(round(CAST((quantity - real) / real * 100 AS DECIMAL(30, 8)), 8), 2) AS DOUBLE) AS deviation_pct, CAST(round(round(CAST(real / quantity AS DECIMAL(30, 10)), 10), 4) AS DOUBLE) AS correction_factor, stage FROM m WHERE quantity <> real AND quantity > 0 AND real > 0)"""


def calib(s: SparkSession, d: str) -> DataFrame:
    return den.calibration(den.compare_budgets(items(s, d), fixture(s, d, "budget_revised")))


@query("j04_compare_budgets", "budget_revised", MATCH_SQL + " SELECT * FROM calib")
def j04(s, d):
    return calib(s, d)


@query("j05_fuzzy_match")
def j05(s, d):
    revised = fixture(s, d, "budget_revised").withColumns({"item_num": F.concat(F.lit("9"), "item_num"), "description": F.concat("description", F.lit(" rev"))})
    return den.fuzzy_match(items(s, d), revised)


STORED_SQL = f"""+ parsed AS (SELECT job_id, seq, typology, description, {ITEM_KEY.format('description')} AS item_type, unit, round(quantity / ref_area, 6) AS density, familia_id, CAST(job_id AS VARCHAR) AS project_label FROM item_areas WHERE ref_area > 0 AND quantity / ref_area > 0 AND quantity / ref_area <= 100),
    raw AS (SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY typology, item_type, unit, project_label ORDER BY seq DESC) = 1)"""


def benchmark_sql(rows: str) -> str:
    """CTEs up to ``bench``: benchmarks of all levels over density rows."""
    return f""", lv AS (SELECT r.*, k.level, k.level_id FROM {rows} r LEFT JOIN catalog USING (familia_id), LATERAL (SELECT 'familia' AS level, r.familia_id AS level_id UNION ALL SELECT 'grupo', grupo_id UNION ALL SELECT 'capitulo', capitulo_id) k WHERE r.familia_id IS NOT NULL AND k.level_id IS NOT NULL AND density > 0),
    sums AS (SELECT typology, level, level_id, unit, project_label, sum(density) AS d FROM lv GROUP BY ALL),
    bench AS MATERIALIZED (SELECT typology, level, level_id, unit, CAST(round(round(CAST(avg(d) AS DECIMAL(30, 12)), 12), 6) AS DOUBLE) AS mean, CAST(round(round(CAST(coalesce(stddev_samp(d), 0) AS DECIMAL(30, 12)), 12), 6) AS DOUBLE) AS stddev, CAST(round(round(CAST(min(d) AS DECIMAL(30, 12)), 12), 6) AS DOUBLE) AS min_value, CAST(round(round(CAST(max(d) AS DECIMAL(30, 12)), 12), 6) AS DOUBLE) AS max_value, count(*) AS n_projects, concat(level, ':', level_id) AS item_type FROM sums GROUP BY typology, level, level_id, unit)"""


RAW_SQL = STORED_SQL + benchmark_sql("raw")
BENCH_SQL = CATALOG_SQL + ", " + RAW_SQL.lstrip("+")
BENCH = "item_areas " + CATALOG


def bench(s: SparkSession, d: str, levels: tuple = den.LEVELS) -> DataFrame:
    return den.benchmarks(den.raw_densities(fixture(s, d, "item_areas", ITEMS_A_TASK)), full_catalog(s, d), levels)


def fixed_sql(c: str, n: int) -> str:
    """A number with n places, rounded as ``numbers.rounded`` does."""
    return f"printf('%.{n}f', CAST(round(round(CAST({c} AS DECIMAL(30, {n + 6})), {n + 6}), {n}) AS DOUBLE))"


def alert_sql() -> str:
    level = "CASE level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.LEVEL_LABELS.items()) + " END"
    cases = ""
    for kind, (more, cause) in rules.ALERT_WORDS.items():
        factor = "density / mean" if kind == "high" else "mean / density"
        values = [fixed_sql("density", 3), "coalesce(unit, '')", fixed_sql(factor, 1), f"'{more}'", level, fixed_sql("mean", 3), fixed_sql("sd", 3), "n", f"'{cause}'"]
        cases += f" WHEN alert = '{kind}' THEN format('{rules.ALERT_TEXT.replace('%s', '{}')}', {', '.join(values)})"
    return f"CASE{cases} END"


@query("j06_density_alerts", BENCH, BENCH_SQL + """, picked AS (SELECT i.job_id, i.seq, trim(i.unit) AS unit, i.confidence, i.observations, i.quantity, i.ref_area, CASE WHEN f.level IS NOT NULL THEN f.n_projects WHEN g.level IS NOT NULL THEN g.n_projects ELSE c.n_projects END AS n, coalesce(f.level, g.level, c.level) AS level, CASE WHEN f.level IS NOT NULL THEN f.mean WHEN g.level IS NOT NULL THEN g.mean ELSE c.mean END AS mean,
    CASE WHEN f.level IS NOT NULL THEN f.stddev WHEN g.level IS NOT NULL THEN g.stddev ELSE c.stddev END AS sd, CASE WHEN f.level IS NOT NULL THEN f.max_value WHEN g.level IS NOT NULL THEN g.max_value ELSE c.max_value END AS top
    FROM item_areas i LEFT JOIN catalog k USING (familia_id) LEFT JOIN bench f ON f.level = 'familia' AND f.level_id = i.familia_id AND f.typology = i.typology AND f.unit = i.unit AND f.n_projects >= 2
    LEFT JOIN bench g ON g.level = 'grupo' AND g.level_id = k.grupo_id AND g.typology = i.typology AND g.unit = i.unit AND g.n_projects >= 2 LEFT JOIN bench c ON c.level = 'capitulo' AND c.level_id = k.capitulo_id AND c.typology = i.typology AND c.unit = i.unit AND c.n_projects >= 2)
    , judged AS (SELECT *, quantity / ref_area AS density, CASE WHEN mean > 0 THEN CASE WHEN quantity / ref_area > CASE WHEN sd = 0 THEN 2.5 * mean ELSE mean + 2 * sd END OR (top > 0 AND quantity / ref_area > 1.5 * top) THEN 'high'
        WHEN CASE WHEN sd = 0 THEN mean / 2.5 ELSE mean - 2 * sd END > 0 AND quantity / ref_area < CASE WHEN sd = 0 THEN mean / 2.5 ELSE mean - 2 * sd END THEN 'low' END END AS alert FROM picked),
    told AS (SELECT *, """ + alert_sql() + """ AS reason FROM judged)
    SELECT job_id, seq, level, round(density, 6) AS density, alert, reason, n AS n_projects, CASE WHEN alert IS NULL THEN confidence ELSE 'estimado' END AS confidence, CASE WHEN alert IS NULL THEN observations ELSE trim(concat(coalesce(observations, ''), '""" + rules.ALERT_NOTE + """', reason), ' |') END AS observations FROM told""")
def j06(s, d):
    out = den.density_alerts(fixture(s, d, "item_areas"), bench(s, d), full_catalog(s, d))
    return out.select("job_id", "seq", "level", numbers.rounded_product(F.col("density"), 6).alias("density"), "alert", "reason", "n_projects", "confidence", "observations")


FACTORS_SQL = MATCH_SQL + ", factors AS (SELECT item_type, discipline, unit, CAST(round(round(CAST(avg(correction_factor) AS DECIMAL(30, 12)), 12), 6) AS DOUBLE) AS avg_factor, count(*) AS data_points, CAST(round(round(CAST(avg(deviation_pct) AS DECIMAL(30, 12)), 12), 6) AS DOUBLE) AS avg_deviation, CAST(round(round(CAST(coalesce(stddev_samp(correction_factor), 0) AS DECIMAL(30, 12)), 12), 6) AS DOUBLE) AS stddev_factor, min(correction_factor) AS min_factor, max(correction_factor) AS max_factor FROM calib GROUP BY item_type, discipline, unit)"


@query("j07_apply_factors", "budget_revised", FACTORS_SQL + f""", f AS (SELECT item_type, max_by(avg_factor, row(data_points, avg_factor)) AS factor FROM factors WHERE data_points >= 2 AND NOT avg_factor BETWEEN 0.98 AND 1.02 GROUP BY item_type)
    SELECT job_id, seq, CASE WHEN factor IS NULL THEN quantity ELSE CAST(round(round(CAST(quantity * factor AS DECIMAL(30, 8)), 8), 2) AS DOUBLE) END AS quantity FROM budget_items LEFT JOIN f ON f.item_type = {ITEM_KEY.format('description')}""")
def j07(s, d):
    return den.apply_factors(items(s, d), den.calibration_factors(calib(s, d))).select("job_id", "seq", "quantity")


SUGGEST = "+ words AS (SELECT DISTINCT description, unit, unnest(" + KEYWORDS.format("description") + """) AS word FROM budget_items), master AS (SELECT codigo, substring(descricao, 1, 400) AS descricao, substring(unidade, 1, 20) AS unidade FROM (
    SELECT *, row_number() OVER (PARTITION BY codigo ORDER BY seq) AS r FROM price_catalog WHERE coalesce(tipo_item, '-') IN ('', '-') AND codigo <> '0') WHERE r = 1),
    hits AS (SELECT * FROM (SELECT word, codigo, descricao, unidade, row_number() OVER (PARTITION BY word ORDER BY codigo) AS r FROM (SELECT DISTINCT word FROM words) w JOIN master ON contains(lower(descricao), word)) WHERE r <= 20)
    SELECT description, unit, codigo, descricao, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY description, unit ORDER BY score DESC, length(descricao), codigo) AS INTEGER) AS rank FROM (
    SELECT description, unit, codigo, descricao, CAST(sum(1 + CASE WHEN contains(lower(unidade), lower(unit)) THEN 0.5 ELSE 0 END) AS DOUBLE) AS score FROM words JOIN hits USING (word) GROUP BY ALL)) WHERE rank <= 3"""


MASTER_SQL = """+ master AS (SELECT codigo, substring(descricao, 1, 400) AS descricao, substring(unidade, 1, 20) AS unidade, familia_id FROM price_catalog
    WHERE coalesce(tipo_item, '-') IN ('', '-') AND codigo <> '0' QUALIFY row_number() OVER (PARTITION BY codigo ORDER BY seq) = 1)"""


def long_words(c: str) -> str:
    return f"list_filter(list_distinct(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}_]+')), lambda t: length(t) >= 4)"


@query("j08_suggest_codes", "budget_items price_catalog", SUGGEST)
def j08(s, d):
    return cat.suggest_codes(items(s, d), io.read_price_catalog(fixture(s, d, "price_catalog")), 3)


@query("j09_codes_for_family", "price_catalog catalog_familia", MASTER_SQL + f""" SELECT familia_id, query, codigo, score, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY familia_id, query ORDER BY score DESC, codigo) AS INTEGER) AS rank FROM (
    SELECT m.familia_id, words AS query, codigo, CAST(len(list_intersect({long_words('descricao')}, {long_words('words')})) AS INTEGER) AS score
    FROM (SELECT * FROM master WHERE familia_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY familia_id ORDER BY codigo) <= 50) m JOIN catalog_familia f ON m.familia_id = f.id)) WHERE rank <= 5""")
def j09(s, d):
    c = io.read_price_catalog(fixture(s, d, "price_catalog"))
    return cat.codes_for_family(c, fixture(s, d, "catalog_familia").select(F.col("id").alias("familia_id"), F.col("words").alias("query")))


CATEGORIZED = f"list_concat({categories_sql('layer')}, list_filter({categories_sql('name')}, lambda c: NOT list_contains({categories_sql('layer')}, c)))"


@query("j10_categorize_elements", "cad_blocks", f" SELECT file_id, seq, unnest({CATEGORIZED}) AS category FROM cad_blocks")
def j10(s, d):
    return take.categorize(fixture(s, d, "cad_blocks")).select("file_id", "seq", "category")


@query("j11_uncategorized_blocks", "cad_blocks", f"+ named AS (SELECT file_id, name, arg_min(layer, seq) AS layer, count(*) AS n FROM cad_blocks WHERE {COUNTABLE} GROUP BY file_id, name) SELECT file_id, name, layer, n, 'verificar' AS confidence FROM named WHERE len({CATEGORIZED}) = 0")
def j11(s, d):
    return take.uncategorized(fixture(s, d, "cad_blocks"))


@query("j12_project_reference_area", "budget_items projects", " SELECT i.job_id, seq, typology, coalesce(project_name, concat('job_', i.job_id)) AS project_label, coalesce(nullif(layout_area, 0), total_area, 0) AS ref_area FROM budget_items i LEFT JOIN projects p ON i.job_id = p.job_id")
def j12(s, d):
    return rep.reference_area(items(s, d).select("job_id", "seq"), fixture(s, d, "projects"))


@query("j13_prefer_new_phase", "cad_blocks", """ SELECT DISTINCT file_id, layer FROM cad_blocks b WHERE NOT (starts_with(layer, 'LEV-') AND EXISTS (SELECT 1 FROM cad_blocks n WHERE n.file_id = b.file_id AND regexp_matches(n.layer, '^(FOR|NOV|ARQ)-') AND regexp_extract(n.layer, '^[A-Za-z]+-(.*)$', 1) = regexp_extract(b.layer, '^[A-Za-z]+-(.*)$', 1)))""")
def j13(s, d):
    return take.prefer_new_phase(fixture(s, d, "cad_blocks").select("file_id", "layer").distinct()).select("file_id", "layer")


@query("j14_unclassified_semi", "price_catalog", " SELECT seq, codigo FROM price_catalog WHERE familia_id IS NULL")
def j14(s, d):
    return cat.pending(fixture(s, d, "price_catalog"), F.col("seq")).select("seq", "codigo")


# Aggregations


@query("a01_density_benchmarks", BENCH, BENCH_SQL + " SELECT * FROM bench WHERE level = 'familia'")
def a01(s, d):
    return bench(s, d, ("familia",))


@query("a02_benchmarks_three_levels", BENCH, BENCH_SQL + " SELECT * FROM bench")
def a02(s, d):
    return bench(s, d)


@query("a03_calibration_factors", "budget_revised", FACTORS_SQL + " SELECT * FROM factors")
def a03(s, d):
    return den.calibration_factors(calib(s, d))


CONSOLIDATED = f"""+ keys AS MATERIALIZED (SELECT description, {key_sql('description')} AS key FROM (SELECT DISTINCT description FROM budget_items)), k AS (SELECT *, round(quantity, 2) AS q FROM budget_items JOIN keys USING (description)), w AS (SELECT *, count(*) OVER g AS n, max(q) OVER g AS most, min(q) OVER g AS least, round(sum(q) OVER g, 2) AS total, min(seq) OVER g AS head,
    row_number() OVER (PARTITION BY job_id, key, unit ORDER BY length(description) DESC, seq) AS place FROM k WINDOW g AS (PARTITION BY job_id, key, unit)),
    pass1 AS (SELECT job_id, item_num, CASE WHEN n >= 4 AND most < 2 THEN concat(trim(split_part(split_part(split_part(split_part(split_part(description, ' - ', 1), ' — ', 1), ' departamento ', 1), ' deptos ', 1), ' da sala ', 1)), ' (várias variantes)') ELSE description END AS description,
    unit, CASE WHEN n >= 4 AND most < 2 THEN total ELSE quantity END AS quantity, CASE WHEN n >= 4 AND most < 2 THEN 'estimado' ELSE confidence END AS confidence, discipline, row_number() OVER (PARTITION BY job_id ORDER BY head, seq) AS seq FROM w WHERE place = 1 OR (NOT (n >= 4 AND most < 2) AND most <> least))"""


@query("a04_consolidate_exact", "budget_items", CONSOLIDATED + " SELECT job_id, seq, item_num, description, unit, quantity, confidence, discipline FROM pass1")
def a04(s, d):
    return con.consolidate_exact(items(s, d)).select("job_id", "seq", "item_num", "description", "unit", "quantity", "confidence", "discipline")


# First fit by rounds: in each the first open row of a bucket heads a family, and the open rows that match it join.
SIMILAR_SQL = CONSOLIDATED + f""", named AS MATERIALIZED (SELECT description, {key_sql('description')} AS key, {noun_sql('description')} AS noun FROM (SELECT DISTINCT description FROM pass1)),
    p AS MATERIALIZED (SELECT pass1.*, round(quantity, 2) AS q, noun, list_distinct(string_split(key, ' ')) AS words FROM pass1 JOIN named USING (description)),
    fam AS (SELECT job_id, discipline, q, seq, noun, words, CAST(NULL AS BIGINT) AS head FROM p WHERE q >= 2
        UNION ALL SELECT job_id, discipline, q, seq, noun, words, CASE WHEN seq = h.seq OR (noun <> '' AND noun = h.noun) OR len(list_intersect(words, h.words)) >= 2 THEN h.seq END
        FROM (SELECT job_id, discipline, q, seq, noun, words, first_value(struct_pack(seq := seq, noun := noun, words := words)) OVER (PARTITION BY job_id, discipline, q ORDER BY seq) AS h FROM fam WHERE head IS NULL)),
    headed AS (SELECT p.*, coalesce(f.head, p.seq) AS head, CASE WHEN p.q >= 2 THEN min(p.seq) OVER (PARTITION BY p.job_id, p.discipline, p.q) ELSE p.seq END AS start FROM p LEFT JOIN (SELECT job_id, seq, head FROM fam WHERE head IS NOT NULL) f ON p.job_id = f.job_id AND p.seq = f.seq),
    merged AS (SELECT *, count(*) OVER v AS n, min(q) OVER v AS same, first_value(unit) OVER (PARTITION BY job_id, start, head ORDER BY seq) AS unit1, list(unit) OVER v AS units FROM headed WINDOW v AS (PARTITION BY job_id, start, head)
        QUALIFY row_number() OVER (PARTITION BY job_id, start, head ORDER BY length(description) DESC, headed.seq) = 1),
    asked AS (SELECT *, {unit_sql('description', 'unit1')} AS unit2 FROM merged)
    SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY start, head) AS seq, item_num, description, CASE WHEN n = 1 THEN unit WHEN unit2 <> unit1 THEN unit2 {" ".join(f"WHEN list_contains(units, '{u}') THEN '{u}'" for u in rules.UNIT_PRIORITY)} ELSE unit1 END AS unit,
    CASE WHEN n = 1 THEN quantity ELSE same END AS quantity, CASE WHEN n = 1 THEN confidence ELSE 'estimado' END AS confidence, discipline FROM asked"""


@query("a05_consolidate_similar", "budget_items", SIMILAR_SQL, recursive=True)
def a05(s, d):
    return con.consolidate_similar(con.consolidate_exact(fixture(s, d, "budget_items", ITEMS_A_TASK))).select("job_id", "seq", "item_num", "description", "unit", "quantity", "confidence", "discipline")


EXTENT_SQL = "SELECT name AS block, max(ex + 0.5) - min(ex - 0.5) AS w, max(ey + 0.5) - min(ey - 0.5) AS h FROM cad_blocks GROUP BY name"
BLOCKS_SQL = f"""+ extent AS MATERIALIZED ({EXTENT_SQL}), sized AS (SELECT b.*, abs(w * xscale * factor) AS wm, abs(h * yscale * factor) AS hm FROM cad_blocks b JOIN (SELECT file_id, {FACTOR} AS factor FROM cad_files) USING (file_id) LEFT JOIN extent ON block = name WHERE {COUNTABLE}),
    counts AS MATERIALIZED (SELECT file_id, name, count(*) AS n, min_by(layer, seq) AS layer, CAST(round(round(CAST(coalesce(median(wm) FILTER (WHERE ok), 0) AS DECIMAL(30, 8)), 8), 2) AS DOUBLE) AS width_m, CAST(round(round(CAST(coalesce(median(hm) FILTER (WHERE ok), 0) AS DECIMAL(30, 8)), 8), 2) AS DOUBLE) AS height_m
    FROM (SELECT *, regexp_matches(upper(name), '{rules.OPENING_PATTERN}') AND wm > 0.1 AND wm < 10 AND hm > 0.1 AND hm < 10 AS ok FROM sized) GROUP BY file_id, name)"""


def extents(s: SparkSession, d: str) -> DataFrame:
    return take.block_bbox(fixture(s, d, "cad_blocks").select(F.col("name").alias("block"), F.col("ex").alias("x"), F.col("ey").alias("y"), F.lit(0.5).alias("r")))


@query("a06_block_counts", "cad_blocks cad_files", BLOCKS_SQL + " SELECT * FROM counts")
def a06(s, d):
    return take.block_counts(fixture(s, d, "cad_blocks"), extents(s, d), fixture(s, d, "cad_files"))


@query("a06_block_positions", "cad_blocks", f" SELECT file_id, name, seq, CAST(round(round(CAST(x AS DECIMAL(30, 8)), 8), 2) AS DOUBLE) AS x, CAST(round(round(CAST(y AS DECIMAL(30, 8)), 8), 2) AS DOUBLE) AS y FROM cad_blocks WHERE {COUNTABLE}")
def a06_positions(s, d):
    return take.block_positions(fixture(s, d, "cad_blocks"))


@query("a07_block_bbox", "cad_blocks", " SELECT block, round(w, 4) AS w, round(h, 4) AS h FROM (" + EXTENT_SQL + ")")
def a07(s, d):
    return extents(s, d).select("block", F.round("w", 4).alias("w"), F.round("h", 4).alias("h"))


@query("a08_length_by_layer", "cad_lines cad_files", f" SELECT file_id, layer, CAST(round(round(CAST(sum({LENGTH_SQL}) AS DECIMAL(30, 9)), 9), 3) AS DOUBLE) AS length, count(*) AS n FROM cad_lines JOIN cad_files USING (file_id) WHERE {LENGTH_SQL} > 0 GROUP BY ALL")
def a08(s, d):
    return take.sum_by_layer(take.line_lengths(fixture(s, d, "cad_lines"), fixture(s, d, "cad_files")), "length")


@query("a09_area_by_layer", "", f"WITH {POINTS} SELECT file_id, 'hatch' AS layer, CAST(round(round(CAST(sum(a) AS DECIMAL(30, 9)), 9), 3) AS DOUBLE) AS area, count(*) AS n FROM (SELECT p.file_id, p.seq, abs(sum(p.x * q.y - q.x * p.y)) / 2 AS a FROM poly p JOIN poly q ON p.seq = q.seq AND q.i = (p.i + 1) % 32 GROUP BY ALL) GROUP BY ALL")
def a09(s, d):
    rows = polylines(s, d).select("file_id", F.lit("hatch").alias("layer"), geometry.polygon_area(F.array("points")).alias("area"))
    return take.sum_by_layer(rows, "area")


@query("a10_texts_by_layer", "cad_texts", """ SELECT file_id, layer, string_agg(text, ' | ' ORDER BY text) AS texts, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY file_id, layer ORDER BY text) AS r FROM (SELECT DISTINCT file_id, layer, trim(text) AS text FROM cad_texts WHERE length(trim(text)) > 2)) WHERE r <= 50 GROUP BY file_id, layer""")
def a10(s, d):
    return take.texts_by_layer(fixture(s, d, "cad_texts"))


@query("a11_unit_sanity", "cad_lines cad_files", f""" SELECT file_id, longest, CASE WHEN longest > 500 THEN 'large' WHEN longest < 0.05 THEN 'small' END AS warning FROM (SELECT file_id, round(max({LENGTH_SQL}), 4) AS longest FROM (SELECT * FROM cad_lines QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY seq) <= 200) JOIN cad_files USING (file_id) WHERE {LENGTH_SQL} > 0 GROUP BY file_id)""")
def a11(s, d):
    return take.unit_sanity(fixture(s, d, "cad_lines"), fixture(s, d, "cad_files"))


def by_category_sql(rows: str, value: str, words: tuple, unit: str) -> str:
    return f"""SELECT file_id, category, CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in words[1].items())} ELSE concat('{words[0]}', category) END, CAST(round(round(CAST(sum({value}) AS DECIMAL(30, 8)), 8), 2) AS DOUBLE), '{unit}', 'confirmado' FROM (SELECT file_id, {value}, unnest({categories_sql('layer')}) AS category FROM {rows}) WHERE {value} > 0 GROUP BY file_id, category"""


@query("a12_takeoff_items", "cad_blocks cad_lines cad_dims cad_files", f""", {POINTS.replace(" AS (", " AS MATERIALIZED (", 1)}, ok AS (SELECT * FROM cad_blocks WHERE {COUNTABLE}), named AS MATERIALIZED (SELECT file_id, name, arg_min(layer, seq) AS layer, CAST(count(*) AS DOUBLE) AS quantity FROM ok GROUP BY file_id, name),
    measured AS (SELECT file_id, layer, {LENGTH_SQL} AS length FROM cad_lines JOIN cad_files USING (file_id)), hatched AS (SELECT p.file_id, CASE WHEN p.seq % 2 = 0 THEN 'A-PISO' ELSE 'FOR-GESSO' END AS layer, abs(sum(p.x * q.y - q.x * p.y)) / 2 AS area FROM poly p JOIN poly q ON p.seq = q.seq AND q.i = (p.i + 1) % 32 GROUP BY p.file_id, p.seq),
    dims AS (SELECT file_id, CASE WHEN d.measurement IS NOT NULL THEN coalesce(nullif(label, ''), 'cota') ELSE label END AS label, round(d.measurement * factor, 3) AS metres FROM cad_dims d JOIN (SELECT file_id, {FACTOR} AS factor FROM cad_files) USING (file_id) WHERE CASE WHEN d.measurement IS NOT NULL THEN abs(d.measurement * factor) >= 0.001 ELSE coalesce(label, '') NOT IN ('', '0') END)
    SELECT *, coalesce({DISCIPLINE_SQL}, '') AS discipline FROM (
    SELECT file_id, unnest({CATEGORIZED}) AS category, name AS description, quantity, 'un' AS unit, 'confirmado' AS confidence FROM named UNION ALL SELECT file_id, NULL, name, quantity, 'un', 'verificar' FROM named WHERE len({CATEGORIZED}) = 0
    UNION ALL {by_category_sql('measured', 'length', rules.LENGTH_NAMES, 'm')} UNION ALL {by_category_sql('hatched', 'area', rules.AREA_NAMES, 'm²')}
    UNION ALL SELECT file_id, NULL, concat('Cota: ', label), 0.0, 'm', 'verificar' FROM dims)""")
def a12(s, d):
    areas = polylines(s, d).select("file_id", F.when(F.col("seq") % 2 == 0, "A-PISO").otherwise("FOR-GESSO").alias("layer"), geometry.polygon_area(F.array("points")).alias("area"))
    return take.takeoff_items(fixture(s, d, "cad_blocks"), fixture(s, d, "cad_lines"), fixture(s, d, "cad_files"), areas, p37(s, d))


PRIORITY_SQL = f"CASE {SHEET_SQL} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.SHEET_PRIORITY.items()) + " ELSE 99 END"


@query("a13_merge_project_data", "sheets", f"""+ s2 AS (SELECT *, row({PRIORITY_SQL}, seq) AS o FROM sheets) SELECT job_id, count(*) AS sheets, CASE WHEN count(*) > 1 THEN concat('Quantitativos — ', count(*), ' arquivos processados') ELSE min_by(filename, o) FILTER (WHERE seq % 2 = 0) END AS name, min_by(concat('rua ', seq), o) FILTER (WHERE seq % 3 = 0) AS address, min_by(concat('arq ', seq), o) FILTER (WHERE seq % 5 = 0) AS architect,
    max_by(CAST(n_chars AS DOUBLE), o) FILTER (WHERE n_chars % 3 <> 0) AS total_area, max_by(CAST(seq % 11 * 10 AS DOUBLE), o) FILTER (WHERE seq % 11 > 0) AS layout_area, max_by(CAST(seq % 13 AS DOUBLE) * 1.5, o) FILTER (WHERE seq % 13 > 0) AS no_intervention_area, max_by(CAST(seq % 5 AS INTEGER), o) FILTER (WHERE seq % 5 > 0) AS workstations, max_by(concat('d', seq, ':2'), o) FILTER (WHERE seq % 4 = 0) AS departments,
    string_agg(CAST(seq AS VARCHAR), '|' ORDER BY o) AS demolition_notes, coalesce(string_agg(concat('sala ', seq), '|' ORDER BY o) FILTER (WHERE seq % 2 = 1), '') AS new_rooms, '' AS kept_elements FROM s2 GROUP BY job_id""")
def a13(s, d):
    i, none = F.col("seq"), F.array().cast("array<string>")
    word = lambda k, text: F.when(i % k == 0, text if text is not None else F.col("filename"))
    numbers_of = {"total_area": F.when(F.col("n_chars") % 3 != 0, F.col("n_chars").cast("double")), "layout_area": (i % 11 * 10).cast("double"), "no_intervention_area": i % 13 * F.lit(1.5), "workstations": (i % 5).cast("int")}
    project = F.struct(word(2, None).alias("name"), word(3, F.concat(F.lit("rua "), i)).alias("address"), word(5, F.concat(F.lit("arq "), i)).alias("architect"), F.array(i.cast("string")).alias("demolition_notes"), F.when(i % 2 == 1, F.array(F.concat(F.lit("sala "), i))).alias("new_rooms"), none.alias("kept_elements"),
        *[e.alias(c) for c, e in numbers_of.items()], F.when(i % 4 == 0, F.array(F.struct(F.concat(F.lit("d"), i).alias("name"), F.lit(2).alias("positions")))).alias("departments"))
    sheets = fixture(s, d, "sheets").select("job_id", classify.sheet_priority(classify.sheet_type(F.col("filename"))).alias("priority"), "seq", project.alias("project"))
    joined = {c: F.array_join(c, "|") for c in ("demolition_notes", "new_rooms", "kept_elements")}
    return rep.merge_project_data(sheets).withColumns({**joined, "departments": F.array_join(F.transform("departments", lambda x: F.concat(x["name"], F.lit(":"), x["positions"].cast("string"))), ",")})


@query("a14_price_estimate", "sheets", " SELECT *, greatest(9700, 2000 * greatest(sheets, 1)) AS cents, round(greatest(9700, 2000 * greatest(sheets, 1)) / 100, 2) AS brl FROM (SELECT job_id, CAST(sum(greatest(1, n_chars % 7)) AS BIGINT) AS sheets, count(*) AS files, string_agg(concat(filename, ' pdf ', greatest(1, n_chars % 7)), '|' ORDER BY seq) AS breakdown FROM sheets GROUP BY job_id)")
def a14(s, d):
    out = rep.price_estimate(fixture(s, d, "sheets").select("job_id", "seq", "filename", (F.col("n_chars") % 7).cast("int").alias("pages"), F.array().cast("array<string>").alias("layouts")))
    return out.withColumn("breakdown", F.array_join(F.transform("breakdown", lambda x: F.concat_ws(" ", x["filename"], x["type"], x["sheets"].cast("string"))), "|"))


@query("a15_file_type_counts", "sheets", " SELECT job_id, string_agg(concat(n, ' ', upper(ext)), ', ' ORDER BY n DESC, ext) AS summary, string_agg(concat(ext, '=', n), ',' ORDER BY ext) AS file_types FROM (SELECT job_id, CASE WHEN seq % 3 = 0 THEN 'dxf' ELSE 'pdf' END AS ext, count(*) AS n FROM sheets GROUP BY ALL) GROUP BY job_id")
def a15(s, d):
    out = rep.file_type_counts(fixture(s, d, "sheets").select("job_id", F.when(F.col("seq") % 3 == 0, "x.dxf").otherwise(F.col("filename")).alias("filename")))
    return out.withColumn("file_types", F.array_join(F.transform(F.array_sort(F.map_entries("file_types")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ","))


@query("a16_agent_stats", "agent_runs", " SELECT count(*) AS total, count(DISTINCT job_id) AS jobs, count(error) AS errors, CAST(trunc(avg(duration_ms)) AS BIGINT) AS avg_duration_ms, round(avg(iterations), 2) AS avg_iterations FROM agent_runs")
def a16(s, d):
    return rep.agent_stats(fixture(s, d, "agent_runs"))


@query("a17_platform_counts", "projects", " SELECT count(*) FILTER (WHERE created_at >= TIMESTAMP '1995-06-01') AS today, count(*) AS projects, count(DISTINCT user_id) AS users FROM projects")
def a17(s, d):
    return rep.platform_counts(fixture(s, d, "projects"), F.lit("1995-06-01").cast("timestamp"))


@query("a18_budget_totals", "budget_items", """ SELECT job_id, discipline, CAST(round(round(CAST(direct AS DECIMAL(30, 8)), 8), 2) AS DOUBLE) AS direct, CASE WHEN discipline IS NULL THEN CAST(round(round(CAST(direct * 0.1 AS DECIMAL(30, 8)), 8), 2) AS DOUBLE) END AS contingency, CASE WHEN discipline IS NULL THEN CAST(round(round(CAST(direct * 1.1 * 0.275 AS DECIMAL(30, 8)), 8), 2) AS DOUBLE) END AS bdi, CASE WHEN discipline IS NULL THEN CAST(round(round(CAST(direct + direct * 0.1 + direct * 1.1 * 0.275 AS DECIMAL(30, 8)), 8), 2) AS DOUBLE) END AS total
    FROM (SELECT job_id, discipline, sum(CASE WHEN unit = '%' THEN 0 ELSE quantity * 3 END) AS direct FROM budget_items GROUP BY GROUPING SETS ((job_id, discipline), (job_id)))""")
def a18(s, d):
    return den.budget_totals(items(s, d).withColumn("price", F.lit(3.0)))


@query("a19_conversation_list", "sender_log", " SELECT sender_id, substring(max_by(text, seq), 1, 100) AS last_text, max_by(role, seq) AS last_role, max_by(ts, seq) AS last_at, max(seq) AS last_seq, count(*) AS messages FROM sender_log GROUP BY sender_id ORDER BY last_at DESC, last_seq DESC LIMIT 50")
def a19(s, d):
    return rep.conversation_list(fixture(s, d, "sender_log"))


@query("a20_catalog_outline", CATALOG, CATALOG_SQL + """, lines AS (SELECT *, concat_ws(' ', familia_code, familia_name, concat('[', typical_unit, ']'), array_to_string(keywords[1:6], ', ')) AS l FROM catalog), g AS (SELECT capitulo_code, capitulo_name, grupo_code, grupo_name, string_agg(l, chr(10) ORDER BY familia_code) AS families FROM lines GROUP BY ALL)
    SELECT capitulo_code, capitulo_name, string_agg(concat(grupo_code, ' ', grupo_name, chr(10), families), chr(10) ORDER BY grupo_code) AS outline FROM g GROUP BY ALL""")
def a20(s, d):
    return cat.catalog_outline(full_catalog(s, d))


@query("a21_run_summary", BENCH, BENCH_SQL + f""", parts AS (SELECT {', '.join(f"count(*) FILTER (level = '{x}') AS benchmarks_{x}" for x in den.LEVELS)}, count(*) AS benchmarks FROM bench)
    SELECT p.*, parts.* FROM (SELECT count(*) AS parsed, count(familia_id) AS classified, string_agg(DISTINCT typology, ',' ORDER BY typology) AS typologies FROM parsed) p, parts""")
def a21(s, d):
    return den.ingest_summary(den.density_rows(fixture(s, d, "item_areas")), bench(s, d))


DIM_SQL = f"""dims AS (SELECT file_id, seq, CASE WHEN d.measurement IS NOT NULL THEN coalesce(nullif(label, ''), 'cota') ELSE label END AS label, round(d.measurement * factor, 3) AS metres FROM cad_dims d JOIN (SELECT file_id, {FACTOR} AS factor FROM cad_files) USING (file_id) WHERE CASE WHEN d.measurement IS NOT NULL THEN abs(d.measurement * factor) >= 0.001 ELSE coalesce(label, '') NOT IN ('', '0') END)"""


def two_sql(c: str) -> str:
    return f"printf('%.2f', CAST(round(round(CAST({c} AS DECIMAL(30, 8)), 8), 2) AS DOUBLE))"


def part_sql(place: int, title: str, line: str, order: str, rows: str) -> str:
    return f"SELECT file_id, {place} AS place, concat('{title}', chr(10), string_agg(concat('  ', {line}), chr(10) ORDER BY {order})) AS section FROM {rows} GROUP BY file_id"


@query("a22_cad_digest", "cad_blocks cad_files cad_lines cad_dims cad_texts", BLOCKS_SQL + f""", {POINTS.replace(" AS (", " AS MATERIALIZED (", 1)}, {DIM_SQL}, said AS (SELECT DISTINCT file_id, layer, trim(text) AS text FROM cad_texts WHERE length(trim(text)) > 2),
    hatched AS (SELECT file_id, layer, sum(a) AS v FROM (SELECT p.file_id, CASE WHEN p.seq % 2 = 0 THEN 'A-PISO' ELSE 'FOR-GESSO' END AS layer, abs(sum(p.x * q.y - q.x * p.y)) / 2 AS a FROM poly p JOIN poly q ON p.seq = q.seq AND q.i = (p.i + 1) % 32 GROUP BY p.file_id, p.seq) WHERE a > 0 GROUP BY ALL),
    measured AS (SELECT file_id, layer, sum({LENGTH_SQL}) AS v FROM cad_lines JOIN cad_files USING (file_id) WHERE {LENGTH_SQL} > 0 GROUP BY file_id, layer), parts AS (
    {part_sql(1, 'Layers', 'layer', 'layer', "(SELECT DISTINCT file_id, trim(regexp_replace(layer, '^[^|]*[|]', '')) AS layer FROM cad_lines)")}
    UNION ALL {part_sql(2, 'Esquadrias', "name, ': ', n, ' un | ', " + two_sql('width_m') + ", ' m × ', " + two_sql('height_m') + ", ' m = ', " + two_sql('width_m * height_m') + ", ' m²'", 'n DESC, name', '(SELECT * FROM counts WHERE width_m > 0)')}
    UNION ALL {part_sql(3, 'Blocos', "name, ': ', n, ' un'", 'n DESC, name', '(SELECT * FROM counts WHERE width_m <= 0)')} UNION ALL {part_sql(4, 'Comprimentos por layer', "layer, ': ', " + two_sql('v') + ", ' m'", 'layer', 'measured')}
    UNION ALL {part_sql(5, 'Áreas por layer', "layer, ': ', " + two_sql('v') + ", ' m²'", 'layer', 'hatched')} UNION ALL {part_sql(6, 'Textos', "'[', layer, '] ', text", 'layer, text', 'said')}
    UNION ALL {part_sql(7, 'Cotas', "label, coalesce(': ' || printf('%.3f', metres) || ' m', '')", 'seq', 'dims')}) SELECT file_id, string_agg(section, chr(10) ORDER BY place) AS digest FROM parts GROUP BY file_id""")
def a22(s, d):
    lines, files = fixture(s, d, "cad_lines"), fixture(s, d, "cad_files")
    areas = polylines(s, d).select("file_id", F.when(F.col("seq") % 2 == 0, "A-PISO").otherwise("FOR-GESSO").alias("layer"), geometry.polygon_area(F.array("points")).alias("area")).where("area > 0")
    return take.digest(lines, a06(s, d), take.line_lengths(lines, files), areas, fixture(s, d, "cad_texts"), p37(s, d))


# Windows, lists, sets


@query("w01_fill_section", "budget_items", """ SELECT job_id, seq * 2 AS seq, item_num AS a, array_to_string(list_transform(string_split(lower(first_value(discipline) OVER (PARTITION BY job_id, (seq - 1) // 10 ORDER BY seq)), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS discipline FROM budget_items""")
def w01(s, d):
    return den.fill_section(cells(s, d)).where("discipline is not null").select("job_id", "seq", "a", "discipline")


@query("w02_first_description_wins", "budget_items", " SELECT job_id, seq, description, discipline FROM budget_items QUALIFY row_number() OVER (PARTITION BY job_id, substring(lower(trim(description)), 1, 50) ORDER BY seq) = 1")
def w02(s, d):
    return con.first_description_wins(items(s, d)).select("job_id", "seq", "description", "discipline")


@query("w03_number_items", "budget_items", NUMBERED_SQL + f" SELECT job_id, seq, {ITEM_NUM_SQL} FROM g")
def w03(s, d):
    return con.number_items(con.first_description_wins(items(s, d))).select("job_id", "seq", "item_num")


@query("w04_last_n_messages", "sender_log", " SELECT sender_id, seq, role, text FROM sender_log QUALIFY row_number() OVER (PARTITION BY sender_id ORDER BY seq DESC) <= 20")
def w04(s, d):
    return rep.last_messages(fixture(s, d, "sender_log")).select("sender_id", "seq", "role", "text")


@query("w05_latest_state", "messages", " SELECT sender_id, max_by(event_type, row(ts, seq)) FILTER (WHERE event_type NOT IN ('click', 'view')) AS status, max_by(value, row(ts, seq)) AS progress FROM messages GROUP BY sender_id")
def w05(s, d):
    m = fixture(s, d, "messages").select("sender_id", F.struct("ts", "seq").alias("o"), F.when(~F.col("event_type").isin("click", "view"), F.col("event_type")).alias("status"), F.col("value").alias("progress"))
    return rep.latest_state(m, "sender_id", "o", ["status", "progress"])


@query("w06_recent_activity", "messages", " SELECT seq, sender_id, event_type FROM messages ORDER BY ts DESC, seq DESC LIMIT 50")
def w06(s, d):
    return rep.recent(fixture(s, d, "messages"), [F.desc("ts"), F.desc("seq")], 50).select("seq", "sender_id", "event_type")


@query("t01_search_items", "budget_items", " SELECT job_id, seq, description FROM budget_items WHERE contains(lower(description), 'porta') QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq) <= 20")
def t01(s, d):
    return rep.search_items(items(s, d), "Porta").select("job_id", "seq", "description")


@query("t02_list_items", "budget_items", " SELECT job_id, seq, substring(description, 1, 80) AS description FROM budget_items WHERE seq <= 200")
def t02(s, d):
    return rep.first_per(items(s, d), ["job_id"], ["seq"], 200).select("job_id", "seq", F.substring("description", 1, 80).alias("description"))


@query("t03_item_details", "budget_items " + CATALOG, CATALOG_SQL + " SELECT job_id, item_num, seq, grupo_code FROM (SELECT * FROM budget_items QUALIFY row_number() OVER (PARTITION BY job_id, item_num ORDER BY seq) = 1) LEFT JOIN catalog ON familia_id = l_suppkey")
def t03(s, d):
    first = rep.first_per(items(s, d), ["job_id", "item_num"], ["seq"], 1).withColumn("familia_id", F.col("l_suppkey"))
    return first.join(full_catalog(s, d).select("familia_id", "grupo_code"), "familia_id", "left").select("job_id", "item_num", "seq", "grupo_code")


@query("t04_rank_benchmarks", BENCH, BENCH_SQL + " SELECT typology, item_type, unit, n_projects FROM bench ORDER BY n_projects DESC, item_type")
def t04(s, d):
    return bench(s, d).select("typology", "item_type", "unit", "n_projects").orderBy(F.desc("n_projects"), "item_type")


@query("t05_recent_conversations", "agent_runs", " SELECT seq, job_id, duration_ms FROM agent_runs ORDER BY created_at DESC, seq DESC LIMIT 50")
def t05(s, d):
    return rep.recent(fixture(s, d, "agent_runs"), [F.desc("created_at"), F.desc("seq")], 50).select("seq", "job_id", "duration_ms")


@query("t06_pending_batch", "price_catalog", " SELECT seq, codigo FROM price_catalog WHERE familia_id IS NULL ORDER BY seq LIMIT 100")
def t06(s, d):
    return cat.pending(fixture(s, d, "price_catalog"), F.col("seq"), 100).select("seq", "codigo")


@query("t07_sheet_order", "sheets", f" SELECT job_id, seq, {PRIORITY_SQL} AS priority, row_number() OVER (PARTITION BY job_id ORDER BY {PRIORITY_SQL}, seq) AS place FROM sheets WHERE {PRIORITY_SQL} < 99")
def t07(s, d):
    rows = fixture(s, d, "sheets").withColumn("priority", classify.sheet_priority(classify.sheet_type(F.col("filename")))).where("priority < 99")
    return rep.first_per(rows, ["job_id"], ["priority", "seq"], 1 << 30).select("job_id", "seq", "priority", F.col("place").cast("bigint").alias("place"))


@query("u01_union_sources", "budget_items", " SELECT job_id, seq, 'cad' AS source FROM budget_items WHERE seq % 2 = 0 UNION ALL SELECT job_id, seq, 'pdf' FROM budget_items WHERE seq % 2 = 1")
def u01(s, d):
    it = items(s, d).select("job_id", "seq")
    return it.where("seq % 2 = 0").withColumn("source", F.lit("cad")).unionByName(it.where("seq % 2 = 1").withColumn("source", F.lit("pdf")))


@query("u02_distinct_layers", "cad_blocks", " SELECT DISTINCT file_id, trim(regexp_replace(layer, '^[^|]*[|]', '')) AS layer FROM cad_blocks")
def u02(s, d):
    return take.distinct_layers(fixture(s, d, "cad_blocks"))


@query("u03_union_blocks_layer_name", "cad_blocks", f" SELECT DISTINCT file_id, name, unnest({CATEGORIZED}) AS category FROM cad_blocks")
def u03(s, d):
    return take.categorize(fixture(s, d, "cad_blocks")).select("file_id", "name", "category").distinct()


@query("u04_token_overlap", "budget_revised", f"""+ t AS MATERIALIZED (SELECT description, {key_tokens('description')} AS tokens FROM (SELECT description FROM budget_items UNION SELECT description FROM budget_revised))
    SELECT b.job_id, b.seq, CAST(len(list_intersect(x.tokens, y.tokens)) AS INTEGER) AS shared FROM budget_items b JOIN budget_revised r ON b.job_id = r.job_id AND b.seq = r.seq JOIN t x ON x.description = b.description JOIN t y ON y.description = r.description""")
def u04(s, d):
    r = fixture(s, d, "budget_revised").select("job_id", "seq", F.col("description").alias("other"))
    return items(s, d).join(r, ["job_id", "seq"]).select("job_id", "seq", text.token_overlap(text.description_tokens(F.col("description")), text.description_tokens(F.col("other"))).alias("shared"))


def class_tokens(c: str) -> str:
    return f"list_filter(list_distinct(string_split_regex(regexp_replace(regexp_replace(strip_accents(lower({c})), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +')), lambda t: length(t) >= 4)"


def classified_sql(rows: str) -> str:
    """CTEs up to ``found``: the best familia of each distinct (description, unit) of ``rows``."""
    return f""", described AS (SELECT description, unit, {class_tokens('description')} AS tokens FROM (SELECT DISTINCT description, unit FROM {rows}) WHERE length(trim(description)) >= 3),
    known AS (SELECT DISTINCT familia_code, familia_id, typical_unit, unnest(list_concat({class_tokens("array_to_string(keywords, ' ')")}, {class_tokens('familia_name')})) AS token FROM catalog),
    hits AS (SELECT description, unit, len(tokens) AS n, familia_code, familia_id, typical_unit, count(*) AS hits FROM (SELECT *, unnest(tokens) AS token FROM described) JOIN known USING (token) GROUP BY ALL),
    found AS (SELECT description, unit, familia_code, round(hits / n, 4) * CASE WHEN unit = typical_unit THEN 1.0 ELSE 0.5 END AS confidence_score FROM hits QUALIFY row_number() OVER (PARTITION BY description, unit ORDER BY hits DESC, familia_id) = 1)"""


@query("x01_classify_items", "budget_items " + CATALOG, CATALOG_SQL + classified_sql("budget_items") + " SELECT job_id, seq, familia_code, CAST(coalesce(confidence_score, 0) AS DOUBLE) AS confidence_score FROM budget_items LEFT JOIN found USING (description, unit)")
def x01(s, d):
    return cat.classify_items(items(s, d), full_catalog(s, d)).select("job_id", "seq", "familia_code", "confidence_score")


# A third of the stored rows stand for those that nobody has classified yet.
OPEN_SQL = ", stored AS (SELECT * EXCLUDE familia_id, CASE WHEN seq % 3 <> 0 THEN familia_id END AS familia_id FROM raw), todo AS (SELECT * FROM stored WHERE familia_id IS NULL AND coalesce(description, '') <> '')"
RENEWED_SQL = """, renewed AS (SELECT t.* EXCLUDE familia_id, coalesce(c.familia_id, t.familia_id) AS familia_id, t.familia_id IS NULL AS picked, c.familia_id IS NOT NULL AS found FROM stored t
    LEFT JOIN found f ON t.familia_id IS NULL AND t.description = f.description AND t.unit = f.unit LEFT JOIN catalog c ON c.familia_code = f.familia_code)"""


def reopened(s: SparkSession, d: str) -> DataFrame:
    raw = den.raw_densities(fixture(s, d, "item_areas", ITEMS_A_TASK)).withColumn("familia_id", F.when(F.col("seq") % 3 != 0, F.col("familia_id")))
    catalog = full_catalog(s, d)
    return den.reclassified(raw, catalog, lambda rows: cat.classify_items(rows, catalog))


@query("a21_reclassified_rows", BENCH, CATALOG_SQL + ", " + STORED_SQL.lstrip("+") + OPEN_SQL + classified_sql("todo") + RENEWED_SQL + " SELECT job_id, seq, familia_id, picked, found FROM renewed")
def a21_rows(s, d):
    return reopened(s, d).select("job_id", "seq", "familia_id", "picked", "found")


@query("a21_reclassify_summary", BENCH, CATALOG_SQL + ", " + STORED_SQL.lstrip("+") + OPEN_SQL + classified_sql("todo") + RENEWED_SQL + benchmark_sql("renewed") + """
    SELECT (SELECT count(*) FILTER (picked) FROM renewed) AS raws_total, (SELECT count(*) FILTER (found) FROM renewed) AS classified, (SELECT count(*) FILTER (picked AND coalesce(description, '') = '') FROM renewed) AS skipped,
        (SELECT coalesce(string_agg(DISTINCT typology, ',' ORDER BY typology), '') FROM renewed WHERE found) AS typologies, (SELECT count(*) FROM bench WHERE typology IN (SELECT typology FROM renewed WHERE found)) AS benchmarks""")
def a21_reclassify(s, d):
    return den.reclassify_summary(reopened(s, d), full_catalog(s, d))


PRICED_SQL = ", priced AS (SELECT codigo, descricao AS description, coalesce(unidade, '') AS unit FROM master)"


@query("x02_classify_in_batches", "price_catalog " + CATALOG, MASTER_SQL + "," + CATALOG_SQL.removeprefix("+") + PRICED_SQL + classified_sql("priced") + " SELECT codigo, familia_code, CAST(coalesce(confidence_score, 0) AS DOUBLE) AS confidence_score FROM priced LEFT JOIN found USING (description, unit)")
def x02(s, d):
    rows = io.read_price_catalog(fixture(s, d, "price_catalog")).select("codigo", F.col("descricao").alias("description"), F.coalesce("unidade", F.lit("")).alias("unit"))
    return cat.classify_items(rows, full_catalog(s, d)).select("codigo", "familia_code", "confidence_score")


def by_code(batch: list[dict]) -> list[dict]:
    """A predictor that stands in for a model: a family by the code's number, unsure of every third, out of order."""
    return [{"key": b["key"], "familia_code": f"fam_{int(b['key']) % 7}" if int(b["key"]) % 3 else None, "confidence": 1.7, "reasoning": "r" * 300} for b in reversed(batch)]


@query("x02_classify_with_predictor", "price_catalog " + CATALOG, MASTER_SQL + "," + CATALOG_SQL.removeprefix("+") + " SELECT codigo, coalesce(m.familia_id, c.familia_id) AS familia_id FROM master m LEFT JOIN catalog c ON m.familia_id IS NULL AND CAST(codigo AS BIGINT) % 3 <> 0 AND c.familia_code = concat('fam_', CAST(codigo AS BIGINT) % 7)")
def x02_predictor(s, d):
    codes = io.read_price_catalog(fixture(s, d, "price_catalog")).withColumn("familia_id", F.col("familia_id").cast("long"))
    return cat.classify_codes(codes, full_catalog(s, d), by_code).select("codigo", "familia_id")


def by_words(batch: list[dict]) -> list[dict]:
    """A predictor that stands in for a model: the family of the number of words, the unit as an attribute."""
    return [{"key": b["key"], "familia_code": f"fam_{len(b['description'].split())}", "confidence": 0.5, "attributes": {"unit": b["unit"]}, "reasoning": b["description"].lower() * 20} for b in batch]


@query("x01_classify_with_predictor", "budget_items " + CATALOG, CATALOG_SQL + " SELECT job_id, seq, concat('fam_', len(string_split(description, ' '))) AS familia_code, familia_id, CAST(0.5 AS DOUBLE) AS confidence_score, unit AS attribute, substring(repeat(lower(description), 20), 1, 200) AS reasoning FROM budget_items LEFT JOIN catalog ON familia_code = concat('fam_', len(string_split(description, ' ')))")
def x01_predictor(s, d):
    out = cat.classify_with(items(s, d).drop("confidence"), full_catalog(s, d), by_words)
    return out.select("job_id", "seq", "familia_code", "familia_id", F.col("confidence").alias("confidence_score"), F.try_element_at("attributes", F.lit("unit")).alias("attribute"), "reasoning")


@query("x03_sequence_ratio")
def x03(s, d):
    names = fixture(s, d, "price_catalog").select("codigo", "descricao")
    return names.select("codigo", F.round(den.sequence_ratio(F.col("descricao"), F.lit(DESCRIPTIONS[9])), 6).alias("ratio"))


@query("x03_similar_descriptions")
def x03_similar(s, d):
    rows = items(s, d).select(F.lit(1).alias("all"), F.lower("description").alias("a"))
    names = fixture(s, d, "price_catalog").select(F.lit(1).alias("all"), F.lower("descricao").alias("b"))
    return den.similar_texts(rows, names, "all", 0.7).select("a", "b", F.round("ratio", 6).alias("ratio"))


# Messages

DEDUPED = "+ first AS (SELECT * FROM messages WHERE coalesce(text, '') <> '' QUALIFY row_number() OVER (PARTITION BY mid ORDER BY seq) = 1)"


def stream_of(s: SparkSession, rows: DataFrame, folder: str, files: int | None = None, last: DataFrame | None = None) -> DataFrame:
    """Rows of a table as a file stream; with ``files``, so many a batch. ``last``: rows that come after all others."""
    at = {"ts": F.col("ts").cast("timestamp")}
    rows = rows.withColumns(at)
    rows.write.parquet(folder)
    if last is not None:
        last.withColumns(at).write.mode("append").parquet(folder)
    reader = s.readStream.schema(rows.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def heartbeat(rows: DataFrame, days: int) -> DataFrame:
    """A row of nulls but for a time ``days`` after the last one, so that the watermark passes all that came before."""
    late = (F.max("ts") + F.expr(f"interval {days} days")).alias("ts")
    return rows.agg(late).select(*[F.col("ts") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])


def run_stream(s: SparkSession, d: str, make: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """The messages as a file stream, run to its end into a table in the shared folder."""
    folder = work_folder(s)
    out = make(msg.messages(stream_of(s, payloads(s, d), f"{folder}/in")))
    sink.append_once(out, f"{folder}/out", f"{folder}/state", mode).awaitTermination()
    return sink.read_batches(s, f"{folder}/out", out.schema)


@query("st01_message_stream", "messages", " SELECT seq, CAST(sender_id AS VARCHAR) AS sender_id, mid, text FROM messages WHERE text <> ''")
def st01(s, d):
    return run_stream(s, d, lambda m: m.select("seq", "sender_id", "mid", "text"), "append")


@query("st02_dedupe_messages", "messages", " SELECT DISTINCT mid FROM messages WHERE text <> ''")
def st02(s, d):
    return run_stream(s, d, lambda m: msg.dedupe(m, "60 days"), "append").select("mid")


QUOTA_SQL = DEDUPED + ", ranked AS (SELECT seq, mid, ts, sender_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY seq) AS day_rank FROM first WHERE sender_id <> 3 UNION ALL SELECT seq, mid, ts, sender_id, NULL FROM first WHERE sender_id = 3)"


@query("st03_daily_quota", "messages", QUOTA_SQL + " SELECT seq, mid, day_rank, coalesce(day_rank <= 200, FALSE) AS sent FROM ranked")
def st03(s, d):
    return msg.daily_quota(fixture(s, d, "messages"), own_id="3").select("seq", "mid", "day_rank", "sent")


@query("st03_daily_quota_stream", "messages", QUOTA_SQL + " SELECT seq, mid, coalesce(day_rank <= 5, FALSE) AS sent FROM ranked")
def st03_stream(s, d):
    folder = work_folder(s)
    events = io.read_message_events(payloads(s, d))
    mixed = lambda rows: rows.repartition(6, F.xxhash64("seq", F.lit("any order")))
    first = msg.once(stream_of(s, mixed(events), f"{folder}/in", 2, heartbeat(events, 100)), "40 days")
    sink.append_once(first, f"{folder}/first", f"{folder}/state1").awaitTermination()
    rows = sink.read_batches(s, f"{folder}/first", first.schema)
    out = msg.quota_stream(stream_of(s, mixed(rows), f"{folder}/again", 2, heartbeat(rows, 100)), 5, own_id="3", delay="40 days")
    sink.append_once(out, f"{folder}/out", f"{folder}/state2").awaitTermination()
    return sink.read_batches(s, f"{folder}/out", out.schema)


@query("st04_daily_counters", "messages", " SELECT CAST(ts AS DATE) AS day, count(*) AS messages FROM messages WHERE text <> '' GROUP BY 1")
def st04(s, d):
    folder = work_folder(s)
    events = io.read_message_events(payloads(s, d))
    days = msg.daily_counters(stream_of(s, events, f"{folder}/in", last=heartbeat(events, 40)), "15 days")
    sink.append_once(days, f"{folder}/out", f"{folder}/state").awaitTermination()
    return sink.read_batches(s, f"{folder}/out", days.schema)


HISTORY_SQL = " SELECT {0} AS sender_id, count(*) AS n, string_agg(text, chr(10) ORDER BY seq) AS texts FROM (SELECT * FROM messages WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY sender_id ORDER BY seq DESC) <= 20) GROUP BY sender_id"


@query("st05_sender_history", "messages", HISTORY_SQL.format("sender_id"))
def st05(s, d):
    out = run_stream(s, d, lambda m: msg.sender_history(m.withColumn("sender_id", F.col("sender_id").cast("long"))), "update")
    return out.select("sender_id", F.size("texts").cast("bigint").alias("n"), F.array_join("texts", "\n").alias("texts"))


@query("st05_sender_history_batch", "messages", HISTORY_SQL.format("CAST(sender_id AS VARCHAR)"))
def st05_batch(s, d):
    out = msg.sender_history(msg.messages(payloads(s, d)))
    return out.select("sender_id", F.size("texts").cast("bigint").alias("n"), F.array_join("texts", "\n").alias("texts"))


POSTS_SQL = """WITH RECURSIVE times AS (SELECT DISTINCT user_id AS sender_id, epoch(date_trunc('second', ts)) AS t FROM events),
    taken AS (SELECT sender_id, min(t) AS posted FROM times GROUP BY sender_id UNION ALL SELECT sender_id, posted FROM (SELECT k.sender_id, (SELECT min(t) FROM times x WHERE x.sender_id = k.sender_id AND x.t >= k.posted + 86400) AS posted FROM taken k) WHERE posted IS NOT NULL)
    SELECT {0} AS sender_id, CAST(posted AS BIGINT) AS posted FROM taken"""


@query("st06_post_due", "", POSTS_SQL.format("sender_id"))
def st06(s, d):
    return msg.posts_due(fixture(s, d, "messages"))


@query("st06_post_due_stream", "", POSTS_SQL.format("CAST(sender_id AS VARCHAR)"))
def st06_stream(s, d):
    folder = work_folder(s)
    out = msg.posts_due_stream(io.read_message_events(stream_of(s, payloads(s, d), f"{folder}/in")))
    sink.append_once(out, f"{folder}/out", f"{folder}/state").awaitTermination()
    return sink.read_batches(s, f"{folder}/out", out.schema)


@query("st07_activity_append", "messages", " SELECT count(*) AS n, 'message' AS action FROM messages WHERE text <> ''")
def st07(s, d):
    folder = work_folder(s)
    msg.append_activity(msg.messages(stream_of(s, payloads(s, d), f"{folder}/in")), f"{folder}/log", f"{folder}/state").awaitTermination()
    return sink.read_batches(s, f"{folder}/log", "ts timestamp, action string, details string").groupBy("action").agg(F.count("*").alias("n"))

"""Lists, state and totals over jobs, senders and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import sheet_price_cents, sheets_of_file
from ..rules import TYPOLOGY_DEFAULT


def first_per(rows: DataFrame, keys: list[str], order: list, n: int, name: str = "place") -> DataFrame:
    """The first n rows of each key; always partitioned, so no task gets all rows."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def reference_area(items: DataFrame, projects: DataFrame) -> DataFrame:
    """Adds typology, project label and reference area (layout area, else total area, else 0)."""
    p = projects.select("job_id", F.coalesce(F.nullif("typology", F.lit("")), F.lit(TYPOLOGY_DEFAULT)).alias("typology"), F.substring(F.coalesce(F.nullif("project_name", F.lit("")), F.concat(F.lit("job_"), "job_id")), 1, 100).alias("project_label"), F.coalesce(F.nullif("layout_area", F.lit(0.0)), "total_area", F.lit(0.0)).alias("ref_area"))
    return items.join(p, "job_id", "left").withColumn("ref_area", F.coalesce("ref_area", F.lit(0.0)))


def price_estimate(files: DataFrame) -> DataFrame:
    """Per upload: sheets, files, price and the list of its files with type and sheets, in order. files: job_id, seq, filename, pages, layouts."""
    n = sheets_of_file(F.col("filename"), F.col("pages"), F.col("layouts"))
    kind = F.coalesce(F.nullif(F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)), F.lit("")), F.lit("?"))
    entry = F.struct("seq", "filename", kind.alias("type"), n.cast("long").alias("sheets"))
    sums = files.groupBy("job_id").agg(F.greatest(F.lit(1), F.sum(n)).cast("long").alias("sheets"), F.count("*").alias("files"), F.array_sort(F.collect_list(entry)).alias("breakdown"))
    return sums.withColumn("cents", sheet_price_cents(F.col("sheets"))).withColumn("brl", F.round(F.col("cents") / 100, 2))


def file_type_counts(files: DataFrame) -> DataFrame:
    """Per job a map of its file types to their numbers, and the same as a text, most frequent first."""
    ext = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    n = files.groupBy("job_id", ext.alias("ext")).count()
    found = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "ext")))
    text = F.array_join(F.transform(found, lambda x: F.concat((-x["o"]).cast("string"), F.lit(" "), F.upper(x["ext"]))), ", ")
    return n.groupBy("job_id").agg(text.alias("summary"), F.map_from_entries(F.transform(found, lambda x: F.struct(x["ext"], -x["o"]))).alias("file_types"))


def agent_stats(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("total"), F.count_distinct("job_id").alias("jobs"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.coalesce(F.avg("duration_ms"), F.lit(0.0)).cast("bigint").alias("avg_duration_ms"), F.round(F.coalesce(F.avg("iterations"), F.lit(0.0)), 2).alias("avg_iterations"))


def platform_counts(projects: DataFrame, today: Column) -> DataFrame:
    return projects.agg(F.count_if(F.col("created_at") >= today).alias("today"), F.count("*").alias("projects"), F.count_distinct("user_id").alias("users"))


def conversation_list(log: DataFrame, most: int = 50) -> DataFrame:
    """The ``most`` senders heard of last, newest first: last text (100 characters), its role and time, number of messages."""
    per = log.groupBy("sender_id").agg(F.substring(F.max_by("text", "seq"), 1, 100).alias("last_text"), F.max_by("role", "seq").alias("last_role"), F.max_by("ts", "seq").alias("last_at"), F.max("seq").alias("last_seq"), F.count("*").alias("messages"))
    return per.orderBy(F.desc("last_at"), F.desc("last_seq")).limit(most)


def last_messages(log: DataFrame, n: int = 20) -> DataFrame:
    return first_per(log, ["sender_id"], [F.desc("seq")], n)


def latest_state(changes: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Latest value of each field per key from partial updates (null: unchanged)."""
    return changes.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def recent(rows: DataFrame, order: list, n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def search_items(items: DataFrame, term: str, most: int = 20) -> DataFrame:
    return first_per(items.where(F.contains(F.lower("description"), F.lit(term.lower()))), ["job_id"], ["seq"], most)


def invite_check(profiles: DataFrame, codes: DataFrame, now: Column | None = None) -> DataFrame:
    """Profiles with their contact checks and masks, and whether their invite code counts: active, not expired at ``now`` (the present), with projects left."""
    fresh = F.col("expires_at").isNull() | (F.col("expires_at") >= (F.current_timestamp() if now is None else now))
    code = codes.select(F.col("code").alias("beta"), (F.col("active") & fresh & (F.col("used_projects") < F.col("max_projects"))).alias("ok"))
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    rows = profiles.withColumn("beta", F.upper(F.trim("beta_code"))).join(code, "beta", "left")
    tax, phone = F.substring(digits(F.col("tax_id")), 1, 14), F.substring(digits(F.col("whatsapp")), 1, 11)
    mask = F.when(F.length(tax) == 11, F.regexp_replace(tax, "^(.{3})(.{3})(.{3})(.{2})$", "$1.$2.$3-$4")).when(F.length(tax) == 14, F.regexp_replace(tax, "^(.{2})(.{3})(.{3})(.{4})(.{2})$", "$1.$2.$3/$4-$5"))
    shown = F.when(F.length(phone) > 6, F.regexp_replace(phone, "^(.{2})(.{5})(.*)$", "($1) $2-$3")).when(F.length(phone) > 2, F.regexp_replace(phone, "^(.{2})(.*)$", "($1) $2")).otherwise(F.regexp_replace(phone, "^(.+)$", "($1"))
    return rows.select("user_id", (F.length(digits(F.col("whatsapp"))) >= 10).alias("phone_ok"), shown.alias("phone_masked"), F.length(tax).isin(11, 14).alias("tax_ok"), mask.alias("tax_masked"), F.coalesce("ok", F.lit(False)).alias("invite_ok"))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Target with source rows inserted or updated by key; later source rows win, other columns keep the target's."""
    columns = [c for c in source.columns if c not in (*keys, order)]
    last = source.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("new"))
    joined = target.join(last, keys, "full")
    return joined.select(*keys, *[(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)) if c in columns else F.col(c)).alias(c) for c in target.columns if c not in keys])


def patch(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Given columns where the key is equal; null changes leave the old value."""
    columns = [c for c in changes.columns if c != key]
    joined = target.join(changes.select(key, F.struct(*columns).alias("new")), key, "left")
    return joined.select(*[(F.coalesce(F.col(f"new.{c}"), F.col(c)) if c in columns else F.col(c)).alias(c) for c in target.columns])


def merge_project_data(sheets: DataFrame) -> DataFrame:
    """Per job over its sheets in priority order: the last areas, workstations and departments that say something, the first name, address and architect, notes, rooms and kept elements one after the other.

    sheets: job_id, priority, seq and ``project`` (``payload.answer``). A job of several sheets is named by their number.
    """
    o, p = F.struct("priority", "seq"), lambda c: F.col(f"project.{c}")
    last = {c: F.max_by(p(c), F.when(p(c) > 0, o)) for c in ("total_area", "layout_area", "no_intervention_area", "workstations")}
    first = {c: F.min_by(p(c), F.when(F.coalesce(p(c), F.lit("")) != "", o)) for c in ("name", "address", "architect")}
    lists = {c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("priority", "seq", F.coalesce(p(c), F.array().cast("array<string>")).alias("v")))), lambda x: x["v"])) for c in ("demolition_notes", "new_rooms", "kept_elements")}
    out = sheets.groupBy("job_id").agg(F.count("*").alias("sheets"), F.max_by(p("departments"), F.when(F.size(p("departments")) > 0, o)).alias("departments"), *[e.alias(c) for c, e in {**last, **first, **lists}.items()])
    many = F.concat(F.lit("Quantitativos — "), F.col("sheets").cast("string"), F.lit(" arquivos processados"))
    return out.withColumn("name", F.when(F.col("sheets") > 1, many).otherwise(F.col("name")))

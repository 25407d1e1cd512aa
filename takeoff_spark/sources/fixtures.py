"""Adapters: the jobs' tables derived from the test tables, as one SQL text for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings conversations".split()

DESCRIPTIONS = (
    *(f"Demarcação de área departamento {x}" for x in ("Contabilidade", "Financeira", "Marketing", "RH")), "Alvenaria tijolo cerâmico 9x14x19", "Execução de alvenaria nova",
    "LED LINE pendurada tipo A", "LED LINE tipo A encastrada", "LED LINE linear tipo A", "Porta de madeira PM-01 80x210", "Porta de vidro PV-01 90x210", "Porta de emergência P-EM 100x210",
    "Rodapé de madeira natural", "Carpete de parede em salas fechadas", "Forro mineral modular", "Forro de gesso liso", "Pintura acrílica Branco Neve", "Pintura acrílica acetinada",
    "Luminária de emergência", "Tomada 2P+T piso elevado", "Piso vinílico novo", "Sprinkler pendente", "Limpeza final de obra", "Perfil linear alumínio",
)
ITEM_DISCIPLINES = (
    *["Complementares"] * 4, *["Fechamentos Verticais"] * 2, *["Iluminação"] * 3, *["Portas e Ferragens"] * 3, *["Pisos e Rodapés"] * 2, *["Forros"] * 2, *["Revestimentos"] * 2,
    "Iluminação", "Instalações Elétricas e Dados", "Pisos e Rodapés", "Prevenção e Combate a Incêndio", "Serviços Preliminares", "Complementares",
)
LAYERS = ("A-WALL-INT", "04-PAREDES_DRYWALL", "FOR-GESSO", "LUM-01", "LEV-MFR", "FOR-MFR", "xref1|A-PISO", "DEM-ALV", "0", "ELE-TOM")
BLOCKS = ("PM3", "porta_PM1", "lum-R4", "lum. R5 remanejada", "WIN-02", "JN1", "TAG-porta", "ANNO_Section_A2", "AREA3", "A$C6BFD6B53", "*U12", "base.dwg", "CHNIVP", "BLOCO1", "spk-01", "tomada dupla")
SHEETS = ("100. demolir", "200. layout novo", "201. layout atual", "300. mobiliario", "301. marcenaria", "400. arquitetura", "500. pontos", "600. piso", "700. forro", "701. det forro", "det forro", "fachada", "corte", "LAYOUT NOVO")
UNITS = ("un", "ml", "m²", "m", "vb")


def pick(index: str, values: tuple) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"

SQL = {
    "projects": """SELECT CAST(floor(o_orderkey / 25) AS BIGINT) AS job_id, o_custkey AS user_id,
        CASE WHEN CAST(floor(o_orderkey / 25) AS BIGINT) % 7 = 0 THEN NULL ELSE concat('obra ', CAST(CAST(floor(o_orderkey / 25) AS BIGINT) AS VARCHAR(20))) END AS project_name,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'office' WHEN '2-HIGH' THEN 'residential' WHEN '3-MEDIUM' THEN 'retail' WHEN '5-LOW' THEN 'educational' ELSE 'hospital' END AS typology,
        CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'processing' END AS status,
        round(o_totalprice / 1000, 2) AS total_area, CASE WHEN CAST(floor(o_orderkey / 25) AS BIGINT) % 5 = 0 THEN 0.0 ELSE round(o_totalprice / 1250, 2) END AS layout_area, o_orderdate AS created_at
        FROM orders WHERE o_orderkey % 25 = 0""",
    "items_raw": f"""SELECT CAST(floor(l_orderkey / 25) AS BIGINT) AS job_id, CAST(row_number() OVER (PARTITION BY floor(l_orderkey / 25) ORDER BY {ORDER}) AS BIGINT) AS seq,
        l_partkey % 24 AS dx, * FROM lineitem""",
    "budget_items": f"""SELECT job_id, seq, concat(CAST(1 + dx % 16 AS VARCHAR(9)), '.', CAST(l_linenumber AS VARCHAR(9))) AS item_num, {pick('dx', DESCRIPTIONS)} AS description,
        CASE WHEN dx < 4 THEN 'm²' ELSE {pick('l_suppkey % 5', UNITS)} END AS unit,
        CASE WHEN dx < 4 THEN 0.72 WHEN l_suppkey % 11 = 0 THEN CAST(l_quantity AS DOUBLE) + 0.11 ELSE CAST(l_quantity AS DOUBLE) END AS quantity, '' AS observations, concat('Pr.', CAST(l_linenumber AS VARCHAR(9))) AS ref_sheet,
        CASE l_returnflag WHEN 'A' THEN 'confirmado' WHEN 'N' THEN 'estimado' ELSE 'verificar' END AS confidence, {pick('dx', ITEM_DISCIPLINES)} AS discipline, l_partkey, l_suppkey FROM items_raw""",
    "budget_revised": """SELECT job_id, seq, CASE WHEN l_partkey % 5 = 0 THEN concat('9', item_num) ELSE item_num END AS item_num, CASE WHEN l_partkey % 15 = 0 THEN concat(description, ' rev') ELSE description END AS description,
        unit, CASE WHEN l_partkey % 3 = 1 THEN quantity * 1.1 ELSE quantity END AS quantity, observations, ref_sheet, confidence, discipline FROM budget_items WHERE l_partkey % 10 <> 9""",
    "catalog_capitulo": "SELECT r_regionkey AS id, concat('cap_', CAST(r_regionkey AS VARCHAR(9))) AS code, r_name AS name FROM region",
    "catalog_grupo": "SELECT n_nationkey AS id, concat('gru_', CAST(n_nationkey AS VARCHAR(9))) AS code, n_name AS name, n_regionkey AS capitulo_id FROM nation",
    "catalog_familia": f"""SELECT s_suppkey AS id, concat('fam_', CAST(s_suppkey AS VARCHAR(9))) AS code, s_name AS name, {pick('s_suppkey % 5', UNITS)} AS typical_unit, {pick('s_suppkey % 24', DESCRIPTIONS)} AS words, s_nationkey AS grupo_id FROM supplier""",
    "price_catalog": f"""SELECT p_partkey AS seq, CASE p_partkey % 4 WHEN 0 THEN '-' WHEN 1 THEN NULL WHEN 2 THEN 'COMPOSICAO' ELSE 'INSUMO' END AS tipo_item, CAST(p_partkey AS VARCHAR(20)) AS codigo,
        concat({pick('p_partkey % 24', DESCRIPTIONS)}, ' ', p_name) AS descricao, {pick('p_size % 5', UNITS)} AS unidade, CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE p_partkey % 100 END AS familia_id FROM part
        UNION ALL SELECT p_partkey + 100000000, '-', CAST(p_partkey AS VARCHAR(20)), 'repetido', 'un', NULL FROM part WHERE p_partkey % 50 = 0""",
    "item_areas": """SELECT i.*, p.typology, CASE WHEN coalesce(p.layout_area, 0) <> 0 THEN p.layout_area ELSE coalesce(p.total_area, 0) END AS ref_area, p.total_area,
        CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_suppkey END AS familia_id FROM budget_items i JOIN projects p ON i.job_id = p.job_id""",
    "cad_files": "SELECT job_id AS file_id, CASE job_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN 6 WHEN 4 THEN 2 ELSE 99 END AS insunits, CAST(job_id % 2 AS INT) AS measurement FROM projects",
    "cad_lines": f"""SELECT job_id AS file_id, seq, {pick('l_suppkey % 10', LAYERS)} AS layer, l_extendedprice / 10 AS x1, CAST(l_quantity AS DOUBLE) AS y1, l_extendedprice / 10 + l_quantity * 100 AS x2, l_tax * 1000 AS y2,
        CAST(l_quantity AS DOUBLE) AS radius, (l_discount * 3600) % 360 AS start_deg, (l_tax * 3600) % 360 AS end_deg FROM items_raw""",
    "cad_blocks": f"""SELECT job_id AS file_id, seq, {pick('l_partkey % 16', BLOCKS)} AS name, {pick('l_suppkey % 10', LAYERS)} AS layer, l_extendedprice AS x, CAST(l_quantity AS DOUBLE) AS y, 1 + l_discount AS xscale, 1 + l_tax AS yscale, CAST(l_linenumber * 150 AS DOUBLE) AS ex, CAST(l_partkey % 15 * 150 AS DOUBLE) AS ey FROM items_raw""",
    "cad_dims": f"""SELECT job_id AS file_id, seq, {pick('l_suppkey % 10', LAYERS)} AS layer, CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '0' ELSE concat('L=', CAST(l_linenumber AS VARCHAR(9))) END AS label,
        CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_tax END AS measurement FROM items_raw""",
    "cad_texts": f"""SELECT doc_id % 20 AS file_id, doc_id AS seq, {pick('doc_id % 10', LAYERS)} AS layer, text FROM documents""",
    "sheets": f"SELECT doc_id % 50 AS job_id, doc_id AS seq, concat({pick('doc_id % 14', SHEETS)}, '-', CAST(doc_id AS VARCHAR(20)), '.pdf') AS filename, n_chars FROM documents",
    "messages": """SELECT concat('m', CAST(event_id - CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END AS VARCHAR(20))) AS mid, user_id AS sender_id, CASE WHEN event_type = 'error' THEN '' ELSE concat(event_type, ' ', coalesce(props, '')) END AS text,
        event_id AS seq, ts, event_type, value FROM events""",
    "sender_log": "SELECT conv_id % 20 AS sender_id, conv_id * 1000 + turn AS seq, role, text, CAST('2024-01-01' AS TIMESTAMP) + CAST((conv_id % 7) * 100 + turn AS INT) * INTERVAL '1' HOUR AS ts FROM conversations",
    "agent_runs": """SELECT CASE WHEN user_id % 13 = 0 THEN NULL ELSE user_id END AS job_id, event_id % 8 + 1 AS iterations, CAST(floor(value * 100) AS BIGINT) AS duration_ms, CASE WHEN event_type = 'error' THEN 'error' END AS error, ts AS created_at, event_id AS seq FROM events""",
    "profiles": """SELECT c_custkey AS user_id, substring(concat('55119', CAST(100000000 + c_custkey AS VARCHAR(20))), 1, CAST(9 + c_custkey % 4 AS INT)) AS whatsapp, substring(concat('12345', CAST(1000000000 + c_custkey AS VARCHAR(20))), 1, CASE c_custkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 11 ELSE 14 END) AS tax_id,
        concat('code', CAST(c_custkey % 30 AS VARCHAR(9))) AS beta_code FROM customer""",
    "invite_codes": """SELECT concat('CODE', CAST(n_nationkey AS VARCHAR(9))) AS code, n_nationkey % 4 <> 3 AS active, n_nationkey % 6 AS used_projects, 4 AS max_projects, CASE n_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST('2024-06-01' AS TIMESTAMP) ELSE CAST('2025-06-01' AS TIMESTAMP) END AS expires_at FROM nation""",
}
NEEDS = {"budget_items": ["items_raw"], "budget_revised": ["budget_items"], "item_areas": ["budget_items", "projects"], "cad_files": ["projects"], "cad_lines": ["items_raw"], "cad_blocks": ["items_raw"], "cad_dims": ["items_raw"]}


def half_up(x: str) -> str:
    """round(x, 2) of an amount as the oracle has it: of the double 100 * x. Spark's own takes the digits that x is written with, so that ties such as 104.345 differ."""
    return f"(floor(100 * ({x})) + CASE WHEN 100 * ({x}) - floor(100 * ({x})) >= 0.5 THEN 1 ELSE 0 END) / CAST(100 AS DOUBLE)"


#: Adapters that Spark has to write in another way for the same values.
SPARK_SQL = {
    "projects": re.sub(r"round\((o_totalprice / \d+), 2\)", lambda m: half_up(m[1]), SQL["projects"]),
    # The job as a column of its own below the window: its rows then count as dealt by job, and what follows by job needs no further shuffle.
    "items_raw": f"""SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY {ORDER}) AS BIGINT) AS seq, l_partkey % 24 AS dx, * EXCEPT (job_id)
        FROM (SELECT CAST(floor(l_orderkey / 25) AS BIGINT) AS job_id, * FROM lineitem)""",
}


def with_sql(*names: str, materialized: bool = False) -> str:
    """A WITH clause that defines the named adapters and what they need, for Spark; ``materialized``: as the oracle may write it."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' * materialized}({SQL[n] if materialized else SPARK_SQL.get(n, SQL[n])})" for n in order)


#: Items of a task where many steps by job follow one another, each with memory of its own.
ITEMS_A_TASK = 200_000


def fixture(spark: SparkSession, sf_dir: str, name: str, items_a_task: int | None = None) -> DataFrame:
    """An adapter's rows. ``items_a_task``: items are dealt by job to as many tasks as their number (from the files' footers) asks for, or the session's shuffles have if more."""
    for t in TABLES:
        if f" {t}" in with_sql(name):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    text = with_sql(name)
    if items_a_task:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-spark.table("lineitem").count() // items_a_task))
        text = text.replace("(SELECT CAST(floor(l_orderkey / 25)", f"(SELECT /*+ REPARTITION({tasks}, job_id) */ CAST(floor(l_orderkey / 25)")
    return spark.sql(f"{text} SELECT * FROM {name}")

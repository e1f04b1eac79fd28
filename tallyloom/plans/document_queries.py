"""Queries of the invoice pipelines, nested evaluation and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import evaluate, normalise, structure
from ..operators.normalise import Provider
from ..sources import invoices
from ..streaming import increments
from ..work import kept
from .base import Catalogue, Tables

C = Catalogue()

PROVIDERS = {
    "standard": (normalise.standard, Provider("Proveedor")),
    "dermofarm": (normalise.credit_notes, Provider("Dermofarm", ["Dermofarm S.A."], ("ABONO",))),
    "fedefarma": (normalise.literal_fusion, Provider("Proveedor", flags={"usar_literal": True}, tax_id=text.dashed_tax_id)),
    "suavinex": (normalise.split_quota, Provider("Proveedor", flags={"albaran_unico_abarca_factura": True})),
    "alliance": (
        normalise.literal_tables,
        Provider("Alliance Healthcare", ["Alliance"], flags={"factura_separada_inequivocamente": True, "pagos_parciales_o_fraccionamiento": False, "importes_vencimiento_distintos": False, "descuadre_total": False}),
    ),
}


def normalised(t: Tables, name: str) -> DataFrame:
    """The provider's example documents for every customer, normalised."""
    run, provider = PROVIDERS[name]
    return run(invoices.from_table(t.customer, "c_custkey", invoices.examples()[name]), provider)


#: What the examples come to, by document: total, rows of taxes, notes, adjustments and due dates, and incidents in their order.
RESULTS: dict[str, dict[str, tuple]] = {
    "standard": {
        "s1": ("126.20", (1, 0, 0, 1), "PREFIJO_PAIS_ELIMINADO"),
        "s2": ("130.00", (1, 0, 0, 1), "PREFIJO_PAIS_ELIMINADO ALBARANES_NO_INTERPRETABLES_POR_RUTA_ESTANDAR VALIDACION_MONETARIA_ERROR"),
        "s3": ("126.20", (1, 0, 0, 2), "TIPO_DOCUMENTO_NO_DEMOSTRADO PREFIJO_PAIS_ELIMINADO IMPORTE_VENCIMIENTO_NO_VISIBLE ESTRUCTURA_INCOMPLETA"),
    },
    "dermofarm": {
        "d1": ("-126.20", (1, 2, 0, 1), "PREFIJO_PAIS_ELIMINADO SIGNO_CONTABLE_APLICADO FILAS_FISCALES_COMPLEMENTARIAS_UNIFICADAS IMPORTES_ALBARAN_NO_VISIBLES"),
        "d2": ("126.20", (1, 0, 0, 1), "TIPO_DOCUMENTO_NO_DEMOSTRADO PROVEEDOR_NO_RECONOCIDO PREFIJO_PAIS_ELIMINADO ESTRUCTURA_INCOMPLETA"),
    },
    "fedefarma": {
        "f1": ("126.20", (1, 4, 1, 1), "TRAMO_FISCAL_SIN_IMPORTE_OMITIDO FILA_LITERAL_SIN_IDENTIFICADOR ALBARAN_SIN_FECHA_VISIBLE ALBARAN_SIN_IMPORTE_VISIBLE MARCADORES_ALBARAN_AMBIGUOS DUPLICADO_CONFLICTIVO_PRIORIZADO_LITERAL IDENTIFICADOR_ALBARAN_DUPLICADO ABONO_RECLASIFICADO_COMO_ALBARAN"),
        "f2": ("126.20", (1, 1, 0, 1), ""),
    },
    "suavinex": {
        "x1": ("126.20", (1, 1, 0, 1), "PREFIJO_PAIS_ELIMINADO CUOTA_FISCAL_AGREGADA_SEPARADA FORMA_PAGO_NO_ES_NOTA_VENCIMIENTO REFERENCIA_PEDIDO_BLOQUEADA_COMO_DESCRIPCION_ALBARAN IMPORTES_ASOCIADOS_A_ALBARAN_UNICO"),
        "x2": ("126.20", (0, 2, 0, 1), "PREFIJO_PAIS_ELIMINADO CUOTA_FISCAL_AGREGADA_NO_CUADRA RELACION_IMPORTES_ALBARAN_NO_DEMOSTRADA RELACION_IMPORTES_ALBARAN_NO_DEMOSTRADA VALIDACION_MONETARIA_NO_EVALUABLE"),
        "x3": ("126.20", (0, 0, 0, 1), "PREFIJO_PAIS_ELIMINADO ESTRUCTURA_FISCAL_SUAVINEX_NO_DEMOSTRADA VALIDACION_MONETARIA_NO_EVALUABLE"),
    },
    "alliance": {
        "a1": ("126.20", (1, 3, 1, 1), "PREFIJO_PAIS_ELIMINADO FILA_LITERAL_INCOMPLETA FILA_LITERAL_INCOMPLETA ORDEN_RECONSTRUIDO ESTRUCTURA_INCOMPLETA"),
        "a2": ("126.20", (1, 0, 0, 2), "PROVEEDOR_NO_RECONOCIDO PREFIJO_PAIS_ELIMINADO SERVICIO_BASICO_INCOMPLETO REGLA_VENCIMIENTO_UNICO_NO_APLICABLE IMPORTE_VENCIMIENTO_NO_VISIBLE IMPORTE_VENCIMIENTO_NO_VISIBLE"),
    },
}


def result_sql(name: str) -> str:
    rows = ", ".join(f"('{d}', {total}, {', '.join(map(str, sizes))}, '{kinds}')" for d, (total, sizes, kinds) in RESULTS[name].items())
    return f"""SELECT d || '-' || CAST(c_custkey AS VARCHAR) AS doc_id, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS numero_factura, CAST(total AS DECIMAL(14,2)) AS importe_total, impuestos, albaranes, ajustes, vencimientos, incidencias
FROM customer, (VALUES {rows}) v(d, total, impuestos, albaranes, ajustes, vencimientos, incidencias)"""


def add_pipeline(name: str) -> None:
    @C.add(f"pipeline_{name}", result_sql(name) if name in RESULTS else None)
    def run(t: Tables) -> DataFrame:
        kinds = F.concat_ws(" ", F.transform("incidencias", lambda i: i["tipo_incidencia"]))
        return normalised(t, name).select("doc_id", "numero_factura", "importe_total", *(F.size(b).alias(b) for b in ("impuestos", "albaranes", "ajustes", "vencimientos")), kinds.alias("incidencias"))


for _name in PROVIDERS:
    add_pipeline(_name)


@C.add(
    "pipeline_orders_as_invoices",
    """WITH r AS (SELECT l_orderkey, CAST(round(l_tax * 100) AS DECIMAL(4,0)) AS tipo, sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS base FROM lineitem GROUP BY 1, 2),
x AS (SELECT l_orderkey, CAST(sum(base) AS DECIMAL(14,2)) AS base, CAST(sum(round(base * tipo * CAST(0.01 AS DECIMAL(3,2)), 2)) AS DECIMAL(14,2)) AS iva, count(*) AS tramos FROM r GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS numero_factura, CAST(o_orderdate AS DATE) AS fecha_factura, base AS base_imponible_total, iva AS iva_total,
  CAST(tramos AS INTEGER) AS tramos, CASE WHEN o_orderkey % 10 = 0 THEN 'ERROR' ELSE 'OK' END AS total, 'OK' AS iva FROM orders JOIN x ON l_orderkey = o_orderkey""",
)
def orders(t: Tables) -> DataFrame:
    """The standard way over all orders: nested rows built, checked and taken apart again."""
    done = normalise.standard(invoices.from_orders(t.orders, t.lineitem), Provider("cliente 1"))
    state = lambda i: F.col("validaciones")[i]["resultado"]["estado"]
    return done.select("doc_id", "numero_factura", "fecha_factura", "base_imponible_total", F.col("iva_total").alias("iva_total"), F.size("impuestos").alias("tramos"), state(0).alias("total"), state(1).alias("iva"))


@C.add("evidence_gate", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lang END AS valor FROM documents")
def evidence(t: Tables) -> DataFrame:
    """Values with and without valid evidence."""
    proof = lambda *texts: F.array(*(F.struct(F.lit(x).cast("string").alias("texto_visible"), F.lit(None).cast("int").alias("pagina")) for x in texts))
    by = F.col("doc_id") % 4
    full = F.when(by == 0, proof("a", "b")).when(by == 1, proof("a", " ")).when(by == 2, F.slice(proof("a"), 1, 0))
    f = F.struct(F.col("lang").alias("valor"), full.alias("evidencias"))
    return t.documents.select("doc_id", f.alias("f")).select("doc_id", rules.evidenced(F.col("f")).alias("valor"))


@C.add(
    "eval_nested_invoices",
    f"""WITH r(d, total, impuestos) AS (VALUES {", ".join(f"('{d}', {x[0]}, {x[1][0]})" for d, x in RESULTS["suavinex"].items())}), k AS (SELECT *, d || '-' || CAST(c_custkey AS VARCHAR) AS doc_id FROM customer, r)
SELECT doc_id, 'numero_factura' AS ruta, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS esperado, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS obtenido, 'CORRECTO' AS estado FROM k
UNION ALL SELECT doc_id, 'importe_total', rtrim(CAST(CAST(total AS DECIMAL(14,1)) AS VARCHAR), '0'), rtrim(CAST(CAST(total + 1 AS DECIMAL(14,1)) AS VARCHAR), '0'), 'INCORRECTO' FROM k
UNION ALL SELECT doc_id, CASE WHEN impuestos = 0 THEN 'impuestos' ELSE 'impuestos[0].base_imponible' END, CASE WHEN impuestos = 0 THEN '[]' ELSE '100' END, CASE WHEN impuestos = 0 THEN '[]' ELSE '100' END, 'CORRECTO' FROM k""",
)
def nested(t: Tables) -> DataFrame:
    """Two versions of normalised invoices flattened to paths and compared; shown are the number, the total and the taxes' base or emptiness."""
    gold = normalised(t, "suavinex").select("doc_id", F.struct("numero_factura", "importe_total", F.transform("impuestos", lambda x: F.struct(x["base_imponible"].alias("base_imponible"))).alias("impuestos")).alias("f"))
    # Flattening reads its source once a leaf, so the invoices are normalised once and written.
    gold = kept(gold, "gold")
    got = gold.withColumn("f", F.col("f").withField("importe_total", F.col("f.importe_total") + 1))
    a, b = (evaluate.atoms(x, "doc_id", "f") for x in (gold, got))
    return evaluate.compare(a, b, ["doc_id", "ruta"])


@C.add("stream_available_now_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream(t: Tables) -> DataFrame:
    """Events that arrive twice, through a stream into an idempotent table."""
    return increments.dedup_stream(t.spark, f"{t.sf_dir}/events.parquet", ["event_id", "user_id", "event_type"], ["event_id"])


#: Orders as finished invoices with faults: blocks out of order, wrong pages, missing fields.
@C.add(
    "structure_invoice_errors",
    """WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'pagina_inicio debe ser igual o superior a 1.' END AS a, CASE WHEN o_custkey % 3 < o_orderkey % 7 THEN 'pagina_fin no puede ser anterior a pagina_inicio.' END AS b,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Falta tipo_documento.' END AS c, CASE WHEN o_orderkey % 5 = 0 THEN 'Falta numero_factura.' END AS d, CASE o_orderkey % 6 WHEN 0 THEN 'Falta destinatario.' WHEN 1 THEN 'Falta destinatario.id_farmacia.' END AS f,
  CASE WHEN o_orderkey % 9 = 0 AND n > 0 THEN 'impuestos tiene órdenes incorrectos: [' || array_to_string(range(2, n + 2), ', ') || ']. Se esperaba [' || array_to_string(range(1, n + 1), ', ') || '].' END AS g FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, unnest(list_filter([a, b, c, d, f, g], lambda x: x IS NOT NULL)) AS mensaje FROM e""",
)
def invoice_errors(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("int").alias("n"))
    key = F.col("o_orderkey")
    places = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct((i + F.when(key % 9 == 0, 1).otherwise(0)).alias("orden")))
    made = t.orders.join(lines, "o_orderkey", "left").select(
        "o_orderkey", (key % 7).alias("pagina_inicio"), (F.col("o_custkey") % 3).alias("pagina_fin"), F.when(key % 4 != 0, "FACTURA").alias("tipo_documento"), F.lit("p").alias("proveedor_nombre"),
        F.when(key % 5 == 0, "").otherwise(key.cast("string")).alias("numero_factura"), F.when(key % 6 != 0, F.struct(F.when(key % 6 != 1, "0007").alias("id_farmacia"))).alias("destinatario"),
        F.when(F.col("n") > 0, places).alias("impuestos"), *(F.lit(None).cast("array<struct<orden:int>>").alias(b) for b in ("vencimientos", "albaranes", "ajustes")),
    )
    return made.select("o_orderkey", F.explode(structure.invoice_errors(F.col)).alias("mensaje"))


#: Customers as documents of orders: the expected number of invoices is wrong for some, some have no name, some share one.
NAME = "CASE WHEN c_custkey % 11 = 0 THEN ' ' WHEN c_custkey % 13 < 2 THEN 'doc-' || CAST(c_custkey // 13 AS VARCHAR) ELSE c_name END"


@C.add(
    "structure_document_errors",
    f"""WITH k AS (SELECT o_custkey, o_orderkey % 5 = 0 AS bad, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
d AS (SELECT c_custkey, {NAME} AS archivo, coalesce(n, 0) AS n, CASE WHEN c_custkey % 3 = 0 THEN coalesce(n, 0) + 1 ELSE coalesce(n, 0) END AS esperados, c_custkey % 8 AS paginas FROM customer LEFT JOIN n ON o_custkey = c_custkey),
m AS (SELECT archivo, 1 AS a, 0 AS b, c_custkey, 'El documento no tiene nombre de archivo.' AS mensaje FROM d WHERE trim(archivo) = '' UNION ALL SELECT archivo, 2, 0, c_custkey, archivo || ': numero_paginas debe ser superior a 0.' FROM d WHERE paginas < 1
  UNION ALL SELECT archivo, 3, 0, c_custkey, archivo || ': cantidad_documentos_esperados=' || esperados || ', pero contiene ' || n || ' facturas.' FROM d WHERE esperados <> n
  UNION ALL SELECT archivo, 4, i, c_custkey, archivo || ' - factura ' || i || ': Falta numero_factura.' FROM d JOIN k ON o_custkey = c_custkey WHERE bad)
SELECT archivo, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY a, b) AS INTEGER) AS posicion, mensaje FROM m""",
)
def document_errors(t: Tables) -> DataFrame:
    errors = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: F.when(k % 5 == 0, F.array(F.lit(structure.MISSING["numero_factura"]))).otherwise(F.array().cast("array<string>")))
    lists = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(errors.alias("errores_facturas"))
    n = F.coalesce(F.size("errores_facturas"), F.lit(0))
    docs = t.customer.join(lists, "c_custkey", "left").select(F.expr(NAME.replace("VARCHAR", "STRING").replace("//", "div")).alias("archivo"), (F.col("c_custkey") % 8).alias("numero_paginas"), F.when(F.col("c_custkey") % 3 == 0, n + 1).otherwise(n).alias("cantidad_documentos_esperados"), "errores_facturas")
    return structure.document_errors(docs)


@C.add("structure_repeated_names", f"""WITH d AS (SELECT {NAME} AS archivo FROM customer) SELECT archivo, count(*) AS veces, 'Documento duplicado en el patrón: ' || archivo AS mensaje FROM d GROUP BY 1 HAVING count(*) > 1""")
def repeated_names(t: Tables) -> DataFrame:
    return structure.repeated_names(t.customer.select(F.expr(NAME.replace("VARCHAR", "STRING").replace("//", "div")).alias("archivo")))


@C.add(
    "pipeline_envelope",
    """WITH r AS (SELECT l_orderkey, CAST(round(l_tax * 100) AS DECIMAL(4,0)) AS tipo, sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS base FROM lineitem GROUP BY 1, 2), x AS (SELECT l_orderkey, CAST(sum(base) AS DECIMAL(14,2)) AS base FROM r GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'estandar_v1' AS version, '2026-01-02T03:04:05+00:00' AS fecha, 'pedido-' || CAST(o_orderkey AS VARCHAR) || '.pdf' AS archivo, base AS base_imponible_total, 'luna_general' AS procedencia, '0007' AS id_farmacia, 2 AS validaciones,
  CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS revisiones FROM orders JOIN x ON l_orderkey = o_orderkey""",
)
def enveloped(t: Tables) -> DataFrame:
    """All orders as normalised invoices with version, instant, source, provenance and settings around them."""
    done = normalise.standard(invoices.from_orders(t.orders, t.lineitem), Provider("cliente 1"))
    made = structure.envelope(done, "estandar_v1", {"impuestos": "luna_general"}, {"farmacia": "FARMACIA", "destinatario_id_farmacia": "0007"}, F.concat(F.lit("pedido-"), "doc_id", F.lit(".pdf")), F.lit("2026-01-02 03:04:05").cast("timestamp"))
    r = F.col("resultado")
    failed = F.size(F.filter("incidencias", lambda i: i["tipo_incidencia"] == "VALIDACION_MONETARIA_ERROR"))
    return made.select(
        "doc_id", r["version_normalizador"].alias("version"), r["fecha_ejecucion"].alias("fecha"), r["archivo_origen"].alias("archivo"), r["resultado_normalizado"]["base_imponible_total"].alias("base_imponible_total"), r["procedencia_bloques"]["impuestos"].alias("procedencia"),
        r["configuracion_interna_aplicada"]["destinatario_id_farmacia"].alias("id_farmacia"), F.size(r["validaciones_monetarias"]).alias("validaciones"), failed.alias("revisiones"),
    )

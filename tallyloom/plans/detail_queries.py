"""Queries of engine results and of small operators: first pages, divisions, flags, lenient numbers, latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, rules, text
from ..operators import catalog, engines, trees
from .base import Catalogue, Tables
from .catalog_queries import META, columns

C = Catalogue()

#: Orders as files: some are gone, some folders, some of another kind.
PATH = "'entrada/' || CAST(o_orderkey AS VARCHAR) || CASE o_orderkey % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' ELSE '.pdf' END"


@C.add(
    "engine_results",
    f"""WITH f AS (SELECT *, {PATH} AS ruta FROM orders), r AS (SELECT *, split_part(ruta, '/', 2) AS archivo, o_orderkey % 5 AS paginas, o_orderkey % 3 AS facturas FROM f),
e AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 'ARCHIVO_NO_ENCONTRADO' WHEN o_orderkey % 13 = 0 THEN 'RUTA_NO_ES_ARCHIVO' WHEN o_orderkey % 4 = 0 THEN 'FORMATO_NO_ADMITIDO' WHEN o_orderkey % 7 < 2 THEN 'ERROR_PROCESAMIENTO' WHEN paginas < 1 OR facturas <> 1 THEN 'RESULTADO_INVALIDO' END AS codigo FROM r)
SELECT ruta, archivo, codigo IS NULL AS procesado_correctamente, CASE WHEN codigo IS NULL OR codigo = 'RESULTADO_INVALIDO' THEN paginas END AS paginas, codigo,
  CASE codigo WHEN 'ARCHIVO_NO_ENCONTRADO' THEN 'No se encuentra el archivo: ' || ruta WHEN 'RUTA_NO_ES_ARCHIVO' THEN 'La ruta no corresponde a un archivo: ' || ruta WHEN 'FORMATO_NO_ADMITIDO' THEN 'El archivo debe tener extensión PDF: ' || archivo
    WHEN 'ERROR_PROCESAMIENTO' THEN 'El motor no ha podido procesar el documento.' WHEN 'RESULTADO_INVALIDO' THEN CASE WHEN paginas < 1 THEN archivo || ': numero_paginas debe ser superior a 0.' ELSE archivo || ': cantidad_documentos_esperados=1, pero contiene ' || facturas || ' facturas.' END END AS mensaje,
  CASE WHEN codigo = 'ERROR_PROCESAMIENTO' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'LookupError: sin respuesta' ELSE 'TimeoutError: timed out' END END AS detalle,
  CASE WHEN codigo IS NULL THEN 0 WHEN codigo = 'RESULTADO_INVALIDO' THEN (paginas < 1)::INT + (facturas <> 1)::INT ELSE 1 END AS errores FROM e""",
)
def engine_results(t: Tables) -> DataFrame:
    """A simulated engine: its answers are a table; some files have none, some a failure, some a document that contradicts itself."""
    key = F.col("o_orderkey")
    files = t.orders.select(key, F.expr(PATH.replace("VARCHAR", "STRING")).alias("ruta"), (key % 11 != 0).alias("existe"), (key % 13 != 0).alias("es_archivo"))
    failed = key % 7 == 1
    got = files.filter("o_orderkey % 7 <> 0").select(
        "ruta", F.when(~failed, F.lit("{}")).alias("documento"), F.when(~failed, (key % 5).cast("int")).alias("paginas"), F.lit(1).alias("esperadas"), (key % 3).cast("int").alias("facturas"),
        F.lit("0.01").cast("decimal(18,6)").alias("coste"), F.lit("0.9").cast("decimal(6,4)").alias("confianza"), F.when(failed, "TimeoutError: timed out").alias("fallo"),
    )
    made = engines.results(files, got, "simulado", "patron", "1")
    first = F.get("errores", F.lit(0))
    return made.select("ruta", "archivo", "procesado_correctamente", "paginas", first["codigo"].alias("codigo"), first["mensaje"].alias("mensaje"), first["detalle"].alias("detalle"), F.size("errores").alias("errores"))


@C.add("evidence_first_page", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 5 = 0 THEN 2 WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS BIGINT) AS pagina FROM orders")
def first_page(t: Tables) -> DataFrame:
    """The page of the first evidence of the first field that has one, by the fields' priority."""
    key = F.col("o_orderkey")
    proof = lambda page: F.array(F.struct(page.cast("int").alias("pagina")), F.struct(F.lit(99).alias("pagina")))
    none = F.lit(None).cast("int")
    row = F.struct(
        F.struct(F.when(key % 3 == 0, proof(F.lit(1))).otherwise(proof(none)).alias("evidencias")).alias("numero_albaran"), F.struct(F.when(key % 5 == 0, proof(F.lit(2))).alias("evidencias")).alias("fecha_albaran"),
        F.when(key % 7 != 0, F.struct(proof(F.col("o_custkey")).alias("evidencias"))).alias("importe_total"),
    )
    return t.orders.select("o_orderkey", row.alias("r")).select("o_orderkey", rules.first_page(F.col("r"), "numero_albaran", "fecha_albaran", "importe_total").cast("long").alias("pagina"))


@C.add("division_ranges", "SELECT o_orderkey, o_custkey % 3 = 0 AS coinciden FROM orders")
def divisions(t: Tables) -> DataFrame:
    """Page lists of a splitter's entities against the divisions expected; a missing page is the first."""
    doc = F.concat(F.lit('{"entities":[{"page_anchor":{"page_refs":[{},{"page":"1"}]}},{"pageAnchor":{"pageRefs":[{"page":'), F.when(F.col("o_custkey") % 3 == 0, "2").otherwise("3"), F.lit("}]}}]}"))
    docs = t.orders.select("o_orderkey", F.parse_json(doc).alias("doc"))
    return docs.select("o_orderkey", trees.divided(F.col("doc"), [(1, 2), (3, 3)]).alias("coinciden"))


@C.add(
    "catalog_search_ranked",
    f"""SELECT esquema, tabla, CAST(row_number() OVER (ORDER BY CASE WHEN lower(tabla) = 'venta1' THEN 0 ELSE 1 END, esquema, tabla) AS INTEGER) AS puesto FROM (SELECT DISTINCT esquema, tabla FROM ({META}) WHERE lower(tabla) LIKE '%venta1%')""",
)
def ranked(t: Tables) -> DataFrame:
    """Tables whose name has a text, the one of just this name first."""
    return catalog.ranked_search(columns(t), "Venta1")


@C.add(
    "dedup_six_columns",
    """SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey % 5, l_linenumber, l_returnflag, l_linestatus, l_tax, l_discount ORDER BY l_orderkey, l_partkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1""",
)
def dedup(t: Tables) -> DataFrame:
    """Of rows equal in six columns the first by order, part and price; the least struct of each group, without a window."""
    row = F.min(F.struct("l_orderkey", "l_partkey", "l_extendedprice")).alias("r")
    return t.lineitem.groupBy((F.col("l_suppkey") % 5).alias("s"), "l_linenumber", "l_returnflag", "l_linestatus", "l_tax", "l_discount").agg(row).select("r.l_orderkey", "r.l_partkey")


@C.add("latest_per_partition", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def latest(t: Tables) -> DataFrame:
    """Each customer's row with the greatest number."""
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.max_by("o_orderstatus", "o_orderkey").alias("o_orderstatus"))


#: Numbers as found in transcriptions, rates and plain decimals.
LENIENT = """CASE o_orderkey % 5 WHEN 0 THEN replace(x, '.', ',') || ' €' WHEN 1 THEN x WHEN 2 THEN '1.0' || replace(x, '.', ',') WHEN 3 THEN 'x' || x END"""
RATE = "CASE o_orderkey % 4 WHEN 0 THEN '21' WHEN 1 THEN ' 5.2 ' WHEN 2 THEN 'NaN' ELSE '1000000' END"


@C.add(
    "numbers_lenient",
    f"""WITH w AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) AS x FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(x AS DECIMAL(14,2)) WHEN 1 THEN CAST(x AS DECIMAL(14,2)) WHEN 2 THEN CAST('10' || x AS DECIMAL(14,2)) END AS importe, CASE o_orderkey % 4 WHEN 0 THEN CAST(21 AS DECIMAL(6,3)) WHEN 1 THEN 5.2 END AS tipo,
  o_orderkey % 4 > 1 AS tipo_error, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(x AS DECIMAL(14,2)) END AS simple, o_orderkey % 3 = 0 AS simple_error FROM w""",
)
def lenient(t: Tables) -> DataFrame:
    x = F.col("o_totalprice").cast(numbers.MONEY).cast("string")
    said = t.orders.select("o_orderkey", x.alias("x")).select("o_orderkey", F.expr(LENIENT).alias("a"), F.expr(RATE).alias("r"), F.when(F.col("o_orderkey") % 3 == 0, F.concat("x", F.lit("!"))).otherwise(F.concat(F.lit(" "), "x")).alias("p"))
    rate, plain = numbers.percentage(F.col("r")), numbers.plain_decimal(F.col("p"))
    return said.select("o_orderkey", numbers.lenient_amount(F.col("a")).alias("importe"), rate["value"].alias("tipo"), rate["error"].alias("tipo_error"), plain["value"].alias("simple"), plain["error"].alias("simple_error"))


@C.add(
    "shown_values",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'NULL' WHEN length(text) > 300 THEN substr(text, 1, 297) || '...' ELSE text END AS texto, '<BINARIO: ' || octet_length(encode(text)) || ' bytes>' AS binario, CASE WHEN doc_id % 3 = 0 THEN 'SI' ELSE 'NO' END AS multiplo FROM documents""",
)
def shown_values(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.shown(F.when(F.col("doc_id") % 5 != 0, F.col("text"))).alias("texto"), text.shown_binary(F.col("text").cast("binary")).alias("binario"), text.yes_no(F.col("doc_id") % 3 == 0).alias("multiplo"))


@C.add(
    "unmet_preconditions",
    """SELECT o_orderkey, list_filter(['abierto', 'cliente_par', 'sin_dato'], lambda x: CASE x WHEN 'abierto' THEN o_orderstatus <> 'O' WHEN 'cliente_par' THEN o_custkey % 2 <> 0 ELSE TRUE END) AS incumplidas FROM orders""",
)
def unmet(t: Tables) -> DataFrame:
    """The names of flags that aren't exactly true."""
    flags = F.create_map(F.lit("abierto"), F.col("o_orderstatus") == "O", F.lit("cliente_par"), F.col("o_custkey") % 2 == 0, F.lit("sin_dato"), F.lit(None).cast("boolean"))
    return t.orders.select("o_orderkey", F.map_keys(rules.unmet(flags)).alias("incumplidas"))


@C.add("sorted_path_sets", "SELECT user_id, list_sort(list(DISTINCT 'campo[' || (event_id % 12) || '].' || event_type)) AS rutas FROM events GROUP BY 1")
def sorted_paths(t: Tables) -> DataFrame:
    """Each user's set of paths in a fixed order."""
    path = F.concat(F.lit("campo["), (F.col("event_id") % 12).cast("string"), F.lit("]."), "event_type")
    return t.events.groupBy("user_id").agg(F.sort_array(F.collect_set(path)).alias("rutas"))


@C.add(
    "union_of_columns",
    "SELECT c_custkey AS clave, CAST(NULL AS VARCHAR) AS dir, c_name AS nombre, 'c' AS origen FROM customer UNION ALL SELECT s_suppkey, 'x', s_name, NULL FROM supplier",
)
def union_of_columns(t: Tables) -> DataFrame:
    """Rows of two shapes under the union of their columns, in the order of the names."""
    a = t.customer.select(F.lit("c").alias("origen"), F.col("c_custkey").alias("clave"), F.col("c_name").alias("nombre"))
    b = t.supplier.select(F.col("s_name").alias("nombre"), F.col("s_suppkey").alias("clave"), F.lit("x").alias("dir"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.select(*sorted(both.columns))

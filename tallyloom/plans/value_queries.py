"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text
from .base import Catalogue, Tables

C = Catalogue()


#: Fixed values of this query: month names in two languages, as people name folders by them.
FOLDER_MONTHS = ("Gener", "FEBRERO", "març", "Abril", "MAIG", "junio", "Juliol", "AGOSTO", "setembre", "Octubre", "novembre", "DICIEMBRE")


@C.add(
    "month_folder_date",
    f"""WITH f AS (SELECT o_orderkey, o_orderdate, {list(FOLDER_MONTHS)}[month(o_orderdate)] AS mes, year(o_orderdate) AS a FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN mes || '_' || CAST(a + 20 AS VARCHAR) WHEN 1 THEN CAST(a + 20 AS VARCHAR) || ' ' || mes WHEN 2 THEN mes WHEN 3 THEN 'facturas ' || CAST(a AS VARCHAR) ELSE upper(mes) || ' - ' || lpad(CAST((a + 20) % 100 AS VARCHAR), 2, '0') END AS carpeta,
  CASE WHEN o_orderkey % 5 NOT IN (2, 3) THEN CAST(date_trunc('month', o_orderdate) + INTERVAL 20 YEAR AS DATE) END AS mes FROM f""",
)
def month_folder(t: Tables) -> DataFrame:
    """Folders named after the months of orders, twenty years on; some without a month or a year."""
    name = F.element_at(F.array(*map(F.lit, FOLDER_MONTHS)), F.month("o_orderdate"))
    year = F.year("o_orderdate")
    said = (year + 20).cast("string")
    kind = F.col("o_orderkey") % 5
    folder = F.when(kind == 0, F.concat(name, F.lit("_"), said)).when(kind == 1, F.concat(said, F.lit(" "), name)).when(kind == 2, name).when(kind == 3, F.concat(F.lit("facturas "), year.cast("string"))).otherwise(F.concat(F.upper(name), F.lit(" - "), F.lpad(((year + 20) % 100).cast("string"), 2, "0")))
    return t.orders.select("o_orderkey", folder.alias("carpeta")).select("o_orderkey", "carpeta", numbers.month_folder_date(F.col("carpeta")).alias("mes"))


@C.add(
    "spanish_amount_parse",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(14,2)) AS importe FROM lineitem""",
)
def amount(t: Tables) -> DataFrame:
    """Prices written out with grouped thousands, a comma, and a sign behind, read back."""
    shown = F.format_number("l_extendedprice", 2)
    spanish = F.translate(shown, ",.", ".,")
    written = F.when(F.col("l_returnflag") == "R", F.concat(spanish, F.lit("-"))).otherwise(F.concat(spanish, F.lit(" €")))
    return numbers.with_amounts(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", written.alias("escrito")), importe=F.col("escrito")).select("l_orderkey", "l_linenumber", "l_partkey", "importe.value").withColumnRenamed("value", "importe")


#: A price written in ways that are and aren't amounts, as both engines say it.
WRITTEN = """CASE o_orderkey % 12 WHEN 0 THEN replace(x, '.', ',') WHEN 1 THEN '-' || replace(x, '.', ',') WHEN 2 THEN replace(x, '.', ',') || '- €' WHEN 3 THEN x WHEN 4 THEN '-' || replace(x, '.', ',') || '-' WHEN 5 THEN '0' || replace(x, '.', ',')
  WHEN 6 THEN '' WHEN 7 THEN NULL WHEN 8 THEN '€' WHEN 9 THEN replace(x, '.', ',') || '0' WHEN 10 THEN '+' || split_part(x, '.', 1) ELSE x || 'e2' END"""


@C.add(
    "spanish_amount_invalid",
    f"""WITH w AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) AS x FROM orders)
SELECT o_orderkey, {WRITTEN} AS escrito, CASE o_orderkey % 12 WHEN 0 THEN CAST(x AS DECIMAL(14,2)) WHEN 1 THEN -CAST(x AS DECIMAL(14,2)) WHEN 2 THEN -CAST(x AS DECIMAL(14,2)) WHEN 10 THEN CAST(split_part(x, '.', 1) AS DECIMAL(14,2)) END AS importe,
  o_orderkey % 12 IN (3, 4, 5, 8, 9, 11) AS error FROM w""",
)
def amount_invalid(t: Tables) -> DataFrame:
    written = t.orders.select("o_orderkey", F.col("o_totalprice").cast(numbers.MONEY).cast("string").alias("x")).select("o_orderkey", F.expr(WRITTEN).alias("escrito"))
    return numbers.with_amounts(written, leido=F.col("escrito")).select("o_orderkey", "escrito", F.col("leido.value").alias("importe"), F.col("leido.error").alias("error"))


@C.add("visible_date_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS fecha, o_orderkey % 5 = 0 AS error FROM orders")
def date(t: Tables) -> DataFrame:
    """Dates written day first, year first, and with slashes, which is an error."""
    d = F.col("o_orderdate")
    written = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(d, "dd/MM/yyyy")).when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "d-M-yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    got = numbers.visible_date(written)
    return t.orders.select("o_orderkey", got["value"].alias("fecha"), got["error"].alias("error"))


@C.add("swapped_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS fecha FROM orders")
def swapped(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", numbers.swapped_date(F.date_format("o_orderdate", "dd-MM-yyyy")).alias("fecha"))


@C.add("tax_quota_half_up", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(21 AS DECIMAL(4,0)) * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(14,2)) AS cuota FROM lineitem")
def quota(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", numbers.tax_quota(F.col("l_extendedprice"), F.lit(21)).alias("cuota"))


@C.add("credit_note_sign", "SELECT l_orderkey, l_partkey, CAST(CASE WHEN l_returnflag = 'R' THEN -abs(l_quantity) ELSE l_quantity END AS DECIMAL(14,2)) AS cantidad FROM lineitem")
def credit(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "ABONO").otherwise("FACTURA")
    return t.lineitem.select("l_orderkey", "l_partkey", numbers.credit_sign(kind, F.col("l_quantity").cast(numbers.MONEY)).alias("cantidad"))


@C.add(
    "token_cost",
    """SELECT conv_id, turn, CAST(round((CAST(greatest(length(text) - conv_id % 50, 0) AS DECIMAL(12,0)) * CAST(1.25 AS DECIMAL(10,4)) + CAST(conv_id % 50 AS DECIMAL(12,0)) * CAST(0.125 AS DECIMAL(10,4))
  + CAST(length(role) AS DECIMAL(12,0)) * CAST(10 AS DECIMAL(10,4))) * CAST(0.000001 AS DECIMAL(7,6)), 6) AS DECIMAL(18,6)) AS coste FROM conversations""",
)
def token_cost(t: Tables) -> DataFrame:
    cost = numbers.token_cost(F.length("text"), F.col("conv_id") % 50, F.length("role"), "1.25", "0.125", "10")
    return t.conversations.select("conv_id", "turn", cost.alias("coste"))


@C.add("spanish_money_text", "SELECT o_orderkey, replace(CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR), '.', ',') AS escrito FROM orders")
def money_text(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", numbers.spanish_text(F.col("o_totalprice")).alias("escrito"))


@C.add(
    "page_ranges",
    """WITH p AS (SELECT o_orderkey, o_orderkey % 4 AS a, o_custkey % 5 AS b, CASE WHEN o_custkey % 7 > 0 THEN o_custkey % 7 - 1 END AS n, o_orderkey % 6 AS k FROM orders), g AS (SELECT *, k > 1 AND a >= 1 AND b >= a AS dado FROM p)
SELECT o_orderkey, CAST(CASE WHEN dado THEN a WHEN n >= 1 THEN 1 END AS INTEGER) AS desde, CAST(CASE WHEN dado THEN b WHEN n >= 1 THEN n END AS INTEGER) AS hasta, NOT dado AND coalesce(n, 0) < 1 AS error FROM g""",
)
def pages(t: Tables) -> DataFrame:
    """Ranges of pages in and out of order, of one number, or none, with page counts that may be zero or unknown."""
    a, b = (F.col("o_orderkey") % 4).cast("int"), (F.col("o_custkey") % 5).cast("int")
    given = F.when(F.col("o_orderkey") % 6 == 0, F.array(a)).when(F.col("o_orderkey") % 6 > 1, F.array(a, b))
    count = F.when(F.col("o_custkey") % 7 > 0, (F.col("o_custkey") % 7 - 1).cast("int"))
    df = t.orders.select("o_orderkey", given.alias("paginas"), count.alias("total"))
    got = numbers.page_range(F.col("paginas"), F.col("total"))
    return df.select("o_orderkey", got["first"].alias("desde"), got["last"].alias("hasta"), got["error"].alias("error"))


#: A customer's tax id with and without the country, with blanks, of a person, and too short.
CIF = """CASE c_custkey % 6 WHEN 0 THEN 'ESA' || n WHEN 1 THEN 'es a' || substr(n, 1, 4) || ' ' || substr(n, 5) WHEN 2 THEN 'esB ' || substr(n, 7) WHEN 3 THEN 'ESX' || substr(n, 2) || 'A' WHEN 4 THEN ' A' || n || ' ' ELSE '' END"""


@C.add(
    "tax_id_prefix",
    f"""WITH c AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS n FROM customer)
SELECT c_custkey, {CIF} AS cif, CASE c_custkey % 6 WHEN 0 THEN 'A' || n WHEN 1 THEN 'A' || n WHEN 2 THEN 'esB ' || substr(n, 7) WHEN 3 THEN 'ESX' || substr(n, 2) || 'A' WHEN 4 THEN 'A' || n END AS limpio FROM c""",
)
def tax_id(t: Tables) -> DataFrame:
    ids = t.customer.select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("n")).select("c_custkey", F.expr(CIF).alias("cif"))
    return ids.select("c_custkey", "cif", text.spanish_tax_id(F.col("cif")).alias("limpio"))


#: An order's number behind labels of delivery notes, in forms that are and aren't the label's.
LABELLED = """CASE o_orderkey % 8 WHEN 0 THEN 'Albarán: ' || k WHEN 1 THEN 'ALBARAN ' || k || '/A' WHEN 2 THEN 'nº albarà: ' || k || ' b' WHEN 3 THEN 'No  ALBARÁN :' || k WHEN 4 THEN 'albarán:' WHEN 5 THEN k WHEN 6 THEN 'pedido: ' || k || ' albaran' ELSE ' ' END"""


@C.add(
    "note_number_label",
    f"""WITH n AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS k FROM orders)
SELECT o_orderkey, {LABELLED} AS visto, CASE o_orderkey % 8 WHEN 0 THEN k WHEN 1 THEN 'ALBARAN ' || k || '/A' WHEN 2 THEN k || ' b' WHEN 3 THEN k WHEN 4 THEN 'albarán:' WHEN 5 THEN k WHEN 6 THEN 'pedido: ' || k || ' albaran' END AS numero FROM n""",
)
def note_label(t: Tables) -> DataFrame:
    said = t.orders.select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 6, "0").alias("k")).select("o_orderkey", F.expr(LABELLED).alias("visto"))
    return said.select("o_orderkey", "visto", text.note_number(F.col("visto")).alias("numero"))


@C.add("provider_alias", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN s_name ELSE 'Alliance Healthcare' END AS proveedor FROM supplier")
def alias(t: Tables) -> DataFrame:
    said = F.when(F.col("s_suppkey") % 3 == 0, "  ALLIANCE   healthcare ").when(F.col("s_suppkey") % 3 == 1, "Alliance  H.").otherwise(F.col("s_name"))
    return t.supplier.select("s_suppkey", text.canonical_name(said, {"Alliance Healthcare": ["Alliance H."]}).alias("proveedor"))


#: What a failed event may say.
SAID = """CASE event_id % 5 WHEN 0 THEN 'Read timed out after ' || CAST(user_id AS VARCHAR) || ' s' WHEN 1 THEN 'HTTP 503 on ' || event_type WHEN 2 THEN 'Broken PIPE' WHEN 3 THEN '23505 duplicate ' || event_type ELSE NULL END"""


@C.add("retryable_errors", f"SELECT event_id, {SAID} AS mensaje, CASE event_id % 5 WHEN 3 THEN FALSE WHEN 4 THEN NULL ELSE TRUE END AS reintentar FROM events WHERE event_type = 'error'")
def retryable(t: Tables) -> DataFrame:
    said = t.events.filter("event_type = 'error'").select("event_id", F.expr(SAID.replace("VARCHAR", "STRING")).alias("mensaje"))
    return said.select("event_id", "mensaje", text.is_retryable(F.col("mensaje")).alias("reintentar"))


@C.add("array_slice_last", "SELECT vec_id, embedding[-3:] AS ultimos, embedding[-1] AS ultimo, list_concat(embedding[1:3], embedding[-1:]) AS extremos FROM embeddings")
def slices(t: Tables) -> DataFrame:
    e = F.col("embedding")
    last = F.element_at(e, -1)
    return t.embeddings.select("vec_id", F.slice(e, -3, 3).alias("ultimos"), last.alias("ultimo"), F.concat(F.slice(e, 1, 3), F.array(last)).alias("extremos"))


@C.add(
    "nested_table_cells",
    """SELECT doc_id, CAST(fila AS INTEGER) AS fila, CAST(columna AS INTEGER) AS columna, celda FROM (
SELECT doc_id, fila, unnest(celdas) AS celda, generate_subscripts(celdas, 1) - 1 AS columna FROM (
SELECT doc_id, fila, string_split(linea, ' | ') AS celdas FROM (SELECT doc_id, unnest(l) AS linea, generate_subscripts(l, 1) - 1 AS fila FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) WHERE len(celdas) = 5)""",
)
def cells(t: Tables) -> DataFrame:
    """Lines of text as rows, bars between cells; only rows of five cells count."""
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("fila", "linea"))
    five = rows.withColumn("celdas", F.split("linea", r" \| ")).filter(F.size("celdas") == 5)
    return five.select("doc_id", "fila", F.posexplode("celdas").alias("columna", "celda"))


@C.add("json_props_flatten", "SELECT event_id, 'k' AS ruta, CAST(json_extract_string(props, '$.k') AS BIGINT) AS valor FROM events")
def props(t: Tables) -> DataFrame:
    """JSON of unknown keys as paths and values, through variant."""
    each = t.events.select("event_id", F.try_parse_json("props").alias("v"))
    each.createOrReplaceTempView("props_variant")
    return t.spark.sql("SELECT event_id, key AS ruta, try_variant_get(value, '$', 'bigint') AS valor FROM props_variant, LATERAL variant_explode(v)")


@C.add("text_simplify_equal", "SELECT doc_id, TRUE AS iguales FROM documents")
def simplify(t: Tables) -> DataFrame:
    """Documents whose text equals its shouted, doubly spaced form under a collation that ignores case and marks."""
    shouted = F.replace(F.upper("text"), F.lit(" "), F.lit("  "))
    return t.documents.select("doc_id", text.same_text(F.col("text"), shouted).alias("iguales"))


@C.add("redacted_props", "SELECT event_id, concat('{\"token\": \"***\", \"k\": ', CAST(user_id AS VARCHAR), '}') AS json FROM events")
def redacted(t: Tables) -> DataFrame:
    raw = F.concat(F.lit('{"token": "abc'), F.col("event_id").cast("string"), F.lit('", "k": '), F.col("user_id").cast("string"), F.lit("}"))
    return t.events.select("event_id", text.redacted(raw).alias("json"))

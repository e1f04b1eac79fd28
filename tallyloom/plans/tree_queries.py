"""Queries of trees of unknown shape and of pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pairing, trees
from .base import Catalogue, Tables

C = Catalogue()

#: An event as a tree: its number, type and properties, so many levels down as its id says, beside nulls and texts; every seventh has a decoy.
#: The depth is at most 2 * 4 + 3.
TREE = """repeat('{"hijos":[null,', CAST(event_id % 5 AS INTEGER)) || '{"numero":"' || CAST(event_id AS VARCHAR) || '","tipo":"' || event_type || '","de que":' || props || ',"vacio":[],"decoy":{"numero":'
  || CASE WHEN event_id % 7 = 0 THEN CAST(event_id AS VARCHAR) ELSE '"-"' END || '}}' || repeat(',"fin"]}', CAST(event_id % 5 AS INTEGER))"""


def event_trees(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.expr(f"parse_json({TREE.replace('VARCHAR', 'STRING')})").alias("arbol"), F.col("event_id").cast("string").alias("numero"))


NODES = f"""WITH RECURSIVE w AS (
  SELECT event_id, 0 AS nivel, '' AS ruta, CAST(NULL AS VARCHAR) AS clave, CAST({TREE} AS JSON) AS v FROM events
  UNION ALL
  SELECT event_id, nivel + 1, CASE WHEN json_type(v) = 'ARRAY' THEN ruta || '[' || e.key || ']' WHEN e.key = 'de que' THEN ruta || '["de que"]' WHEN ruta = '' THEN e.key ELSE ruta || '.' || e.key END,
    CASE WHEN json_type(v) = 'OBJECT' THEN e.key END, e.value
  FROM w, LATERAL (SELECT * FROM json_each(w.v)) e WHERE json_type(v) IN ('OBJECT', 'ARRAY'))"""


@C.add(
    "tree_walk",
    NODES + """ SELECT event_id, nivel, ruta, clave, CASE json_type(v) WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'NULL' THEN 'VOID' ELSE json_type(v) END AS tipo,
  CASE WHEN json_type(v) NOT IN ('OBJECT', 'ARRAY') THEN v ->> '$' END AS texto FROM w""",
)
def tree_walk(t: Tables) -> DataFrame:
    nodes = trees.walk(event_trees(t), ["event_id"], "arbol")
    return nodes.select("event_id", "nivel", "ruta", "clave", "tipo", trees.scalar_text(F.col("nodo"), F.col("tipo")).alias("texto"))


@C.add("tree_find_only", NODES + """ SELECT event_id, CAST(event_id AS VARCHAR) AS numero, ruta, v ->> '$.tipo' AS tipo FROM w WHERE json_type(v) = 'OBJECT' AND json_type(v, '$.numero') = 'VARCHAR' AND v ->> '$.numero' = CAST(event_id AS VARCHAR)""")
def tree_find_only(t: Tables) -> DataFrame:
    """Where in each tree the one object with the event's number is; a number that is no text isn't it."""
    found = trees.find_only(event_trees(t), ["event_id"], "arbol", "numero", "numero")
    return found.select("event_id", "numero", "ruta", F.try_variant_get(trees.member(F.col("nodo"), "tipo"), "$", "string").alias("tipo"))


#: An order as a processed document: two entities a priority, the first with a property that has one in turn; pages from 0, missing for the first.
DOCUMENT = """'{"entities":[{"type":"pedido","mentionText":"' || CAST(o_orderkey AS VARCHAR) || '","pageAnchor":{"pageRefs":[{"page":' || CAST(o_custkey % 4 AS VARCHAR) || '},{}]},"properties":[{"type_":"cliente","mention_text":"'
  || CAST(o_custkey AS VARCHAR) || '","page_anchor":{"page_refs":[{"page":"1"}]},"properties":[{"type":"estado","mentionText":"' || o_orderstatus || '"}]}]},{"type":"prioridad","mentionText":"' || o_orderpriority || '"}]}'"""


@C.add(
    "tree_entities",
    """SELECT o_orderkey, 0 AS nivel, [0] AS ruta, 'pedido' AS tipo, CAST(o_orderkey AS VARCHAR) AS texto, CASE WHEN o_custkey % 4 = 0 THEN [1] ELSE [1, o_custkey % 4 + 1] END AS paginas FROM orders
UNION ALL SELECT o_orderkey, 1, [0, 0], 'cliente', CAST(o_custkey AS VARCHAR), [2] FROM orders UNION ALL SELECT o_orderkey, 2, [0, 0, 0], 'estado', o_orderstatus, [] FROM orders UNION ALL SELECT o_orderkey, 0, [1], 'prioridad', o_orderpriority, [] FROM orders""",
)
def tree_entities(t: Tables) -> DataFrame:
    docs = t.orders.select("o_orderkey", F.expr(f"parse_json({DOCUMENT.replace('VARCHAR', 'STRING')})").alias("doc"))
    return trees.entities(docs, ["o_orderkey"], "doc")


#: A recognised order: a typed value in either spelling, one that is null before one that isn't, or the content only.
FIELDS = """'{"Total":{"value_number":null,"valueCurrency":' || CAST(o_custkey AS VARCHAR) || ',"content":"x","confidence":0.5},"Estado":{"content":"' || o_orderstatus || '"},"Clave":{"value_string":"' || CAST(o_orderkey AS VARCHAR) || '","confidence":0.25}}'"""


@C.add(
    "tree_field_picks",
    """SELECT o_orderkey, 'Total' AS campo, CAST(o_custkey AS VARCHAR) AS valor, 0.5::DOUBLE AS confianza FROM orders UNION ALL SELECT o_orderkey, 'Estado', o_orderstatus, NULL FROM orders
UNION ALL SELECT o_orderkey, 'Clave', CAST(o_orderkey AS VARCHAR), 0.25 FROM orders UNION ALL SELECT o_orderkey, 'Fecha', NULL, NULL FROM orders""",
)
def tree_field_picks(t: Tables) -> DataFrame:
    docs = t.orders.select("o_orderkey", F.expr(f"parse_json({FIELDS.replace('VARCHAR', 'STRING')})").alias("doc"))
    return trees.picked(docs, ["o_orderkey"], "doc", ["Total", "Estado", "Clave", "Fecha"])


def due_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    """An order's lines as expected ones by line number, and as obtained ones without each fifth part, dearest first."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast("decimal(14,2)").alias("importe"))
    got = rows.filter("l_partkey % 5 <> 0").withColumn("l_linenumber", (100 - F.col("l_linenumber")).cast("int"))
    more = rows.filter("l_partkey % 6 = 0").withColumn("l_linenumber", (200 + F.col("l_linenumber")).cast("int"))
    return rows, got.unionByName(more)


SIDES = """WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(14,2)) AS importe FROM lineitem),
o AS (SELECT l_orderkey, 100 - l_linenumber AS l_linenumber, l_partkey, importe FROM e WHERE l_partkey % 5 <> 0 UNION ALL SELECT l_orderkey, 200 + l_linenumber, l_partkey, importe FROM e WHERE l_partkey % 6 = 0),
a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, importe) AS indice FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, importe) AS indice FROM o),
z AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, CAST(coalesce(a.indice, b.indice) AS INTEGER) AS indice, a.l_partkey AS esperada, b.l_partkey AS obtenida, a.importe AS importe_esperado, b.importe AS importe_obtenido
  FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.indice = b.indice)"""


@C.add("pair_by_place", SIDES + " SELECT * FROM z")
def pair_by_place(t: Tables) -> DataFrame:
    pairs = pairing.by_place(*due_sides(t), ["l_orderkey"], ["l_linenumber"])
    return pairs.select("l_orderkey", "indice", F.col("a.l_partkey").alias("esperada"), F.col("b.l_partkey").alias("obtenida"), F.col("a.importe").alias("importe_esperado"), F.col("b.importe").alias("importe_obtenido"))


@C.add(
    "pair_arrays",
    SIDES.replace("100 - l_linenumber", "l_linenumber").replace("ORDER BY l_linenumber, l_partkey, importe", "ORDER BY l_partkey, importe") + " SELECT l_orderkey, indice, esperada, obtenida FROM z",
)
def pair_arrays(t: Tables) -> DataFrame:
    """The same by arrays: an order's few lines are collected on each side, sorted by part."""
    sides = [x.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_partkey", "importe"))), lambda r: r["l_partkey"]).alias(name)) for x, name in zip(due_sides(t), "ab")]
    both = sides[0].join(sides[1], "l_orderkey", "full").select("l_orderkey", F.explode(pairing.padded_zip(F.col("a"), F.col("b"))).alias("p"))
    return both.select("l_orderkey", "p.indice", F.col("p.a").alias("esperada"), F.col("p.b").alias("obtenida"))


@C.add("unique_lookup", "SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey")
def unique_lookup(t: Tables) -> DataFrame:
    """The one customer of each order, or an error."""
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    return pairing.only_match(t.orders.select("o_orderkey", "o_custkey"), customers, ["o_custkey"])

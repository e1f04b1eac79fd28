"""Queries of the catalog analytics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog
from .base import Catalogue, Tables

C = Catalogue()

#: A small ERP-like catalog: schema, table, column, type, place, primary key, unique.  Every supplier has one, its number behind the names.
ERP = [
    ("dbo", "Proveedor", "IdProveedor", "int", 1, True, False), ("dbo", "Proveedor", "Nombre", "varchar", 2, False, False),
    ("dbo", "Albaran", "IdContador", "int", 1, True, False), ("dbo", "Albaran", "XProv_IdProveedor", "int", 2, False, False),
    ("dbo", "Albaran", "Fecha", "datetime", 3, False, False), ("dbo", "Articu", "IdArticu", "char", 1, True, False),
    ("dbo", "LineaAlbaran", "IdLinea", "int", 1, True, False), ("dbo", "LineaAlbaran", "XArt_IdArticu", "varchar", 2, False, False),
    ("dbo", "LineaAlbaran", "IdAlbaran", "int", 3, False, False), ("ven", "Venta", "IdVenta", "bigint", 1, True, False),
    ("ven", "LineaVenta", "IdVenta", "int", 1, False, False), ("ven", "LineaVenta", "CodVendedor", "int", 2, False, False),
    ("ven", "Vendedor", "IdVendedor", "smallint", 1, False, True), ("ven", "VendedorHist", "IdVendedor", "int", 1, True, False),
    ("ven", "Cobro", "FkVenta", "decimal", 1, False, False), ("ven", "Cobro", "IdProveedor", "int", 2, False, False),
]
OFFICIAL = [("VEN", "cobro", "idproveedor", "dbo", "proveedor", "IDPROVEEDOR")]
EDGE = "esquema_o string, tabla_o string, columna_o string, esquema_d string, tabla_d string, columna_d string"


def values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join(f"({', '.join(str(x).upper() if isinstance(x, bool) else repr(x) for x in r)})" for r in rows)


META = f"SELECT esquema, tabla || CAST(s_suppkey AS VARCHAR) AS tabla, columna || CAST(s_suppkey AS VARCHAR) AS columna, tipo, orden, es_pk, es_unica FROM supplier, ({values(ERP)}) v(esquema, tabla, columna, tipo, orden, es_pk, es_unica)"
MEANING = "regexp_replace(CASE WHEN {p} LIKE 'id_%' THEN substr({p}, 3) WHEN {p} LIKE 'oid_%' THEN substr({p}, 4) WHEN {p} LIKE 'codigo_%' THEN substr({p}, 7) WHEN {p} LIKE 'cod_%' THEN substr({p}, 4) WHEN {p} LIKE 'fk_%' THEN substr({p}, 3) ELSE {p} END, '[^a-z0-9]', '', 'g')"


def meaning(c: str) -> str:
    return MEANING.format(p=f"regexp_extract(lower(trim({c})), '[^_]*$')")


def for_suppliers(t: Tables, rows: list[tuple], ddl: str, numbered: tuple[str, ...]) -> DataFrame:
    """The rows for every supplier, whose number stands behind some columns."""
    names = [x.split()[0] for x in ddl.split(", ")]
    each = t.supplier.select("s_suppkey", F.explode(F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), f"array<struct<{ddl.replace(', ', ',').replace(' ', ':')}>>")).alias("r"))
    return each.select(*(F.concat(F.col(f"r.{n}"), F.col("s_suppkey").cast("string")).alias(n) if n in numbered else F.col(f"r.{n}").alias(n) for n in names))


@C.add("catalog_columns", f"{META}")
def columns(t: Tables) -> DataFrame:
    return for_suppliers(t, ERP, catalog.COLUMNS, ("tabla", "columna"))


@C.add("catalog_search_name", f"SELECT DISTINCT esquema, tabla FROM ({META}) WHERE lower(esquema) LIKE '%vend%' OR lower(tabla) LIKE '%vend%'")
def search_name(t: Tables) -> DataFrame:
    return catalog.search_objects(columns(t), "VEND")


@C.add("catalog_of_tables", "SELECT table_name AS tabla, count(*) AS columnas FROM information_schema.columns WHERE table_name IN ('nation', 'region', 'customer') GROUP BY 1")
def of_tables(t: Tables) -> DataFrame:
    """The catalog of real tables, from their schemas alone."""
    rows = catalog.columns_of({n: getattr(t, n) for n in ("nation", "region", "customer")}, {"nation": "n_nationkey"})
    return catalog.metadata(t.spark, rows).groupBy("tabla").agg(F.count("*").alias("columnas"))


@C.add(
    "catalog_star_join",
    """SELECT c.c_custkey, s.s_suppkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey JOIN supplier s ON s.s_nationkey = n.n_nationkey WHERE c.c_acctbal > 8000""",
)
def star_join(t: Tables) -> DataFrame:
    c = t.customer.filter("c_acctbal > 8000")
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(place, F.col("c_nationkey") == F.col("n_nationkey")).join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).select("c_custkey", "s_suppkey", "n_name", "r_name")


@C.add(
    "catalog_self_join_aliases",
    """SELECT a.n_name AS origen, b.n_name AS destino FROM customer c JOIN nation a ON c.c_nationkey = a.n_nationkey
JOIN orders o ON o.o_custkey = c.c_custkey JOIN supplier s ON s.s_suppkey = o.o_orderkey % 10 JOIN nation b ON s.s_nationkey = b.n_nationkey""",
)
def self_join(t: Tables) -> DataFrame:
    """The same table twice, as origin and as target."""
    a, b = t.nation.alias("a"), t.nation.alias("b")
    left = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(a, F.col("c_nationkey") == F.col("a.n_nationkey"))
    return left.join(t.supplier, F.col("s_suppkey") == F.col("o_orderkey") % 10).join(b, F.col("s_nationkey") == F.col("b.n_nationkey")).select(F.col("a.n_name").alias("origen"), F.col("b.n_name").alias("destino"))


@C.add(
    "catalog_left_on_predicate",
    "SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber IN (0, 1)",
)
def left_on(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, (F.col("o_orderkey") == F.col("l_orderkey")) & F.col("l_linenumber").isin(0, 1), "left").select("o_orderkey", "l_linenumber", "l_quantity")


@C.add(
    "catalog_theta_self_join",
    "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
)
def theta(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@C.add("catalog_official_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@C.add("catalog_key_semi", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def semi(t: Tables) -> DataFrame:
    return t.part.join(t.lineitem.filter("l_quantity > 49"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@C.add("catalog_single_col_key", "SELECT l_orderkey, l_linenumber FROM lineitem a WHERE (SELECT count(*) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey) = 1")
def single(t: Tables) -> DataFrame:
    """Rows that are alone under their key: one aggregate and a semi-join instead of a subquery a row."""
    alone = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).filter("n = 1").select("l_orderkey")
    return t.lineitem.join(alone, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@C.add("relation_name_normalise", f"SELECT DISTINCT columna, {meaning('columna')} AS significado FROM ({META})")
def names(t: Tables) -> DataFrame:
    return columns(t).select("columna", text.relation_meaning(F.col("columna")).alias("significado")).distinct()


@C.add(
    "relation_score_best",
    f"""WITH m AS (SELECT *, {meaning('columna')} AS s, {meaning('tabla')} AS st, CASE WHEN tipo IN ('int', 'bigint', 'smallint') THEN 'int' WHEN tipo IN ('char', 'varchar') THEN 'text' ELSE tipo END AS f
  FROM ({META}) WHERE lower(columna) NOT IN ({', '.join(repr(x) for x in catalog.GENERIC)})),
p AS (SELECT o.esquema AS esquema_o, o.tabla AS tabla_o, o.columna AS columna_o, d.esquema AS esquema_d, d.tabla AS tabla_d, d.columna AS columna_d, d.es_pk,
  least(100, CASE WHEN d.es_pk THEN 50 ELSE 40 END + 20 + CASE WHEN o.s = d.st THEN 30 WHEN d.st <> '' AND contains(o.s, d.st) THEN 20 WHEN o.s <> '' AND contains(d.st, o.s) THEN 10 ELSE 0 END) AS puntos
  FROM m o JOIN m d ON o.s = d.s AND o.f = d.f AND (o.esquema <> d.esquema OR o.tabla <> d.tabla) WHERE NOT (o.es_pk OR o.es_unica) AND (d.es_pk OR d.es_unica) AND o.s <> ''
  AND NOT (lower(o.tabla) LIKE 'cobro%' AND lower(o.columna) LIKE 'idproveedor%' AND lower(d.tabla) LIKE 'proveedor%')),
r AS (SELECT *, row_number() OVER (PARTITION BY esquema_o, tabla_o, columna_o ORDER BY puntos DESC, es_pk DESC, length(tabla_d), lower(tabla_d) DESC) AS n FROM p)
SELECT esquema_o, tabla_o, columna_o, esquema_d, tabla_d, columna_d, puntos, CASE WHEN puntos >= 95 THEN 'MUY ALTA' WHEN puntos >= 85 THEN 'ALTA' ELSE 'MEDIA' END AS confianza
FROM r WHERE n = 1 AND puntos >= 80""",
)
def relations(t: Tables) -> DataFrame:
    return catalog.probable_relations(columns(t), for_suppliers(t, OFFICIAL, EDGE, ("tabla_o", "columna_o", "tabla_d", "columna_d")))


@C.add("dict_counts", "SELECT count(*) AS n, count(*) FILTER (p_size > 25) AS grandes, count(DISTINCT p_brand) AS marcas, count(DISTINCT (p_brand, p_type)) AS pares, max(length(p_name)) AS ancho FROM part")
def counts(t: Tables) -> DataFrame:
    return t.part.agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("grandes"), F.countDistinct("p_brand").alias("marcas"), F.countDistinct("p_brand", "p_type").alias("pares"), F.max(F.length("p_name")).cast("long").alias("ancho"))


@C.add("dict_table_rows", "SELECT 'nation' AS tabla, count(*) AS filas FROM nation UNION ALL SELECT 'orders', count(*) FROM orders")
def table_rows(t: Tables) -> DataFrame:
    from ..sources.files import row_counts

    return row_counts(t.spark, {n: f"{t.sf_dir}/{n}.parquet" for n in ("nation", "orders")})


@C.add("dict_distinct_groups", "SELECT DISTINCT l_returnflag, l_linestatus, CAST(l_linenumber AS INTEGER) AS l_linenumber FROM lineitem")
def distinct_groups(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@C.add("dict_sums", "SELECT l_returnflag, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS filas FROM lineitem GROUP BY 1")
def sums(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.coalesce(F.sum(F.col("l_quantity").cast("long")), F.lit(0)).alias("filas"))


@C.add(
    "dict_rendered_types",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'varchar(' || p_size || ')' WHEN 1 THEN 'nvarchar(' || p_size || ')' WHEN 2 THEN 'varbinary(MAX)' WHEN 3 THEN 'decimal(' || (p_size % 20 + 10) || ',' || p_partkey % 4 || ')' ELSE 'int' END AS escrito FROM part""",
)
def rendered(t: Tables) -> DataFrame:
    """Column types as a dictionary writes them, one a part: a wide character takes two bytes, -1 is without limit."""
    kind = F.element_at(F.array(*map(F.lit, ("varchar", "nvarchar", "varbinary", "decimal", "int"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    length = F.when(kind == "nvarchar", F.col("p_size") * 2).when(kind == "varbinary", -1).otherwise(F.col("p_size")).cast("int")
    return t.part.select("p_partkey", text.rendered_type(kind, length, (F.col("p_size") % 20 + 10).cast("int"), (F.col("p_partkey") % 4).cast("int")).alias("escrito"))


@C.add(
    "fk_label_concat",
    """SELECT l_orderkey, string_agg(concat(CAST(l_partkey AS VARCHAR), ' -> ', CAST(l_suppkey AS VARCHAR)), ' | ' ORDER BY l_linenumber, concat(CAST(l_partkey AS VARCHAR), ' -> ', CAST(l_suppkey AS VARCHAR))) AS etiqueta
FROM lineitem GROUP BY 1""",
)
def labels(t: Tables) -> DataFrame:
    return catalog.edge_labels(t.lineitem, ["l_orderkey"], "l_partkey", "l_suppkey", "l_linenumber")


@C.add("group_sets", "SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS prioridades, bool_or(o_orderstatus = 'F') AS alguno, bool_and(o_orderstatus = 'F') AS todos FROM orders GROUP BY 1")
def sets(t: Tables) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    return t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("prioridades"), F.bool_or(done).alias("alguno"), F.bool_and(done).alias("todos"))

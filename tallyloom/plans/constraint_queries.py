"""Queries of columns, keys, indexes and foreign keys, declared and held against the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import constraints
from ..operators.constraints import ForeignKey, Index
from .base import Catalogue, Tables

C = Catalogue()
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

INDEXES = [
    Index("nation", "PK_nation", ("n_nationkey",), primary=True), Index("customer", "PK_customer", ("c_custkey",), primary=True), Index("orders", "PK_orders", ("o_orderkey",), primary=True),
    Index("orders", "IX_orders_cliente", ("o_custkey", "-o_orderdate"), ("o_totalprice",)), Index("lineitem", "UQ_lineitem", ("l_orderkey", "l_linenumber"), unique=True), Index("lineitem", "IX_lineitem_part", ("l_partkey", "-l_shipdate", "l_suppkey"), ("l_quantity", "l_tax")),
]
KEYS = [
    ForeignKey("FK_orders_customer", "orders", ("o_custkey",), "customer", ("c_custkey",), "CASCADE"), ForeignKey("FK_customer_nation", "customer", ("c_nationkey",), "nation", ("n_nationkey",), "SET_NULL", "CASCADE"),
    ForeignKey("FK_lineitem_orders", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",), "CASCADE"), ForeignKey("FK_lineitem_previa", "lineitem", ("l_orderkey", "l_linenumber"), "previas", ("l_orderkey", "l_linenumber")),
]


def tables(t: Tables) -> dict[str, DataFrame]:
    """The tables, and earlier lines: those of odd parts, without their key in some."""
    key = F.when(F.col("l_partkey") % 5 != 0, F.col("l_orderkey")).alias("l_orderkey")
    return {n: getattr(t, n) for n in NAMES} | {"previas": t.lineitem.filter("l_partkey % 2 = 1").select(key, "l_linenumber")}


def columns_sql() -> str:
    """Of each column the rows and nulls."""
    columns = {
        "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
        "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "events": "event_id ts user_id event_type value props",
    }
    return " UNION ALL ".join(f"SELECT '{t}' AS tabla, {i} AS orden, '{c}' AS columna, TRUE AS admite_nulos, FALSE AS identidad, FALSE AS calculada, count(*) AS filas, count(*) - count({c}) AS nulos FROM {t}" for t, cs in columns.items() for i, c in enumerate(cs.split(), 1))


@C.add("catalog_describe_columns", columns_sql())
def describe_columns(t: Tables) -> DataFrame:
    some = {n: df for n, df in tables(t).items() if n in ("region", "nation", "customer", "orders", "lineitem", "events")}
    rows = constraints.columns(t.spark, some).join(constraints.profile(some), ["tabla", "columna"])
    return rows.select("tabla", "orden", "columna", "admite_nulos", "identidad", "calculada", "filas", "nulos")


def key_sql(i: Index) -> str:
    keys = [constraints.bare(c) for c in i.columns]
    whole = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    shown = ", ".join(f"{constraints.bare(c)} DESC" if c.startswith("-") else c for c in i.columns)
    return f"""SELECT '{i.table}' AS tabla, '{i.name}' AS indice, '{shown}' AS clave, {f"'{', '.join(i.included)}'" if i.included else 'NULL'} AS incluidas, {i.unique or i.primary} AS unico, {i.primary} AS primario, CAST(sum(n) AS BIGINT) AS filas, count(*) FILTER ({whole}) AS valores,
  CAST(coalesce(sum(n - 1) FILTER ({whole}), 0) AS BIGINT) AS repetidas, CAST(coalesce(sum(n) FILTER (NOT ({whole})), 0) AS BIGINT) AS sin_valor FROM (SELECT {', '.join(keys)}, count(*) AS n FROM {i.table} GROUP BY ALL)"""


@C.add("catalog_indexes_checked", " UNION ALL ".join(map(key_sql, INDEXES)))
def indexes_checked(t: Tables) -> DataFrame:
    """Declared keys and indexes, ordered, with descending and carried columns, and how far the data are unique in them."""
    return constraints.indexes(t.spark, INDEXES).join(constraints.checked_keys(tables(t), INDEXES), ["tabla", "indice"])


def fk_sql(k: ForeignKey) -> str:
    on = " AND ".join(f"a.{x} = b.{y}" for x, y in zip(k.columns, k.to_columns))
    none = " OR ".join(f"a.{x} IS NULL" for x in k.columns)
    pairs = " | ".join(f"{k.table}.{x} -> {k.to}.{y}" for x, y in zip(k.columns, k.to_columns))
    ways = ["SALIENTE"] * (k.table == "orders") + ["ENTRANTE"] * (k.to == "orders")
    return " UNION ALL ".join(
        f"SELECT '{way}' AS sentido, '{k.name}' AS fk, '{k.table}' AS origen, '{k.to}' AS destino, '{pairs}' AS columnas, '{k.on_delete}' AS al_borrar, '{k.on_update}' AS al_actualizar, count(*) AS filas, count(*) FILTER ({none}) AS sin_valor, count(*) FILTER (NOT ({none}) AND NOT EXISTS (SELECT 1 FROM {k.to} b WHERE {on})) AS huerfanas FROM {k.table} a"
        for way in ways
    )


@C.add("catalog_foreign_keys_of", " UNION ALL ".join(filter(None, map(fk_sql, KEYS))))
def foreign_keys_of(t: Tables) -> DataFrame:
    """What goes out from orders and what comes in, with actions, rows and orphans."""
    return constraints.foreign_keys(t.spark, KEYS, "orders").join(constraints.checked_foreign_keys(tables(t), KEYS), "fk")


@C.add(
    "catalog_foreign_key_orphans",
    """WITH p AS (SELECT DISTINCT CASE WHEN l_partkey % 5 <> 0 THEN l_orderkey END AS k, l_linenumber AS n FROM lineitem WHERE l_partkey % 2 = 1)
SELECT 'FK_lineitem_previa' AS fk, count(*) AS filas, 0 AS sin_valor, count(*) FILTER (p.k IS NULL) AS huerfanas FROM lineitem LEFT JOIN p ON p.k = l_orderkey AND p.n = l_linenumber
UNION ALL SELECT 'FK_previa_lineitem', count(*), count(*) FILTER (l_partkey % 5 = 0), 0 FROM lineitem WHERE l_partkey % 2 = 1""",
)
def orphans(t: Tables) -> DataFrame:
    """A key of two columns that many rows don't find, and one with nulls, which refer to nothing and so aren't orphans."""
    back = ForeignKey("FK_previa_lineitem", "previas", ("l_orderkey", "l_linenumber"), "lineitem", ("l_orderkey", "l_linenumber"))
    return constraints.checked_foreign_keys(tables(t), [KEYS[3], back])

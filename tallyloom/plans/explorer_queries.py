"""Queries of the explorer: eleven operators, previews, frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import explorer
from ..operators.explorer import SearchSpec
from .base import Catalogue, Tables

C = Catalogue()

#: One query an operator: table, column, operator, value, SQL condition.
SEARCHES = [
    ("eq", "customer", "c_mktsegment", "BUILDING", "c_mktsegment = 'BUILDING'"),
    ("ne", "customer", "c_mktsegment", "BUILDING", "c_mktsegment <> 'BUILDING'"),
    ("contains", "part", "p_type", "eco", "upper(p_type) LIKE '%ECO%'"),
    ("startswith", "part", "p_type", "pro", "upper(p_type) LIKE 'PRO%'"),
    ("endswith", "part", "p_brand", "#13", "upper(p_brand) LIKE '%#13'"),
    ("gt", "lineitem", "l_quantity", 45.0, "l_quantity > 45"),
    ("lt", "lineitem", "l_quantity", 3.0, "l_quantity < 3"),
    ("ge", "orders", "o_custkey", 100, "o_custkey >= 100"),
    ("le", "supplier", "s_suppkey", 5, "s_suppkey <= 5"),
]


def add_search(op: str, name: str, column: str, value: object, condition: str) -> None:
    @C.add(f"explorer_{op}", f"SELECT * FROM {name} WHERE {condition}")
    def run(t: Tables) -> DataFrame:
        return explorer.matches(getattr(t, name), SearchSpec(column, op, value))


for _s in SEARCHES:
    add_search(*_s)


def with_nulls(t: Tables) -> DataFrame:
    return t.part.withColumn("p_brand", F.nullif("p_brand", F.lit("Brand#2")))


NULLED = "(SELECT * REPLACE (nullif(p_brand, 'Brand#2') AS p_brand) FROM part)"


@C.add("explorer_is_null", f"SELECT * FROM {NULLED} WHERE p_brand IS NULL")
def is_null(t: Tables) -> DataFrame:
    return explorer.matches(with_nulls(t), SearchSpec("p_brand", "is_null"))


@C.add("explorer_not_null", f"SELECT * FROM {NULLED} WHERE p_brand IS NOT NULL")
def not_null(t: Tables) -> DataFrame:
    return explorer.matches(with_nulls(t), SearchSpec("p_brand", "not_null"))


@C.add("explorer_ne_drops_null", f"SELECT p_partkey, p_brand FROM {NULLED} WHERE p_brand <> 'Brand#3'")
def ne_null(t: Tables) -> DataFrame:
    return explorer.matches(with_nulls(t), SearchSpec("brand", "ne", "Brand#3")).select("p_partkey", "p_brand")


@C.add("explorer_not_like", "SELECT p_partkey, p_type FROM part WHERE NOT upper(p_type) LIKE '%ECO%'")
def not_like(t: Tables) -> DataFrame:
    return t.part.filter(~explorer.predicate(F.col("p_type"), "contains", "ECO")).select("p_partkey", "p_type")


@C.add("explorer_in_list", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('1-URGENT')")
def in_list(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderstatus").isin("F", "O") & ~F.col("o_orderpriority").isin("1-URGENT")).select("o_orderkey")


@C.add("explorer_topk_name_asc", "SELECT * RENAME (c_name AS Nombre) FROM customer ORDER BY Nombre ASC NULLS FIRST LIMIT 20")
def topk_name(t: Tables) -> DataFrame:
    return explorer.preview(t.customer.withColumnRenamed("c_name", "Nombre"))


@C.add("explorer_topk_id_desc", "SELECT * RENAME (o_orderkey AS IdContador) FROM orders ORDER BY IdContador DESC NULLS LAST LIMIT 100")
def topk_id(t: Tables) -> DataFrame:
    return explorer.preview(t.orders.withColumnRenamed("o_orderkey", "IdContador"), 5000)


@C.add("explorer_search", "SELECT o_custkey, o_orderkey AS IdContador FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey DESC LIMIT 10")
def search(t: Tables) -> DataFrame:
    return explorer.search(t.orders.withColumnRenamed("o_orderkey", "IdContador"), SearchSpec("totalprice", "gt", 1000.0, ["2", "IDCONTADOR", "custkey"]))


@C.add("explorer_match_count", "SELECT count(*) FILTER (l_quantity > 45) AS coinciden, count(*) AS total FROM lineitem")
def match_count(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count_if(explorer.predicate(F.col("l_quantity"), "gt", 45.0)).alias("coinciden"), F.count("*").alias("total"))


@C.add(
    "explorer_value_counts_pct",
    """SELECT o_orderpriority AS value, count(*) AS n, CAST(round(CAST(count(*) AS DECIMAL(18,0)) * 100.0 / (SELECT count(*) FROM orders), 2) AS DECIMAL(7,2)) AS pct
FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 50""",
)
def value_counts(t: Tables) -> DataFrame:
    return explorer.value_counts(t.orders, "o_orderpriority")


@C.add("explorer_projection_subset", "SELECT s_name, s_suppkey FROM supplier")
def projection(t: Tables) -> DataFrame:
    return t.supplier.select(*explorer.resolve_columns(t.supplier, ["2", "suppkey", "S_NAME"]))


@C.add(
    "explorer_sql_gate",
    "SELECT c_custkey, 'DELETE-1' AS marca FROM customer WHERE c_custkey < 10",
)
def gate(t: Tables) -> DataFrame:
    t.customer.createOrReplaceTempView("gate_customer")
    return explorer.query(t.spark, "SELECT c_custkey, 'DELETE-1' AS marca FROM gate_customer WHERE c_custkey < :top;", top=10)


@C.add(
    "explorer_shown_values",
    """SELECT doc_id, CASE WHEN length(text) > 300 THEN concat(substr(text, 1, 297), '...') WHEN text = '' THEN '<VACÍO>' ELSE coalesce(text, 'NULL') END AS visto FROM documents""",
)
def shown(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.shown(F.col("text")).alias("visto"))


@C.add("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k")))


@C.add("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union(t: Tables) -> DataFrame:
    return union_all(t).distinct()


@C.add("set_intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).intersect(t.orders.select(F.col("o_custkey").alias("k")))


@C.add("set_except", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def difference(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("k")).subtract(t.lineitem.select(F.col("l_orderkey").alias("k")))


LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@C.add(
    "order_reconstruct",
    f"SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE)}) AS INTEGER) AS orden FROM lineitem WHERE l_quantity > 2",
)
def reconstruct(t: Tables) -> DataFrame:
    """Ordinals without gaps after some rows were left out."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE)
    return t.lineitem.filter("l_quantity > 2").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).alias("orden"))


@C.add("keep_first", "SELECT user_id, arg_min(event_id, event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def keep_first(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("event_type"))


@C.add(
    "order_integrity",
    f"""SELECT l_orderkey, count(*) FILTER (n <> l_linenumber) AS fuera FROM (
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE)}) AS n FROM lineitem) GROUP BY 1 HAVING count(*) FILTER (n <> l_linenumber) > 0""",
)
def integrity(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*LINE)
    n = t.lineitem.select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("n"))
    return n.groupBy("l_orderkey").agg(F.count_if(F.col("n") != F.col("l_linenumber")).alias("fuera")).filter("fuera > 0")


@C.add(
    "running_cost_stop",
    """SELECT user_id, event_id, CAST(total AS DECIMAL(18,2)) AS total FROM (SELECT user_id, event_id,
  sum(CAST(value AS DECIMAL(14,2))) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS total FROM events) WHERE total <= 200""",
)
def running_cost(t: Tables) -> DataFrame:
    """Calls of each user up to the cost limit."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(F.col("value").cast("decimal(14,2)")).over(w).cast("decimal(18,2)")
    return t.events.select("user_id", "event_id", total.alias("total")).filter("total <= 200")


@C.add(
    "attempt_numbers",
    """SELECT user_id, event_type, count(*) AS intentos, count(*) > 1 AS recuperado, max(event_id) AS ultimo FROM events GROUP BY 1, 2""",
)
def attempts(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    n = t.events.select("user_id", "event_type", "event_id", F.row_number().over(w).alias("n"))
    return n.groupBy("user_id", "event_type").agg(F.max("n").cast("long").alias("intentos"), (F.max("n") > 1).alias("recuperado"), F.max("event_id").alias("ultimo"))

"""What views depend on: edges from their definitions, and the transitive closure of edges by iterated joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..work import kept
from . import parsed

EDGES = "objeto string, tipo string, depende_de string"


def definition(spark: SparkSession, name: str, temporary: bool):
    """A view's plan: parsed from its text if it has one, else as it was analysed."""
    catalog = spark._jsparkSession.sessionState().catalog()
    if temporary:
        view = catalog.getTempView(name).get()
        text = view.desc().viewText()
        return parsed.parse(spark, text.get()) if text.isDefined() else view.child()
    text = catalog.getTableMetadata(spark._jvm.org.apache.spark.sql.catalyst.TableIdentifier(name)).viewText()
    return parsed.parse(spark, text.get()) if text.isDefined() else None


def read_names(spark: SparkSession, plan) -> set[str]:
    """Objects that a plan reads by name: relations of parsed plans, views that an analysed plan stands on."""
    names = {parts[-1].lower() for parts in parsed.relations(spark, plan)}
    own = None
    for what, node in parsed.walk(spark, plan):
        if what == "plan" and parsed.kind(node) == "View":
            own = node.desc().identifier().table().lower()
            names.add(own)
    return names


def dependency_edges(spark: SparkSession) -> DataFrame:
    """(objeto, tipo, depende_de): each view of the session's catalog and what its definition reads directly, each pair once.

    Names in subqueries and in bodies of common tables count, names of common tables don't.  Names are in lower case.
    """
    rows = set()
    for t in spark.catalog.listTables():
        if t.tableType == "TEMPORARY" or t.tableType == "VIEW":
            plan = definition(spark, t.name, t.isTemporary)
            rows |= {(t.name.lower(), "VISTA TEMPORAL" if t.isTemporary else "VISTA", name) for name in (read_names(spark, plan) if plan is not None else ()) if name != t.name.lower()}
    return spark.createDataFrame(sorted(rows), EDGES)


def closure(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target, nivel): every pair that a path of edges joins, once, with the length of the shortest.

    Each round joins the pairs found in the last round with the edges and leaves out those found before, so it ends on cycles, after as many rounds
    as the longest shortest path; every round is a written table.
    """
    steps = kept(edges.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).alias("a"), F.col(target).alias("b")).distinct(), "edges")
    rounds = [kept(steps.withColumn("nivel", F.lit(1)), "closure")]
    while not rounds[-1].isEmpty():
        found = reduce(DataFrame.unionByName, rounds).select("a", "b")
        ahead = steps.select(F.col("a").alias("b"), F.col("b").alias("c"))
        new = rounds[-1].select("a", "b").join(ahead, "b").select("a", F.col("c").alias("b")).distinct().join(found, ["a", "b"], "left_anti")
        rounds.append(kept(new.withColumn("nivel", F.lit(len(rounds) + 1)), "closure"))
    return reduce(DataFrame.unionByName, rounds).select(F.col("a").alias(source), F.col("b").alias(target), "nivel")


def dependents(spark: SparkSession, target: str) -> DataFrame:
    """(objeto, tipo, nivel): the views that depend on a table or view, directly or through others, by type and name."""
    edges = dependency_edges(spark)
    kinds = edges.select("objeto", "tipo").distinct()
    return closure(edges, "objeto", "depende_de").filter(F.col("depende_de") == target.lower()).join(kinds, "objeto").select("objeto", "tipo", "nivel").orderBy("tipo", "objeto")

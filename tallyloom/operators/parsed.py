"""A walk over Spark's parsed plans, before anything in them is looked up: nodes, expressions, relations, functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession


def items(seq) -> Iterator:
    """A Scala sequence's items."""
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def kind(node) -> str:
    return node.getClass().getSimpleName()


def parse(spark: SparkSession, statement: str):
    """The parsed plan of a statement; nothing is analysed or looked up, so nothing can run."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)


def instance_of(spark: SparkSession, name: str):
    """A test for instances of a class of Spark's catalyst."""
    cls = spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.{name}", True, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    return cls.isInstance


def walk(spark: SparkSession, plan) -> Iterator[tuple[str, object]]:
    """("plan" or "expression", node) for every node: children, bodies of common tables, expressions, and the plans inside these."""
    is_subquery = instance_of(spark, "expressions.PlanExpression")
    is_plan = instance_of(spark, "plans.QueryPlan")
    todo = [("plan", plan)]
    while todo:
        what, node = todo.pop()
        yield what, node
        todo += [(what, x) for x in items(node.children())]
        if what == "plan":
            todo += [("plan" if is_plan(x) else "expression", x) for x in items(node.innerChildren())]
            todo += [("expression", x) for x in items(node.expressions())]
            if kind(node) == "WithWindowDefinition":  # a map, which expressions() passes over
                todo += [("expression", pair._2()) for pair in items(node.windowDefinitions())]
        elif is_subquery(node):
            todo.append(("plan", node.plan()))


def common_tables(node) -> list[str]:
    """Names that a WITH node gives."""
    return [pair._1() for pair in items(node.cteRelations())] if kind(node) == "UnresolvedWith" else []


def relations(spark: SparkSession, plan) -> list[tuple[str, ...]]:
    """The names of tables and views that a plan reads, each once, without its own common tables."""
    own, named = set(), {}
    for what, node in walk(spark, plan):
        if what == "plan":
            own |= {n.lower() for n in common_tables(node)}
            if kind(node) == "UnresolvedRelation":
                named[tuple(items(node.multipartIdentifier()))] = None
    return [n for n in named if len(n) > 1 or n[0].lower() not in own]


def functions(spark: SparkSession, plan) -> list[tuple[str, ...]]:
    """The names of functions and table functions that a plan calls, each once."""
    named: dict[tuple[str, ...], None] = {}
    for _, node in walk(spark, plan):
        if kind(node) == "UnresolvedFunction":
            named[tuple(items(node.nameParts()))] = None
        elif kind(node) == "UnresolvedTableValuedFunction":
            named[tuple(items(node.name()))] = None
        elif kind(node) == "UnresolvedGenerator":
            named[tuple(node.name().unquotedString().split("."))] = None
    return list(named)


def function_group(spark: SparkSession, name: str) -> str | None:
    """A built-in function's group; None for any other function, a registered one of the same name included."""
    catalog = spark._jsparkSession.sessionState().catalog()
    identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
    if not catalog.functionExists(identifier):
        return None
    info = catalog.lookupFunctionInfo(identifier)
    return info.getGroup() if info.getSource() == "built-in" else None

"""Evaluation of obtained fields against a gold standard: flatten, compare, classify, sum up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import simplified
from .sync import named


def atoms(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, ruta, valor): the scalars of a nested column by path; an empty list is an atom of its own.

    The paths come from the schema, so this is a plan of projections and explodes, without Python on the data.
    """

    def walk(frame: DataFrame, kind: T.DataType) -> list[DataFrame]:
        """``frame`` has the key, ruta and the value v."""
        if isinstance(kind, T.StructType):
            names = [f.name for f in kind.fields]
            if names == ["valor", "evidencias"]:  # evidence is no content
                return walk(frame.withColumn("v", F.col("v.valor")), kind["valor"].dataType)
            path = lambda n: F.when(F.col("ruta") == "", F.lit(n)).otherwise(F.concat("ruta", F.lit(f".{n}")))
            return [x for f in kind.fields for x in walk(frame.select(key, path(f.name).alias("ruta"), F.col("v")[f.name].alias("v")), f.dataType)]
        if isinstance(kind, T.ArrayType):
            empty = frame.filter(F.col("v").isNull() | (F.size("v") == 0)).select(key, "ruta", F.when(F.col("v").isNotNull(), "[]").alias("valor"))
            each = frame.select(key, "ruta", F.posexplode("v").alias("i", "v")).select(key, F.concat("ruta", F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("ruta"), "v")
            return [empty, *walk(each, kind.elementType)]
        if isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
            return [frame.select(key, "ruta", F.regexp_replace(F.col("v").cast("decimal(24,6)").cast("string"), r"\.?0+$", "").alias("valor"))]
        return [frame.select(key, "ruta", F.col("v").cast("string").alias("valor"))]

    parts = walk(df.select(key, F.lit("").alias("ruta"), F.col(column).alias("v")), df.schema[column].dataType)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def field_of(path: Column) -> Column:
    """The top-level field of a path."""
    return F.regexp_extract(path, r"^([^.\[]*)", 1)


def atom_state(expected: Column, got: Column, intentional: Column | None = None) -> Column:
    """How an obtained atom stands to the expected one."""
    none = lambda c: c.isNull() | (c == "[]")
    state = F.when(expected.eqNullSafe(got), "CORRECTO")
    if intentional is not None:
        state = state.when(intentional & none(got), "DELIBERADAMENTE_NO_COMPLETADO")
    return state.when(none(got), "AUSENTE").when(none(expected), "INVENTADO").when(simplified(expected) == simplified(got), "DIFERENCIA_FORMATO").otherwise("INCORRECTO")


def compare(gold: DataFrame, got: DataFrame, keys: list[str], value: str = "valor") -> DataFrame:
    """Both sides' atoms by key, each with its state."""
    a, b = gold.select(*keys, F.col(value).alias("esperado")), got.select(*keys, F.col(value).alias("obtenido"))
    return a.join(b, keys, "full").withColumn("estado", atom_state(F.col("esperado"), F.col("obtenido")))


STATES = ("CORRECTO", "DIFERENCIA_FORMATO", "AUSENTE", "INVENTADO", "INCORRECTO")


def field_class(states: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by state for each field, and the class they make."""
    counts = states.groupBy(*keys).agg(*(F.count_if(F.col("estado") == s).alias(s.lower()) for s in STATES), F.count("*").alias("n"))
    kind = (
        F.when(F.col("correcto") == F.col("n"), "CORRECTO")
        .when((F.col("inventado") > 0) & (F.col("correcto") == 0) & (F.col("incorrecto") == 0), "INVENTADO")
        .when(F.col("ausente") == F.col("n"), "AUSENTE")
        .when((F.col("correcto") > 0) | (F.col("diferencia_formato") > 0), "PARCIAL")
        .otherwise("INCORRECTO")
    )
    return counts.withColumn("clase", kind)


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part.cast("decimal(18,0)") * 100 / whole.cast("decimal(18,0)"), 2)).cast("decimal(6,2)")


def summary(classes: DataFrame, keys: list[str]) -> DataFrame:
    """Fields, strict accuracy and coverage."""
    good, some = F.count_if(F.col("clase") == "CORRECTO"), F.count_if(~F.col("clase").isin("AUSENTE"))
    return classes.groupBy(*keys).agg(F.count("*").alias("campos"), good.alias("correctos"), pct(good, F.count("*")).alias("exactitud"), pct(some, F.count("*")).alias("cobertura"))


def key_metrics(gold: DataFrame, got: DataFrame, keys: list[str], number: str, amounts: list[str], date: str | None = None, order: str | None = None) -> DataFrame:
    """Counters of numbered rows by key: rows expected and obtained, distinct numbers correct, missing and invented, rows doubled,
    and expected rows whose date, amounts (where there is one) and place are those of the last obtained row of their number.

    Rows without a number count as rows only.  Both sides are tagged and meet in one aggregation by (keys, number) and one by keys, without a join.
    """
    fields = [*amounts, *(c for c in (date, order) if c)]
    of = [named(k) for k in keys]
    row, none = F.struct(*map(named, fields)), F.lit(None)
    by = F.struct(named(order) if order else F.lit(0), *map(named, amounts))
    both = gold.select(*of, named(number), row.alias("_g"), none.alias("_o"), none.alias("_by")).unionByName(got.select(*of, named(number), none.alias("_g"), row.alias("_o"), by.alias("_by")))
    ones = both.groupBy(*of, named(number)).agg(F.collect_list("_g").alias("g"), F.max_by("_o", "_by").alias("o"), F.count("_g").alias("n_g"), F.count("_o").alias("n_o"))
    numbered = named(number).isNotNull()
    found = numbered & (F.col("n_g") > 0) & (F.col("n_o") > 0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    agree = lambda test: total(F.when(found, F.aggregate("g", F.lit(0), lambda n, r: n + test(r))))
    one = lambda c: F.when(c, 1).otherwise(0)
    right = lambda r: sum((one(r[a].isNotNull() & r[a].eqNullSafe(F.col("o")[a])) for a in amounts), F.lit(0))
    wrong = lambda r: sum((one(r[a].isNotNull() & ~r[a].eqNullSafe(F.col("o")[a])) for a in amounts), F.lit(0))
    signs = lambda r: sum((one(F.coalesce(F.signum(r[a]) != F.signum(F.col("o")[a]), F.lit(False))) for a in amounts), F.lit(0))
    more = [agree(lambda r, c=c: one(r[c].eqNullSafe(F.col("o")[c]))).alias(f"{name}_correctos" if name == "ordenes" else f"{name}_correctas") for c, name in ((date, "fechas"), (order, "ordenes")) if c]
    return ones.groupBy(*of).agg(
        total("n_g").alias("esperados"),
        total("n_o").alias("obtenidos"),
        F.count_if(found).alias("correctos"),
        F.count_if(numbered & (F.col("n_o") == 0)).alias("omitidos"),
        F.count_if(numbered & (F.col("n_g") == 0)).alias("inventados"),
        total(F.when(numbered, F.greatest(F.col("n_o") - 1, F.lit(0)))).alias("duplicados"),
        agree(right).alias("importes_correctos"),
        agree(wrong).alias("importes_incorrectos"),
        agree(signs).alias("signos_incorrectos"),
        *more,
    )


def row_verdict(rows: DataFrame, keys: list[str], content: Column, order: Column) -> DataFrame:
    """COMPLETO if content and order agree in all rows, ORDEN_DIFERENTE if only content does."""
    verdict = F.when(F.bool_and(content & order), "CORRECTO_COMPLETO").when(F.bool_and(content), "CONTENIDO_ORDEN_DIFERENTE").otherwise("DIFERENCIAS_REALES")
    return rows.groupBy(*keys).agg(verdict.alias("veredicto"))


def cost_summary(calls: DataFrame, model: str, state: str, cost: str) -> DataFrame:
    """Calls, failures, the cost of all calls, its mean over the successes and calls without a cost, by model."""
    ok = F.col(state) == "completed"
    total = F.coalesce(F.sum(cost), F.lit(0)).cast("decimal(18,6)")
    good = F.count_if(ok)
    return calls.groupBy(model).agg(
        F.count("*").alias("llamadas"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("fallidas"), total.alias("coste"),
        F.when(good > 0, F.round(total / good.cast("decimal(12,0)"), 6)).otherwise(0).cast("decimal(18,6)").alias("coste_medio"),
        F.count_if(F.col(cost).isNull()).alias("sin_coste"),
    )


def projection(means: DataFrame, general: str, literal: str, monthly: int = 60, shares: tuple[str, ...] = ("0.2", "0.4", "0.6")) -> DataFrame:
    """Cost of a month and a year: a general call for every document, and a literal one for so large a share of them."""
    share = F.explode(F.array(*(F.lit(s).cast("decimal(3,2)") for s in shares)))
    month = F.col(general) * monthly + F.col(literal) * monthly * F.col("proporcion")
    return means.select("*", share.alias("proporcion")).withColumns({"coste_mensual": F.round(month, 2).cast("decimal(18,2)"), "coste_anual": F.round(month * 12, 2).cast("decimal(18,2)")})


#: The blocks of an invoice and their fields.
BLOCKS = {
    "cabecera": ("tipo_documento", "categoria", "requiere_conciliacion_albaranes", "pagina_inicio", "pagina_fin", "numero_factura", "fecha_factura"),
    "proveedor": ("proveedor_nombre", "proveedor_cif"),
    "destinatario": ("destinatario",),
    "totales": ("base_imponible_total", "iva_total", "recargo_equivalencia_total", "importe_total"),
    "fiscalidad": ("impuestos",),
    "vencimientos": ("vencimientos",),
    "albaranes": ("albaranes",),
    "ajustes": ("ajustes",),
    "campos_especiales": ("fecha_cargo", "periodo_facturacion_inicio", "periodo_facturacion_fin", "nota_revision"),
}


def block_of(field: Column, blocks: dict[str, tuple[str, ...]] = BLOCKS) -> Column:
    """A field's block; null if none has it."""
    pairs = [x for name, fields in blocks.items() for f in fields for x in (F.lit(f), F.lit(name))]
    return F.try_element_at(F.create_map(*pairs), field)


#: Classes of fields that are counted, with their counters.
COUNTED = {"CORRECTO": "correctos", "INCORRECTO": "incorrectos", "AUSENTE": "ausentes", "PARCIAL": "parciales", "INVENTADO": "inventados"}


def rollup(classes: DataFrame, dimensions: list[str], kind: str = "clase") -> DataFrame:
    """(dimension, valor, campos_evaluados, one counter a class, acierto_estricto, cobertura): by each dimension, and in total.

    All groupings are grouping sets of one aggregation, so the classified fields are read and shuffled once, after partial aggregation.
    A null value of a dimension is a value of its own.
    """
    level = F.grouping_id()
    sets = classes.groupingSets([[d] for d in dimensions] + [[]], *dimensions)
    counts = sets.agg(level.alias("_set"), F.count("*").alias("campos_evaluados"), *(F.count_if(F.col(kind) == c).alias(n) for c, n in COUNTED.items()))
    # A dimension's bit is 0 where the row is grouped by it; the first has the highest.
    full = 2 ** len(dimensions) - 1
    bit = {d: full - 2 ** (len(dimensions) - 1 - i) for i, d in enumerate(dimensions)}
    name = value = F.lit(None).cast("string")
    for d, b in bit.items():
        name = F.when(F.col("_set") == b, d).otherwise(name)
        value = F.when(F.col("_set") == b, F.col(d).cast("string")).otherwise(value)
    n = F.col("campos_evaluados")
    return counts.select(
        F.coalesce(name, F.lit("total")).alias("dimension"), value.alias("valor"), "campos_evaluados", *COUNTED.values(),
        pct(F.col("correctos"), n).alias("acierto_estricto"), pct(n - F.col("ausentes"), n).alias("cobertura"),
    )


def call_summary(calls: DataFrame, classes: DataFrame, key: str, model: str, fields: int, kind: str = "clase", cost: str = "coste") -> DataFrame:
    """By model: calls that gave fields and calls that failed, fields, correct and absent ones, accuracy, coverage and costs.

    A call (``key``, once) without classified fields failed: it counts with ``fields`` absent fields and none correct.  Accuracy is a share of the
    fields of all calls; the mean cost is that of all calls by the calls that didn't fail.
    """
    counts = classes.groupBy(named(key)).agg(F.count("*").alias("_n"), *(F.count_if(F.col(kind) == c).alias(n) for c, n in COUNTED.items()))
    each = calls.select(named(key), named(model), named(cost).alias("_cost")).join(counts, key, "left").withColumn("_failed", F.col("_n").isNull())
    asked = F.count("*") * fields
    good = F.count_if(~F.col("_failed"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    spent = F.coalesce(F.sum(F.col("_cost").cast("decimal(18,6)")), F.lit(0)).cast("decimal(18,6)")
    sums = each.groupBy(named(model)).agg(
        good.alias("llamadas_correctas"), F.count_if("_failed").alias("llamadas_fallidas"), asked.alias("campos_evaluados"), total(F.col("correctos")).alias("correctos"),
        total(F.when(F.col("_failed"), fields).otherwise(F.col("ausentes"))).alias("ausentes"), total(F.col("inventados")).alias("invenciones"), spent.alias("coste"),
        F.when(good > 0, F.round(spent / good.cast("decimal(12,0)"), 6)).otherwise(0).cast("decimal(18,6)").alias("coste_medio"),
    )
    n = F.col("campos_evaluados")
    return sums.withColumns({"acierto_estricto": pct(F.col("correctos"), n), "cobertura": pct(n - F.col("ausentes"), n)})


def usage_totals(calls: DataFrame, counters: list[str], cost: str, needs: Column, by: list[str] | None = None) -> DataFrame:
    """Sums of the counters (tokens, pages) and costs, the mean cost, and how many calls need a second reading, of all or by columns."""
    n, more = F.count("*"), F.count_if(F.coalesce(needs, F.lit(False)))
    spent = F.coalesce(F.sum(named(cost).cast("decimal(18,6)")), F.lit(0)).cast("decimal(18,6)")
    mean = F.when(n > 0, F.round(spent / n.cast("decimal(12,0)"), 6)).cast("decimal(18,6)")
    return calls.groupBy(*map(named, by or [])).agg(n.alias("documentos"), *(F.coalesce(F.sum(named(c)), F.lit(0)).cast("long").alias(c) for c in counters), spent.alias("coste_total"), mean.alias("coste_medio"), more.alias("requieren_tablas"), pct(more, n).alias("porcentaje_tablas"))


def before_after(before: DataFrame, after: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Two summaries side by side: each counter before, after, and the change; a key that one of them lacks counts as zeros."""
    side = lambda df, name: df.select(*map(named, keys), *(named(c).alias(f"{c}_{name}") for c in counters))
    both = side(before, "antes").join(side(after, "despues"), keys, "full")
    zero = lambda c: F.coalesce(named(c), F.lit(0))
    return both.select(*map(named, keys), *(x for c in counters for x in (zero(f"{c}_antes").alias(f"{c}_antes"), zero(f"{c}_despues").alias(f"{c}_despues"), (zero(f"{c}_despues") - zero(f"{c}_antes")).alias(f"{c}_cambio"))))

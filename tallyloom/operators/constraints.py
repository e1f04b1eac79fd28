"""Columns, keys, indexes and foreign keys of tables: what is declared, and whether the data keep to it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sync import named

#: Names of field metadata that say a column is made by the table itself, as table formats write them.
IDENTITY, COMPUTED = ("identity", "delta.identity.start"), ("computed", "delta.generationExpression")
#: What happens to rows that refer to a row that is deleted or changed.
ACTIONS = ("NO_ACTION", "CASCADE", "SET_NULL", "SET_DEFAULT")
#: Schemas of the system itself.
SYSTEM = ("sys", "information_schema", "guest")


@dataclass(frozen=True)
class Index:
    """A key (unique, perhaps primary) or another index: its columns in order, a minus before descending ones, and those it only carries."""

    table: str
    name: str
    columns: tuple[str, ...]
    included: tuple[str, ...] = ()
    unique: bool = False
    primary: bool = False


@dataclass(frozen=True)
class ForeignKey:
    """Columns of a table, in order, that refer to those of another one."""

    name: str
    table: str
    columns: tuple[str, ...]
    to: str
    to_columns: tuple[str, ...]
    on_delete: str = "NO_ACTION"
    on_update: str = "NO_ACTION"

    def __post_init__(self):
        if len(self.columns) != len(self.to_columns) or not self.columns or {self.on_delete, self.on_update} - {*ACTIONS}:
            raise ValueError(f"foreign key {self.name}: as many columns on each side, and known actions")


def user_tables(spark: SparkSession, views: bool = True) -> DataFrame:
    """(esquema, tabla, tipo): tables of the session's catalog, and views, without the system's schemas."""
    rows = []
    for db in spark.catalog.listDatabases():
        if db.name.lower() not in SYSTEM:
            rows += [(".".join(t.namespace or []) or None, t.name, "VISTA" if t.tableType in ("VIEW", "TEMPORARY") else "TABLA") for t in spark.catalog.listTables(db.name)]
    rows = sorted({r for r in rows if views or r[2] == "TABLA"}, key=repr)
    return spark.createDataFrame(rows, "esquema string, tabla string, tipo string")


def described(field: T.StructField) -> tuple:
    """(type, length, precision, scale, nullable, identity, computed) of a column."""
    kind, text = field.dataType, field.metadata.get("__CHAR_VARCHAR_TYPE_STRING", "")
    name = text.split("(")[0] or kind.typeName()
    length = int(text[text.index("(") + 1 : -1]) if "(" in text else None
    exact = isinstance(kind, T.DecimalType)
    has = lambda names: any(field.metadata.get(n) is not None and field.metadata.get(n) is not False for n in names)
    return name, length, kind.precision if exact else None, kind.scale if exact else None, field.nullable, has(IDENTITY), has(COMPUTED)


DESCRIPTION = "tabla string, orden int, columna string, tipo string, longitud int, precision int, escala int, admite_nulos boolean, identidad boolean, calculada boolean"


def columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """DESCRIPTION rows of all columns of some tables."""
    return spark.createDataFrame([(t, i, f.name, *described(f)) for t, df in tables.items() for i, f in enumerate(df.schema.fields, 1)], DESCRIPTION)


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """(tabla, columna, filas, nulos) from the data: one aggregation a table, whatever its number of columns."""

    def one(name: str, df: DataFrame) -> DataFrame:
        counts = df.agg(F.count("*").alias("_n"), *(F.count_if(named(c).isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)))
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("columna"), F.col(f"_{i}").alias("nulos")) for i, c in enumerate(df.columns))))
        return counts.select(F.lit(name).alias("tabla"), F.col("_n").alias("filas"), each.alias("x")).select("tabla", "x.columna", "filas", "x.nulos")

    return reduce(DataFrame.unionByName, (one(n, df) for n, df in tables.items()))


def bare(column: str) -> str:
    return column.removeprefix("-")


def indexes(spark: SparkSession, declared: list[Index]) -> DataFrame:
    """(tabla, indice, clave, incluidas, unico, primario): each index with its columns in order as one text."""
    shown = lambda c: f"{bare(c)} DESC" if c.startswith("-") else c
    rows = [(i.table, i.name, ", ".join(map(shown, i.columns)), ", ".join(i.included) or None, i.unique or i.primary, i.primary) for i in declared]
    return spark.createDataFrame(rows, "tabla string, indice string, clave string, incluidas string, unico boolean, primario boolean")


def checked_keys(tables: dict[str, DataFrame], declared: list[Index]) -> DataFrame:
    """(tabla, indice, filas, valores, repetidas, sin_valor) of each declared index from the data.

    ``valores``: distinct keys without nulls; ``repetidas``: rows beyond the first of their key; ``sin_valor``: rows with a null in the key.  Only key columns
    are read, and equal keys meet after partial aggregation.
    """

    def one(i: Index) -> DataFrame:
        keys = [named(bare(c)) for c in i.columns]
        whole = reduce(lambda a, b: a & b, (k.isNotNull() for k in keys))
        groups = tables[i.table].groupBy(*keys).agg(F.count("*").alias("_n")).select("_n", whole.alias("_whole"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        sums = groups.agg(total("_n").alias("filas"), F.count_if("_whole").alias("valores"), total(F.when(F.col("_whole"), F.col("_n") - 1)).alias("repetidas"), total(F.when(~F.col("_whole"), F.col("_n"))).alias("sin_valor"))
        return sums.select(F.lit(i.table).alias("tabla"), F.lit(i.name).alias("indice"), "filas", "valores", "repetidas", "sin_valor")

    return reduce(DataFrame.unionByName, map(one, declared))


def foreign_keys(spark: SparkSession, declared: list[ForeignKey], table: str | None = None) -> DataFrame:
    """(sentido, fk, origen, destino, columnas, al_borrar, al_actualizar): of all tables (SALIENTE), or of one, what goes out from it and what comes in.

    A key of a table to itself is both.  Column pairs stand in the key's order.
    """
    pairs = lambda k: " | ".join(f"{k.table}.{a} -> {k.to}.{b}" for a, b in zip(k.columns, k.to_columns))
    row = lambda way, k: (way, k.name, k.table, k.to, pairs(k), k.on_delete, k.on_update)
    rows = [row("SALIENTE", k) for k in declared if table in (None, k.table)] + [row("ENTRANTE", k) for k in declared if table == k.to]
    return spark.createDataFrame(rows, "sentido string, fk string, origen string, destino string, columnas string, al_borrar string, al_actualizar string")


def checked_foreign_keys(tables: dict[str, DataFrame], declared: list[ForeignKey]) -> DataFrame:
    """(fk, filas, sin_valor, huerfanas) from the data: rows, rows with a null in the key, and rows whose key the other table lacks.

    Equal keys are counted before they meet the other side, so a hot key is one row there.
    """

    def one(k: ForeignKey) -> DataFrame:
        names = [f"_k{i}" for i in range(len(k.columns))]
        side = lambda df, cols: df.select(*(named(c).alias(n) for c, n in zip(cols, names)))
        groups = side(tables[k.table], k.columns).groupBy(*names).agg(F.count("*").alias("_n"))
        known = side(tables[k.to], k.to_columns).distinct().withColumn("_known", F.lit(True))
        none = reduce(lambda a, b: a | b, (F.col(n).isNull() for n in names))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        both = groups.join(known, names, "left")
        return both.agg(total("_n").alias("filas"), total(F.when(none, F.col("_n"))).alias("sin_valor"), total(F.when(~none & F.col("_known").isNull(), F.col("_n"))).alias("huerfanas")).select(F.lit(k.name).alias("fk"), "filas", "sin_valor", "huerfanas")

    return reduce(DataFrame.unionByName, map(one, declared))

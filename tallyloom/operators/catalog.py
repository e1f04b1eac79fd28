"""Catalog analytics over a metadata frame: dictionary, declared and inferred relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import relation_meaning

#: Column names that say nothing about what they refer to.
GENERIC = (
    "id", "oid", "codigo", "cod", "numero", "num", "orden", "linea", "idlinea", "idnlinea", "fecha", "empresa",
    "ejercicio", "ordinal", "contador", "idcontador", "tipo", "idtipo", "estado", "resultado", "version", "indice",
    "usuario", "valor", "clave", "referencia", "descripcion", "nombre", "observaciones",
)

#: Type families within which keys can refer to each other.
FAMILIES = {
    "int": ("tinyint", "smallint", "int", "bigint", "integer", "long"),
    "text": ("char", "varchar", "nchar", "nvarchar", "text", "string"),
    "decimal": ("decimal", "numeric", "money", "smallmoney"),
}

#: Points of a target that is a key, or only unique; of equal meanings; of a table that means the same, is in the meaning, or
#: holds it; and the least points of each confidence.
KEY, UNIQUE, SAME, TABLE, IN_MEANING, HOLDS_MEANING, MOST = 50, 40, 20, 30, 20, 10, 100
BANDS = {"MUY ALTA": 95, "ALTA": 85, "MEDIA": 80}

COLUMNS = "esquema string, tabla string, columna string, tipo string, orden int, es_pk boolean, es_unica boolean"


def columns_of(tables: dict[str, DataFrame], keys: dict[str, str], schema: str = "main") -> list[tuple]:
    """Rows of the metadata frame for some tables; ``keys``: the single-column key of each."""
    return [(schema, t, name, kind.split("(")[0], i + 1, keys.get(t) == name, False) for t, df in tables.items() for i, (name, kind) in enumerate(df.dtypes)]


def metadata(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, COLUMNS)


def family(kind: Column) -> Column:
    low = F.lower(kind)
    out = low
    for name, kinds in FAMILIES.items():
        out = F.when(low.isin(*kinds), name).otherwise(out)
    return out


def search_objects(columns: DataFrame, said: str) -> DataFrame:
    """Tables whose schema or name holds a text, in any case."""
    low = said.lower()
    hit = F.lower("esquema").contains(low) | F.lower("tabla").contains(low)
    return columns.filter(hit).select("esquema", "tabla").distinct()


def score(meaning: Column, table: Column, target: Column, is_key: Column) -> Column:
    """How much sense a table makes as what a column refers to, up to 100."""
    base = F.when(is_key, KEY).otherwise(UNIQUE) + F.when(meaning == target, SAME).otherwise(0)
    named = F.when(meaning == table, TABLE).when((F.length(table) > 0) & F.contains(meaning, table), IN_MEANING).when((F.length(meaning) > 0) & F.contains(table, meaning), HOLDS_MEANING).otherwise(0)
    return F.least(base + named, F.lit(MOST))


def confidence(points: Column) -> Column:
    return F.coalesce(*(F.when(points >= least, name) for name, least in BANDS.items()))


def probable_relations(columns: DataFrame, official: DataFrame) -> DataFrame:
    """The best target of every column that is no key itself, found over an equi-join on what the names mean.

    ``official``: declared edges (esquema_o, tabla_o, columna_o, esquema_d, tabla_d, columna_d), left out in any case.
    """
    named = columns.filter(~F.lower(F.trim("columna")).isin(*GENERIC)).withColumn("significado", relation_meaning(F.col("columna"))).filter("significado <> ''")
    is_key = F.col("es_pk") | F.col("es_unica")
    side = lambda df, s: df.select(*(F.col(c).alias(f"{c}_{s}") for c in ("esquema", "tabla", "columna", "tipo", "es_pk")), "significado")
    pairs = side(named.filter(~is_key), "o").join(side(named.filter(is_key), "d"), "significado")
    pairs = pairs.filter(((F.lower("esquema_o") != F.lower("esquema_d")) | (F.lower("tabla_o") != F.lower("tabla_d"))) & (family(F.col("tipo_o")) == family(F.col("tipo_d"))))
    names = ["esquema_o", "tabla_o", "columna_o", "esquema_d", "tabla_d", "columna_d"]
    known = official.select(*(F.lower(c).alias(f"k_{c}") for c in names)).distinct()
    pairs = pairs.join(known, [F.lower(c) == F.col(f"k_{c}") for c in names], "left_anti")
    points = score(F.col("significado"), relation_meaning(F.col("tabla_d")), relation_meaning(F.col("columna_d")), F.col("es_pk_d"))
    best = Window.partitionBy("esquema_o", "tabla_o", "columna_o").orderBy(F.desc("puntos"), F.desc("es_pk_d"), F.length("tabla_d"), F.desc(F.lower("tabla_d")))
    chosen = pairs.withColumn("puntos", points).withColumn("_n", F.row_number().over(best)).filter((F.col("_n") == 1) & (F.col("puntos") >= min(BANDS.values())))
    return chosen.select(*names, "puntos", confidence(F.col("puntos")).alias("confianza"))


def edge_labels(edges: DataFrame, keys: list[str], origin: str, target: str, order: str) -> DataFrame:
    """One label an edge: its column pairs in order, with a bar between."""
    pair = F.concat(F.col(origin).cast("string"), F.lit(" -> "), F.col(target).cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), pair.alias("p"))))
    return edges.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["p"]), " | ").alias("etiqueta"))


def ranked_search(columns: DataFrame, said: str) -> DataFrame:
    """(esquema, tabla, puesto): tables whose name holds a text in any case, that of just this name first, then by schema and name.

    A catalog's names are few, so their order is one sort of the distinct ones found.
    """
    low = said.lower()
    found = columns.filter(F.lower("tabla").contains(low)).select("esquema", "tabla").distinct()
    rank = F.row_number().over(Window.orderBy(F.when(F.lower("tabla") == low, 0).otherwise(1), "esquema", "tabla"))
    return found.withColumn("puesto", rank)

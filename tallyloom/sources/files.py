"""File sources and sinks: binary files by month folder, JSON documents, checked lookups, reports."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import month_folder_date
from ..functions.text import diagram_id, markdown_cell
from ..operators.ingest import content_hash, is_sound_pdf
from ..operators.sync import named


def below_root(path: Column, root: str) -> Column:
    """A path without the folder it was looked for in, whose name is plain text here, not a pattern."""
    plain = F.regexp_replace(path, "^file:/*", "/")
    prefix = f"{re.sub('^file:/*', '/', root).rstrip('/')}/"
    return F.when(plain.startswith(prefix), F.substring(plain, F.lit(len(prefix) + 1), F.length(plain))).otherwise(plain)


def pdf_inventory(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """PDFs under month-named folders: path, size, time, hash, soundness and the folder's month, by lower-case path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    relative = below_root(F.col("path"), root)
    found = files.select(
        relative.alias("ruta"), F.col("length").alias("bytes"), "modificationTime", content_hash(F.col("content")).alias("hash"),
        is_sound_pdf(F.col("content")).alias("valido"), month_folder_date(F.split(relative, "/")[0]).alias("mes"),
    )
    found = found.filter(F.col("mes").isNotNull())
    return (found.filter(F.col("mes") >= F.lit(since).cast("date")) if since else found).orderBy(F.lower("ruta"))


def json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents, one a file, of a declared schema; anything else fails the read."""
    return spark.read.option("mode", "FAILFAST").option("multiLine", True).schema(schema).json(path)


FAULT = T.StructType([T.StructField("mensaje", T.StringType()), T.StructField("linea", T.IntegerType()), T.StructField("columna", T.IntegerType())])


@F.pandas_udf(FAULT)
def json_fault(texts: pd.Series) -> pd.DataFrame:
    """What is wrong with texts that are no JSON, and where: line and column from 1.  Null for null, and where nothing is found wrong."""

    def fault(text: str | None) -> tuple[str | None, int | None, int | None]:
        if text is None:
            return None, None, None
        try:
            json.loads(text)
        except json.JSONDecodeError as e:
            return e.msg, e.lineno, e.colno
        except RecursionError:
            return "too deep", None, None
        return None, None, None

    return pd.DataFrame([fault(t) for t in texts], columns=["mensaje", "linea", "columna"]).astype({"linea": "Int32", "columna": "Int32"})


#: What is said of a document that is JSON but no object.
NOT_OBJECT = "the root is not an object"


def strict_json(text: Column) -> Column:
    """The text as variant, null unless it is one JSON value and nothing else.

    Spark's reader passes over what follows a value.  So the text is read as a member and as an element: what follows a value can't go on
    both an object and an array.
    """
    around = lambda a, b: F.try_parse_json(F.concat(F.lit(a), text, F.lit(b)))
    return F.when(around("[", "]").isNotNull(), F.try_variant_get(around('{"x":', "}"), "$.x", "variant"))


def checked_json(df: DataFrame, text: str, *more: str) -> DataFrame:
    """(more columns, documento, mensaje, linea, columna): each text as variant if it is a JSON object, else what is wrong and where.

    Texts are parsed by Spark; only those it can't read go to Python, to be told the place.  A null text is an error without a place, and so is what only Spark refuses (a repeated key, NaN).  No
    row is left out and none stops the others: a consumer decides by ``mensaje IS NULL``.
    """
    own = [named(c) for c in more]
    parsed = df.select(*own, named(text).alias("_text"), strict_json(named(text)).alias("_tree"))
    bad = parsed.select(*own, "_tree", F.col("_text").isNull().alias("_none"), F.when(F.col("_tree").isNull(), F.col("_text")).alias("_bad"))
    told = bad.select(*own, "_tree", "_none", json_fault(F.col("_bad")).alias("_fault"))
    is_object = F.schema_of_variant("_tree").startswith("OBJECT")
    message = F.when(F.col("_none"), "no text").when(F.col("_tree").isNull(), F.coalesce("_fault.mensaje", F.lit("not JSON"))).when(~is_object, NOT_OBJECT)
    return told.select(*own, F.when(is_object, F.col("_tree")).alias("documento"), message.alias("mensaje"), F.col("_fault.linea").alias("linea"), F.col("_fault.columna").alias("columna"))


def located_json(spark: SparkSession, path: str) -> DataFrame:
    """checked_json() of files, one document a file, by path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return checked_json(files, "value", "path")


def first_file(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """The file whose path is the first in order; no row if there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.agg(F.min("path").alias("path")).filter("path IS NOT NULL")


def latest_file(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """The file that was modified last."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).drop("content")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).filter("path IS NOT NULL")


def exactly_one(df: DataFrame) -> DataFrame:
    """The frame, which fails when it runs unless it has one row."""
    guard = df.agg(F.assert_true(F.count("*") == 1, F.lit("exactly one row was expected")).alias("_ok"), *(F.first(c).alias(c) for c in df.columns))
    return guard.select(*df.columns, F.col("_ok").isNull().alias("_one")).filter("_one").drop("_one")


def exact_count(df: DataFrame, n: int, what: str = "rows") -> DataFrame:
    """The frame, which fails when it runs unless it has just ``n`` rows."""
    count = df.agg(F.count("*").alias("_n"))
    guard = count.select(F.when(F.col("_n") == n, True).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} {what}, found "), F.col("_n").cast("string"))).cast("boolean")).alias("_right"))
    return df.join(F.broadcast(guard)).filter("_right").select(*map(named, df.columns))


def jdbc_table(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of an operational database; filters above the mark are pushed to it."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def row_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows of parquet tables: counts come from file footers, not from the data."""
    parts = [spark.read.parquet(p).agg(F.count("*").alias("filas")).select(F.lit(n).alias("tabla"), "filas") for n, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def head_and_more(lines: DataFrame, limit: int) -> list[str]:
    """The first texts of a frame of one column, and how many more there are, if any."""
    got = [r[0] for r in lines.limit(limit + 1).collect()]
    return got if len(got) <= limit else [*got[:limit], f"... and {lines.count() - limit} more"]


def markdown_lines(df: DataFrame) -> DataFrame:
    """Every row as a line of a Markdown table."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(markdown_cell(named(c)) for c in df.columns)), F.lit(" |")).alias("line"))


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A frame as a Markdown table for reading; it says how many rows there are beyond the limit."""
    return "\n".join([f"| {' | '.join(df.columns)} |", f"| {' | '.join(['---'] * len(df.columns))} |", *head_and_more(markdown_lines(df), limit)])


def mermaid_lines(edges: DataFrame) -> DataFrame:
    """Every edge (origen, destino, etiqueta) as a line of a diagram, in order; names become identifiers, quotes in labels a code."""
    label = F.replace(F.coalesce("etiqueta", F.lit("")), F.lit('"'), F.lit("#quot;"))
    line = F.concat(F.lit("    "), diagram_id(F.col("origen")), F.lit(' -->|"'), label, F.lit('"| '), diagram_id(F.col("destino")))
    return edges.orderBy("origen", "destino", "etiqueta").select(line.alias("line"))


def mermaid(edges: DataFrame, limit: int = 1000) -> str:
    """The diagram as one text; a comment says how many edges there are beyond the limit."""
    lines = head_and_more(mermaid_lines(edges), limit)
    return "\n".join(["graph LR", *(f"    %% {x}" if x.startswith("...") else x for x in lines)])


def write_lines(lines: DataFrame, path: str) -> None:
    """All lines of a report or diagram, however many, written by the cluster."""
    lines.write.mode("overwrite").text(path)


def write_report(frames: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder a frame."""
    for name, df in frames.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")

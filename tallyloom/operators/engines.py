"""Results of extraction engines: checked inputs, one answer a file, validated results, failures as codes."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sync import named

#: The codes of failures and their messages.
MISSING, NO_FILE, FORMAT, INVALID, FAILED = "ARCHIVO_NO_ENCONTRADO", "RUTA_NO_ES_ARCHIVO", "FORMATO_NO_ADMITIDO", "RESULTADO_INVALIDO", "ERROR_PROCESAMIENTO"
FAILED_MESSAGE = "El motor no ha podido procesar el documento."
ERRORS = "array<struct<codigo:string,mensaje:string,detalle:string,recuperable:boolean>>"
ANSWER = "ruta string, documento string, paginas int, esperadas int, facturas int, coste decimal(18,6), confianza decimal(6,4), fallo string"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def input_error(path: Column, exists: Column, is_file: Column) -> Column:
    """What keeps a file from being processed, or null: it isn't there, is no file, or is no PDF."""
    error = lambda code, text: F.struct(F.lit(code).alias("codigo"), text.alias("mensaje"), F.lit(None).cast("string").alias("detalle"), F.lit(False).alias("recuperable"))
    return (
        F.when(~F.coalesce(exists, F.lit(False)), error(MISSING, F.concat(F.lit("No se encuentra el archivo: "), path)))
        .when(~F.coalesce(is_file, F.lit(False)), error(NO_FILE, F.concat(F.lit("La ruta no corresponde a un archivo: "), path)))
        .when(~F.lower(file_name(path)).rlike(r"[^.].*\.pdf\z"), error(FORMAT, F.concat(F.lit("El archivo debe tener extensión PDF: "), file_name(path))))
    )


def answers(files: DataFrame, extract: Callable[[dict], dict]) -> DataFrame:
    """ANSWER rows of an engine: ``extract`` gets a row and gives its document (numero_paginas, cantidad_documentos_esperados, facturas), coste and confianza.

    A failure of one row is that row's ``fallo``, and stops no other.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            rows = []
            for row in part.to_dict("records"):
                try:
                    got = extract(row)
                    document = got["documento"]
                    rows.append((row["ruta"], json.dumps(document, ensure_ascii=False), document.get("numero_paginas"), document.get("cantidad_documentos_esperados"), len(document.get("facturas") or []), got.get("coste"), got.get("confianza"), None))
                except Exception as error:  # noqa: BLE001 - it becomes the row's failure
                    rows.append((row["ruta"], None, None, None, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ANSWER.split(", ")]).astype({"paginas": "Int32", "esperadas": "Int32", "facturas": "Int32"})

    return files.mapInPandas(run, ANSWER)


def results(files: DataFrame, got: DataFrame, provider: str, model: str, version: str | None = None, path: str = "ruta", exists: str = "existe", is_file: str = "es_archivo") -> DataFrame:
    """One result a file: archivo, motor, procesado_correctamente, documento, paginas, coste, confianza, errores.

    ``got``: ANSWER rows, one a path, of an engine or of a table of expected answers (a simulated engine).  Files with a fault of their own aren't asked for; a
    file without an answer, or whose answer is a failure, is ERROR_PROCESAMIENTO; what is wrong with an answer's document makes it RESULTADO_INVALIDO, with the document kept.
    """
    asked = files.select(named(path).alias("ruta"), input_error(named(path), named(exists), named(is_file)).alias("_input"))
    both = asked.join(got.withColumn("_answered", F.lit(True)), "ruta", "left")
    name = file_name(F.col("ruta"))
    entry = lambda code, text, detail=None: F.struct(F.lit(code).alias("codigo"), text.alias("mensaje"), (detail if detail is not None else F.lit(None)).cast("string").alias("detalle"), F.lit(False).alias("recuperable"))
    failed = F.when(F.col("_answered").isNull(), "LookupError: sin respuesta").otherwise(F.col("fallo"))
    wrong = F.filter(
        F.array(
            F.when(F.col("paginas") < 1, F.concat(name, F.lit(": numero_paginas debe ser superior a 0."))),
            F.when(~F.col("esperadas").eqNullSafe(F.col("facturas")), F.concat(name, F.lit(": cantidad_documentos_esperados="), F.coalesce(F.col("esperadas").cast("string"), F.lit("None")), F.lit(", pero contiene "), F.coalesce("facturas", F.lit(0)).cast("string"), F.lit(" facturas."))),
        ),
        lambda x: x.isNotNull(),
    )
    errors = F.when(F.col("_input").isNotNull(), F.array("_input")).when(failed.isNotNull(), F.array(entry(FAILED, F.lit(FAILED_MESSAGE), failed))).otherwise(F.transform(wrong, lambda m: entry(INVALID, m)))
    made = both.withColumn("errores", errors.cast(ERRORS)).withColumn("_kept", F.col("_input").isNull() & F.col("documento").isNotNull())
    kept = lambda c: F.when(F.col("_kept"), F.col(c)).alias(c)
    return made.select(
        "ruta", name.alias("archivo"), F.struct(F.lit(provider).alias("proveedor"), F.lit(model).alias("nombre_modelo"), F.lit(version).cast("string").alias("version_modelo")).alias("motor"),
        (F.size("errores") == 0).alias("procesado_correctamente"), kept("documento"), kept("paginas"), kept("coste"), kept("confianza"), "errores",
    )


def result_errors(done: Column, document: Column, errors: Column, name: Column, seconds: Column) -> Column:
    """array<string>: what contradicts itself in a result, whoever made it."""
    n = F.coalesce(F.size(errors), F.lit(0))
    return F.filter(
        F.array(
            F.when(F.coalesce(F.trim(name), F.lit("")) == "", "Falta el nombre del archivo procesado."),
            F.when(seconds < 0, "El tiempo de procesamiento no puede ser negativo."),
            F.when(done & document.isNull(), "Una ejecución correcta debe contener documento_normalizado."),
            F.when(done & (n > 0), "Una ejecución marcada como correcta no debe contener errores."),
            F.when(~done & (n == 0), "Una ejecución fallida debe contener al menos un error."),
        ),
        lambda x: x.isNotNull(),
    )

"""Engine results: faults of files, failures of rows, documents that contradict themselves; first pages and divisions."""

import json

from pyspark.sql import functions as F

from tallyloom.functions import rules
from tallyloom.operators import catalog, engines, trees


def test_results_of_an_engine(spark):
    def extract(row):
        """An engine: its answer depends on the file's name."""
        if "slow" in row["ruta"]:
            raise TimeoutError("timed out")
        if "empty" in row["ruta"]:
            return {"documento": {"numero_paginas": 0, "cantidad_documentos_esperados": 2, "facturas": [{}]}}
        return {"documento": {"numero_paginas": 3, "cantidad_documentos_esperados": 1, "facturas": [{"n": "é"}]}, "coste": None, "confianza": None}

    rows = [("in/a.PDF", True, True), ("in/slow.pdf", True, True), ("in/empty.pdf", True, True), ("gone.pdf", False, None), ("folder.pdf", True, False), ("x/notes.txt", True, True), (".pdf", True, True), ("no answer.pdf", True, True), ("null.pdf", None, None)]
    files = spark.createDataFrame([(*r, 1) for r in rows], "ruta string, existe boolean, es_archivo boolean, fallo int")
    got = engines.answers(files.filter("ruta <> 'no answer.pdf'").select("ruta"), extract)
    out = {r.ruta: r for r in engines.results(files, got, "p", "m").collect()}
    codes = {k: [e.codigo for e in r.errores] for k, r in out.items()}
    assert codes == {
        "in/a.PDF": [], "in/slow.pdf": [engines.FAILED], "in/empty.pdf": [engines.INVALID] * 2, "gone.pdf": [engines.MISSING], "folder.pdf": [engines.NO_FILE], "x/notes.txt": [engines.FORMAT], ".pdf": [engines.FORMAT],
        "no answer.pdf": [engines.FAILED], "null.pdf": [engines.MISSING],
    }
    assert {k for k, r in out.items() if r.procesado_correctamente} == {"in/a.PDF"} and out["in/a.PDF"].archivo == "a.PDF"
    assert json.loads(out["in/a.PDF"].documento)["facturas"] == [{"n": "é"}] and out["in/a.PDF"].paginas == 3
    # A document that contradicts itself is kept; a file that wasn't to be asked for has none.
    assert out["in/empty.pdf"].documento and out["folder.pdf"].documento is None
    assert out["in/slow.pdf"].errores[0].detalle == "TimeoutError: timed out" and out["no answer.pdf"].errores[0].detalle == "LookupError: sin respuesta"
    assert engines.results(files.limit(0), got, "p", "m").count() == 0


def test_results_that_contradict_themselves(spark):
    df = spark.createDataFrame([(True, None, [], "a", 1.0), (True, "d", ["e"], " ", -1.0), (False, None, None, "a", None), (True, "d", [], "a", 0.0)], "ok boolean, d string, e array<string>, n string, s double")
    got = [r.x for r in df.select(engines.result_errors(F.col("ok"), F.col("d"), F.col("e"), F.col("n"), F.col("s")).alias("x")).collect()]
    assert [len(x) for x in got] == [1, 3, 1, 0] and got[2] == ["Una ejecución fallida debe contener al menos un error."]


def test_first_page_divisions_and_ranks(spark):
    row = spark.sql("SELECT named_struct('a', named_struct('evidencias', array(named_struct('pagina', CAST(NULL AS INT)))), 'b', named_struct('evidencias', array(named_struct('pagina', 7), named_struct('pagina', 8))), 'c', CAST(NULL AS struct<evidencias:array<struct<pagina:int>>>)) AS r")
    assert row.select(rules.first_page(F.col("r"), "a", "b", "c").alias("p")).first().p == 7
    docs = spark.createDataFrame([('{"entities":[{"pageAnchor":{"pageRefs":[{}]}}]}',), ('{"entities":[]}',), ("{}",), (None,)], "t string").select(F.parse_json("t").alias("d"))
    assert [r.x for r in docs.select(trees.divided(F.col("d"), [(1, 1)]).alias("x")).collect()] == [True, False, False, False]
    assert [r.x for r in docs.select(trees.divided(F.col("d"), []).alias("x")).collect()] == [False, True, True, True]
    names = spark.createDataFrame([("b", "venta", "x"), ("a", "Ventas", "x"), ("a", "LineaVenta", "x"), ("a", "otra", "x")], "esquema string, tabla string, columna string")
    assert [(r.esquema, r.tabla) for r in catalog.ranked_search(names, "VENTA").orderBy("puesto").collect()] == [("b", "venta"), ("a", "LineaVenta"), ("a", "Ventas")]

"""Invoice pipelines on synthetic extractions."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import normalise as N
from tallyloom.plans.document_queries import PROVIDERS
from tallyloom.sources import invoices as I


@pytest.fixture(scope="module")
def done(spark):
    out = {}
    for name, (run, provider) in PROVIDERS.items():
        rows = run(I.from_json_rows(spark, I.examples()[name]), provider).select("doc_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()
        out |= {r.doc_id: json.loads(r.j) for r in rows}
    return out


def kinds(d):
    return [x["tipo_incidencia"] for x in d["incidencias"]]


def states(d):
    return {v["nombre"]: v["resultado"]["estado"] for v in d["validaciones"]}


def test_standard(done):
    a, b, c = done["s1"], done["s2"], done["s3"]
    assert a["numero_factura"] == "000123" and a["fecha_factura"] == "2026-06-05" and a["proveedor_cif"] == "A12345678" and a["destinatario"]["cif"] == "B12345678"
    assert states(a) == {"total": "OK", "iva": "OK"} and kinds(a) == ["PREFIJO_PAIS_ELIMINADO"] and (a["pagina_inicio"], a["pagina_fin"]) == (1, 2)
    assert b["albaranes"] == [] and kinds(b) == ["PREFIJO_PAIS_ELIMINADO", "ALBARANES_NO_INTERPRETABLES_POR_RUTA_ESTANDAR", "VALIDACION_MONETARIA_ERROR"]
    assert [x["orden"] for x in b["incidencias"]] == [1, 2, 3]
    assert c["tipo_documento"] is None and [(v["orden"], v["fecha_vencimiento"], v["importe"]) for v in c["vencimientos"]] == [(1, "2026-12-31", None), (2, None, 0.0)]
    assert kinds(c) == ["TIPO_DOCUMENTO_NO_DEMOSTRADO", "PREFIJO_PAIS_ELIMINADO", "IMPORTE_VENCIMIENTO_NO_VISIBLE", "ESTRUCTURA_INCOMPLETA"] and c["incidencias"][3]["descripcion"] == "Falta tipo_documento."


def test_credit_notes(done):
    a, b = done["d1"], done["d2"]
    assert (a["base_imponible_total"], a["importe_total"]) == (-100.0, -126.2) and states(a)["total"] == "OK"
    assert len(a["impuestos"]) == 1 and (a["impuestos"][0]["cuota_iva"], a["impuestos"][0]["cuota_recargo_equivalencia"], a["impuestos"][0]["base_imponible"]) == (-21.0, -5.2, -100.0)
    assert [(n["tipo_movimiento"], n["importe_total"]) for n in a["albaranes"]] == [("ABONO", -9.0), ("ABONO", None)]
    assert kinds(a) == ["PREFIJO_PAIS_ELIMINADO", "SIGNO_CONTABLE_APLICADO", "FILAS_FISCALES_COMPLEMENTARIAS_UNIFICADAS", "IMPORTES_ALBARAN_NO_VISIBLES"]
    assert b["tipo_documento"] is None and b["importe_total"] == 126.2 and "PROVEEDOR_NO_RECONOCIDO" in kinds(b)


def test_literal_fusion(done, spark):
    a, b = done["f1"], done["f2"]
    assert [(n["orden"], n["numero_albaran"], n["tipo_movimiento"], n["importe_total"]) for n in a["albaranes"]] == [(1, "1", "CARGO", 10.0), (2, "2", None, None), (3, "3", "ABONO", -3.0), (4, "77", "CARGO", 9.0)]
    assert [(x["tipo_ajuste"], x["descripcion"]) for x in a["ajustes"]] == [("BONIFICACION", "Bonificación pago inmediato")] and len(a["impuestos"]) == 1
    want = ["TRAMO_FISCAL_SIN_IMPORTE_OMITIDO", "FILA_LITERAL_SIN_IDENTIFICADOR", "ALBARAN_SIN_FECHA_VISIBLE", "ALBARAN_SIN_IMPORTE_VISIBLE", "MARCADORES_ALBARAN_AMBIGUOS", "DUPLICADO_CONFLICTIVO_PRIORIZADO_LITERAL", "IDENTIFICADOR_ALBARAN_DUPLICADO", "ABONO_RECLASIFICADO_COMO_ALBARAN"]
    assert kinds(a) == want
    assert [n["numero_albaran"] for n in b["albaranes"]] == ["77"]
    run, provider = PROVIDERS["fedefarma"]
    for flag in (False, None):
        got = run(I.from_json_rows(spark, I.examples()["fedefarma"][:1]), replace(provider, flags={"usar_literal": flag})).first()
        assert [n.numero_albaran for n in got.albaranes] == ["77", "1"] and "FUSION_LITERAL_BLOQUEADA" in [x.tipo_incidencia for x in got.incidencias]


def test_split_quota(done):
    a, b, c = done["x1"], done["x2"], done["x3"]
    assert (a["impuestos"][0]["cuota_iva"], a["impuestos"][0]["cuota_recargo_equivalencia"], a["impuestos"][0]["nota"]) == (21.0, 5.2, "El PDF agrupa IVA y recargo en una cuota total de 26,20 €")
    assert states(a) == {"total": "OK"} and a["vencimientos"][0]["nota"] is None and a["albaranes"][0]["descripcion"] is None and a["albaranes"][0]["importe_total"] == 126.2
    assert kinds(a) == ["PREFIJO_PAIS_ELIMINADO", "CUOTA_FISCAL_AGREGADA_SEPARADA", "FORMA_PAGO_NO_ES_NOTA_VENCIMIENTO", "REFERENCIA_PEDIDO_BLOQUEADA_COMO_DESCRIPCION_ALBARAN", "IMPORTES_ASOCIADOS_A_ALBARAN_UNICO"]
    assert b["impuestos"] == [] and "CUOTA_FISCAL_AGREGADA_NO_CUADRA" in kinds(b) and kinds(b).count("RELACION_IMPORTES_ALBARAN_NO_DEMOSTRADA") == 2
    assert b["incidencias"][2]["datos"] == "precondicion:un_albaran_visible=False"
    assert kinds(c)[1] == "ESTRUCTURA_FISCAL_SUAVINEX_NO_DEMOSTRADA"


def test_literal_tables(done, spark):
    a, b = done["a1"], done["a2"]
    assert [(n["orden"], n["numero_albaran"], n["tipo_movimiento"], n["importe_total"]) for n in a["albaranes"]] == [(2, "1", "CARGO", 2.42), (3, "2", "CARGO", 1.21), (5, "003", "ABONO", -1.21)]
    assert [(x["importe"], x["incluido_en_base"], x["incluido_en_total"]) for x in a["ajustes"]] == [(12.1, True, True)]
    assert a["vencimientos"][0]["importe"] == 126.2
    assert kinds(a) == ["PREFIJO_PAIS_ELIMINADO", "FILA_LITERAL_INCOMPLETA", "FILA_LITERAL_INCOMPLETA", "ORDEN_RECONSTRUIDO", "ESTRUCTURA_INCOMPLETA"]
    assert {"SERVICIO_BASICO_INCOMPLETO", "REGLA_VENCIMIENTO_UNICO_NO_APLICABLE", "PROVEEDOR_NO_RECONOCIDO"} <= set(kinds(b)) and b["vencimientos"][0]["importe"] is None
    run, provider = PROVIDERS["alliance"]
    for flag in (True, None):
        got = run(I.from_json_rows(spark, I.examples()["alliance"][:1]), replace(provider, flags=provider.flags | {"descuadre_total": flag})).first()
        assert got.vencimientos[0].importe is None
        assert [x.datos for x in got.incidencias if x.tipo_incidencia == "REGLA_VENCIMIENTO_UNICO_NO_APLICABLE"] == [f"precondicion:sin_descuadre_total={'None' if flag is None else 'False'}"]


def test_twice_the_same(spark):
    run, provider = PROVIDERS["fedefarma"]
    df = I.from_json_rows(spark, I.examples()["fedefarma"])
    assert run(df, provider).collect() == run(df, provider).collect()


def test_wrong_json_fails(spark):
    with pytest.raises(Exception):
        I.from_json_rows(spark, [{"doc_id": "1", "numero_paginas": "many"}]).collect()
    assert N.VERSION


def test_what_a_tax_id_loses_is_noted_where_wanted(spark):
    ids = {"a": "es a1234 5678", "b": "A-12-345678", "c": "A12345678"}
    docs = [I.example(k, proveedor_cif=I.field(v)) for k, v in ids.items()]
    made = lambda **more: {r.doc_id: r for r in N.standard(I.from_json_rows(spark, docs), N.Provider("Proveedor", notices=True, **more)).collect()}
    got = made()
    assert [x.tipo_incidencia for x in got["a"].incidencias] == ["PREFIJO_PAIS_ELIMINADO"] and got["a"].proveedor_cif == "A12345678" and got["a"].incidencias[0].nivel == "AVISO"
    assert got["b"].proveedor_cif == "A-12-345678" and got["b"].incidencias == got["c"].incidencias == []
    dashed = made(tax_id=N.text.dashed_tax_id)
    assert [x.tipo_incidencia for x in dashed["b"].incidencias] == ["SEPARADORES_CIF_ELIMINADOS"] and dashed["b"].proveedor_cif == "A12345678" and dashed["a"].proveedor_cif == "es a1234 5678"


def test_structure_of_documents_and_collections(spark):
    from tallyloom.operators import structure as S

    docs = spark.createDataFrame([("a.pdf", 2, 2, [[], ["Falta numero_factura.", "x"]]), (None, 0, None, None), ("a.pdf", 1, 1, [[]])], "archivo string, numero_paginas int, cantidad_documentos_esperados int, errores_facturas array<array<string>>")
    got = {(r.archivo, r.posicion): r.mensaje for r in S.document_errors(docs).collect()}
    assert got == {
        ("a.pdf", 1): "a.pdf - factura 2: Falta numero_factura.", ("a.pdf", 2): "a.pdf - factura 2: x", ("", 1): "El documento no tiene nombre de archivo.", ("", 2): ": numero_paginas debe ser superior a 0.",
        ("", 3): ": cantidad_documentos_esperados=None, pero contiene 0 facturas.",
    }
    assert [(r.archivo, r.veces) for r in S.repeated_names(docs).collect()] == [("a.pdf", 2)]
    heads = spark.createDataFrame([("1", " ", None)], "v string, f string, m string")
    assert heads.select(S.collection_errors(F.col("v"), F.col("f"), F.col("m")).alias("e")).first().e == ["Falta farmacia.", "Falta moneda."]
    texts = spark.createDataFrame([(1, '{"a":1,"b":null}'), (2, "no"), (3, '{"a":0,"b":""}')], "i int, t string")
    assert [r.e for r in texts.select(S.required(F.col("t"), "a", "b").alias("e")).collect()] == [["b"], ["a", "b"], []]


def test_an_invoice_without_a_receiver_or_with_blocks_out_of_order(spark):
    from tallyloom.operators import structure as S

    row = spark.sql("SELECT CAST(NULL AS INT) AS pagina_inicio, 2 AS pagina_fin, '' AS tipo_documento, 'p' AS proveedor_nombre, 'n' AS numero_factura, named_struct('id_farmacia', '') AS destinatario, array(named_struct('orden', 1), named_struct('orden', 3)) AS vencimientos, array() AS impuestos, CAST(NULL AS array<struct<orden:int>>) AS albaranes, array(named_struct('orden', CAST(NULL AS INT))) AS ajustes")
    row = row.withColumn("impuestos", F.col("impuestos").cast("array<struct<orden:int>>"))
    assert row.select(S.invoice_errors(F.col).alias("e")).first().e == ["Falta tipo_documento.", "Falta destinatario.id_farmacia.", "vencimientos tiene órdenes incorrectos: [1, 3]. Se esperaba [1, 2].", "ajustes tiene órdenes incorrectos: [None]. Se esperaba [1]."]


def test_documents_of_a_small_table_are_dealt_to_all_cores(spark, put):
    """A table of one file is read by one task; the documents made of its rows must not all stay there, none is lost or doubled."""
    keys = spark.read.parquet(put(customer=spark.range(300).withColumnRenamed("id", "c_custkey").coalesce(1)) + "/customer.parquet")
    made = I.from_table(keys, "c_custkey", I.examples()["alliance"])
    by_task = made.select("doc_id", F.spark_partition_id().alias("task"))
    cores = spark.sparkContext.defaultParallelism
    assert by_task.select("task").distinct().count() >= cores
    assert by_task.groupBy("task").count().agg(F.max("count")).first()[0] <= 600 // cores
    assert sorted(r.doc_id for r in by_task.collect()) == sorted(f"{d}-{i}" for d in ("a1", "a2") for i in range(300))

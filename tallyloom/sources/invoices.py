"""Extracted invoices: from JSON, from relational tables, and synthetic ones for tests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.normalise import BASE, EXTRACTED
from ..work import spread


def from_json_rows(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """Documents of BASE's shape; fields that aren't there are null."""
    df = spark.createDataFrame([(json.dumps(d, ensure_ascii=False),) for d in documents], "j string")
    return parsed(df)


def from_table(keys: DataFrame, key: str, documents: list[dict]) -> DataFrame:
    """The documents once for each row of a table, named and numbered by its key: ``s1-42``, 000042."""
    number = F.lpad(F.col(key).cast("string"), 6, "0")
    texts = F.explode(F.array(*(F.struct(F.lit(d["doc_id"]).alias("id"), F.lit(json.dumps(d, ensure_ascii=False)).alias("j")) for d in documents)))
    each = spread(keys.select(key)).select(key, texts.alias("d"))
    named = F.replace(F.replace(F.col("d.j"), F.concat(F.lit('"doc_id": "'), F.col("d.id"), F.lit('"')), F.concat(F.lit('"doc_id": "'), F.col("d.id"), F.lit("-"), F.col(key).cast("string"), F.lit('"'))), F.lit("000123"), number)
    return parsed(each.select(named.alias("j")))


def parsed(texts: DataFrame) -> DataFrame:
    """Documents of BASE's shape from their JSON (j)."""
    return texts.select(F.from_json("j", f"struct<{BASE.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>", {"mode": "FAILFAST"}).alias("d")).select("d.*")


def seen(c: Column) -> Column:
    """A field with evidence on page 1."""
    return F.struct(c.alias("valor"), F.array(F.struct(c.cast("string").alias("texto_visible"), F.lit(1).alias("pagina"))).alias("evidencias"))


def from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Orders as extracted invoices: lines of one tax rate are a tax row, and the sums are shown as people write them."""
    money = lambda c: c.cast("decimal(14,2)")
    rate = F.round(F.col("l_tax") * 100)
    by_rate = lineitem.groupBy("l_orderkey", rate.alias("tipo")).agg(money(F.sum(money(F.col("l_extendedprice")))).alias("base"))
    by_rate = by_rate.withColumn("cuota", money(F.round(F.col("base") * F.col("tipo").cast("decimal(6,3)") / 100, 2)))
    row = F.struct(F.col("tipo"), F.struct(seen(F.col("base").cast("double")).alias("base_imponible"), seen(F.col("tipo")).alias("tipo_iva"), seen(F.col("cuota").cast("double")).alias("cuota_iva")).alias("x"))
    sums = by_rate.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("filas"), money(F.sum("base")).alias("base"), money(F.sum("cuota")).alias("iva"))
    f = orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    factura = F.struct(
        seen(F.lit("FACTURA")).alias("tipo_documento"), seen(F.concat(F.lit("cliente "), F.col("o_custkey").cast("string"))).alias("proveedor_nombre"), seen(F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("numero_factura"),
        seen(F.date_format("o_orderdate", "dd-MM-yyyy")).alias("fecha_factura"), seen(F.col("base").cast("double")).alias("base_imponible_total"), seen(F.col("iva").cast("double")).alias("iva_total"),
        seen((F.col("base") + F.col("iva") + F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0)).cast("double")).alias("importe_total"), F.transform("filas", lambda r: r["x"]).alias("impuestos"),
    )
    made = f.select(F.col("o_orderkey").cast("string").alias("doc_id"), factura.alias("factura"))
    want = T.StructType.fromDDL(f"factura {EXTRACTED}")["factura"].dataType
    return made.select(
        "doc_id", F.lit(None).cast("string").alias("archivo"), F.array(F.lit(1), F.lit(2)).alias("paginas_originales"), F.lit(2).alias("numero_paginas"),
        conform(F.col("factura"), made.schema["factura"].dataType, want).alias("factura"),
    )


def conform(c: Column, have: T.DataType | None, want: T.DataType) -> Column:
    """A value of one type in the shape of another: fields by name, those that aren't there null."""
    if have is None:
        return F.lit(None).cast(want)
    if isinstance(want, T.StructType):
        fields = {f.name: f.dataType for f in have.fields}
        return F.when(c.isNotNull(), F.struct(*(conform(c[f.name], fields.get(f.name), f.dataType).alias(f.name) for f in want.fields)))
    if isinstance(want, T.ArrayType):
        return F.transform(c, lambda x: conform(x, have.elementType, want.elementType))
    return c.cast(want)


def field(value: object, page: int = 1) -> dict:
    return {"valor": value, "evidencias": [{"texto_visible": str(value), "pagina": page}]}


def example(doc_id: str, kind: str = "FACTURA", provider: str = "Proveedor", **parts) -> dict:
    """A sound synthetic invoice: base 100, tax 21, surcharge 5.20."""
    factura = {
        "tipo_documento": field(kind), "proveedor_nombre": field(provider), "proveedor_cif": field("ESA12345678"), "numero_factura": field("000123"), "fecha_factura": field("05-06-2026"),
        "base_imponible_total": field(100.0), "iva_total": field(21.0), "recargo_equivalencia_total": field(5.2), "importe_total": field(126.2),
        "vencimientos": [{"fecha_vencimiento": field("05-07-2026"), "importe": field(126.2)}],
        "impuestos": [{"base_imponible": field(100.0), "tipo_iva": field(21.0), "cuota_iva": field(21.0), "tipo_recargo_equivalencia": field(5.2), "cuota_recargo_equivalencia": field(5.2)}],
        "albaranes": [], "ajustes": [], "destinatario": {"nombre": field("Farmacia"), "cif": field("B-12-345678")},
    }
    outer = {k: parts.pop(k) for k in ("tablas", "bloques_vencimiento", "filas_literales") if k in parts}
    return {"doc_id": doc_id, "archivo": f"{doc_id}.pdf", "paginas_originales": [1, 2], "numero_paginas": 2, "factura": factura | parts, **outer}


def literal_note(number: str | None, date: str | None = "05-06-2026", amount: str | None = "10,00", marks: tuple[str, ...] = ("P", "PA"), section: str = "ALBARANS") -> dict:
    when = "fecha_albaran" if "ABONAMENTS" in section else "fecha_entrega"
    return {"seccion_visible": section, "numero_albaran": number, when: date, "importe": amount, "marcadores_antes_numero": list(marks), "pagina_original": 1}


def grid(title: str, *rows: list[str]) -> dict:
    return {"pagina": 1, "titulo_visible": title, "encabezados": [], "filas": [{"orden_visual": len(rows) - i, "celdas": r} for i, r in enumerate(rows)]}


def examples() -> dict[str, list[dict]]:
    """Synthetic invoices for each provider's way, sound ones and others."""
    note = {"numero_albaran": field("Albarán: 77"), "fecha_albaran": field("01-06-2026"), "tipo_movimiento": field("P"), "importe_total": field(9.0)}
    bare = {"valor": "FACTURA", "evidencias": []}
    tax = {"base_imponible": field(100.0), "tipo_iva": field(21.0), "cuota_iva": field(21.0)}
    extra = {"base_imponible": field(100.0), "tipo_recargo_equivalencia": field(5.2), "cuota_recargo_equivalencia": field(5.2)}
    one = [{"base_imponible": field(100.0), "tipo_iva": field(21.0), "cuota_iva": field(26.2), "tipo_recargo_equivalencia": field(5.2)}]
    fee = grid("GASTOS", ["Servicio basico", "10,00", "2,10", "12,10"])
    bought = grid("COMPRAS", ["Total compras", "30,00", "30,00", "30,00", "1,00", "2,00", "3,00", "4,00", "5,00", "6,00", "114,10"])
    notes = [grid("CARGOS", ["02-06-2026", "b", "2", "1,00", "1,21"], ["01-06-2026", "a", "1", "2,00", "2,42"], ["x", "y", "3", "4"]), grid("ABONOS", ["03-06-2026", "c", "003", "-1,00", "1,21-"], ["", "c", "4", "1,00", "1,00"])]
    block = [{"texto_fecha": "05-07-2026", "texto_importe": None, "pagina": 1}]
    return {
        "standard": [example("s1"), example("s2", albaranes=[note], importe_total=field(130.0)), example("s3", tipo_documento=bare, vencimientos=[{"fecha_vencimiento": field("31-12-2026")}, {"nota": field("sin mas")}, {"importe": field(0.0)}])],
        "dermofarm": [example("d1", "ABONO", "Dermofarm", impuestos=[tax, extra], albaranes=[note, {"numero_albaran": field("78")}]), example("d2", "FACTURA", "Otro")],
        "fedefarma": [
            example("f1", albaranes=[note, {"numero_albaran": field("1"), "importe_total": field(99.0)}], ajustes=[{"tipo_ajuste": field("ABONO"), "importe": field(-3.0)}, {"tipo_ajuste": field("Bonificació"), "importe": field(1.0)}],
                    impuestos=[tax | extra, {"base_imponible": field(0.0), "tipo_iva": field(4.0), "cuota_iva": field(0.0), "cuota_recargo_equivalencia": field(0.0)}],
                    filas_literales=[literal_note("1"), literal_note("1"), literal_note("2", None, None, ("X",)), literal_note(None), literal_note("3", amount="-3,00", section="DETALL ABONAMENTS")]),
            example("f2", albaranes=[note]),
        ],
        "suavinex": [
            example("x1", impuestos=one, albaranes=[{"numero_albaran": field("5"), "descripcion": field("Pedido: 9")}], vencimientos=[{"fecha_vencimiento": field("05-07-2026"), "importe": field(126.2), "nota": field("Giro domiciliado 30")}]),
            example("x2", impuestos=[one[0] | {"cuota_iva": field(27.0)}], albaranes=[{"numero_albaran": field("5")}, {"numero_albaran": field("6")}]),
            example("x3", impuestos=[]),
        ],
        "alliance": [
            example("a1", provider="Alliance Healthcare", tablas=[*notes, fee, bought], bloques_vencimiento=block),
            example("a2", provider="Otro", tablas=[grid("GASTOS", ["Servicio basico", "1,00"])], bloques_vencimiento=block * 2),
        ],
    }

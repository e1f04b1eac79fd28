"""Structural checks of finished invoices, documents and collections, and the envelope around a normalised invoice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sync import named

#: The messages of what an invoice lacks, by field, and the blocks whose rows are numbered.
MISSING = {x: f"Falta {x}." for x in ("tipo_documento", "proveedor_nombre", "numero_factura", "destinatario", "destinatario.id_farmacia")}
FIRST_PAGE, LAST_PAGE = "pagina_inicio debe ser igual o superior a 1.", "pagina_fin no puede ser anterior a pagina_inicio."
BLOCKS = ("vencimientos", "impuestos", "albaranes", "ajustes")


def present(c: Column) -> Column:
    return F.coalesce(c.cast("string") != "", F.lit(False))


def order_error(rows: Column, name: str) -> Column:
    """The message of a block whose rows aren't numbered 1, 2, 3 ...; null if they are, or if there are none."""
    got = F.transform(rows, lambda x: x["orden"].cast("int"))
    want = F.transform(rows, lambda _, i: i + 1)
    shown = lambda c: F.concat(F.lit("["), F.concat_ws(", ", F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("None")))), F.lit("]"))
    return F.when(~got.eqNullSafe(want), F.concat(F.lit(f"{name} tiene órdenes incorrectos: "), shown(got), F.lit(". Se esperaba "), shown(want), F.lit(".")))


def invoice_errors(field) -> Column:
    """array<string>: what a finished invoice lacks, in a fixed order; ``field`` gives the column of a name.

    Missing page numbers are no error, only wrong ones; a block that isn't there has no rows.
    """
    lacks = lambda name, c: F.when(~present(c), F.lit(MISSING[name]))
    receiver = field("destinatario")
    return F.filter(
        F.array(
            F.when(field("pagina_inicio") < 1, F.lit(FIRST_PAGE)),
            F.when(field("pagina_fin") < field("pagina_inicio"), F.lit(LAST_PAGE)),
            *(lacks(x, field(x)) for x in ("tipo_documento", "proveedor_nombre", "numero_factura")),
            F.when(receiver.isNull(), F.lit(MISSING["destinatario"])).when(~present(receiver["id_farmacia"]), F.lit(MISSING["destinatario.id_farmacia"])),
            *(order_error(field(b), b) for b in BLOCKS),
        ),
        lambda x: x.isNotNull(),
    )


def document_errors(documents: DataFrame, file: str = "archivo", pages: str = "numero_paginas", expected: str = "cantidad_documentos_esperados", errors: str = "errores_facturas") -> DataFrame:
    """(archivo, posicion, mensaje): what is wrong with documents and, under their names, with their invoices.

    ``errors``: array of the error lists of a document's invoices, one for each.  Expected and actual numbers of invoices are held against each other, and a file
    name that occurs again is an error of each document but the first by all columns' order.  The messages of one document are numbered from 1.
    """
    name = F.coalesce(named(file), F.lit(""))
    n = F.coalesce(F.size(named(errors)), F.lit(0))
    of_invoices = F.flatten(F.transform(F.coalesce(named(errors), F.array().cast("array<array<string>>")), lambda e, i: F.transform(e, lambda m: F.concat(name, F.lit(" - factura "), (i + 1).cast("string"), F.lit(": "), m))))
    own = F.array(
        F.when(F.trim(name) == "", F.lit("El documento no tiene nombre de archivo.")),
        F.when(named(pages) < 1, F.concat(name, F.lit(": numero_paginas debe ser superior a 0."))),
        F.when(~named(expected).eqNullSafe(n), F.concat(name, F.lit(": cantidad_documentos_esperados="), F.coalesce(named(expected).cast("string"), F.lit("None")), F.lit(", pero contiene "), n.cast("string"), F.lit(" facturas."))),
    )
    messages = F.filter(F.concat(own, of_invoices), lambda x: x.isNotNull())
    each = documents.select(name.alias("_name"), messages.alias("_messages"))
    return each.select("_name", F.posexplode("_messages")).select(F.col("_name").alias("archivo"), (F.col("pos") + 1).alias("posicion"), F.col("col").alias("mensaje"))


def repeated_names(documents: DataFrame, file: str = "archivo") -> DataFrame:
    """(archivo, veces, mensaje): file names that a collection has more than once."""
    counts = documents.groupBy(named(file).alias("archivo")).agg(F.count("*").alias("veces")).filter("veces > 1")
    return counts.withColumn("mensaje", F.concat(F.lit("Documento duplicado en el patrón: "), F.coalesce("archivo", F.lit(""))))


def collection_errors(version: Column, site: Column, currency: Column) -> Column:
    """array<string>: what a collection's head lacks."""
    lacks = lambda name, c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"Falta {name}."))
    return F.filter(F.array(lacks("version_patron", version), lacks("farmacia", site), lacks("moneda", currency)), lambda x: x.isNotNull())


def required(document: Column, *names: str) -> Column:
    """array<string>: the required keys that a document's text lacks or has as null; all of them if it is no JSON object."""
    tree = F.try_parse_json(document)
    lacks = lambda v: v.isNull() | F.is_variant_null(v)
    return F.filter(F.array(*(F.when(lacks(F.try_variant_get(tree, f"$.{n}", "variant")), F.lit(n)) for n in names)), lambda x: x.isNotNull())


#: Columns of a finished invoice that go around it, not into it.
AROUND = ("doc_id", "validaciones", "incidencias")


def envelope(finished: DataFrame, version: str, provenance: dict[str, str], applied: dict[str, object], source: Column, at: Column | None = None) -> DataFrame:
    """(doc_id, resultado, incidencias): each finished invoice with what it was made by and from.

    ``provenance``: block to where it came from; ``applied``: the internal settings used; ``source``: the file's name; ``at``: the instant of
    the run, that of the query unless given, written in UTC.
    """
    instant = at if at is not None else F.current_timestamp()
    whole = F.struct(*(named(c) for c in finished.columns if c not in AROUND))
    text_map = lambda d: F.create_map(*(x for k, v in d.items() for x in (F.lit(k), F.lit(v)))).cast("map<string,string>") if d else F.create_map().cast("map<string,string>")
    made = F.struct(
        F.lit(version).alias("version_normalizador"), F.date_format(F.to_utc_timestamp(instant, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("fecha_ejecucion"), source.alias("archivo_origen"),
        F.array("pagina_inicio", "pagina_fin").alias("paginas_originales"), whole.alias("resultado_normalizado"), text_map(provenance).alias("procedencia_bloques"),
        F.struct(*(F.lit(v).alias(k) for k, v in applied.items())).alias("configuracion_interna_aplicada"), F.col("validaciones").alias("validaciones_monetarias"),
    )
    return finished.select("doc_id", made.alias("resultado"), "incidencias")

"""Invoice normalisation: one row an invoice, nested blocks as array columns, all of it Column expressions.

``extracted`` frames have doc_id, archivo, paginas_originales, numero_paginas, factura (EXTRACTED) and, where a provider
needs them, tablas (TABLES), bloques_vencimiento (BLOCKS) or filas_literales (LITERAL_ROWS).  Results have the
invoice's fields, the arrays vencimientos, impuestos, albaranes and ajustes, validaciones and incidencias.

Fixed values: the codes of incidents (capitals with underscores), the names of rules and validations, field names and states are those that
consumers of the results know.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, rules, text
from ..functions.rules import evidenced, incident
from ..functions.text import bind
from . import structure

VERSION = "1"


def evidence_field(kind: str) -> str:
    return f"struct<valor:{kind},evidencias:array<struct<texto_visible:string,pagina:int>>>"


S, D, I, B = (evidence_field(k) for k in ("string", "double", "int", "boolean"))
EXTRACTED = (
    f"struct<tipo_documento:{S},categoria:{S},requiere_conciliacion_albaranes:{B},pagina_inicio:{I},pagina_fin:{I},proveedor_nombre:{S},proveedor_cif:{S},"
    f"numero_factura:{S},fecha_factura:{S},base_imponible_total:{D},iva_total:{D},recargo_equivalencia_total:{D},importe_total:{D},"
    f"vencimientos:array<struct<orden:{I},fecha_vencimiento:{S},importe:{D},nota:{S}>>,"
    f"impuestos:array<struct<orden:{I},base_imponible:{D},tipo_iva:{D},cuota_iva:{D},tipo_recargo_equivalencia:{D},cuota_recargo_equivalencia:{D},nota:{S}>>,"
    f"albaranes:array<struct<orden:{I},numero_albaran:{S},fecha_albaran:{S},tipo_movimiento:{S},descripcion:{S},importe_base:{D},importe_total:{D}>>,"
    f"ajustes:array<struct<orden:{I},tipo_ajuste:{S},descripcion:{S},importe:{D},incluido_en_base:{B},incluido_en_total:{B}>>,"
    f"destinatario:struct<id_farmacia:{S},nombre:{S},cif:{S},metodo_identificacion:{S}>,fecha_cargo:{S},periodo_facturacion_inicio:{S},periodo_facturacion_fin:{S},nota_revision:{S}>"
)
TABLES = "array<struct<pagina:int,titulo_visible:string,encabezados:array<string>,filas:array<struct<orden_visual:int,celdas:array<string>>>>>"
BLOCKS = "array<struct<texto_fecha:string,texto_importe:string,pagina:int>>"
LITERAL_ROWS = "array<struct<seccion_visible:string,orden_visual:int,fecha_entrega:string,texto_origen:string,fecha_albaran:string,marcadores_antes_numero:array<string>,numero_albaran:string,motivo:string,descripcion:string,importe:string,signo_visible:string,pagina_original:int>>"
BASE = f"doc_id string, archivo string, paginas_originales array<int>, numero_paginas int, factura {EXTRACTED}, tablas {TABLES}, bloques_vencimiento {BLOCKS}, filas_literales {LITERAL_ROWS}"


@dataclass(frozen=True)
class Provider:
    """A provider's policy.  Flags may be true, false or unknown; only true lets a rule apply."""

    name: str
    aliases: list[str] = field(default_factory=list)
    types: tuple[str, ...] = ("FACTURA", "ABONO")
    pharmacy: str = "PIO"
    category: str = "MERCANCIA"
    reconcile: bool = True
    flags: dict[str, bool | None] = field(default_factory=dict)
    #: How the provider's visible tax id is read, and whether what that took away is noted among the incidents (level AVISO).
    tax_id: Callable[[Column], Column] = text.spanish_tax_id
    notices: bool = True
    #: Labels of the extractions that notes come from.
    general: str = "general"
    literal: str = "tablas_literales"

    def flag(self, name: str) -> Column:
        return F.lit(self.flags.get(name)).cast("boolean")


def amount(f: Column) -> Column:
    return evidenced(f).cast(numbers.MONEY)


def rate(f: Column) -> Column:
    return evidenced(f).cast("decimal(6,3)")


def date(f: Column) -> Column:
    return numbers.visible_date(evidenced(f))["value"]


def rows(c: Column, f: Callable[[Column], Column]) -> Column:
    """Each row of a block rewritten; a block that isn't there is empty."""
    return F.coalesce(F.transform(c, f), F.array())


def numbered(c: Column) -> Column:
    """Structs (orden first) with orden set to their place."""
    return F.transform(c, lambda x, i: x.withField("orden", i + 1))


def each(c: Column, entry: Callable[[Column, Column], Column]) -> Column:
    """An incident or null for every element."""
    return F.transform(c, entry)


def due_rows(invoice: Column) -> Column:
    """Due dates in the document's order; rows with neither date nor amount go, zero is an amount."""
    made = rows(invoice["vencimientos"], lambda v: F.struct(F.lit(0).alias("orden"), date(v["fecha_vencimiento"]).alias("fecha_vencimiento"), amount(v["importe"]).alias("importe"), evidenced(v["nota"]).alias("nota")))
    return numbered(F.filter(made, lambda v: v["fecha_vencimiento"].isNotNull() | v["importe"].isNotNull()))


def tax_rows(invoice: Column) -> Column:
    made = rows(
        invoice["impuestos"],
        lambda x: F.struct(
            F.lit(0).alias("orden"), amount(x["base_imponible"]).alias("base_imponible"), rate(x["tipo_iva"]).alias("tipo_iva"), amount(x["cuota_iva"]).alias("cuota_iva"),
            rate(x["tipo_recargo_equivalencia"]).alias("tipo_recargo_equivalencia"), amount(x["cuota_recargo_equivalencia"]).alias("cuota_recargo_equivalencia"), evidenced(x["nota"]).alias("nota"),
        ),
    )
    parts = ("base_imponible", "tipo_iva", "cuota_iva", "tipo_recargo_equivalencia", "cuota_recargo_equivalencia")
    return numbered(F.filter(made, lambda x: F.coalesce(*(x[p].cast("decimal(14,3)") for p in parts)).isNotNull()))


def note_rows(invoice: Column, movement: Callable[[Column], Column], number: Callable[[Column], Column] = text.identifier, source: str = "general") -> Column:
    """Delivery notes that have a number or a date."""
    made = rows(
        invoice["albaranes"],
        lambda x: F.struct(
            F.lit(0).alias("orden"), number(evidenced(x["numero_albaran"])).alias("numero_albaran"), date(x["fecha_albaran"]).alias("fecha_albaran"), movement(evidenced(x["tipo_movimiento"])).alias("tipo_movimiento"),
            evidenced(x["descripcion"]).alias("descripcion"), amount(x["importe_base"]).alias("importe_base"), amount(x["importe_total"]).alias("importe_total"), F.lit(source).alias("fuente"),
        ),
    )
    return numbered(F.filter(made, lambda x: x["numero_albaran"].isNotNull() | x["fecha_albaran"].isNotNull()))


NOTES = "array<struct<orden:int,numero_albaran:string,fecha_albaran:date,tipo_movimiento:string,descripcion:string,importe_base:decimal(14,2),importe_total:decimal(14,2),fuente:string>>"
ADJUSTMENTS = "array<struct<orden:int,tipo_ajuste:string,descripcion:string,importe:decimal(14,2),incluido_en_base:boolean,incluido_en_total:boolean>>"


def adjustment_rows(invoice: Column) -> Column:
    made = rows(
        invoice["ajustes"],
        lambda x: F.struct(
            F.lit(0).alias("orden"), evidenced(x["tipo_ajuste"]).alias("tipo_ajuste"), evidenced(x["descripcion"]).alias("descripcion"), amount(x["importe"]).alias("importe"),
            evidenced(x["incluido_en_base"]).alias("incluido_en_base"), evidenced(x["incluido_en_total"]).alias("incluido_en_total"),
        ),
    )
    return numbered(made)


def tax_id_notices(seen: Column, provider: Provider) -> Column:
    """What was taken away from the visible tax id, if the provider wants that noted."""
    kept = provider.tax_id(seen)
    changed = F.lit(provider.notices) & (kept != text.identifier(seen))
    entry = lambda when, kind, said, decision: incident(changed & when, "proveedor_cif", kind, said, F.concat(F.lit(decision), kept), seen, "AVISO")
    return F.array(
        entry(text.has_country_prefix(seen), "PREFIJO_PAIS_ELIMINADO", "el identificador visible incluye el prefijo de pais ES", "se conserva el identificador fiscal nacional "),
        entry(text.has_dashes(seen), "SEPARADORES_CIF_ELIMINADOS", "el CIF visible separa sus grupos mediante guiones", "se conserva el identificador continuo "),
    )


def header(extracted: DataFrame, provider: Provider) -> DataFrame:
    """Fields that all providers share; ``tipo`` is null unless it is one the provider may have."""
    f = F.col("factura")
    kind = evidenced(f["tipo_documento"])
    seen = evidenced(f["proveedor_nombre"])
    name = text.canonical_name(seen, {provider.name: provider.aliases})
    pages = numbers.page_range(F.col("paginas_originales"), F.col("numero_paginas"))
    return extracted.select(
        "*",
        F.when(kind.isin(*provider.types), kind).alias("tipo_documento"),
        F.lit(provider.category).alias("categoria"),
        F.lit(provider.reconcile).alias("requiere_conciliacion_albaranes"),
        pages["first"].alias("pagina_inicio"),
        pages["last"].alias("pagina_fin"),
        pages["error"].alias("_sin_paginas"),
        name.alias("proveedor_nombre"),
        (seen.isNull() | (name == provider.name)).alias("_proveedor_conocido"),
        provider.tax_id(evidenced(f["proveedor_cif"])).alias("proveedor_cif"),
        tax_id_notices(evidenced(f["proveedor_cif"]), provider).alias("_avisos"),
        text.identifier(evidenced(f["numero_factura"])).alias("numero_factura"),
        date(f["fecha_factura"]).alias("fecha_factura"),
        amount(f["base_imponible_total"]).alias("base_imponible_total"),
        amount(f["iva_total"]).alias("iva_total"),
        amount(f["recargo_equivalencia_total"]).alias("recargo_equivalencia_total"),
        amount(f["importe_total"]).alias("importe_total"),
        F.struct(F.lit(provider.pharmacy).alias("id_farmacia"), evidenced(f["destinatario"]["nombre"]).alias("nombre"), text.dashed_tax_id(evidenced(f["destinatario"]["cif"])).alias("cif"), F.lit("CIF").alias("metodo_identificacion")).alias("destinatario"),
    )


OUT = (
    "doc_id", "tipo_documento", "categoria", "requiere_conciliacion_albaranes", "pagina_inicio", "pagina_fin", "proveedor_nombre", "proveedor_cif", "numero_factura", "fecha_factura", "base_imponible_total", "iva_total",
    "recargo_equivalencia_total", "importe_total", "destinatario", "vencimientos", "impuestos", "albaranes", "ajustes", "validaciones", "incidencias",
)


def finish(df: DataFrame, checks: dict[str, Column], *logs: Column) -> DataFrame:
    """Validations, and all incidents in the order of the steps that made them."""
    names = list(checks)
    df = df.withColumn("validaciones", F.array(*(F.struct(F.lit(n).alias("nombre"), c.alias("resultado")) for n, c in checks.items())))
    one = lambda *entries: F.array(*entries)
    head = one(
        incident(F.col("tipo_documento").isNull(), "tipo_documento", "TIPO_DOCUMENTO_NO_DEMOSTRADO", "no hay evidencia de un tipo admitido", "permanece en null"),
        incident(~F.col("_proveedor_conocido"), "proveedor_nombre", "PROVEEDOR_NO_RECONOCIDO", "el nombre visible no es un alias", "se conserva el texto visible", F.col("proveedor_nombre")),
        incident(F.col("_sin_paginas"), "paginas", "PAGINAS_NO_DEMOSTRADAS", "los metadatos no dan un intervalo", "permanecen en null"),
    )
    failed = one(*(rules.failed_check(n, F.col("validaciones")[i]["resultado"]) for i, n in enumerate(names)))
    shape = F.transform(structure.invoice_errors(F.col), lambda m: incident(F.lit(True), "factura", "ESTRUCTURA_INCOMPLETA", m, "se conserva null; no se completa el campo"))
    due = each(F.col("vencimientos"), lambda v, i: incident(v["importe"].isNull(), F.concat(F.lit("vencimientos["), i.cast("string"), F.lit("].importe")), "IMPORTE_VENCIMIENTO_NO_VISIBLE", "el vencimiento no muestra importe", "no se asigna el total"))
    return df.withColumn("incidencias", rules.incident_log(head, F.col("_avisos"), *logs, due, failed, shape)).select(*OUT)


def total_check() -> Column:
    """Base, tax and surcharge make the total; a surcharge that is not shown counts as zero only if tax is shown."""
    parts = F.array(F.col("base_imponible_total"), F.col("iva_total"), F.coalesce("recargo_equivalencia_total", F.when(F.col("iva_total").isNotNull(), F.lit(0).cast(numbers.MONEY))))
    return rules.check_sum(parts, F.col("importe_total"))


def column_check(block: str, part: str, expected: str) -> Column:
    """A block's column adds up to a field of the invoice."""
    return rules.check_sum(F.transform(block, lambda x: x[part]), F.col(expected))


def blocked(block: str) -> Column:
    """The incident of a block that the standard way leaves out."""
    n = F.coalesce(F.size(F.col("factura")[block]), F.lit(0))
    return incident(n > 0, block, f"{block.upper()}_NO_INTERPRETABLES_POR_RUTA_ESTANDAR", "la ruta estandar no interpreta este bloque", "se devuelve vacio", n)


def standard(extracted: DataFrame, provider: Provider) -> DataFrame:
    """Visible fields only; delivery notes and adjustments are left out and said so."""
    df = header(extracted, provider)
    df = df.withColumns({"vencimientos": due_rows(F.col("factura")), "impuestos": tax_rows(F.col("factura")), "albaranes": F.array().cast(NOTES), "ajustes": F.array().cast(ADJUSTMENTS)})
    return finish(df, {"total": total_check(), "iva": column_check("impuestos", "cuota_iva", "iva_total")}, F.array(blocked("albaranes"), blocked("ajustes")))


def credit_notes(extracted: DataFrame, provider: Provider) -> DataFrame:
    """Dermofarm: credit notes only, whose amounts are negative; tax and surcharge rows of one base are one row."""
    df = header(extracted, provider)
    signed = lambda c: numbers.credit_sign(F.col("tipo_documento"), c).cast(numbers.MONEY)
    money = ("base_imponible_total", "iva_total", "recargo_equivalencia_total", "importe_total")
    turned = reduce(lambda a, b: a | b, (F.coalesce(F.col(c) > 0, F.lit(False)) for c in money)) & F.coalesce(F.col("tipo_documento") == "ABONO", F.lit(False))
    df = df.withColumn("_signo", turned).withColumns({c: signed(F.col(c)) for c in money})
    taxes = F.transform(tax_rows(F.col("factura")), lambda x: x.withField("base_imponible", signed(x["base_imponible"])).withField("cuota_iva", signed(x["cuota_iva"])).withField("cuota_recargo_equivalencia", signed(x["cuota_recargo_equivalencia"])))
    df = df.withColumn("_filas", taxes)
    vat, extra = F.filter("_filas", lambda x: x["tipo_iva"].isNotNull()), F.filter("_filas", lambda x: x["tipo_recargo_equivalencia"].isNotNull())
    a, b = F.try_element_at(vat, F.lit(1)), F.try_element_at(extra, F.lit(1))
    pair = F.coalesce((F.size("_filas") == 2) & (F.size(vat) == 1) & (F.size(extra) == 1) & (a["base_imponible"] == b["base_imponible"]), F.lit(False))
    merged = a.withField("orden", F.lit(1)).withField("tipo_recargo_equivalencia", b["tipo_recargo_equivalencia"]).withField("cuota_recargo_equivalencia", b["cuota_recargo_equivalencia"])
    notes = note_rows(F.col("factura"), lambda _: F.when(F.col("tipo_documento") == "ABONO", "ABONO"))
    notes = F.transform(notes, lambda x: x.withField("importe_base", signed(x["importe_base"])).withField("importe_total", signed(x["importe_total"])))
    df = df.withColumns({"_par": pair, "vencimientos": F.transform(due_rows(F.col("factura")), lambda v: v.withField("importe", signed(v["importe"]))), "impuestos": F.when(pair, F.array(merged)).otherwise(F.col("_filas")), "albaranes": notes.cast(NOTES), "ajustes": F.array().cast(ADJUSTMENTS)})
    log = F.array(
        incident(F.col("_signo"), "importes", "SIGNO_CONTABLE_APLICADO", "un abono muestra importes positivos", "se aplica signo negativo", level="AVISO"),
        incident(F.col("_par"), "impuestos", "FILAS_FISCALES_COMPLEMENTARIAS_UNIFICADAS", "IVA y recargo comparten base", "se representa un tramo", level="AVISO"),
        blocked("ajustes"),
    )
    bare = each(F.col("albaranes"), lambda x, i: incident(x["importe_base"].isNull() & x["importe_total"].isNull(), F.concat(F.lit("albaranes["), i.cast("string"), F.lit("].importes")), "IMPORTES_ALBARAN_NO_VISIBLES", "el albaran no muestra importes", "permanecen en null"))
    checks = {"total": total_check(), "iva": column_check("impuestos", "cuota_iva", "iva_total"), "recargo": column_check("impuestos", "cuota_recargo_equivalencia", "recargo_equivalencia_total")}
    return finish(df, checks, log, bare)


CREDIT_SECTION, CHARGE_MARKS = "detall abonaments", ("P", "PA", "P PA")


def literal_fusion(extracted: DataFrame, provider: Provider) -> DataFrame:
    """Fedefarma: delivery notes of two extractions, the literal one first; zero tax rows and doubled credits go."""
    df = header(extracted, provider)
    taxes = tax_rows(F.col("factura"))
    zero = lambda x: F.coalesce((x["base_imponible"] == 0) & (x["cuota_iva"] == 0) & (x["cuota_recargo_equivalencia"] == 0), F.lit(False))
    general = note_rows(F.col("factura"), lambda m: F.when((F.col("tipo_documento") == "FACTURA") & m.isin(*CHARGE_MARKS), "CARGO"), text.note_number, provider.general).cast(NOTES)

    def literal(x: Column) -> Column:
        credit = F.coalesce(F.lower(x["seccion_visible"]).contains(CREDIT_SECTION), F.lit(False))
        seen = numbers.visible_date(F.when(credit, x["fecha_albaran"]).otherwise(x["fecha_entrega"]), iso=False)["value"]
        move = F.when(credit, "ABONO").when(x["marcadores_antes_numero"] == F.array(F.lit("P"), F.lit("PA")), "CARGO")
        return F.struct(
            F.lit(0).alias("orden"), text.note_number(x["numero_albaran"]).alias("numero_albaran"), seen.alias("fecha_albaran"), move.alias("tipo_movimiento"), F.lit(None).cast("string").alias("descripcion"),
            F.lit(None).cast(numbers.MONEY).alias("importe_base"), numbers.spanish_amount(x["importe"])["value"].alias("importe_total"), F.lit(provider.literal).alias("fuente"),
        )

    df = df.withColumns({"_fiscal": taxes, "_generales": general, "_leidas": rows(F.col("filas_literales"), literal).cast(NOTES)})
    df = df.withColumn("_literales", F.filter("_leidas", lambda x: x["numero_albaran"].isNotNull()))
    use = rules.apply_rule("usar_tablas_literales_fedefarma", VERSION, {"fallback_literal_autorizado": provider.flag("usar_literal")}, {"filas_literales": F.when(F.size("_literales") > 0, F.col("_literales"))}, F.col("_literales"))
    df = df.withColumn("_usar", use["aplicada"])
    same = lambda g: F.filter("_literales", lambda x: x["numero_albaran"] == g["numero_albaran"])
    twin = lambda g: F.try_element_at(same(g), F.lit(-1))
    source = F.when(F.col("_usar"), F.concat("_literales", F.filter("_generales", lambda g: F.size(same(g)) == 0))).otherwise(F.col("_generales"))
    df = df.withColumn("_fuente", source)
    key = lambda x: F.coalesce(x["numero_albaran"], F.lit("\0"))
    first = lambda x, i: F.array_position(F.transform("_fuente", key), key(x)) == i + 1
    df = df.withColumn("albaranes", numbered(F.filter("_fuente", first)))
    credits = F.transform(F.filter("albaranes", lambda x: (x["tipo_movimiento"] == "ABONO") & x["importe_total"].isNotNull()), lambda x: x["importe_total"])
    df = df.withColumns({"_abonos": credits, "_ajustes": adjustment_rows(F.col("factura")).cast(ADJUSTMENTS)})
    moved = lambda x: F.coalesce((x["tipo_ajuste"] == "ABONO") & F.array_contains("_abonos", x["importe"]), F.lit(False))
    bonus = lambda x: F.coalesce(F.lower(x["tipo_ajuste"]).isin("bonificación", "bonificació"), F.lit(False))
    kept = F.transform(F.filter("_ajustes", lambda x: ~moved(x)), lambda x: x.withField("descripcion", F.when(bonus(x), "Bonificación pago inmediato").otherwise(x["descripcion"])).withField("tipo_ajuste", F.when(bonus(x), "BONIFICACION")))
    df = df.withColumns({"vencimientos": due_rows(F.col("factura")), "impuestos": numbered(F.filter("_fiscal", lambda x: ~zero(x))), "ajustes": numbered(kept)})
    differs = lambda g: F.coalesce((twin(g)["fecha_albaran"] != g["fecha_albaran"]), F.lit(False)) | F.coalesce((twin(g)["importe_total"] != g["importe_total"]), F.lit(False))
    logs = [
        each(F.col("_fiscal"), lambda x, i: incident(zero(x), "impuestos", "TRAMO_FISCAL_SIN_IMPORTE_OMITIDO", "el tramo no aporta importes", "no se crea", level="AVISO")),
        each(F.col("_leidas"), lambda x, i: incident(x["numero_albaran"].isNull(), F.concat(F.lit("tablas_literales.filas["), i.cast("string"), F.lit("]")), "FILA_LITERAL_SIN_IDENTIFICADOR", "la fila no tiene numero", "no se incorpora")),
        each(F.col("_literales"), lambda x, i: incident(x["fecha_albaran"].isNull(), "albaranes.fecha_albaran", "ALBARAN_SIN_FECHA_VISIBLE", "la fila no tiene fecha", "permanece en null", x["numero_albaran"])),
        each(F.col("_literales"), lambda x, i: incident(x["importe_total"].isNull(), "albaranes.importe_total", "ALBARAN_SIN_IMPORTE_VISIBLE", "la fila no tiene importe", "permanece en null", x["numero_albaran"])),
        each(F.col("_literales"), lambda x, i: incident(x["tipo_movimiento"].isNull(), "albaranes.tipo_movimiento", "MARCADORES_ALBARAN_AMBIGUOS", "los marcadores no clasifican el movimiento", "permanece en null", x["numero_albaran"])),
        F.array(incident((F.size("_literales") > 0) & ~F.col("_usar"), "albaranes", "FUSION_LITERAL_BLOQUEADA", "la configuracion no autoriza la transcripcion", "solo la extraccion general")),
        each(F.when(F.col("_usar"), F.filter("_generales", lambda g: F.size(same(g)) > 0)).otherwise(F.array().cast(NOTES)), lambda g, i: F.when(differs(g), incident(F.lit(True), "albaranes", "DUPLICADO_CONFLICTIVO_PRIORIZADO_LITERAL", "dos extracciones no coinciden", "vale la literal", g["numero_albaran"])).otherwise(incident(F.lit(True), "albaranes", "DUPLICADO_GENERAL_LITERAL_DEDUPLICADO", "dos extracciones coinciden", "vale la literal", g["numero_albaran"], "AVISO"))),
        each(F.col("_fuente"), lambda x, i: incident(~first(x, i), "albaranes", "IDENTIFICADOR_ALBARAN_DUPLICADO", "dos filas comparten numero", "vale la primera", x["numero_albaran"])),
        each(F.col("_ajustes"), lambda x, i: incident(moved(x), "ajustes", "ABONO_RECLASIFICADO_COMO_ALBARAN", "el abono ya es un albaran", "no se duplica", x["descripcion"], "AVISO")),
    ]
    checks = {"total": total_check(), "base": column_check("impuestos", "base_imponible", "base_imponible_total"), "iva": column_check("impuestos", "cuota_iva", "iva_total"), "recargo": column_check("impuestos", "cuota_recargo_equivalencia", "recargo_equivalencia_total")}
    return finish(df, checks, *logs)


def split_quota(extracted: DataFrame, provider: Provider) -> DataFrame:
    """Suavinex: one shown quota holds tax and surcharge, and is split if the rates reproduce it."""
    df = header(extracted, provider)
    f = F.col("factura")
    df = df.withColumn("_filas", tax_rows(f)).withColumn("_x", F.try_element_at("_filas", F.lit(1)))
    x = F.col("_x")
    both = F.struct(numbers.tax_quota(x["base_imponible"], x["tipo_iva"]).alias("iva"), numbers.tax_quota(x["base_imponible"], x["tipo_recargo_equivalencia"]).alias("recargo"))
    only = F.size("_filas") == 1
    rule = rules.apply_rule(
        "separacion_cuota_fiscal_agregada_suavinex", VERSION, {"un_solo_tramo": only, "cuota_recargo_no_separada": x["cuota_recargo_equivalencia"].isNull()},
        {"base": x["base_imponible"], "tipo_iva": x["tipo_iva"], "tipo_recargo": x["tipo_recargo_equivalencia"], "cuota_agregada": x["cuota_iva"]}, both,
    )
    df = df.withColumn("_regla", rule)
    made = F.col("_regla.valor")
    df = df.withColumn("_cuadre", rules.check_sum(F.array(made["iva"], made["recargo"]), x["cuota_iva"]))
    done = F.coalesce(F.col("_regla.aplicada") & (F.col("_cuadre.estado") == "OK"), F.lit(False))
    df = df.withColumn("_separada", done)
    note = F.concat(F.lit("El PDF agrupa IVA y recargo en una cuota total de "), numbers.spanish_text(x["cuota_iva"]), F.lit(" €"))
    row = x.withField("orden", F.lit(1)).withField("cuota_iva", made["iva"]).withField("cuota_recargo_equivalencia", made["recargo"]).withField("nota", note)
    df = df.withColumns({"impuestos": F.when(F.col("_separada"), F.array(row)).otherwise(F.slice("_filas", 1, 0)), "iva_total": F.when(F.col("_separada"), made["iva"]), "recargo_equivalencia_total": F.when(F.col("_separada"), made["recargo"])})
    pays = lambda n: F.coalesce(F.startswith(F.lower(n), F.lit("giro domiciliado")), F.lit(False))
    orders = lambda n: F.coalesce(F.startswith(F.lower(n), F.lit("pedido:")), F.lit(False))
    due = due_rows(f)
    notes = note_rows(f, lambda _: F.when(F.col("tipo_documento") == "FACTURA", "CARGO")).cast(NOTES)
    df = df.withColumns({"_due": due, "_notes": notes})
    shown = F.coalesce(F.size(f["albaranes"]), F.lit(0))
    whole = rules.apply_rule(
        "importes_factura_para_albaran_unico_suavinex", VERSION, {"factura_visible": F.col("tipo_documento") == "FACTURA", "un_albaran_visible": shown == 1, "relacion_documental_configurada": provider.flag("albaran_unico_abarca_factura")},
        {"base_factura": F.col("base_imponible_total"), "total_factura": F.col("importe_total")}, F.struct(F.col("base_imponible_total").alias("base"), F.col("importe_total").alias("total")),
    )
    df = df.withColumn("_unico", whole)
    clean = lambda n: F.when(~orders(n["descripcion"]), n["descripcion"])
    df = df.withColumns({
        "vencimientos": F.transform("_due", lambda v: v.withField("nota", F.when(~pays(v["nota"]), v["nota"]))),
        "albaranes": F.transform("_notes", lambda n: n.withField("descripcion", clean(n)).withField("importe_base", F.col("_unico.valor.base")).withField("importe_total", F.col("_unico.valor.total"))),
        "ajustes": adjustment_rows(f).cast(ADJUSTMENTS),
    })
    at = lambda block, i, part: F.concat(F.lit(f"{block}["), i.cast("string"), F.lit(f"].{part}"))
    why = F.array_join("_regla.bloqueos", "; ")
    logs = [
        F.array(
            incident(~only, "impuestos", "ESTRUCTURA_FISCAL_SUAVINEX_NO_DEMOSTRADA", "la regla exige un tramo visible", "no se separan cuotas", F.size("_filas")),
            incident(only & ~F.col("_regla.aplicada"), "impuestos", "SEPARACION_FISCAL_BLOQUEADA", "faltan precondiciones para separar", "las cuotas quedan en null", why),
            incident(F.col("_regla.aplicada") & ~F.col("_separada"), "impuestos", "CUOTA_FISCAL_AGREGADA_NO_CUADRA", "las cuotas no reproducen la visible", "las cuotas quedan en null", F.to_json("_cuadre")),
            incident(F.col("_separada"), "impuestos", "CUOTA_FISCAL_AGREGADA_SEPARADA", "la cuota visible es conjunta", "se calculan IVA y recargo", x["cuota_iva"], "AVISO"),
        ),
        each(F.col("_due"), lambda v, i: incident(pays(v["nota"]), at("vencimientos", i, "nota"), "FORMA_PAGO_NO_ES_NOTA_VENCIMIENTO", "la forma de pago no describe el vencimiento", "la nota queda en null", v["nota"], "AVISO")),
        each(F.col("_notes"), lambda n, i: incident(orders(n["descripcion"]), at("albaranes", i, "descripcion"), "REFERENCIA_PEDIDO_BLOQUEADA_COMO_DESCRIPCION_ALBARAN", "el pedido es otro concepto", "la descripcion queda en null", n["descripcion"], "AVISO")),
        each(F.col("_notes"), lambda n, i: F.when(F.col("_unico.aplicada"), incident(F.lit(True), at("albaranes", i, "importes"), "IMPORTES_ASOCIADOS_A_ALBARAN_UNICO", "el unico albaran abarca la factura", "se asocian base y total", n["numero_albaran"], "AVISO")).otherwise(incident(F.lit(True), at("albaranes", i, "importes"), "RELACION_IMPORTES_ALBARAN_NO_DEMOSTRADA", "faltan precondiciones", "los importes quedan en null", F.array_join("_unico.bloqueos", "; ")))),
    ]
    return finish(df, {"total": total_check()}, *logs)


NOTE_TITLES = {"CARGOS": "CARGO", "ABONOS": "ABONO"}


def literal_tables(extracted: DataFrame, provider: Provider) -> DataFrame:
    """Alliance: delivery notes from literal tables, the service fee with proof of inclusion, the single due date rule."""
    df = header(extracted, provider)
    title = lambda t: F.upper(F.trim(F.coalesce(t["titulo_visible"], F.lit(""))))
    tables = F.coalesce("tablas", F.array().cast(TABLES))
    movement = lambda t: F.when(title(t) == "CARGOS", "CARGO").when(title(t) == "ABONOS", "ABONO")
    placed = F.flatten(F.transform(tables, lambda t, n: F.transform(F.when(title(t).isin(*NOTE_TITLES), t["filas"]).otherwise(F.slice(t["filas"], 1, 0)), lambda r: F.struct(t["pagina"].alias("pagina"), n.alias("tabla"), r["orden_visual"].alias("visual"), movement(t).alias("movimiento"), F.transform(r["celdas"], lambda c: F.trim(c)).alias("celdas")))))
    df = df.withColumn("_filas", F.array_sort(placed))
    sound = lambda r: F.coalesce((F.size(r["celdas"]) == 5) & F.forall(r["celdas"], lambda c: c != ""), F.lit(False))
    cell = lambda r, i: F.try_element_at(r["celdas"], F.lit(i))
    made = F.transform(
        "_filas",
        lambda r, i: F.struct(
            (i + 1).alias("orden"), F.when(sound(r), text.identifier(cell(r, 3))).alias("numero_albaran"), numbers.visible_date(cell(r, 1))["value"].alias("fecha_albaran"), r["movimiento"].alias("tipo_movimiento"),
            cell(r, 2).alias("descripcion"), numbers.spanish_amount(cell(r, 4))["value"].alias("importe_base"), numbers.spanish_amount(cell(r, 5))["value"].alias("importe_total"), F.lit(provider.literal).alias("fuente"),
        ),
    ).cast(NOTES)
    amounts = lambda cells: F.filter(F.transform(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), lambda c: numbers.spanish_amount(c)["value"]), lambda v: v.isNotNull())
    named = lambda name: F.try_element_at(F.filter(tables, lambda t: title(t) == name), F.lit(1))
    df = df.withColumns({"albaranes": F.filter(made, lambda x: x["numero_albaran"].isNotNull()), "_gastos": named("GASTOS"), "_compras": named("COMPRAS")})
    bought = F.try_element_at(F.filter(F.coalesce(F.col("_compras.filas"), F.array().cast("array<struct<orden_visual:int,celdas:array<string>>>")), lambda r: F.upper(F.trim(F.try_element_at(r["celdas"], F.lit(1)))) == "TOTAL COMPRAS"), F.lit(1))
    df = df.withColumn("_compra", bind(bind(bought["celdas"], amounts), lambda a: F.when(F.size(a) >= 10, a)))
    fees = F.filter(F.coalesce(F.col("_gastos.filas"), F.array().cast("array<struct<orden_visual:int,celdas:array<string>>>")), lambda r: F.coalesce(F.upper(F.try_element_at(r["celdas"], F.lit(1))).contains("SERVICIO BASICO"), F.lit(False)))
    priced_fees = F.transform(fees, lambda r: F.struct(F.trim(r["celdas"][0]).alias("descripcion"), amounts(r["celdas"]).alias("v")))
    df = df.withColumn("_cuotas", F.transform(priced_fees, lambda r: r.withField("v", F.slice(r["v"], F.greatest(F.size(r["v"]) - 2, F.lit(1)), 3))))
    exact = lambda parts, whole: F.when(F.col("_compra").isNotNull() & whole.isNotNull(), rules.check_sum(parts, whole, "0")["estado"] == "OK")
    base = lambda a: F.concat(F.slice("_compra", 1, 3), F.array(a["v"][0]))
    total = lambda a: F.array(F.element_at("_compra", -1), a["v"][2])
    whole_fee = F.filter("_cuotas", lambda a: F.size(a["v"]) == 3)
    fee = F.transform(whole_fee, lambda a, i: F.struct((i + 1).alias("orden"), F.lit("GASTO").alias("tipo_ajuste"), a["descripcion"].alias("descripcion"), a["v"][2].alias("importe"), exact(base(a), F.col("base_imponible_total")).alias("incluido_en_base"), exact(total(a), F.col("importe_total")).alias("incluido_en_total")))
    df = df.withColumn("ajustes", fee.cast(ADJUSTMENTS))
    blocks = F.coalesce("bloques_vencimiento", F.array().cast(BLOCKS))
    df = df.withColumn("_due", F.transform(blocks, lambda b, i: F.struct((i + 1).alias("orden"), numbers.visible_date(b["texto_fecha"])["value"].alias("fecha_vencimiento"), numbers.spanish_amount(b["texto_importe"])["value"].alias("importe"), F.lit(None).cast("string").alias("nota"))))
    dated, priced = F.size(F.filter("_due", lambda v: v["fecha_vencimiento"].isNotNull())), F.size(F.filter("_due", lambda v: v["importe"].isNotNull()))
    conditions = {
        "proveedor_alliance": F.when(F.col("proveedor_nombre").isNotNull(), F.col("proveedor_nombre") == provider.name),
        "factura_separada_inequivocamente": provider.flag("factura_separada_inequivocamente"),
        "unica_fecha_vencimiento": (dated == 1) & (F.size("_due") == 1),
        "sin_vencimientos_multiples": F.size("_due") == 1,
        "sin_pagos_parciales_o_fraccionamiento": ~provider.flag("pagos_parciales_o_fraccionamiento"),
        "sin_importes_vencimiento_distintos": ~provider.flag("importes_vencimiento_distintos"),
        "importe_total_valido": F.col("importe_total").isNotNull(),
        "sin_descuadre_total": ~provider.flag("descuadre_total"),
        "sin_importe_visible_incompatible": priced == 0,
    }
    df = df.withColumn("_vence", rules.apply_rule("regla_proveedor_alliance_vencimiento_unico", VERSION, conditions, {"importe_total": F.col("importe_total")}, F.col("importe_total")))
    needs = (dated == 1) & (priced == 0)
    df = df.withColumn("_asignar", needs & F.col("_vence.aplicada"))
    fill = F.col("_asignar")
    df = df.withColumns({
        "vencimientos": F.transform("_due", lambda v: v.withField("nota", F.when(fill & v["fecha_vencimiento"].isNotNull(), F.lit("Importe asignado por regla de vencimiento unico"))).withField("importe", F.when(fill & v["fecha_vencimiento"].isNotNull(), F.col("_vence.valor")).otherwise(v["importe"]))),
        "impuestos": tax_rows(F.col("factura")),
    })
    logs = [
        each(F.col("_filas"), lambda r, i: incident(~sound(r), "albaranes", "FILA_LITERAL_INCOMPLETA", "la fila no tiene cinco celdas llenas", "no se crea albaran", F.array_join(r["celdas"], " | "))),
        F.array(incident(F.size("albaranes") > 0, "albaranes.orden", "ORDEN_RECONSTRUIDO", "las tablas pueden ser paralelas", "orden por pagina, tabla y fila", level="AVISO")),
        each(F.col("_cuotas"), lambda a, i: incident(F.size(a["v"]) < 3, "ajustes", "SERVICIO_BASICO_INCOMPLETO", "faltan base, IVA o total", "no se crea el ajuste", a["descripcion"])),
        each(F.col("ajustes"), lambda a, i: incident(a["incluido_en_base"].isNull() | a["incluido_en_total"].isNull(), "ajustes.inclusion", "INCLUSION_NO_DEMOSTRADA", "no se demuestra la inclusion", "quedan en null", a["descripcion"])),
        F.array(incident(~F.col("_vence.aplicada") & (F.size(F.filter("_due", lambda v: v["importe"].isNull())) > 0), "vencimientos.importe", "REGLA_VENCIMIENTO_UNICO_NO_APLICABLE", "no se cumplen las condiciones", "importe en null", F.array_join("_vence.bloqueos", "; "))),
    ]
    return finish(df, {"total": total_check(), "iva": column_check("impuestos", "cuota_iva", "iva_total")}, *logs)

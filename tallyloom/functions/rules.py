"""Evidence, sums, rules, incidents and provenance as struct columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import MONEY
from .text import bind

CENT = "0.01"
PROVENANCE = "struct<tipo:string,fuente:string,regla:string,version_regla:string>"
INCIDENT = "struct<campo:string,tipo_incidencia:string,nivel:string,descripcion:string,datos:string,decision:string>"


def evidenced(field: Column) -> Column:
    """A field's value if it has evidence and all of it is valid: a text or a page."""
    valid = lambda e: F.coalesce((F.trim(e["texto_visible"]) != "") | e["pagina"].isNotNull(), F.lit(False))
    proof = field["evidencias"]
    return F.when(F.coalesce((F.size(proof) > 0) & F.forall(proof, valid), F.lit(False)), field["valor"])


def sum_of(values: Column) -> Column:
    """Exact sum of an array of decimals."""
    return F.aggregate(values, F.lit(0).cast("decimal(24,2)"), lambda a, x: (a + x).cast("decimal(24,2)"))


def check_sum(addends: Column, expected: Column, tolerance: str = CENT) -> Column:
    """struct(estado, esperado, obtenido, diferencia, tolerancia): a null anywhere cannot be evaluated."""

    def summed(x: Column) -> Column:
        whole = x["e"].isNotNull() & x["a"].isNotNull() & F.forall(x["a"], lambda v: v.isNotNull())
        return F.struct(x["e"].alias("e"), F.when(whole, sum_of(x["a"])).alias("got"))

    def stated(x: Column) -> Column:
        off = (x["got"] - x["e"]).cast("decimal(24,2)")
        limit = F.lit(tolerance).cast("decimal(6,2)")
        state = F.when(x["got"].isNull(), "NO_EVALUABLE").when(F.abs(off) <= limit, "OK").otherwise("ERROR")
        return F.struct(state.alias("estado"), x["e"].alias("esperado"), x["got"].alias("obtenido"), off.alias("diferencia"), limit.alias("tolerancia"))

    return bind(bind(F.struct(addends.alias("a"), expected.cast("decimal(24,2)").alias("e")), summed), stated)


def provenance(kind: str, source: str = "python", rule: str | None = None, version: str | None = None) -> Column:
    """A rule and its version belong to derived values, and only to them."""
    if (kind == "REGLA_DETERMINISTA") != (rule is not None and version is not None):
        raise ValueError("rule and version go with a derived value")
    text = lambda x: F.lit(x).cast("string")
    return F.struct(text(kind).alias("tipo"), text(source).alias("fuente"), text(rule).alias("regla"), text(version).alias("version_regla"))


def apply_rule(name: str, version: str, preconditions: dict[str, Column], inputs: dict[str, Column], value: Column) -> Column:
    """struct(valor, aplicada, procedencia, bloqueos): ``value`` counts only if every precondition is exactly true and
    every input is there; else the reasons are listed in order."""
    if not name.strip() or not version.strip():
        raise ValueError("a rule has a name and a version")
    said = lambda c: F.when(c.isNull(), "None").when(c, "True").otherwise("False")
    reasons = [F.when(~c.eqNullSafe(F.lit(True)), F.concat(F.lit(f"precondicion:{k}="), said(c))) for k, c in preconditions.items()]
    reasons += [F.when(c.isNull(), F.lit(f"entrada:{k}=ausente")) for k, c in inputs.items()]
    reasons += [F.lit("precondiciones=ausentes")] * (not preconditions) + [F.lit("entradas=ausentes")] * (not inputs)
    blocks = F.filter(F.array(*reasons), lambda x: x.isNotNull())

    def result(x: Column) -> Column:
        said_none = F.when((F.size(x["b"]) == 0) & x["v"].isNull(), F.array(F.lit("resultado=ausente"))).otherwise(x["b"])
        done = (F.size(x["b"]) == 0) & x["v"].isNotNull()
        return F.struct(F.when(done, x["v"]).alias("valor"), done.alias("aplicada"), F.when(done, provenance("REGLA_DETERMINISTA", rule=name, version=version)).alias("procedencia"), said_none.alias("bloqueos"))

    return bind(F.struct(blocks.alias("b"), value.alias("v")), result)


def incident(when: Column, field: str | Column, kind: str | Column, text: str | Column, decision: str | Column, data: Column | None = None, level: str = "REVISION_MANUAL") -> Column:
    """One incident or null."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(
        F.coalesce(when, F.lit(False)),
        F.struct(
            as_column(field).alias("campo"), as_column(kind).alias("tipo_incidencia"), F.lit(level).alias("nivel"),
            as_column(text).alias("descripcion"), (data if data is not None else F.lit(None)).cast("string").alias("datos"), as_column(decision).alias("decision"),
        ),
    )


def incident_log(*entries: Column) -> Column:
    """Incidents (each a struct, null, or an array of them) in the order given, numbered from 1."""
    lists = F.concat(*(F.filter(e, lambda x: x.isNotNull()) for e in entries))
    return F.transform(lists, lambda x, i: F.struct((i + 1).alias("orden"), x["campo"].alias("campo"), x["tipo_incidencia"].alias("tipo_incidencia"), x["nivel"].alias("nivel"), x["descripcion"].alias("descripcion"), x["datos"].alias("datos"), x["decision"].alias("decision"), (x["nivel"] == "REVISION_MANUAL").alias("requiere_revision_manual")))


def failed_check(name: str, check: Column) -> Column:
    """The incident of a sum check that is not OK."""
    return incident(check["estado"] != "OK", name, F.concat(F.lit("VALIDACION_MONETARIA_"), check["estado"]), "la suma no se pudo confirmar", "se conserva el valor visible", F.to_json(check))


def money(c: Column) -> Column:
    return c.cast(MONEY)


def unmet(preconditions: Column) -> Column:
    """The entries of a map of flags that are not exactly true."""
    return F.map_filter(preconditions, lambda _, v: ~v.eqNullSafe(F.lit(True)))


def first_page(row: Column, *fields: str) -> Column:
    """The page of the first evidence of the first of some fields that has one."""
    return F.coalesce(*(F.get(row[f]["evidencias"], F.lit(0))["pagina"] for f in fields))

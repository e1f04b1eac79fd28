"""Queries of sums, rules, fusion and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numbers import MONEY, tax_quota
from ..operators import evaluate
from .base import Catalogue, Tables

C = Catalogue()
M = "DECIMAL(14,2)"


def order_sums(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast("decimal(24,2)").alias("suma"))
    shift = F.when(F.col("l_orderkey") % 4 == 3, F.lit(None)).otherwise(F.col("suma") + (F.col("l_orderkey") % 4 * F.lit("0.01").cast("decimal(3,2)")))
    return lines.withColumn("esperado", shift.cast("decimal(24,2)"))


@C.add(
    "sum_validation_states",
    f"""SELECT l_orderkey, CASE l_orderkey % 4 WHEN 3 THEN 'NO_EVALUABLE' WHEN 2 THEN 'ERROR' ELSE 'OK' END AS estado,
  CASE l_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN CAST(-0.02 AS DECIMAL(24,2)) WHEN 1 THEN CAST(-0.01 AS DECIMAL(24,2)) ELSE CAST(0 AS DECIMAL(24,2)) END AS diferencia
FROM lineitem GROUP BY 1""",
)
def sum_states(t: Tables) -> DataFrame:
    check = rules.check_sum(F.array(F.col("suma")), F.col("esperado"))
    return order_sums(t).select("l_orderkey", check["estado"].alias("estado"), check["diferencia"].alias("diferencia"))


@C.add(
    "rule_engine_blocks",
    """WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_acctbal AS DECIMAL(14,2)) END AS saldo FROM customer)
SELECT c_custkey, CASE WHEN flag AND saldo IS NOT NULL THEN saldo * 2 END AS valor, coalesce(flag AND saldo IS NOT NULL, FALSE) AS aplicada,
  concat_ws(';', CASE WHEN flag IS NULL THEN 'precondicion:activo=None' WHEN NOT flag THEN 'precondicion:activo=False' END, CASE WHEN saldo IS NULL THEN 'entrada:saldo=ausente' END) AS bloqueos FROM c""",
)
def blocks(t: Tables) -> DataFrame:
    c = t.customer.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 3 == 0, True).when(F.col("c_custkey") % 3 == 1, False).alias("flag"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal").cast(MONEY)).alias("saldo"),
    )
    got = c.select("c_custkey", rules.apply_rule("doble", "1", {"activo": F.col("flag")}, {"saldo": F.col("saldo")}, F.col("saldo") * 2).alias("r"))
    return got.select("c_custkey", F.col("r.valor").cast("decimal(18,2)").alias("valor"), "r.aplicada", F.array_join("r.bloqueos", ";").alias("bloqueos"))


@C.add(
    "tax_rows_validation",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(14,2)) AS base,
  CAST(round(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(round(l_tax * 100) AS DECIMAL(4,0)) * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(14,2)) AS cuota FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, cuota, CASE WHEN l_partkey % 7 = 0 THEN 'ERROR' ELSE 'OK' END AS estado FROM x""",
)
def tax_rows(t: Tables) -> DataFrame:
    """Each line's tax against its base and rate; some visible quotas are a euro off."""
    quota = tax_quota(F.col("l_extendedprice"), F.round(F.col("l_tax") * 100))
    seen = (quota + F.when(F.col("l_partkey") % 7 == 0, 1).otherwise(0)).cast(MONEY)
    check = rules.check_sum(F.array(quota), seen)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", quota.alias("cuota"), check["estado"].alias("estado"))


@C.add(
    "fusion_priority",
    f"""WITH g AS (SELECT o_orderkey AS k, CAST(o_totalprice AS {M}) AS v FROM orders WHERE o_orderkey % 3 <> 0),
l AS (SELECT o_orderkey AS k, CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS {M}) AS v FROM orders WHERE o_orderkey % 2 = 0)
SELECT k, coalesce(l.v, g.v) AS v, CASE WHEN l.k IS NOT NULL THEN 'literal' ELSE 'general' END AS fuente, coalesce(g.v <> l.v, FALSE) AS conflicto FROM g FULL JOIN l USING (k)""",
)
def fusion(t: Tables) -> DataFrame:
    """Two sources of the same notes: the literal one wins, the general one fills up, conflicts are flagged."""
    v = F.col("o_totalprice")
    g = t.orders.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), v.cast(MONEY).alias("gv"))
    lit = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 == 0, v + 1).otherwise(v).cast(MONEY).alias("lv"), F.lit(True).alias("has"))
    return g.join(lit, "k", "full").select("k", F.coalesce("lv", "gv").alias("v"), F.when(F.col("has"), "literal").otherwise("general").alias("fuente"), F.coalesce(F.col("gv") != F.col("lv"), F.lit(False)).alias("conflicto"))


def gold_and_got(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two versions of the documents' fields, one of them perturbed."""
    gold = t.documents.select("doc_id", F.explode(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.expr("CASE WHEN doc_id % 6 <> 0 THEN source END"))).alias("campo", "valor"))
    v = F.when((F.col("doc_id") % 5 == 0) & (F.col("campo") == "lang"), F.upper("valor")).when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 11 == 0, F.lit("otro")).when(F.col("valor").isNull() & (F.col("doc_id") % 2 == 0), "inventado").otherwise(F.col("valor"))
    return gold, gold.filter("doc_id % 13 <> 0").withColumn("valor", v)


STATES = """WITH gold AS (SELECT doc_id, 'lang' AS campo, lang AS valor FROM documents UNION ALL SELECT doc_id, 'source', CASE WHEN doc_id % 6 <> 0 THEN source END FROM documents),
got AS (SELECT doc_id, campo, CASE WHEN doc_id % 5 = 0 AND campo = 'lang' THEN upper(valor) WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'otro' WHEN valor IS NULL AND doc_id % 2 = 0 THEN 'inventado' ELSE valor END AS valor FROM gold WHERE doc_id % 13 <> 0),
s AS (SELECT doc_id, campo, gold.valor AS esperado, got.valor AS obtenido, CASE WHEN gold.valor IS NOT DISTINCT FROM got.valor THEN 'CORRECTO' WHEN got.valor IS NULL THEN 'AUSENTE' WHEN gold.valor IS NULL THEN 'INVENTADO'
  WHEN lower(gold.valor) = lower(got.valor) THEN 'DIFERENCIA_FORMATO' ELSE 'INCORRECTO' END AS estado FROM gold FULL JOIN got USING (doc_id, campo))"""

CLASSES = STATES + """, n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (estado = 'CORRECTO') AS correcto, count(*) FILTER (estado = 'DIFERENCIA_FORMATO') AS diferencia_formato, count(*) FILTER (estado = 'AUSENTE') AS ausente,
  count(*) FILTER (estado = 'INVENTADO') AS inventado, count(*) FILTER (estado = 'INCORRECTO') AS incorrecto FROM s GROUP BY 1),
c AS (SELECT *, CASE WHEN correcto = n THEN 'CORRECTO' WHEN inventado > 0 AND correcto = 0 AND incorrecto = 0 THEN 'INVENTADO' WHEN ausente = n THEN 'AUSENTE' WHEN correcto > 0 OR diferencia_formato > 0 THEN 'PARCIAL' ELSE 'INCORRECTO' END AS clase FROM n)"""


@C.add("eval_atom_state", STATES + " SELECT doc_id, campo, esperado, obtenido, estado FROM s")
def atom_state(t: Tables) -> DataFrame:
    return evaluate.compare(*gold_and_got(t), ["doc_id", "campo"])


@C.add("eval_field_class", CLASSES + " SELECT * FROM c")
def field_class(t: Tables) -> DataFrame:
    return evaluate.field_class(atom_state(t), ["doc_id"])


@C.add(
    "eval_summary",
    CLASSES + """ SELECT lang, count(*) AS campos, count(*) FILTER (clase = 'CORRECTO') AS correctos, CAST(round(count(*) FILTER (clase = 'CORRECTO') * 100.0 / count(*), 2) AS DECIMAL(6,2)) AS exactitud,
  CAST(round(count(*) FILTER (clase <> 'AUSENTE') * 100.0 / count(*), 2) AS DECIMAL(6,2)) AS cobertura FROM c JOIN documents USING (doc_id) GROUP BY 1""",
)
def summary(t: Tables) -> DataFrame:
    return evaluate.summary(field_class(t).join(t.documents.select("doc_id", "lang"), "doc_id"), ["lang"])


@C.add("eval_state_pivot", STATES + """ SELECT campo, count(*) FILTER (estado = 'CORRECTO') AS "CORRECTO", count(*) FILTER (estado = 'AUSENTE') AS "AUSENTE", count(*) FILTER (estado = 'INVENTADO') AS "INVENTADO" FROM s GROUP BY 1""")
def state_pivot(t: Tables) -> DataFrame:
    return atom_state(t).groupBy("campo").pivot("estado", ["CORRECTO", "AUSENTE", "INVENTADO"]).agg(F.count("doc_id")).na.fill(0)


def notes(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Order lines as delivery notes, and as obtained ones with notes left out, renumbered, without a number, doubled, moved and changed."""
    gold = t.lineitem.select("l_orderkey", F.expr("CASE WHEN l_partkey % 23 <> 0 THEN l_partkey END AS l_partkey"), F.col("l_extendedprice").cast(MONEY).alias("importe"), F.to_date("l_shipdate").alias("fecha"), F.col("l_linenumber").cast("int").alias("orden"))
    got = gold.filter("coalesce(l_partkey, 1) % 9 <> 0").select(
        "l_orderkey",
        F.expr("CASE WHEN l_partkey % 8 = 0 THEN l_partkey + 1000000 ELSE l_partkey END AS l_partkey"),
        F.expr(f"CAST(CASE WHEN l_partkey % 5 = 0 THEN -importe ELSE importe END AS {MONEY})").alias("importe"),
        F.expr("CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE fecha END AS fecha"),
        F.expr("CASE WHEN l_partkey % 11 = 0 THEN orden + 1 ELSE orden END AS orden"),
    )
    return gold, got.unionByName(got.filter("l_partkey % 6 = 0").withColumn("importe", (F.col("importe") + 1).cast(MONEY)).withColumn("orden", F.col("orden") + 100))


@C.add(
    "eval_note_metrics",
    f"""WITH g AS (SELECT l_orderkey, CASE WHEN l_partkey % 23 <> 0 THEN l_partkey END AS num, CAST(l_extendedprice AS {M}) AS importe, CAST(l_shipdate AS DATE) AS fecha, CAST(l_linenumber AS INTEGER) AS orden FROM lineitem),
o0 AS (SELECT l_orderkey, CASE WHEN num % 8 = 0 THEN num + 1000000 ELSE num END AS num, CASE WHEN num % 5 = 0 THEN -importe ELSE importe END AS importe,
  CASE WHEN num % 7 = 0 THEN NULL ELSE fecha END AS fecha, CASE WHEN num % 11 = 0 THEN orden + 1 ELSE orden END AS orden FROM g WHERE coalesce(num, 1) % 9 <> 0),
o AS (SELECT * FROM o0 UNION ALL SELECT l_orderkey, num, importe + 1, fecha, orden + 100 FROM o0 WHERE num % 6 = 0),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, num ORDER BY orden DESC, importe DESC) AS r, count(*) OVER (PARTITION BY l_orderkey, num) AS n FROM o WHERE num IS NOT NULL) WHERE r = 1),
k AS (SELECT DISTINCT l_orderkey FROM g), gn AS (SELECT DISTINCT l_orderkey, num FROM g WHERE num IS NOT NULL),
e AS (SELECT g.l_orderkey, count(*) FILTER (g.fecha IS NOT DISTINCT FROM l.fecha) AS fechas, count(*) FILTER (g.importe = l.importe) AS bien, count(*) FILTER (g.importe <> l.importe) AS mal, count(*) FILTER (sign(g.importe) <> sign(l.importe)) AS signos, count(*) FILTER (g.orden = l.orden) AS ordenes
  FROM g JOIN l ON g.l_orderkey = l.l_orderkey AND g.num = l.num GROUP BY 1),
n AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, count(*) FILTER (a.num IS NOT NULL AND b.num IS NOT NULL) AS correctos, count(*) FILTER (b.num IS NULL) AS omitidos, count(*) FILTER (a.num IS NULL) AS inventados, CAST(coalesce(sum(b.n - 1), 0) AS BIGINT) AS duplicados
  FROM gn a FULL JOIN l b ON a.l_orderkey = b.l_orderkey AND a.num = b.num GROUP BY 1)
SELECT k.l_orderkey, (SELECT count(*) FROM g WHERE g.l_orderkey = k.l_orderkey) AS esperados, (SELECT count(*) FROM o WHERE o.l_orderkey = k.l_orderkey) AS obtenidos,
  coalesce(correctos, 0) AS correctos, coalesce(omitidos, 0) AS omitidos, coalesce(inventados, 0) AS inventados, coalesce(duplicados, 0) AS duplicados, coalesce(bien, 0) AS importes_correctos, coalesce(mal, 0) AS importes_incorrectos,
  coalesce(signos, 0) AS signos_incorrectos, coalesce(fechas, 0) AS fechas_correctas, coalesce(ordenes, 0) AS ordenes_correctos
FROM k LEFT JOIN n ON n.l_orderkey = k.l_orderkey LEFT JOIN e ON e.l_orderkey = k.l_orderkey""",
)
def note_metrics(t: Tables) -> DataFrame:
    return evaluate.key_metrics(*notes(t), ["l_orderkey"], "l_partkey", ["importe"], "fecha", "orden")


@C.add(
    "eval_row_verdict",
    """SELECT l_orderkey, CASE WHEN bool_and(l_partkey % 17 <> 0 AND l_linenumber < 7) THEN 'CORRECTO_COMPLETO' WHEN bool_and(l_partkey % 17 <> 0) THEN 'CONTENIDO_ORDEN_DIFERENTE' ELSE 'DIFERENCIAS_REALES' END AS veredicto FROM lineitem GROUP BY 1""",
)
def verdict(t: Tables) -> DataFrame:
    return evaluate.row_verdict(t.lineitem, ["l_orderkey"], F.col("l_partkey") % 17 != 0, F.col("l_linenumber") < 7)


@C.add(
    "cost_summary",
    """WITH c AS (SELECT event_type, event_type <> 'error' AND event_id % 10 <> 0 AS ok, CASE WHEN event_id % 4 <> 0 THEN CAST(value AS DECIMAL(14,2)) END AS v FROM events)
SELECT event_type, count(*) AS llamadas, count(*) FILTER (NOT ok) AS fallidas, CAST(coalesce(sum(v), 0) AS DECIMAL(18,6)) AS coste,
  CAST(CASE WHEN count(*) FILTER (ok) > 0 THEN round(CAST(coalesce(sum(v), 0) AS DECIMAL(18,6)) / count(*) FILTER (ok), 6) ELSE 0 END AS DECIMAL(18,6)) AS coste_medio, count(*) FILTER (v IS NULL) AS sin_coste FROM c GROUP BY 1""",
)
def costs(t: Tables) -> DataFrame:
    calls = t.events.select("event_type", F.when((F.col("event_type") != "error") & (F.col("event_id") % 10 != 0), "completed").otherwise("failed").alias("estado"), F.when(F.col("event_id") % 4 != 0, F.col("value").cast(MONEY)).alias("coste_usd"))
    return evaluate.cost_summary(calls, "event_type", "estado", "coste_usd")


@C.add(
    "cost_projection",
    """WITH m AS (SELECT event_type, CAST(sum(CAST(value AS DECIMAL(14,2))) AS DECIMAL(18,6)) AS total, count(*) FILTER (event_id % 10 <> 0) AS n, CAST(max(CAST(value AS DECIMAL(14,2))) AS DECIMAL(18,6)) AS literal FROM events GROUP BY 1),
x AS (SELECT event_type, CAST(CASE WHEN n > 0 THEN round(total / n, 6) ELSE 0 END AS DECIMAL(18,6)) AS general, literal FROM m),
y AS (SELECT event_type, general, literal, CAST(p AS DECIMAL(3,2)) AS proporcion, general * 60 + literal * 60 * CAST(p AS DECIMAL(3,2)) AS mes FROM x, (VALUES (0.2), (0.4), (0.6)) v(p))
SELECT event_type, general, literal, proporcion, CAST(round(mes, 2) AS DECIMAL(18,2)) AS coste_mensual, CAST(round(mes * 12, 2) AS DECIMAL(18,2)) AS coste_anual FROM y""",
)
def project(t: Tables) -> DataFrame:
    calls = t.events.select("event_type", F.when(F.col("event_id") % 10 != 0, "completed").otherwise("failed").alias("estado"), F.col("value").cast(MONEY).alias("coste_usd"))
    means = evaluate.cost_summary(calls, "event_type", "estado", "coste_usd").select("event_type", F.col("coste_medio").alias("general"))
    literal = t.events.groupBy("event_type").agg(F.max(F.col("value").cast(MONEY)).cast("decimal(18,6)").alias("literal"))
    return evaluate.projection(means.join(literal, "event_type"), "general", "literal")

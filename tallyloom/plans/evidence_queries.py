"""Queries of evidence in texts, of dependencies between views, and of reading JSON with located errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dependencies, evidence
from ..sources.files import NOT_OBJECT, checked_json
from .base import Catalogue, Tables

C = Catalogue()

#: Three pieces of evidence a document as both engines say them: a part of the text in capitals, one that isn't there, and none.
PART = "upper(substr(text, 3, 40))"
TREE_SQL = """to_json(named_struct('factura', named_struct('numero', named_struct('valor', doc_id, 'evidencias', array(named_struct('pagina', 1, 'texto_visible', upper(substr(text, 3, 40))), named_struct('pagina', 1, 'texto_visible', concat(upper(substr(text, 3, 40)), '@@')))),
  'lineas', array(named_struct('total', named_struct('valor', n_chars, 'evidencias', array(named_struct('pagina', 2, 'texto_visible', ''))))))))"""
FOLDED = "trim(regexp_replace(replace(replace(lower(strip_accents({})), 'ß', 'ss'), 'ς', 'σ'), '\\s+', ' ', 'g'))"


@C.add(
    "evidence_verified",
    f"""WITH e AS (SELECT doc_id, {PART} AS texto, text FROM documents UNION ALL SELECT doc_id, {PART} || '@@', text FROM documents UNION ALL SELECT doc_id, '', text FROM documents),
v AS (SELECT doc_id, texto <> '' AND contains({FOLDED.format('text')}, {FOLDED.format('texto')}) AS ok FROM e)
SELECT doc_id, count(*) FILTER (ok) AS verificadas_en_texto, count(*) FILTER (NOT ok) AS no_verificables FROM v GROUP BY 1""",
)
def evidence_verified(t: Tables) -> DataFrame:
    """Evidence of nested results, found wherever it stands in their trees, against the text of their document in two pages."""
    trees = t.documents.select("doc_id", F.expr(f"parse_json({TREE_SQL})").alias("arbol"))
    half = F.expr("CAST(length(text) / 2 AS INT)")
    pages = t.documents.select("doc_id", F.explode(F.array(F.struct(F.lit(2).alias("n"), F.substring("text", half + 61, F.length("text")).alias("x")), F.struct(F.lit(1).alias("n"), F.substring("text", F.lit(1), half + 60).alias("x")))).alias("p"))
    texts = evidence.page_text(pages.select("doc_id", F.col("p.n").alias("n"), F.col("p.x").alias("x")), ["doc_id"], "n", "x")
    return evidence.verification_counts(evidence.verified(evidence.evidence_texts(trees, ["doc_id"], "arbol"), texts, ["doc_id"]), ["doc_id"])


#: A benchmark item's first, second and all words, and a middle part that begins and ends within words.
ITEMS = """SELECT split_part(text, ' ', 1) AS patron FROM benchmark UNION SELECT split_part(text, ' ', 2) FROM benchmark UNION SELECT text FROM benchmark UNION SELECT substr(text, 12, 30) FROM benchmark"""


@C.add(
    "evidence_search",
    f"""WITH p AS (SELECT patron, {FOLDED.format('patron')} AS q FROM ({ITEMS})), d AS (SELECT doc_id, {FOLDED.format('text')} AS x FROM documents)
SELECT patron, count(d.doc_id) AS textos, min(d.doc_id) AS primero FROM p LEFT JOIN d ON contains(d.x, p.q) GROUP BY 1""",
)
def evidence_search(t: Tables) -> DataFrame:
    """How many documents have each of many patterns."""
    part = lambda *x: F.array(*(F.split_part("text", F.lit(" "), F.lit(n)) for n in x), F.col("text"), F.substring("text", 12, 30))
    items = t.benchmark.select(F.explode(part(1, 2)).alias("patron"))
    return evidence.search_texts(items, t.documents, "patron", "text", "doc_id")


#: Views over the tables: by name the statement; some read others, in subqueries and common tables too.
VIEWS = {
    "dep_abiertos": "SELECT * FROM dep_orders WHERE o_orderstatus = 'O'",
    "dep_clientes": "SELECT c_custkey, c_name, n FROM dep_customer JOIN (SELECT o_custkey, count(*) AS n FROM dep_abiertos GROUP BY o_custkey) ON c_custkey = o_custkey",
    "dep_lineas": "WITH dep_clientes AS (SELECT * FROM dep_lineitem) SELECT * FROM dep_clientes WHERE l_orderkey IN (SELECT o_orderkey FROM dep_abiertos)",
    "dep_informe": "SELECT c.*, (SELECT count(*) FROM dep_lineas) AS lineas FROM dep_clientes c",
    "dep_suelta": "SELECT 1 AS uno",
}
BASES = ("orders", "customer", "lineitem")


@C.add(
    "view_dependencies",
    """WITH RECURSIVE e AS (SELECT * FROM (VALUES ('dep_abiertos', 'dep_orders'), ('dep_clientes', 'dep_customer'), ('dep_clientes', 'dep_abiertos'), ('dep_lineas', 'dep_lineitem'), ('dep_lineas', 'dep_abiertos'), ('dep_informe', 'dep_clientes'), ('dep_informe', 'dep_lineas')) v(objeto, depende_de)),
r AS (SELECT objeto, depende_de, 1 AS nivel FROM e UNION SELECT r.objeto, e.depende_de, nivel + 1 FROM r JOIN e ON e.objeto = r.depende_de),
a AS (SELECT * FROM orders WHERE o_orderstatus = 'O'), k AS (SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM a)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM a)),
n AS (SELECT 'dep_orders' AS depende_de, count(*) AS filas FROM orders UNION ALL SELECT 'dep_customer', count(*) FROM customer UNION ALL SELECT 'dep_lineitem', count(*) FROM lineitem
  UNION ALL SELECT 'dep_abiertos', count(*) FROM a UNION ALL SELECT 'dep_clientes', count(*) FROM k UNION ALL SELECT 'dep_lineas', count(*) FROM l)
SELECT objeto, depende_de, CAST(min(nivel) AS INTEGER) AS nivel, any_value(filas) AS filas FROM r JOIN n USING (depende_de) GROUP BY 1, 2""",
)
def view_dependencies(t: Tables) -> DataFrame:
    """What views over the tables depend on, at which remove, and how many rows each of these has."""
    spark = t.spark
    for name in BASES:
        getattr(t, name).createOrReplaceTempView(f"dep_{name}")
    for name, text in VIEWS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS {text}")
    try:
        edges = dependencies.dependency_edges(spark).filter(F.col("objeto").isin(*VIEWS))
        counted = [spark.table(n).agg(F.count("*").alias("filas")).select(F.lit(n).alias("depende_de"), "filas") for n in (*(f"dep_{b}" for b in BASES), "dep_abiertos", "dep_clientes", "dep_lineas")]
        return dependencies.closure(edges, "objeto", "depende_de").join(reduce(DataFrame.unionByName, counted), "depende_de").select("objeto", "depende_de", "nivel", "filas")
    finally:
        for name in (*VIEWS, *(f"dep_{b}" for b in BASES)):
            spark.catalog.dropTempView(name)


@C.add(
    "event_reach",
    """WITH RECURSIVE e AS (SELECT DISTINCT event_id AS a, event_id // 4 AS b FROM events WHERE event_id > 0 AND event_type <> 'error'),
r AS (SELECT a, b, 1 AS nivel FROM e UNION ALL SELECT r.a, e.b, nivel + 1 FROM r JOIN e ON e.a = r.b) SELECT a, b, CAST(min(nivel) AS INTEGER) AS nivel FROM r GROUP BY 1, 2""",
)
def event_reach(t: Tables) -> DataFrame:
    """The closure of a forest over all events, each under the event of a quarter of its number."""
    edges = t.events.filter("event_id > 0 AND event_type <> 'error'").select(F.col("event_id").alias("a"), F.expr("event_id div 4 AS b"))
    return dependencies.closure(edges, "a", "b")


#: An order as JSON over three lines: sound, an array, without a colon (at a column that differs), cut off, or null.
BROKEN = """CASE o_orderkey % 5 WHEN 0 THEN '[' || CAST(o_custkey AS VARCHAR) || ']' WHEN 1 THEN '{' || chr(10) || repeat(' ', CAST(o_custkey % 9 AS INTEGER)) || '"cliente" ' || CAST(o_custkey AS VARCHAR) || '}'
  WHEN 2 THEN '{"cliente":' || chr(10) || chr(10) || '"' WHEN 3 THEN NULL ELSE '{"cliente":' || CAST(o_custkey AS VARCHAR) || '}' END"""


@C.add(
    "json_located_errors",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN CAST(o_custkey AS VARCHAR) END AS cliente, CASE o_orderkey % 5 WHEN 0 THEN '{NOT_OBJECT}' WHEN 1 THEN 'Expecting '':'' delimiter' WHEN 2 THEN 'Unterminated string starting at' WHEN 3 THEN 'no text' END AS mensaje,
  CAST(CASE o_orderkey % 5 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS INTEGER) AS linea, CAST(CASE o_orderkey % 5 WHEN 1 THEN o_custkey % 9 + 11 WHEN 2 THEN 1 END AS INTEGER) AS columna FROM orders""",
)
def json_errors(t: Tables) -> DataFrame:
    texts = t.orders.select("o_orderkey", F.expr(BROKEN.replace("VARCHAR", "STRING")).alias("texto"))
    got = checked_json(texts, "texto", "o_orderkey")
    return got.select("o_orderkey", F.try_variant_get("documento", "$.cliente", "string").alias("cliente"), "mensaje", "linea", "columna")

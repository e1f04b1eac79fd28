"""Evidence in texts, dependencies and closures, alignment of transcribed rows: edge cases against plain Python."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from tallyloom.functions import numbers
from tallyloom.operators import alignment, dependencies, evaluate, evidence


def test_search_equals_contains(spark, monkeypatch):
    monkeypatch.setattr(evidence, "BLOCK_CHARS", 40)
    r = random.Random(2)
    texts = ["".join(r.choices("abÁ  ", k=r.randrange(0, 60))) for _ in range(120)] + [None, ""]
    patterns = ["".join(r.choices("abÁ ", k=r.randrange(1, 5))) for _ in range(60)] + ["", "zz", None, "ab", "ab", "Á"]
    got = {p: (n, first) for p, n, first in evidence.search_texts(spark.createDataFrame([(p,) for p in patterns], "p string"), spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "p", "t", "id").collect()}
    plain = lambda t: " ".join(t.lower().replace("á", "a").split())
    for p in set(patterns) - {None}:
        hits = [i for i, t in enumerate(texts) if t is not None and plain(p) in plain(t)]
        assert got[p] == (len(hits), min(hits, default=None)), p
    assert None not in got
    none = spark.createDataFrame([], "id long, t string")
    assert evidence.search_texts(spark.createDataFrame([("x",)], "p string"), none, "p", "t", "id").collect()[0].textos == 0


def test_verified_by_document(spark):
    tree = '{"a":{"valor":1,"evidencias":[{"texto_visible":"Total  ÀB"},{"texto_visible":""},{"pagina":2}]},"x":[{"evidencias":[{"texto_visible":"no"}]}],"evidencias":"text"}'
    docs = spark.createDataFrame([(1, tree), (2, tree)], "k long, t string").select("k", F.parse_json("t").alias("arbol"))
    pages = spark.createDataFrame([(1, 2, "ab fin"), (1, 1, "el TOTAL"), (1, 3, None), (3, 1, "x")], "k long, p int, t string")
    got = evidence.verified(evidence.evidence_texts(docs, ["k"], "arbol"), evidence.page_text(pages, ["k"], "p", "t"), ["k"])
    assert {(r.k, r.ruta): r.verificada for r in got.collect()} == {(k, path): k == 1 and path == "a.evidencias[0]" for k in (1, 2) for path in ("a.evidencias[0]", "a.evidencias[1]", "a.evidencias[2]", "x[0].evidencias[0]")}
    assert {r.k: (r.verificadas_en_texto, r.no_verificables) for r in evidence.verification_counts(got, ["k"]).collect()} == {1: (1, 3), 2: (0, 4)}


def test_closure_of_random_graphs_with_cycles(spark):
    r = random.Random(5)
    edges = [(r.randrange(25), r.randrange(25)) for _ in range(30)] + [(1, 1), (None, 2)]
    got = {(a, b): n for a, b, n in dependencies.closure(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {}
    for start in range(25):
        level, reach, n = {start}, set(), 0
        while level:
            n += 1
            level = {b for a, b in edges if a in level} - reach
            want |= {(start, b): n for b in level}
            reach |= level
    assert got == want
    assert dependencies.closure(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_dependents_through_subqueries_common_tables_and_frames(spark):
    spark.range(3).createOrReplaceTempView("dd_base")
    spark.sql("CREATE OR REPLACE TEMP VIEW dd_one AS WITH c AS (SELECT id FROM dd_base) SELECT * FROM c")
    spark.sql("CREATE OR REPLACE TEMP VIEW dd_two AS SELECT * FROM range(2) WHERE id IN (SELECT id FROM dd_one)")
    spark.table("dd_two").filter("id > 0").createOrReplaceTempView("dd_three")
    try:
        got = {r.objeto: (r.tipo, r.nivel) for r in dependencies.dependents(spark, "DD_base").collect() if r.objeto.startswith("dd_")}
        assert got["dd_one"] == ("VISTA TEMPORAL", 1) and got["dd_two"] == ("VISTA TEMPORAL", 2) and got["dd_three"][0] == "VISTA TEMPORAL"
    finally:
        for v in ("dd_base", "dd_one", "dd_two", "dd_three"):
            spark.catalog.dropTempView(v)


def test_amounts_as_written(spark):
    cases = {"1.234,5": "1234.5", "-1": "-1", "1-": "-1", "1.2.3": "123", " 12,30 €": "12.3", "": None, "x": None, "-": None, "--5": "-5", "1,2,3": None, "€": None, None: None}
    got = {r.t: r.v for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", numbers.signed_amount(F.col("t")).alias("v")).collect()}
    assert got == {k: v and Decimal(v) for k, v in cases.items()}


def test_staged_and_bound_amounts_agree(spark):
    r = random.Random(9)
    texts = ["".join(r.choices("0123456789.,+-€ x", k=r.randrange(0, 9))) for _ in range(3000)] + ["1.234.567,89", "12.34,5", "0,5", "00", "1.000-", "+1.000,00 €", "١٢", "1234.567", None, "1" * 40]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bound = [(r.t, r.x.value, r.x.error) for r in df.select("t", numbers.spanish_amount(F.col("t")).alias("x")).collect()]
    staged = [(r.t, r.x.value, r.x.error) for r in numbers.with_amounts(df, x=F.col("t")).collect()]
    assert sorted(bound, key=repr) == sorted(staged, key=repr)
    got = {t: v for t, v, _ in bound}
    assert (got["1.234.567,89"], got["12.34,5"], got["0,5"], got["00"], got["1.000-"], got["+1.000,00 €"], got["١٢"], got["1234.567"]) == (Decimal("1234567.89"), None, Decimal("0.5"), None, Decimal("-1000"), Decimal("1000"), None, None)


ROW = "k long, orden struct<tabla:int,fila:int>, pagina int, titulo string, orden_visual int, fecha string, descripcion string, numero string, base string, total string"
GOLD = "k long, orden struct<tabla:int,fila:int>, numero string, fecha date, base decimal(14,2), total decimal(14,2)"


def test_table_metrics_of_odd_rows(spark):
    row = lambda n, numero, **x: (1, (0, n), x.get("page", 1), "CARGOS", x.get("place", n), x.get("day", "01-02-2024"), x.get("text", "t"), numero, x.get("base", "1,00"), x.get("total", "2,00"))
    reference = [row(1, "A"), row(2, "B"), row(3, "B", text="last"), row(4, None), row(5, "Z")]
    got = [row(1, "A", day="1-2-2024"), row(2, "B", text="last", base="", total="-2,00"), row(3, None, page=2), row(4, None, total="2,00-"), row(5, "NEW")]
    frame = lambda rows: spark.createDataFrame(rows, ROW)
    gold = spark.sql("SELECT 1L AS k, named_struct('tabla', 0, 'fila', 0) AS orden, 'B' AS numero, DATE '2024-02-01' AS fecha, CAST(NULL AS DECIMAL(14,2)) AS base, CAST(-2 AS DECIMAL(14,2)) AS total UNION ALL SELECT 2L, named_struct('tabla', 0, 'fila', 0), 'Q', NULL, 1, 1")
    out = {r.k: r.asDict() for r in alignment.table_metrics(frame(got), frame(reference), gold, ["k"]).collect()}
    assert out[1] == dict(zip(("k", *alignment.COUNTERS), (1, 5, 5, 3, 2, 3, 0, 1, 4, 3, 2, 1, 1, 1)))
    assert set(out[2].values()) == {2, 0}


def test_value_states_blocks_and_rollups(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), ("Ábc", "abc"), ("a", "b"), (None, None), (None, "x")], "e string, o string")
    assert [r.s for r in df.select(alignment.value_state(F.col("e"), F.col("o")).alias("s")).collect()] == ["CORRECTO", "DELIBERADAMENTE_NO_COMPLETADO", "DIFERENCIA_FORMATO", "DIFERENCIA_REAL", "CORRECTO", "DIFERENCIA_REAL"]
    rows = spark.createDataFrame([("impuestos", None, "CORRECTO"), ("otra", None, "AUSENTE")], "campo string, p string, clase string").withColumn("bloque", evaluate.block_of(F.col("campo")))
    out = {(r.dimension, r.valor): (r.campos_evaluados, r.correctos, r.ausentes) for r in evaluate.rollup(rows, ["campo", "bloque", "p"]).collect()}
    assert out == {("campo", "impuestos"): (1, 1, 0), ("campo", "otra"): (1, 0, 1), ("bloque", "fiscalidad"): (1, 1, 0), ("bloque", None): (1, 0, 1), ("p", None): (2, 1, 1), ("total", None): (2, 1, 1)}

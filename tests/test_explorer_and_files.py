"""The SQL gate, name resolution, file sources, sinks and streams."""

import os

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import catalog, explorer, ingest, sync
from tallyloom.sources import files
from tallyloom.streaming import increments

ALLOWED = ["SELECT TOP 10 * FROM t", "select a from t where a = 'DELETE-1';", "WITH x AS (SELECT 1 AS a) SELECT * FROM x", 'SELECT "DROP", [UPDATE] FROM t']
FORBIDDEN = [
    "UPDATE t SET a = 1", "DELETE FROM t", "INSERT INTO t VALUES (1)", "DROP TABLE t", "SELECT * INTO u FROM t", "EXEC p 'x'", "SELECT 1; DELETE FROM t", "SELECT 1 -- x", "SELECT 1 /* x */",
    "WITH x AS (SELECT 1) DELETE FROM x", "", "  ", "SELECT NEXT VALUE FOR s", "MERGE INTO t USING u ON 1=1", "SHOW TABLES",
]


@pytest.mark.parametrize("text", ALLOWED)
def test_gate_lets_reading_through(text):
    assert explorer.read_only(text) == text.strip().removesuffix(";")


@pytest.mark.parametrize("text", FORBIDDEN)
def test_gate_stops_the_rest(text):
    with pytest.raises(explorer.NotReadOnly):
        explorer.read_only(text)


def test_names_orders_and_limits(spark):
    df = spark.createDataFrame([(1, "a", "b")], "IdContador int, NombreCorto string, fecha string")
    assert explorer.resolve_columns(df, ["2", "contador", "FECHA", "fecha"]) == ["NombreCorto", "IdContador", "fecha"]
    for bad in ("9", "x", "o"):
        with pytest.raises(ValueError):
            explorer.resolve_column(df, bad)
    assert explorer.default_order(df) == ("IdContador", False) and explorer.default_order(df.select("fecha")) == ("fecha", False)
    assert explorer.default_order(df.select(F.lit(1).alias("x"))) is None
    assert (explorer.clamp(None, 20, 100), explorer.clamp(0, 20, 100), explorer.clamp(500, 20, 100)) == (20, 20, 100)
    with pytest.raises(ValueError):
        explorer.predicate(F.col("a"), "like", "x")


def test_gate_by_the_parsed_plan(spark):
    spark.range(3).createOrReplaceTempView("known")
    assert explorer.query(spark, "WITH x AS (SELECT id FROM known) SELECT * FROM x WHERE id > :low", low=0).count() == 2
    assert explorer.query(spark, "SELECT 'java_method' AS `DROP`, (SELECT max(id) FROM known) AS m").first().m == 2
    for text in (
        "SELECT TRANSFORM(1) USING 'id' AS (x string)",
        "SELECT java_method('java.lang.System','getProperty','user.home')",
        "SELECT `reflect`('java.lang.System','getProperty','user.home')",
        "SELECT id FROM known WHERE id IN (SELECT try_reflect('a', 'b'))",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`",
        "WITH x AS (SELECT * FROM csv.`/etc/passwd`) SELECT * FROM x",
        "SELECT * FROM unknown",
        "SELECT 'a\\' DELETE",
    ):
        with pytest.raises(explorer.NotReadOnly):
            explorer.query(spark, text)


def test_values_and_names_of_any_kind(spark):
    df = spark.createDataFrame([("a\\b", 1), ("axb", 2), ("A\\B%", 3)], "`a.b` string, `c``d` int")
    look = lambda op, v: [r[1] for r in explorer.matches(df, explorer.SearchSpec("a.b", op, v)).collect()]
    assert look("contains", "a\\b") == [1, 3] and look("startswith", "a_b") == [1, 2, 3] and look("endswith", "\\B%") == [1, 3]
    assert explorer.search(df, explorer.SearchSpec("c`d", "ge", 2, ["a.b"], ("c`d", False))).columns == ["a.b"]
    assert explorer.value_counts(df, "a.b").count() == 3 and explorer.preview(df).count() == 3
    for a, b in (("Łódź", "łodz"), ("Čapek", "capek"), ("Ωμέγα", "ωμεγα"), ("ΣΟΦΟΣ", "σοφος"), ("Straße", "STRASSE"), ("Йод", "йод")):
        row = spark.createDataFrame([(a, b)], "a string, b string").select(text.simplified(F.col("a")), text.simplified(F.col("b"))).first()
        assert row[0] == row[1], row


def test_default_order_follows_the_list(spark):
    order = lambda *names: explorer.default_order(spark.createDataFrame([tuple([1] * len(names))], ", ".join(f"`{n}` int" for n in names)))
    assert order("Id", "RazonSocial", "Denominacion") == ("Denominacion", True) and order("x", "FechaAlta", "FechaVenta") == ("FechaVenta", False)
    assert order("a", "IdOtro") == ("IdOtro", False) and order("a", "mifecha") == ("mifecha", False) and order("c_name") is None


def test_pdf_inventory(spark, tmp_path):
    for name, data in {"JUNY 26/b.PDF": b"%PDF-1", "JULIOL 2026/sub/a.pdf": b"%PDF-1", "JULIOL 2026/c.pdf": b"<html>", "MAIG 26/old.pdf": b"%PDF-", "otros/x.pdf": b"%PDF-", "JUNY 26/n.txt": b"x"}.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = files.pdf_inventory(spark, str(tmp_path), "2026-06-01").collect()
    names = [(os.path.basename(r.ruta), r.valido, str(r.mes)) for r in got]
    assert sorted(names) == [("a.pdf", True, "2026-07-01"), ("b.PDF", True, "2026-06-01"), ("c.pdf", False, "2026-07-01")]
    assert len({r.hash for r in got if r.valido}) == 1


def test_json_latest_and_exactly_one(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}')
    os.utime(tmp_path / "a.json", (1, 1))
    (tmp_path / "b.json").write_text('{"a": 2}')
    assert files.latest_file(spark, str(tmp_path)).first().path.endswith("b.json")
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("a int")
    df = files.json_documents(spark, str(tmp_path / "b.json"), schema)
    assert files.exactly_one(df).collect() == [(2,)]
    with pytest.raises(Exception):
        files.exactly_one(df.unionByName(df)).collect()
    (tmp_path / "c.json").write_text("[broken")
    with pytest.raises(Exception):
        files.json_documents(spark, str(tmp_path / "c.json"), schema).collect()


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", None), ("c\nd", 1)], "x string, y int")
    assert files.markdown(df).splitlines()[2:] == ["| a\\|b |  |", "| c d | 1 |"]
    edges = spark.createDataFrame([("t", "u", 2, "c", "d"), ("t", "u", 1, "a", "b")], "origen string, destino string, n int, o string, d string")
    labels = catalog.edge_labels(edges, ["origen", "destino"], "o", "d", "n")
    assert files.mermaid(labels).splitlines()[1].strip() == 't -->|"a -> b | c -> d"| u'
    files.write_report({"hoja": df}, str(tmp_path))
    assert spark.read.csv(f"{tmp_path}/hoja", header=True, multiLine=True).count() == 2


def test_long_reports_say_how_much_is_left_and_are_written_whole(spark, tmp_path):
    df = spark.range(25).selectExpr("concat('t-', id) AS origen", "'2u' AS destino", """'a "b"' AS etiqueta""")
    lines = files.mermaid(df, 10).splitlines()
    assert len(lines) == 12 and lines[-1] == "    %% ... and 15 more" and lines[1] == '    t_0 -->|"a #quot;b#quot;"| T_2u'
    assert files.markdown(df, 10).splitlines()[-1] == "... and 15 more" and len(files.markdown(df).splitlines()) == 27
    files.write_lines(files.mermaid_lines(df), f"{tmp_path}/edges")
    assert spark.read.text(f"{tmp_path}/edges").count() == 25


def test_upsert_changes_and_names_of_the_users(spark):
    state = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, _n int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1), (None, "x", 1), (None, "x", 1)], "id int, v string, _n int")
    got = sync.upsert(state, new, ["id"], last="_n")
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "a", 0), (2, "d", 2), (3, "e", 1), (None, "x", 1), (None, "x", 1)] and got.columns == state.columns
    assert sync.insert_or_ignore(state, new, ["id"]).columns == ["id", "v", "_n"]
    twice = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, None, 1)], "id int, `x.y` string, _a int")
    assert sorted(map(tuple, ingest.changes(twice, twice, "id", ["x.y", "_a"]).collect())) == [(1, "IGUAL"), (2, "IGUAL")]


def test_a_new_checkpoint_keeps_old_rows(spark, tmp_path):
    sink = f"file://{tmp_path}/sink"
    for n, ids in enumerate(([1, 2], [2, 3])):
        src = f"file://{tmp_path}/src{n}"
        spark.createDataFrame([(i, n) for i in ids], "id long, run int").coalesce(1).write.parquet(src)
        increments.run_available(spark.readStream.schema("id long, run int").parquet(src), sink, ["id"], f"file://{tmp_path}/marks{n}")
    assert sorted((r.id, r.run) for r in spark.read.parquet(sink).collect()) == [(1, 0), (2, 0), (3, 1)]


def test_insert_or_ignore_twice_changes_nothing(spark):
    sink, new = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "id int, v string")
    first = sink.unionByName(sync.insert_or_ignore(sink, new, ["id"]))
    assert sorted(map(tuple, first.collect())) == [(1, "a"), (2, "c")]
    assert sync.insert_or_ignore(first, new, ["id"]).count() == 0
    df, seen = sync.progress(new, "p", dobles=F.col("id") == 2)
    df.collect()
    assert seen.get == {"dobles": 2, "rows": 3}
    assert ingest.changes(sink, new.limit(0), "id", ["v"]).first().cambio == "AUSENTE"


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, sink, marks = (f"file://{tmp_path}/{x}" for x in ("src", "sink", "marks"))
    put = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema("id long").parquet(src)
    put(1, 2, 2)
    increments.run_available(stream(), sink, ["id"], marks)
    put(2, 3)
    increments.run_available(stream(), sink, ["id"], marks)
    increments.run_available(stream(), sink, ["id"], marks)
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [1, 2, 3]

"""File states over restarts, retried batches, located JSON errors, files on their way."""

import datetime

import pytest
from pyspark.errors import PySparkException

from tallyloom.operators import ingest
from tallyloom.sources import files
from tallyloom.streaming import retries, states
from tallyloom.streaming.increments import idempotent_writer

REPORT = "ruta string, orden long, estado string, error string, extra int"


def reports(spark, rows, folder):
    spark.createDataFrame([(*r, 1) for r in rows], REPORT).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(REPORT).option("maxFilesPerTrigger", 1).parquet(folder)


def test_states_over_two_restarts_equal_the_batch(spark, tmp_path):
    ok, bad = states.DONE, states.FAILED
    parts = [
        [("a", 1, bad, "timeout"), ("a", 2, bad, "503"), ("b", 1, ok, None), (None, 1, ok, None), ("c", None, ok, None), ("a", 2, bad, "503")],
        [("a", 3, ok, None), ("b", 2, bad, "x"), ("d", 5, ok, None)],
        [("a", 4, bad, "y"), ("d", 6, ok, None), ("b", 3, ok, None)],
    ]
    sink, marks, folder = (f"{tmp_path}/{x}" for x in ("sink", "marks", "reports"))
    for rows in parts:
        states.run_states(reports(spark, rows, folder), sink, marks)
    got = spark.read.parquet(sink).select(*[c.split()[0] for c in states.CHANGE.split(", ")])
    want = states.changes_of_batch(spark.createDataFrame([(*r, 1) for rows in parts for r in rows], REPORT))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert {r.ruta: (r.estado, r.intentos, r.recuperada) for r in states.current_states(got).collect()} == {"a": (bad, 1, False), "b": (ok, 2, True), "d": (ok, 1, False)}
    # A report that comes after a later one changes nothing; a stream with nothing new ends.
    states.run_states(reports(spark, [("a", 2, ok, None)], folder), sink, marks)
    states.run_states(spark.readStream.schema(REPORT).parquet(folder), sink, marks)
    assert spark.read.parquet(sink).count() == 9


def test_many_files_are_put_in_order_by_the_engine(spark, tmp_path):
    """No call of Python a file: 30,000 files in two parts equal the batch, in plans without Python."""
    n = 30_000
    rows = lambda part: spark.range(2 * n).selectExpr("concat('f', id % 30000) AS ruta", f"2 * {part} + id div 30000 AS orden", f"if((id + {part}) % 3 = 0, 'ERROR', 'IMPORTADA') AS estado", "CAST(NULL AS string) AS error", "1 AS extra")
    sink, marks, folder = (f"{tmp_path}/{x}" for x in ("sink", "marks", "reports"))
    for part in (0, 1):
        rows(part).coalesce(1).write.mode("append").parquet(folder)
        states.run_states(spark.readStream.schema(REPORT).option("maxFilesPerTrigger", 1).parquet(folder), sink, marks)
    got = spark.read.parquet(sink).select(*[c.split()[0] for c in states.CHANGE.split(", ")])
    want = states.changes_of_batch(rows(0).unionByName(rows(1)))
    assert got.count() == 4 * n and not got.exceptAll(want).count()
    plan = states.changes_after(spark.createDataFrame([], states.STATE), rows(0))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_a_batch_of_states_that_runs_again_replaces_itself(spark, tmp_path):
    ok, bad = states.DONE, states.FAILED
    sink, marks = f"{tmp_path}/sink", f"{tmp_path}/marks"
    write = states.states_writer(sink, marks)
    batch = lambda *rows: spark.createDataFrame([(*r, 1) for r in rows], REPORT)
    write(batch(("a", 1, bad, "x"), ("a", 2, bad, "y")), 0)
    for _ in range(2):
        write(batch(("a", 2, ok, None), ("a", 3, bad, "z"), ("b", 1, bad, "z")), 1)
    write(batch(("a", 4, ok, None), ("b", 2, ok, None)), 2)
    got = sorted((r.ruta, r.orden, r.estado_previo, r.intentos, r.recuperada) for r in spark.read.parquet(sink).collect())
    assert got == [("a", 1, None, 1, False), ("a", 2, bad, 2, False), ("a", 3, bad, 3, False), ("a", 4, bad, 4, True), ("b", 1, None, 1, False), ("b", 2, bad, 2, True)]
    # States that a later batch should find and doesn't are an error, never a new start.
    with pytest.raises(PySparkException):
        states.states_writer(sink, f"{tmp_path}/other")(batch(("a", 5, ok, None)), 3)


class Flaky:
    """Writes half of a batch and fails, as often as told."""

    def __init__(self, sink, failures):
        self.write, self.failures = idempotent_writer(sink, ["id"], "s"), list(failures)

    def __call__(self, batch, batch_id):
        if self.failures:
            self.write(batch.filter("id % 2 = 0"), batch_id)
            raise self.failures.pop(0)
        self.write(batch, batch_id)


def stream_of(spark, folder):
    return spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)


def test_retries_write_each_row_once_and_log_attempts(spark, tmp_path):
    folder, sink, log, marks = (f"{tmp_path}/{x}" for x in ("in", "sink", "log", "marks"))
    spark.range(10).coalesce(1).write.parquet(folder)
    waits = []
    flaky = Flaky(sink, [ConnectionError("Connection reset"), TimeoutError("read operation timed out")])
    retries.run_retrying(stream_of(spark, folder), flaky, log, marks, pause=waits.append)
    assert waits == [5, 15] and sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(10))
    rows = sorted((r.intento, r.estado, r.recuperada, r.error) for r in spark.read.parquet(log).collect())
    assert rows == [(1, "REINTENTO", False, "ConnectionError: Connection reset"), (2, "REINTENTO", False, "TimeoutError: read operation timed out"), (3, "IMPORTADA", True, None)]
    assert [tuple(r) for r in retries.outcomes(spark.read.parquet(log)).collect()] == [(0, 3, "IMPORTADA", True)]


@pytest.mark.parametrize(("failures", "tries"), [([ValueError("bad value")], 1), ([ConnectionError("connection reset")] * 3, 3)])
def test_what_fails_for_good_fails_the_stream_and_is_repeated_by_the_next(spark, tmp_path, failures, tries):
    folder, sink, log, marks = (f"{tmp_path}/{x}" for x in ("in", "sink", "log", "marks"))
    spark.range(6).coalesce(1).write.parquet(folder)
    with pytest.raises(PySparkException, match="bad value|connection reset"):
        retries.run_retrying(stream_of(spark, folder), Flaky(sink, failures), log, marks, pause=lambda s: None)
    assert [tuple(r) for r in retries.outcomes(spark.read.parquet(log)).collect()] == [(0, tries, "ERROR", False)]
    retries.run_retrying(stream_of(spark, folder), Flaky(sink, []), log, marks)
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(6))
    assert [tuple(r) for r in retries.outcomes(spark.read.parquet(log)).collect()] == [(0, 1, "IMPORTADA", False)]


def test_located_json(spark, tmp_path):
    texts = {"good": '{"a": {"b": [1, null]}}', "array": "[1]", "scalar": '"x"', "colon": '{"a": 1,\n "b" 2}', "cut": '{"a":\n\n  "x', "empty": "", "extra": '{"a": 1} x', "nan": '{"a": NaN}', "two": '{"a": 1} {"b": 2}', "list": '{"a": 1}, {"b": 2}', "closed": '{"a": 1}] [{"b": 2}', "shut": '{"a": 1}} {"x": {"b": 2}', "null": "null"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {r.path.rsplit("/", 1)[1].removesuffix(".json"): (r.documento is not None, r.mensaje, r.linea, r.columna) for r in files.located_json(spark, str(tmp_path)).collect()}
    assert got["good"] == (True, None, None, None)
    assert got["array"] == got["scalar"] == (False, files.NOT_OBJECT, None, None)
    assert got["colon"] == (False, "Expecting ':' delimiter", 2, 6) and got["cut"] == (False, "Unterminated string starting at", 3, 3)
    # Spark's reader gives no row's text for an empty file, or an empty one.
    assert got.get("empty", (False, "Expecting value", 1, 1)) == (False, "Expecting value", 1, 1)
    assert [got[x][0] for x in ("two", "list", "closed", "shut")] == [False] * 4 and got["null"][1] == files.NOT_OBJECT
    assert got["extra"][1:] == ("Extra data", 1, 10) and got["nan"][1] == "not JSON"


def test_paths_below_a_root_with_signs(spark, tmp_path):
    for root in ("a+b", "x(1)"):
        (tmp_path / root / "JUNY 26").mkdir(parents=True)
        (tmp_path / root / "JUNY 26" / "one.PDF").write_bytes(b"%PDF-1")
        got = files.pdf_inventory(spark, f"{tmp_path}/{root}").collect()
        assert [(r.ruta, r.valido, r.mes) for r in got] == [("JUNY 26/one.PDF", True, datetime.date(2026, 6, 1))]
        assert files.first_file(spark, f"{tmp_path}/{root}", "*.PDF").count() == 1 and files.first_file(spark, f"{tmp_path}/{root}", "*.x").count() == 0


def test_files_on_their_way_counts_and_the_index(spark):
    before = spark.createDataFrame([("a", 5), ("b", 7), ("c", 0)], "ruta string, bytes long")
    now = spark.createDataFrame([("a", 5), ("b", 9), ("c", 0), ("d", 4)], "ruta string, bytes long")
    assert [r.ruta for r in ingest.settled(before, now).collect()] == ["a"]
    assert files.exact_count(now, 4).count() == 4
    with pytest.raises(PySparkException, match="expected 3 files, found 4"):
        files.exact_count(now, 3, "files").collect()
    index = spark.createDataFrame([("a", 5, None, "IMPORTADA"), ("b", 9, 1, "ERROR"), ("d", 4, 2, "IMPORTADA")], "ruta string, tamano long, fecha_modificacion_ns long, estado string")
    found = spark.createDataFrame([("a", 5, None), ("b", 9, 1), ("d", 4, 3), ("e", 1, 1)], "ruta string, tamano long, fecha_modificacion_ns long")
    assert {r.ruta: r.omitir for r in ingest.unchanged(found, index).collect()} == {"a": True, "b": False, "d": False, "e": False}
    assert {r.ruta: r.estado for r in ingest.indexed(index, found).collect()} == {"a": "IMPORTADA", "b": "ERROR", "d": "IMPORTADA", "e": None}

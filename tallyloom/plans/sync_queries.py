"""Queries of the incremental sync and of ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ingest, sync
from ..streaming import retries, states
from ..streaming.increments import idempotent_writer
from ..work import work_dir
from .base import Catalogue, Tables

C = Catalogue()
HIGH_WATER = 100
MONEY = "DECIMAL(14,2)"


@C.add(
    "sync_incremental_left_join",
    f"""SELECT 'FARMACIA' AS farmacia, o_orderkey AS id_contador, o_custkey AS id_proveedor,
  trim(coalesce(c_name, '')) AS proveedor, CAST(o_orderkey AS VARCHAR) AS numero_albaran,
  CAST(o_orderdate AS DATE) AS fecha, CAST(o_totalprice AS {MONEY}) AS importe_pvp, 'PENDIENTE' AS estado
FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey > {HIGH_WATER}""",
)
def incremental(t: Tables) -> DataFrame:
    """Orders above the mark with their customer's name, in the sink's shape, by ascending id."""
    names = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    new = sync.above_mark(t.orders, "o_orderkey", HIGH_WATER)
    return sync.to_sink_rows(new.join(names, "o_custkey", "left")).orderBy("id_contador")


@C.add("sync_historical_since_date", "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS fecha FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def historical(t: Tables) -> DataFrame:
    since = F.lit("1997-01-01").cast("timestamp")
    return t.orders.filter(F.col("o_orderdate") >= since).select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("fecha")).orderBy("o_orderkey")


@C.add("sync_high_water_mark", "SELECT CAST(coalesce(max(o_orderkey), 0) AS BIGINT) AS mark FROM orders WHERE o_orderstatus = 'F'")
def mark(t: Tables) -> DataFrame:
    return sync.high_water_mark(t.orders, "o_orderkey", F.col("o_orderstatus") == "F")


@C.add("sync_high_water_mark_empty", "SELECT CAST(coalesce(max(o_orderkey), -1) AS BIGINT) AS mark FROM orders WHERE o_orderstatus = 'none'")
def empty_mark(t: Tables) -> DataFrame:
    return sync.high_water_mark(t.orders, "o_orderkey", F.col("o_orderstatus") == "none", default=-1)


@C.add(
    "sync_insert_or_ignore",
    "SELECT DISTINCT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 0 AND NOT (o_orderkey % 2 = 0)",
)
def insert_or_ignore(t: Tables) -> DataFrame:
    """New rows, some of them doubled and some already there."""
    rows = t.orders.select("o_orderkey", "o_custkey")
    new = rows.filter("o_orderkey % 3 <> 0")
    return sync.insert_or_ignore(rows.filter("o_orderkey % 2 = 0"), new.unionByName(new), ["o_orderkey"])


@C.add(
    "sync_upsert_state",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'IMPORTADA' ELSE 'ERROR' END AS estado,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS VARCHAR) ELSE o_orderstatus END AS detalle
FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0""",
)
def upsert(t: Tables) -> DataFrame:
    """A new null replaces an old value."""
    old = t.orders.filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit("ERROR").alias("estado"), F.col("o_orderstatus").alias("detalle"))
    new = t.orders.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("IMPORTADA").alias("estado"), F.lit(None).cast("string").alias("detalle"))
    return sync.upsert(old, new, ["o_orderkey"])


@C.add(
    "sync_latest_rows",
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 30",
)
def latest(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey").orderBy(F.desc("o_orderkey")).limit(30)


@C.add(
    "file_dup_groups",
    "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS primero FROM documents GROUP BY text HAVING count(*) > 1",
)
def duplicates(t: Tables) -> DataFrame:
    return ingest.duplicate_groups(t.documents.select("doc_id", ingest.content_hash(F.col("text")).alias("hash")), "hash", "doc_id")


@C.add("file_dup_totals", "SELECT count(*) AS total, count(DISTINCT text) AS unicos, count(*) - count(DISTINCT text) AS repetidos FROM documents")
def duplicate_totals(t: Tables) -> DataFrame:
    one = t.documents.groupBy(ingest.content_hash(F.col("text")).alias("h")).agg(F.count("*").alias("n"))
    return one.agg(F.sum("n").alias("total"), F.count("*").alias("unicos"), (F.sum("n") - F.count("*")).alias("repetidos"))


@C.add(
    "ingest_change_detect",
    """WITH a AS (SELECT doc_id, n_chars AS bytes, lang AS marca FROM documents WHERE doc_id % 10 <> 0),
b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS bytes, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS marca
  FROM documents WHERE doc_id % 9 <> 0)
SELECT doc_id, CASE WHEN a.doc_id IS NULL THEN 'NUEVO' WHEN b.doc_id IS NULL THEN 'AUSENTE'
  WHEN a.bytes IS NOT DISTINCT FROM b.bytes AND a.marca IS NOT DISTINCT FROM b.marca THEN 'IGUAL' ELSE 'MODIFICADO' END AS cambio
FROM a FULL JOIN b USING (doc_id)""",
)
def change_detect(t: Tables) -> DataFrame:
    src = t.documents.select("doc_id", F.col("n_chars").alias("bytes"), F.col("lang").alias("marca"))
    before = src.filter("doc_id % 10 <> 0")
    now = src.filter("doc_id % 9 <> 0").select("doc_id", F.expr("CASE WHEN doc_id % 7 = 0 THEN bytes + 1 ELSE bytes END").alias("bytes"), F.expr("CASE WHEN doc_id % 11 <> 0 THEN marca END").alias("marca"))
    return ingest.changes(before, now, "doc_id", ["bytes", "marca"])


@C.add(
    "ingest_unregistered",
    """WITH d AS (SELECT sha256(text) AS hash, concat(source, '/', lpad(CAST(doc_id AS VARCHAR), 9, '0'), '.pdf') AS path, doc_id FROM documents)
SELECT hash, min(path) AS path FROM d WHERE hash NOT IN (SELECT hash FROM d WHERE doc_id % 4 = 0) GROUP BY hash""",
)
def unregistered(t: Tables) -> DataFrame:
    files = t.documents.select(ingest.content_hash(F.col("text")).alias("hash"), F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".pdf")).alias("path"), "doc_id")
    return ingest.unregistered(files.select("hash", "path"), files.filter("doc_id % 4 = 0").select("hash").distinct())


@C.add(
    "storage_safe_name",
    """SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(strip_accents(url), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'),
  '^[._-]+|[._-]+$', '', 'g'), ''), 'archivo') AS nombre FROM pages""",
)
def safe_name(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.storage_name(F.col("url")).alias("nombre"))


@C.add(
    "storage_path",
    """SELECT doc_id, concat('PIO/', source, '/', lang, '/doc_', CAST(doc_id AS VARCHAR), '_', substr(sha256(text), 1, 12), '.pdf') AS ruta FROM documents""",
)
def path(t: Tables) -> DataFrame:
    name = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(".PDF")))
    return t.documents.select("doc_id", text.storage_path("PIO", name, ingest.content_hash(F.col("text"))).alias("ruta"))


#: Parts in which the events arrive, by ranges of their numbers.
PARTS = 3


def arriving(rows: DataFrame, what: str, part: Column, each: Callable[[DataFrame, str], None]) -> None:
    """Calls ``each`` after every part has come to a folder, with a stream over the folder that takes a file a batch."""
    spark = rows.sparkSession
    folder, marks = work_dir(spark, what), work_dir(spark, f"{what}-marks")
    for n in range(PARTS):
        rows.filter(part == n).coalesce(1).write.mode("append").parquet(folder)
        each(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder), marks)


@C.add(
    "stream_file_states",
    """WITH r AS (SELECT 'c' || CAST(user_id AS VARCHAR) || '/' || event_type || '.pdf' AS ruta, event_id AS orden, CASE WHEN event_id % 3 = 0 OR event_type = 'error' THEN 'ERROR' ELSE 'IMPORTADA' END AS estado, CASE WHEN event_id % 3 = 0 OR event_type = 'error' THEN 'timeout ' || CAST(event_id % 7 AS VARCHAR) END AS error FROM events),
b AS (SELECT *, lag(estado) OVER (PARTITION BY ruta ORDER BY orden) AS estado_previo, coalesce(sum(CASE WHEN estado = 'IMPORTADA' THEN 1 ELSE 0 END) OVER (PARTITION BY ruta ORDER BY orden ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM r)
SELECT ruta, orden, estado_previo, estado, error, CAST(row_number() OVER (PARTITION BY ruta, d ORDER BY orden) AS INTEGER) AS intentos, coalesce(estado = 'IMPORTADA' AND estado_previo = 'ERROR', FALSE) AS recuperada FROM b""",
)
def file_states(t: Tables) -> DataFrame:
    """Reports on files in three parts, the stream stopped and started again after each."""
    bad = (F.col("event_id") % 3 == 0) | (F.col("event_type") == "error")
    reports = t.events.select(
        F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit("/"), "event_type", F.lit(".pdf")).alias("ruta"), F.col("event_id").alias("orden"),
        F.when(bad, states.FAILED).otherwise(states.DONE).alias("estado"), F.when(bad, F.concat(F.lit("timeout "), (F.col("event_id") % 7).cast("string"))).alias("error"),
    )
    last = t.events.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("m")).first()["m"]
    sink = work_dir(t.spark, "states")
    arriving(reports, "reports", F.least(F.floor(F.col("orden") * PARTS / (last + 1)), F.lit(PARTS - 1)), lambda stream, marks: states.run_states(stream, sink, marks))
    return t.spark.read.parquet(sink).select("ruta", "orden", "estado_previo", "estado", "error", "intentos", "recuperada")


@C.add(
    "stream_with_retries",
    """WITH m AS (SELECT max(event_id) AS m FROM events) SELECT event_id, event_type, least(event_id * 3 // (m + 1), 2) AS lote, CAST(1 + least(event_id * 3 // (m + 1), 2) AS INTEGER) AS intentos, event_id * 3 // (m + 1) > 0 AS recuperada FROM events, m""",
)
def with_retries(t: Tables) -> DataFrame:
    """Batch n fails n times, with rows already written, before it goes through; each event is in the sink once, with its batch's attempts."""
    failed: dict[int, int] = {}
    sink, log = work_dir(t.spark, "sink"), work_dir(t.spark, "attempts")
    whole = idempotent_writer(sink, ["event_id"], "events")

    def unsure(batch: DataFrame, batch_id: int) -> None:
        if failed.get(batch_id, 0) < batch_id:
            failed[batch_id] = failed.get(batch_id, 0) + 1
            whole(batch.filter("event_id % 2 = 0"), batch_id)
            raise ConnectionError("connection reset by peer")
        whole(batch, batch_id)

    last = t.events.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("m")).first()["m"]
    rows = t.events.select("event_id", "event_type")
    arriving(rows, "events", F.least(F.floor(F.col("event_id") * PARTS / (last + 1)), F.lit(PARTS - 1)), lambda stream, marks: retries.run_retrying(stream, unsure, log, marks, pause=lambda s: None))
    done = retries.outcomes(t.spark.read.parquet(log)).select("lote", "intentos", "recuperada")
    return t.spark.read.parquet(sink).select("event_id", "event_type", F.col("_batch").cast("long").alias("lote")).join(F.broadcast(done), "lote").select("event_id", "event_type", "lote", "intentos", "recuperada")


@C.add(
    "ingest_skip_unchanged",
    """WITH i AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS tamano, CASE WHEN o_orderkey % 5 = 0 THEN 'ERROR' ELSE 'IMPORTADA' END AS estado FROM orders WHERE o_orderkey % 3 <> 0)
SELECT o_orderkey AS ruta, o_custkey AS tamano, coalesce(i.estado = 'IMPORTADA' AND i.tamano = o_custkey, FALSE) AS omitir FROM orders LEFT JOIN i USING (o_orderkey)""",
)
def skip_unchanged(t: Tables) -> DataFrame:
    """Files that the index has as imported, of the same size, needn't be read again."""
    found = t.orders.select(F.col("o_orderkey").alias("ruta"), F.col("o_custkey").alias("tamano"))
    size = F.when(F.col("ruta") % 7 == 0, F.col("tamano") + 1).otherwise(F.col("tamano"))
    index = found.filter("ruta % 3 <> 0").select("ruta", size.alias("tamano"), F.when(F.col("ruta") % 5 == 0, "ERROR").otherwise("IMPORTADA").alias("estado"))
    return ingest.unchanged(found, index, marks=("tamano",))


@C.add(
    "ingest_register_new",
    """WITH r AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 4 = 0), n AS (SELECT sha256(text) AS h, min('doc-' || CAST(doc_id AS VARCHAR) || '.pdf') AS nombre FROM documents WHERE sha256(text) NOT IN (SELECT h FROM r) GROUP BY 1)
SELECT 'FARMACIA' AS farmacia, nombre AS archivo_nombre, 'facturas/' || nombre AS archivo_ruta, h AS archivo_hash, 'PENDIENTE' AS estado_lectura, FALSE AS requiere_revision, '{}' AS datos_extraidos, FALSE AS necesita_lectura_visual, 0 AS intentos_lectura FROM n""",
)
def register_new(t: Tables) -> DataFrame:
    """Rows for contents that aren't registered yet, each content once, by its first name, with what a new document starts with."""
    files = t.documents.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), ingest.content_hash(F.col("text").cast("binary")).alias("hash"), "doc_id")
    new = ingest.unregistered(files.select("path", "hash"), files.filter("doc_id % 4 = 0").select("hash").distinct())
    return ingest.registration(new.select("path", F.concat(F.lit("facturas/"), "path").alias("at"), "hash"), "FARMACIA", "path", "at", "hash")

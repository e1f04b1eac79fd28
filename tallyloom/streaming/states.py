"""The state of every file as a stream of reports, kept by file beside the checkpoint, so that it survives restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .increments import idempotent_writer, stream_name

#: What a report says of a file.
DONE, FAILED = "IMPORTADA", "ERROR"
REPORT = ("ruta", "orden", "estado", "error")
CHANGE = "ruta string, orden long, estado_previo string, estado string, error string, intentos int, recuperada boolean"
#: A file's last accepted report; ``intentos`` counts those since the last success.
STATE = "ruta string, orden long, estado string, intentos int"


def changes_after(states: DataFrame, reports: DataFrame) -> DataFrame:
    """REPORT rows as the accepted ones, each with the state before, attempts since the last success, and whether it recovers.

    ``states``: STATE rows, what is known of files so far.  A report not later than its file's last one is left out; of several with one order the first by
    state stays.  Rows without a path or an order take no part.  All meets by file, in one shuffle, and is put in order by sorts that may go to disk.
    """
    known = reports.select(*REPORT).filter("ruta IS NOT NULL AND orden IS NOT NULL")
    file = Window.partitionBy("ruta").orderBy("orden", "estado")
    last = states.select("ruta", F.col("orden").alias("_orden"), F.col("estado").alias("_estado"), F.col("intentos").alias("_intentos"))
    later = known.join(last, "ruta", "left").filter("_orden IS NULL OR orden > _orden")
    one = later.withColumn("_twin", F.lag("orden").over(file).eqNullSafe(F.col("orden"))).filter("NOT _twin")
    before = one.withColumns({
        "estado_previo": F.when(F.row_number().over(file) == 1, F.col("_estado")).otherwise(F.lag("estado").over(file)),
        "_done": F.count_if(F.col("estado") == DONE).over(file.rowsBetween(Window.unboundedPreceding, -1)),
    })
    tries = F.row_number().over(Window.partitionBy("ruta", "_done").orderBy("orden")) + F.when(F.col("_done") == 0, F.coalesce("_intentos", F.lit(0))).otherwise(0)
    back = F.coalesce((F.col("estado") == DONE) & (F.col("estado_previo") == FAILED), F.lit(False))
    return before.select("ruta", "orden", "estado_previo", "estado", "error", tries.alias("intentos"), back.alias("recuperada"))


def changes_of_batch(reports: DataFrame) -> DataFrame:
    """The same of all reports at once: what the stream must come to."""
    return changes_after(reports.sparkSession.createDataFrame([], STATE), reports)


def current_states(changes: DataFrame) -> DataFrame:
    """The last accepted report of each file."""
    row = F.max_by(F.struct(*(c for c in changes.columns if c != "ruta")), "orden").alias("r")
    return changes.groupBy("ruta").agg(row).select("ruta", "r.*")


def states_writer(sink: str, checkpoint: str):
    """A foreachBatch function: a batch's changes into the idempotent sink, and the states after it beside the checkpoint.

    States lie in two tables by turns, so what a batch starts from is left as it is until the batch has gone through: a batch that runs again comes to the same.
    """
    write = idempotent_writer(sink, ["ruta", "orden"], stream_name(checkpoint))
    at = lambda batch_id: f"{checkpoint.rstrip('/')}/files/{batch_id % 2}"

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Only a stream's first batch starts from nothing; states that aren't there later are an error.
        states = spark.read.schema(STATE).parquet(at(batch_id - 1)) if batch_id else spark.createDataFrame([], STATE)
        changes = changes_after(states, batch).persist()
        try:
            write(changes, batch_id)
            since = F.when(F.col("estado") == DONE, 0).otherwise(F.col("intentos")).alias("intentos")
            current_states(states.unionByName(changes.select("ruta", "orden", "estado", since))).write.mode("overwrite").parquet(at(batch_id))
        finally:
            changes.unpersist()

    return each


def run_states(reports: DataFrame, sink: str, checkpoint: str) -> None:
    """All reports that have arrived, into an idempotent sink; the next run takes the states up from the checkpoint."""
    reports.writeStream.foreachBatch(states_writer(sink, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

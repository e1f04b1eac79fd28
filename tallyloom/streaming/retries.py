"""Batches of a stream written again while their failure is worth it, with a log of attempts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import RETRYABLE
from .increments import stream_name

#: Attempts in all, and seconds to wait before each further one.
ATTEMPTS, WAITS = 3, (5, 15)
LOG = "lote long, intento int, estado string, recuperada boolean, error string"
Writer = Callable[[DataFrame, int], None]


def worth_retrying(error: BaseException) -> bool:
    """Whether an error's message has one of the marks of a passing failure."""
    said = str(error).lower()
    return any(mark in said for mark in RETRYABLE)


def retrying_writer(write: Writer, log: str, stream: str, attempts: int = ATTEMPTS, waits: tuple[float, ...] = WAITS, pause: Callable[[float], None] = time.sleep) -> Writer:
    """A foreachBatch function that calls ``write`` up to ``attempts`` times, and again only after failures worth it.

    ``write`` must replace what a former attempt left, as idempotent_writer()'s function does.  Each batch's attempts are a part of the table
    ``log`` (LOG rows) that the batch replaces when it runs again.  After the last attempt, or a failure not worth another, the log says ERROR and the failure
    goes on to the stream, whose next run repeats the batch.
    """

    def tried(batch: DataFrame, batch_id: int) -> None:
        rows: list[tuple] = []
        failure: Exception | None = None
        for attempt in range(1, attempts + 1):
            try:
                write(batch, batch_id)
                failure = None
                rows.append((batch_id, attempt, "IMPORTADA", attempt > 1, None))
                break
            except Exception as error:  # noqa: BLE001 - every failure is logged, and goes on below if it stays
                failure = error
                again = worth_retrying(error) and attempt < attempts
                rows.append((batch_id, attempt, "REINTENTO" if again else "ERROR", False, f"{type(error).__name__}: {error}"[:300]))
                if not again:
                    break
                pause(waits[min(attempt, len(waits)) - 1])
        batch.sparkSession.createDataFrame(rows, LOG).coalesce(1).write.mode("overwrite").parquet(f"{log}/_stream={stream}/_batch={batch_id}")
        if failure is not None:
            raise failure

    return tried


def run_retrying(stream: DataFrame, write: Writer, log: str, checkpoint: str, **options) -> None:
    """All that has arrived, each batch with its attempts; the next run goes on from the checkpoint."""
    writer = retrying_writer(write, log, stream_name(checkpoint), **options)
    stream.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def outcomes(log: DataFrame) -> DataFrame:
    """(lote, intentos, estado, recuperada): each batch's attempts and how it ended."""
    return log.groupBy("lote").agg(F.max("intento").alias("intentos"), F.max_by("estado", "intento").alias("estado"), F.bool_or("recuperada").alias("recuperada"))

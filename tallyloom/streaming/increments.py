"""Incremental streams into tables that take each key once."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.sync import insert_or_ignore
from ..work import work_dir


def read_sink(spark: SparkSession, sink: str, schema: StructType) -> DataFrame:
    """The sink's rows so far; none before the first batch, and any other failure is one."""
    try:
        return spark.read.schema(schema).parquet(sink)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def idempotent_writer(sink: str, keys: list[str], stream: str):
    """A foreachBatch function: rows whose key the sink has are left out, and a batch that runs again replaces itself.

    ``stream`` names the stream's checkpoint: each writes parts of its own, so a stream with a new checkpoint leaves the
    rows of others as they are, and takes their keys as given.  Of equal keys in a batch the first by all columns stays.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parts = StructType([*batch.schema.fields, StructField("_stream", StringType()), StructField("_batch", LongType())])
        others = ~((F.col("_stream") == stream) & (F.col("_batch") >= batch_id))
        have = read_sink(spark, sink, parts).filter(others)
        insert_or_ignore(have, batch, keys).write.mode("overwrite").parquet(f"{sink}/_stream={stream}/_batch={batch_id}")

    return write


def stream_name(checkpoint: str) -> str:
    """A name for the parts of the stream with this checkpoint."""
    return uuid.uuid5(uuid.NAMESPACE_URL, checkpoint.rstrip("/")).hex


def run_available(stream: DataFrame, sink: str, keys: list[str], checkpoint: str) -> None:
    """All that has arrived, then stops; the next run goes on from the checkpoint."""
    query = stream.writeStream.foreachBatch(idempotent_writer(sink, keys, stream_name(checkpoint))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def dedup_stream(spark: SparkSession, path: str, columns: list[str], keys: list[str]) -> DataFrame:
    """A parquet table as a stream in which every row comes twice, into an idempotent sink; the sink's rows."""
    schema = spark.read.parquet(path).schema
    # A file's folder with the file's name as a pattern; a folder's own files have any name.
    files = spark.read.parquet(path).select(F.input_file_name().alias("f")).limit(1).collect()
    source = spark.readStream.schema(schema)
    if files and files[0].f.rstrip("/").endswith(path.rstrip("/").rpartition("/")[2]):
        folder, _, name = path.rpartition("/")
        stream = source.option("pathGlobFilter", name).parquet(folder)
    else:
        stream = source.parquet(path)
    twice = stream.select(*columns)
    sink, marks = work_dir(spark, "stream"), work_dir(spark, "stream-marks")
    run_available(twice.unionByName(twice), sink, keys, marks)
    return spark.read.parquet(sink).select(*columns)

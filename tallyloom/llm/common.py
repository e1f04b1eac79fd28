"""Shared folder, written tables and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local session may do without."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file:///tmp/checkpoints/{context.applicationId}"
        context.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def written_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder, computed once, safe from lost executors, lineage cut; and its path."""
    spark = df.sparkSession
    at = fresh_dir(spark, what)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at), at


def written(df: DataFrame, what: str) -> DataFrame:
    return written_at(df, what)[0]


def forget(path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    filesystem, at = pafs.FileSystem.from_uri(path)
    filesystem.delete_dir(at)


def join_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: int = 1000, least: int = 2000) -> DataFrame:
    """``left`` joined with ``right``, which has each key once, so that no task gets all rows of a hot key.

    Keys of more than one in ``share`` rows of ``left`` are fewer than ``share``, whatever the data: their right rows are sent to
    all tasks.  ``left`` is read twice more for their counts: give a written table or a short plan.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_rows"))
    limit = max(least, left.count() // share)
    hot = [r[key] for r in counts.filter(F.col("_rows") > limit).collect()]
    if not hot:
        return left.join(right, key, how)
    keys = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in hot], left.select(key).schema))
    many = left.join(keys, key, "left_semi").join(F.broadcast(right.join(keys, key, "left_semi")), key, how)
    few = left.join(keys, key, "left_anti").join(right.join(keys, key, "left_anti"), key, how)
    return few.unionByName(many)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def texts_as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [x or b"" for x in col.to_pylist()]


def tidy(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """The same, with memory it freed given back to the machine at its end: Spark keeps a worker for the stages that follow."""

    @wraps(run)
    def tidied(*args: object) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's own, where it has one
            if trim is not None:
                trim(0)

    return tidied


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Row tuples as record batches of bounded size."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

"""Incremental load from an operational source into an idempotent sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def above_mark(source: DataFrame, key: str, mark: int | None) -> DataFrame:
    """Rows whose monotone key lies above the high-water mark; all rows when the sink is still empty."""
    return source if mark is None else source.filter(F.col(key) > F.lit(mark))


def clean_text(c: Column) -> Column:
    """Padded source text without its blanks; null becomes the empty string."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def to_sink_rows(joined: DataFrame, site: str = "FARMACIA") -> DataFrame:
    """The sink's columns: renames, casts, constants."""
    return joined.select(
        F.lit(site).alias("farmacia"),
        F.col("o_orderkey").cast("long").alias("id_contador"),
        F.col("o_custkey").cast("long").alias("id_proveedor"),
        clean_text(F.col("c_name")).alias("proveedor"),
        F.col("o_orderkey").cast("string").alias("numero_albaran"),
        F.to_date("o_orderdate").alias("fecha"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("importe_pvp"),
        F.lit("PENDIENTE").alias("estado"),
    )


def high_water_mark(sink: DataFrame, key: str, site: Column | None = None, default: int = 0) -> DataFrame:
    """One row: the sink's largest key (of one site), or the default for an empty sink."""
    mine = sink if site is None else sink.filter(site)
    return mine.agg(F.coalesce(F.max(key), F.lit(default).cast("long")).alias("mark"))


def each_once(df: DataFrame, keys: list[str], last: str | None = None) -> DataFrame:
    """One row a key: that with the greatest ``last``, else the first by all columns.  Rows with a null in the key all stay."""
    columns = [named(c) for c in df.columns]
    order = ([named(last).desc_nulls_last()] if last else []) + [c.asc_nulls_first() for c in columns]
    place = unused(df, "_place")
    whole = reduce(Column.__and__, (named(k).isNotNull() for k in keys))
    ranked = df.filter(whole).withColumn(place, F.row_number().over(Window.partitionBy(*map(named, keys)).orderBy(*order)))
    # Rows without a key never meet in one task.
    return ranked.filter(F.col(place) == 1).select(*columns).unionByName(df.filter(~whole))


def insert_or_ignore(sink: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key the sink does not have yet, each key once (first by all columns): append them.

    A key with a null equals no other, as in SQL, so its rows are new each time.
    """
    return each_once(new, keys).join(sink.select(*map(named, keys)), keys, "left_anti").select(*map(named, new.columns))


def upsert(state: DataFrame, new: DataFrame, keys: list[str], last: str | None = None) -> DataFrame:
    """The state after new rows replaced those of the same key; of new rows with one key that with the greatest ``last`` counts."""
    one = each_once(new, keys, last).select(*map(named, state.columns))
    return state.join(one.select(*map(named, keys)), keys, "left_anti").select(*map(named, state.columns)).unionByName(one)


def named(name: str) -> Column:
    """The column of just this name, dots and backquotes included."""
    return F.col(f"`{name.replace('`', '``')}`")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def progress(df: DataFrame, name: str, **counts: Column):
    """Counters that run with the write: (frame, observation)."""
    seen = Observation(name)
    return df.observe(seen, *(F.count_if(c).alias(k) for k, c in counts.items()), F.count(F.lit(1)).alias("rows")), seen

"""Pairing of rows: by place up to the longer side, and with exactly one partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sync import named, unused


def padded_zip(left: Column, right: Column) -> Column:
    """Pairs (indice from 1, a, b) of two arrays up to the longer one; the shorter one gives nulls, a null array none."""
    a, b = (F.coalesce(x, F.array()) for x in (left, right))
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: F.struct((i + 1).alias("indice"), x["a"].alias("a"), x["b"].alias("b")))


def by_place(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The n-th row of each key of one side beside the n-th of the other: (keys, indice, a, b), a or b null where a side is shorter.

    Both sides are tagged and numbered in one window, so one shuffle by key serves numbering and pairing, and no join is needed.  Rows of
    equal order go by all their columns; null keys are a key.
    """
    columns = [c for c in left.columns if c not in keys]
    if sorted(columns) != sorted(c for c in right.columns if c not in keys):
        raise ValueError("both sides must have the same columns")
    side, place = unused(left, "_side"), unused(left, "_place")
    both = left.withColumn(side, F.lit("a")).unionByName(right.withColumn(side, F.lit("b")))
    rows = Window.partitionBy(*map(named, keys), side).orderBy(*map(named, order), *map(named, columns))
    numbered = both.repartition(*map(named, keys)).withColumn(place, F.row_number().over(rows))
    row = F.struct(*map(named, columns))
    # Each place has one row a side.
    pairs = numbered.groupBy(*map(named, keys), place).agg(*(F.first(F.when(F.col(side) == s, row), ignorenulls=True).alias(s) for s in "ab"))
    return pairs.select(*map(named, keys), F.col(place).alias("indice"), "a", "b")


def only_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of its one match in ``right``; a left row with no match or several fails the query when it runs.

    The matches are counted before they meet the left side, so several don't multiply rows.  A null in a key matches
    nothing, so such a left row fails.  The check is a filter: leaving out the right columns later doesn't leave out the check.
    """
    count, match = unused(left, "_matches"), unused(left, "_match")
    columns = [c for c in right.columns if c not in keys]
    if clash := {c.lower() for c in columns} & {c.lower() for c in left.columns}:
        raise ValueError(f"both sides have {sorted(clash)}")
    ones = right.groupBy(*map(named, keys)).agg(F.count("*").alias(count), F.first(F.struct(F.lit(1).alias("_one"), *map(named, columns))).alias(match))
    both = left.join(ones, keys, "left")
    n = F.coalesce(F.col(count), F.lit(0))
    said = F.concat(F.lit("expected one match, found "), n.cast("string"), F.lit(" for "), F.to_json(F.struct(*map(named, keys))))
    sure = both.filter(F.when(n == 1, True).otherwise(F.raise_error(said).cast("boolean")))
    return sure.select(*map(named, left.columns), *(F.col(match)[c].alias(c) for c in columns))

"""Columns, keys, indexes and foreign keys: metadata, nulls and failures."""

import pytest

from tallyloom.operators import constraints as K


def test_columns_tell_length_precision_identity_and_formulas(spark):
    from pyspark.sql import types as T

    spark.sql("CREATE OR REPLACE TEMP VIEW k_dummy AS SELECT 1")
    schema = T.StructType([
        T.StructField("id", T.LongType(), False, {"identity": True}), T.StructField("name", T.StringType(), True, {"__CHAR_VARCHAR_TYPE_STRING": "varchar(40)"}),
        T.StructField("price", T.DecimalType(14, 2)), T.StructField("twice", T.DecimalType(15, 2), True, {"delta.generationExpression": "price * 2"}),
    ])
    rows = K.columns(spark, {"t": spark.createDataFrame([], schema)}).collect()
    assert [tuple(r)[2:] for r in rows] == [("id", "long", None, None, None, False, True, False), ("name", "varchar", 40, None, None, True, False, False), ("price", "decimal", None, 14, 2, True, False, False), ("twice", "decimal", None, 15, 2, True, False, True)]


def test_tables_and_views_of_the_session(spark):
    spark.range(1).createOrReplaceTempView("k_view")
    assert ("k_view", "VISTA") in {(r.tabla, r.tipo) for r in K.user_tables(spark).collect()}
    assert "k_view" not in {r.tabla for r in K.user_tables(spark, views=False).collect()}
    spark.catalog.dropTempView("k_view")


def test_keys_with_nulls_and_repeats(spark):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (2, None)], "a long, b string")
    index = [K.Index("t", "UQ", ("a", "-b"), unique=True), K.Index("t", "IX", ("b",), ("a",)), K.Index("e", "PK", ("a",), primary=True)]
    got = {r.indice: (r.filas, r.valores, r.repetidas, r.sin_valor) for r in K.checked_keys({"t": t, "e": t.limit(0)}, index).collect()}
    assert got == {"UQ": (5, 2, 1, 2), "IX": (5, 3, 1, 1), "PK": (0, 0, 0, 0)}
    assert [tuple(r) for r in K.indexes(spark, index).collect()] == [("t", "UQ", "a, b DESC", None, True, False), ("t", "IX", "b", "a", False, False), ("e", "PK", "a", None, True, True)]


def test_foreign_keys_in_and_out(spark):
    t = spark.createDataFrame([(1, 1), (2, 1), (3, 9), (4, None)], "id long, up long")
    keys = [K.ForeignKey("FK_self", "t", ("up",), "t", ("id",), "CASCADE"), K.ForeignKey("FK_two", "u", ("x", "y"), "t", ("id", "up"))]
    u = spark.createDataFrame([(1, 1)] * 5 + [(1, 2), (None, 1)], "x long, y long")
    got = {r.fk: (r.filas, r.sin_valor, r.huerfanas) for r in K.checked_foreign_keys({"t": t, "u": u}, keys).collect()}
    assert got == {"FK_self": (4, 1, 1), "FK_two": (7, 1, 1)}
    ways = [(r.sentido, r.fk, r.columnas) for r in K.foreign_keys(spark, keys, "t").collect()]
    assert ways == [("SALIENTE", "FK_self", "t.up -> t.id"), ("ENTRANTE", "FK_self", "t.up -> t.id"), ("ENTRANTE", "FK_two", "u.x -> t.id | u.y -> t.up")]
    with pytest.raises(ValueError, match="known actions"):
        K.ForeignKey("bad", "t", ("a",), "u", ("b",), "EXPLODE")
    with pytest.raises(ValueError, match="as many columns"):
        K.ForeignKey("bad", "t", ("a", "b"), "u", ("b",))

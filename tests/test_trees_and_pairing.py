"""Trees of unknown shape, entities, pairing by place, unique lookups: edge cases and failures."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyloom.operators import pairing, trees


def forest(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", F.try_parse_json("t").alias("arbol"))


def flat(value, path="", level=0):
    yield path, level, value
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in items:
        step = f"[{k}]" if isinstance(k, int) else (f".{k}" if path else k) if k.isidentifier() else f"[{json.dumps(k)}]"
        yield from flat(v, path + step, level + 1)


def test_walk_equals_recursion_in_python(spark):
    texts = ['{"a":[null,{"x.y":"1","n":5,"e":{},"l":[]}],"b":{"c":{"d":[[1,[2,"z"]]]}}}', "[]", "{}", '"only"', "null", "17", "not json", None, '{"key":1,"pos":2,"value":{"id":3},"say \\"x\\"":true}']
    got = sorted((r.id, r.nivel, r.ruta, r.tipo) for r in trees.walk(forest(spark, texts), ["id"], "arbol").collect() if r.tipo)
    kind = lambda v: {dict: "OBJECT", list: "ARRAY", str: "STRING", bool: "BOOLEAN", int: "BIGINT", type(None): "VOID"}[type(v)]
    want = sorted((i, level, path, kind(v)) for i, t in enumerate(texts) if t not in (None, "not json") for path, level, v in flat(json.loads(t)))
    assert got == want
    # What is no JSON, or null, is a node of no type.
    assert {r.id for r in trees.walk(forest(spark, texts), ["id"], "arbol").filter("tipo IS NULL").collect()} == {6, 7}


def test_walk_of_deep_trees_and_of_none(spark):
    deep = '{"a":' * 30 + "1" + "}" * 30
    assert trees.walk(forest(spark, [deep]), ["id"], "arbol").count() == 31
    with pytest.raises(ValueError, match="deeper than 20"):
        trees.walk(forest(spark, [deep]), ["id"], "arbol", most=20)
    assert trees.walk(forest(spark, ["1"]).limit(0), ["id"], "arbol").count() == 0


def test_find_only(spark):
    df = forest(spark, ['{"d":[{"f":[{"n":"7","v":1}]},{"n":7}]}', '{"n":"8","in":{"n":"9"}}']).withColumn("wanted", F.element_at(F.array(F.lit("7"), F.lit("9")), (F.col("id") + 1).cast("int")))
    assert [(r.id, r.wanted, r.ruta) for r in trees.find_only(df, ["id"], "arbol", "n", "wanted").orderBy("id").collect()] == [(0, "7", "d[0].f[0]"), (1, "9", "in")]
    for bad in ('{"n":"8"}', '[{"n":"7"},{"n":"7"}]', '{"n":7}'):
        some = forest(spark, [bad]).withColumn("wanted", F.lit("7"))
        with pytest.raises(PySparkException, match="expected one match, found [02]"):
            trees.find_only(some, ["id"], "arbol", "n", "wanted").collect()


def test_entities_and_typed_values(spark):
    doc = {"entities": [{"type": "a", "pageAnchor": {"pageRefs": [{"page": "3"}, {}, {"page": 3}]}, "properties": [{"type": "b"}, {"type": "c", "properties": [{"type": "d"}]}]}, {"type": "e"}]}
    got = trees.entities(forest(spark, [json.dumps(doc), "{}", None]), ["id"], "arbol").collect()
    assert sorted((r.nivel, r.ruta, r.tipo, r.paginas) for r in got) == [(0, [0], "a", [1, 4]), (0, [1], "e", []), (1, [0, 0], "b", []), (1, [0, 1], "c", []), (2, [0, 1, 0], "d", [])]
    fields = [{"value_string": None, "valueNumber": 2.5, "content": "x"}, {"content": "y"}, {"valueArray": [1, 2]}, {}, None]
    df = forest(spark, [json.dumps(x) for x in fields])
    got = df.select("id", F.to_json(trees.typed_value(F.col("arbol"))).alias("v")).orderBy("id").collect()
    assert [r.v for r in got] == ["2.5", None, "[1,2]", None, None]


def test_by_place_pads_the_shorter_side(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z"), (None, 1, "n")], "k long, o int, v string")
    b = spark.createDataFrame([(1, 5, "p"), (3, 1, "q"), (None, 2, "m"), (None, 2, "m")], "k long, o int, v string")
    got = {(r.k, r.indice): (r.a and r.a.v, r.b and r.b.v) for r in pairing.by_place(a, b, ["k"], ["o"]).collect()}
    assert got == {(1, 1): ("x", "p"), (1, 2): ("y", None), (2, 1): ("z", None), (3, 1): (None, "q"), (None, 1): ("n", "m"), (None, 2): (None, "m")}
    plan = pairing.by_place(a, b, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert pairing.by_place(a.limit(0), b.limit(0), ["k"], ["o"]).count() == 0


def test_padded_zip(spark):
    df = spark.createDataFrame([([1, 2], [3]), (None, [4]), ([], None)], "a array<int>, b array<int>")
    got = [[tuple(p) for p in r.z] for r in df.select(pairing.padded_zip(F.col("a"), F.col("b")).alias("z")).collect()]
    assert got == [[(1, 1, 3), (2, 2, None)], [(1, None, 4)], []]


@pytest.mark.parametrize(("right", "found"), [([(1, "a")], 0), ([(1, "a"), (2, "b"), (2, "c")], 2)])
def test_only_match_fails_on_none_and_on_several(spark, right, found):
    left = spark.createDataFrame([(1, "l"), (2, "m")], "k long, own string")
    got = pairing.only_match(left, spark.createDataFrame(right, "k long, v string"), ["k"])
    with pytest.raises(PySparkException, match=f"expected one match, found {found} for .*2"):
        got.collect()
    # Nor does leaving out the right side's columns leave out the check.
    with pytest.raises(PySparkException, match="expected one match"):
        got.select("own").collect()


def test_only_match_of_null_keys_and_of_rows_nobody_asks_for(spark):
    left = spark.createDataFrame([(1, "l")], "k long, own string")
    right = spark.createDataFrame([(1, None), (3, "b"), (3, "c")], "k long, v string")
    assert [tuple(r) for r in pairing.only_match(left, right, ["k"]).collect()] == [(1, "l", None)]
    with pytest.raises(PySparkException, match="found 0"):
        pairing.only_match(spark.createDataFrame([(None, "l")], "k long, own string"), right, ["k"]).collect()
    with pytest.raises(ValueError, match="both sides have"):
        pairing.only_match(left, right.withColumnRenamed("v", "own"), ["k"])

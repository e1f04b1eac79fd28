"""Trees of unknown shape (variant): all nodes with their paths, nodes by the value of a member, nested entities.

A level of the trees is the children of the containers of the level above, by ``variant_explode``, and is written before the next one is
made, so the work is as many jobs as the deepest tree has levels, whatever the number of trees, and nothing is worked out twice.  No schema is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..work import kept
from .pairing import only_match
from .sync import named

#: Deeper trees are an error, never cut.
DEPTH = 64
CONTAINERS = ("OBJECT", "ARRAY")


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY or the type of a scalar; null for no value, VOID for a JSON null."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def scalar_text(value: Column, kind: Column) -> Column:
    return F.when(~kind.isin(*CONTAINERS), F.try_variant_get(value, "$", "string"))


def child_path(path: Column, key: Column, pos: Column) -> Column:
    """a.b[0]; a key that is no word is quoted as in JSON: ["x y"]."""
    quoted = F.concat(F.lit('["'), F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"]'))
    word = F.concat(F.when(path == "", "").otherwise("."), key)
    step = F.when(key.isNull(), F.concat(F.lit("["), pos.cast("string"), F.lit("]"))).when(key.rlike(r"^\w+\z"), word).otherwise(quoted)
    return F.concat(path, step)


def member(value: Column, name: str) -> Column:
    """A member of an object as variant; null for other values."""
    quoted = name.replace("\\", "\\\\").replace('"', '\\"')
    return F.try_variant_get(value, f'$["{quoted}"]', "variant")


def below(inner: DataFrame, node: str) -> DataFrame:
    """The children (_key, _pos, _value) of the containers in a column, beside the other columns, of which none has these names."""
    each = inner.withColumnRenamed(node, "_node").select(F.struct("*").alias("_row"))
    children = each.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("_row._node").outer()))
    return children.select("_row.*", F.col("key").alias("_key"), F.col("pos").alias("_pos"), F.col("value").alias("_value"))


def walk(df: DataFrame, keys: list[str], tree: str, most: int = DEPTH) -> DataFrame:
    """(keys, nivel, ruta, clave, pos, tipo, nodo): every node of every tree, the root at level 0 with an empty path.

    A null tree is one node of no type; an empty object or array has no children; trees deeper than ``most`` fail.
    """
    of = [named(k) for k in keys]
    root = df.select(*of, F.lit(0).alias("nivel"), F.lit("").alias("ruta"), F.lit(None).cast("string").alias("clave"), F.lit(None).cast("int").alias("pos"), kind_of(named(tree)).alias("tipo"), named(tree).alias("nodo"))
    levels = [kept(root, "tree-level")]
    while not (inner := levels[-1].filter(F.col("tipo").isin(*CONTAINERS))).isEmpty():
        if len(levels) > most:
            raise ValueError(f"a tree is deeper than {most} levels")
        each = below(inner.select(*of, "nivel", "ruta", "nodo"), "nodo")
        path = child_path(F.col("ruta"), F.col("_key"), F.col("_pos"))
        levels.append(kept(each.select(*of, (F.col("nivel") + 1).alias("nivel"), path.alias("ruta"), F.col("_key").alias("clave"), F.col("_pos").alias("pos"), kind_of(F.col("_value")).alias("tipo"), F.col("_value").alias("nodo")), "tree-level"))
    return reduce(DataFrame.unionByName, levels)


def with_member(nodes: DataFrame, name: str, value: Column) -> DataFrame:
    """Of walk()'s nodes the objects that have a member of this name whose value is just this text."""
    found = member(F.col("nodo"), name)
    return nodes.filter((F.col("tipo") == "OBJECT") & (kind_of(found) == "STRING") & (F.try_variant_get(found, "$", "string") == value))


def find_only(df: DataFrame, keys: list[str], tree: str, name: str, value: str, most: int = DEPTH) -> DataFrame:
    """Each row of ``df`` (one a key) with the path and the node of the one object in its tree whose member ``name`` is the row's ``value``.

    None or several fail the query when it runs.  Only objects with such a member are shuffled, not all nodes.
    """
    wanted = df.select(*map(named, keys), named(value).alias("_wanted"))
    nodes = walk(df.select(*map(named, keys), F.struct(F.lit(0)).alias("_none"), named(tree)), keys, tree, most)
    some = nodes.filter((F.col("tipo") == "OBJECT") & (kind_of(member(F.col("nodo"), name)) == "STRING"))
    texts = some.select(*map(named, keys), "ruta", "nodo", F.try_variant_get(member(F.col("nodo"), name), "$", "string").alias("_wanted"))
    return only_match(wanted, texts, [*keys, "_wanted"]).withColumnRenamed("_wanted", value)


def either(value: Column, *names: str) -> Column:
    """The first member that a value has of several names, such as one in two spellings."""
    return F.coalesce(*(member(value, n) for n in names))


def snake_and_camel(name: str) -> tuple[str, str]:
    head, *rest = name.split("_")
    return name, head + "".join(x.capitalize() for x in rest)


def pages_of(entity: Column) -> Column:
    """The pages an entity refers to, sorted, each once, counted from 1: a reference without a page is to the first."""
    anchor = either(entity, *snake_and_camel("page_anchor"))
    refs = F.try_variant_get(either(anchor, *snake_and_camel("page_refs")), "$", "array<variant>")
    return F.sort_array(F.array_distinct(F.transform(F.coalesce(refs, F.array().cast("array<variant>")), lambda r: F.coalesce(F.try_variant_get(r, "$.page", "long"), F.lit(0).cast("long")) + 1)))


def entities(df: DataFrame, keys: list[str], tree: str, roots: str = "entities", children: str = "properties", most: int = DEPTH) -> DataFrame:
    """(keys, nivel, ruta, tipo, texto, paginas): the entities of a document and those nested in them, in the order of their paths' numbers."""
    of = [named(k) for k in keys]

    def listed(frame: DataFrame, holder: Column, level: int, path: Column) -> DataFrame:
        inner = frame.select(*of, path.alias("ruta"), holder.alias("_list"))
        each = below(inner.filter(kind_of(F.col("_list")) == "ARRAY"), "_list")
        return each.select(*of, F.lit(level).alias("nivel"), F.concat("ruta", F.array("_pos")).alias("ruta"), F.col("_value").alias("nodo"))

    levels = [kept(listed(df, member(named(tree), roots), 0, F.array().cast("array<int>")), "entities")]
    while not levels[-1].isEmpty():
        if len(levels) > most:
            raise ValueError(f"entities are nested deeper than {most} levels")
        levels.append(kept(listed(levels[-1], member(F.col("nodo"), children), len(levels), F.col("ruta")), "entities"))
    text = lambda *names: F.try_variant_get(either(F.col("nodo"), *names), "$", "string")
    return reduce(DataFrame.unionByName, levels).select(*of, "nivel", "ruta", text("type", "type_").alias("tipo"), text(*snake_and_camel("mention_text")).alias("texto"), pages_of(F.col("nodo")).alias("paginas"))


def divided(document: Column, expected: list[tuple[int, int]], roots: str = "entities") -> Column:
    """Whether a document's entities refer to just the pages of the expected divisions (first, last), in their order."""
    found = F.transform(F.coalesce(F.try_variant_get(member(document, roots), "$", "array<variant>"), F.array().cast("array<variant>")), pages_of)
    want = F.array(*(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in expected)) if expected else F.array().cast("array<array<bigint>>")
    return found.eqNullSafe(want)


#: A field's typed values, in the order they are looked for.
TYPED = (
    "value", "value_string", "value_date", "value_time", "value_phone_number", "value_number", "value_integer", "value_currency",
    "value_selection_mark", "value_signature", "value_country_region", "value_boolean", "value_array", "value_object",
)


def typed_value(field: Column) -> Column:
    """A field's first typed value that isn't null, in either spelling, as variant."""
    some = [F.nullif(F.to_json(x), F.lit("null")) for x in (either(field, *snake_and_camel(n)) for n in TYPED)]
    return F.parse_json(F.coalesce(*some))


def picked(df: DataFrame, keys: list[str], tree: str, fields: list[str]) -> DataFrame:
    """(keys, campo, valor, confianza): a row for each field of a fixed list, its typed value as text or else its content."""
    field = F.explode(F.array(*(F.struct(F.lit(f).alias("campo"), member(named(tree), f).alias("x")) for f in fields)))
    each = df.select(*map(named, keys), field.alias("f")).select(*map(named, keys), "f.campo", F.col("f.x").alias("x"))
    value = F.coalesce(F.try_variant_get(typed_value(F.col("x")), "$", "string"), F.try_variant_get(member(F.col("x"), "content"), "$", "string"))
    return each.select(*map(named, keys), "campo", value.alias("valor"), F.try_variant_get(member(F.col("x"), "confidence"), "$", "double").alias("confianza"))

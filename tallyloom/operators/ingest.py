"""Document ingestion: content hashes, change detection, duplicate groups, registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sync import each_once, named


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def is_sound_pdf(content: Column) -> Column:
    """Not empty, and with the magic bytes of a PDF."""
    return (F.octet_length(content) > 0) & (F.hex(F.substring(content, 1, 5)) == "255044462D")


def changes(before: DataFrame, now: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """Each key's change between two snapshots: NUEVO, MODIFICADO, IGUAL or AUSENTE, by null-safe comparison.

    A key that a snapshot repeats counts once, with its first row by all columns.
    """
    side = lambda df, name: each_once(df.select(named(key), *map(named, marks)), [key]).select(named(key).alias("k"), F.struct(*(named(m).alias(m) for m in marks)).alias(name), F.lit(True).alias(f"in_{name}"))
    both = side(before, "a").join(side(now, "b"), "k", "full")
    state = F.when(F.col("in_a").isNull(), "NUEVO").when(F.col("in_b").isNull(), "AUSENTE").when(F.col("a").eqNullSafe(F.col("b")), "IGUAL").otherwise("MODIFICADO")
    return both.select(F.col("k").alias(key), state.alias("cambio"))


def duplicate_groups(df: DataFrame, hash_column: str, order: str) -> DataFrame:
    """Hashes that occur more than once: how often, and the first of them."""
    return df.groupBy(hash_column).agg(F.count("*").alias("n"), F.min(order).alias("primero")).filter("n > 1")


def unregistered(found: DataFrame, registered: DataFrame, hash_column: str = "hash") -> DataFrame:
    """Files whose content is not registered yet, each content once (first path)."""
    new = found.join(registered.select(hash_column), hash_column, "left_anti")
    return new.groupBy(hash_column).agg(F.min_by(F.struct(*(c for c in new.columns if c != hash_column)), "path").alias("r")).select(hash_column, "r.*")


def settled(before: DataFrame, now: DataFrame, path: str = "ruta", size: str = "bytes") -> DataFrame:
    """Files of a listing that an earlier one had with the same size, and that aren't empty; others may still be on their way."""
    known = before.select(named(path), named(size).alias("_before"))
    both = now.join(known, path, "left")
    return both.filter((F.col("_before") == named(size)) & (named(size) > 0)).select(*map(named, now.columns))


#: What a newly registered document starts with.
DEFAULTS = {"estado_lectura": "PENDIENTE", "requiere_revision": False, "datos_extraidos": "{}", "necesita_lectura_visual": False, "intentos_lectura": 0}


def registration(files: DataFrame, site: str, name: str = "archivo_nombre", path: str = "archivo_ruta", hashed: str = "archivo_hash") -> DataFrame:
    """Rows to register for new files: the site, what is known of the file, and DEFAULTS."""
    return files.select(F.lit(site).alias("farmacia"), named(name).alias("archivo_nombre"), named(path).alias("archivo_ruta"), named(hashed).alias("archivo_hash"), *(F.lit(v).alias(k) for k, v in DEFAULTS.items()))


def indexed(index: DataFrame, paths: DataFrame, path: str = "ruta") -> DataFrame:
    """Each path with its row in the index of files, if it has one.  The index has a path once."""
    return paths.select(named(path)).join(index, path, "left")


def unchanged(found: DataFrame, index: DataFrame, path: str = "ruta", marks: tuple[str, ...] = ("tamano", "fecha_modificacion_ns"), state: str = "estado") -> DataFrame:
    """Found files with ``omitir``: whether the index has them as imported with the same size and time, so that they needn't be read."""
    known = index.select(named(path), F.struct(*map(named, marks)).alias("_marks"), named(state).alias("_state"))
    both = found.join(known, path, "left")
    same = (F.col("_state") == "IMPORTADA") & F.struct(*map(named, marks)).eqNullSafe(F.col("_marks"))
    return both.select(*(named(c) for c in found.columns), F.coalesce(same, F.lit(False)).alias("omitir"))

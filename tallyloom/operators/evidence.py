"""Evidence held against the text it is said to come from: of its own document by key, or of all texts by an automaton."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import simplified
from . import trees
from .sync import named

#: Characters of patterns in one automaton, some 60 bytes each in a worker; more patterns take further passes over the texts.
BLOCK_CHARS = 2_000_000


def evidence_texts(df: DataFrame, keys: list[str], tree: str) -> DataFrame:
    """(keys, ruta, texto): the visible text of every entry of every list ``evidencias`` in trees of any shape; a missing text is empty."""
    nodes = trees.walk(df, keys, tree)
    entries = nodes.filter((F.col("tipo") == "OBJECT") & F.col("ruta").rlike(r"(^|\.)evidencias\[\d+\]\z"))
    return entries.select(*map(named, keys), "ruta", F.coalesce(F.try_variant_get(trees.member(F.col("nodo"), "texto_visible"), "$", "string"), F.lit("")).alias("texto"))


def page_text(pages: DataFrame, keys: list[str], page: str, text: str) -> DataFrame:
    """(keys, texto): a document's pages joined by line ends in their order; pages without text are empty."""
    rows = F.sort_array(F.collect_list(F.struct(named(page).alias("p"), F.coalesce(named(text), F.lit("")).alias("t"))))
    return pages.groupBy(*map(named, keys)).agg(F.concat_ws("\n", F.transform(rows, lambda r: r["t"])).alias("texto"))


def verified(evidence: DataFrame, texts: DataFrame, keys: list[str], said: str = "texto", text: str = "texto") -> DataFrame:
    """``evidence`` with ``verificada``: whether the document of its key has the text, both simplified.

    No text isn't verified, nor is any without a document.  A text is simplified once, before it meets its evidences.
    """
    plain = texts.select(*map(named, keys), simplified(named(text)).alias("_plain"))
    both = evidence.join(plain, keys, "left")
    found = (named(said) != "") & F.contains("_plain", simplified(named(said)))
    return both.select(*map(named, evidence.columns), F.coalesce(found, F.lit(False)).alias("verificada"))


def verification_counts(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Evidences found, and those that the text can't bear out, by key."""
    return checked.groupBy(*map(named, keys)).agg(F.count_if("verificada").alias("verificadas_en_texto"), F.count_if(~F.col("verificada")).alias("no_verificables"))


def search_texts(patterns: DataFrame, texts: DataFrame, pattern: str, text: str, order: str) -> DataFrame:
    """(pattern, textos, primero): how many texts have each distinct pattern, both simplified, and the least ``order`` (long) of these.

    Each text runs once through an Aho-Corasick automaton of all patterns of a block, so the work grows with the texts and
    the hits, not with patterns times texts, and what leaves a task is one row a pattern, not one a hit.  Blocks of patterns are dealt by
    hash and so bounded by BLOCK_CHARS on average; one block at a time is sent out.  A pattern that simplifies to nothing is found
    in every text that isn't null; null patterns take no part.
    """
    import ahocorasick

    spark = texts.sparkSession
    wanted = patterns.select(named(pattern).alias("pattern"), simplified(named(pattern)).alias("plain")).filter("pattern IS NOT NULL").distinct()
    plain = wanted.select("plain").distinct()
    chars = plain.agg(F.coalesce(F.sum(F.length("plain") + 1), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    read = texts.select(named(order).cast("long").alias("id"), simplified(named(text)).alias("plain")).filter("plain IS NOT NULL")
    schema = pa.schema([("plain", pa.string()), ("textos", pa.int64()), ("primero", pa.int64())])

    def searched(block: int) -> DataFrame:
        words = spark.sparkContext.broadcast([r.plain for r in plain.filter(F.pmod(F.xxhash64("plain"), F.lit(blocks)) == block).collect()])

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for i, w in enumerate(words.value):
                if w:
                    automaton.add_word(w, i)
            automaton.make_automaton()
            always = [i for i, w in enumerate(words.value) if not w]
            hits: dict[int, tuple[int, int | None]] = {}
            for batch in it:
                for number, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = {i for _, i in automaton.iter(t)} if len(automaton) else set()
                    for i in (*found, *always):
                        n, least = hits.get(i, (0, None))
                        hits[i] = (n + 1, number if least is None or (number is not None and number < least) else least)
            rows = [(words.value[i], n, least) for i, (n, least) in hits.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

        return read.mapInArrow(run, "plain string, textos long, primero long")

    hits = reduce(DataFrame.unionByName, map(searched, range(blocks))).groupBy("plain").agg(F.sum("textos").alias("textos"), F.min("primero").alias("primero"))
    return wanted.join(hits, "plain", "left").select(F.col("pattern").alias(pattern), F.coalesce("textos", F.lit(0)).cast("long").alias("textos"), "primero")

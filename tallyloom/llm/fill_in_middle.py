"""Fill-in-the-middle transformation by DuckDB inside mapInArrow.

Each Arrow batch is registered in an in-memory DuckDB of the worker, and SQL returns Arrow: no Python per row.  sha256 of the seed and
doc_id gives four numbers: two cut the text into prefix, middle and suffix, the others choose its form.  The text is taken apart by
regexp_extract_all into runs of RUN code points, so that a list of runs is as large as the text rather than sixteen times
so; list_slice and array_to_string put whole runs together, and the run at a cut is divided.  Texts with a mark in them stay plain, so the
marks of an output are found again: no mark can begin inside another one or across the end of a text.

    plain   text        psm   <P>prefix<S>suffix<M>middle        spm   <S>suffix<P>prefix<M>middle

A batch is cut into parts of TOGETHER bytes of text (a longer text is a part of its own); DuckDB keeps to one thread and memory.

Defined results: a null text is empty; an empty text is plain; a null doc_id counts as an empty number and is kept; repeated
rows are transformed alike and all stay; rows of empty tables: none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SEED, RATE, SPM = 1, 90, 20
RUN = 16
TOGETHER = 4 << 20

#: ``head`` and ``tail`` of a list of runs at a cut, and what is between two cuts.
MACROS = f"""
CREATE MACRO head(runs, a) AS array_to_string(list_slice(runs, 1, a // {RUN}), '') || coalesce(left(runs[a // {RUN} + 1], a % {RUN}), '');
CREATE MACRO tail(runs, a) AS coalesce(substr(runs[a // {RUN} + 1], a % {RUN} + 1), '') || array_to_string(list_slice(runs, a // {RUN} + 2, len(runs)), '');
CREATE MACRO between_(runs, a, b) AS CASE WHEN a // {RUN} = b // {RUN} THEN coalesce(substr(runs[a // {RUN} + 1], a % {RUN} + 1, b - a), '')
  ELSE substr(runs[a // {RUN} + 1], a % {RUN} + 1) || array_to_string(list_slice(runs, a // {RUN} + 2, b // {RUN}), '') || coalesce(left(runs[b // {RUN} + 1], b % {RUN}), '') END;
CREATE MACRO number(digest, i) AS CAST('0x' || substr(digest, 8 * i - 7, 8) AS BIGINT);
"""

CUT_SQL = f"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256($seed || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM batch),
drawn AS (
  SELECT doc_id, text, length(text) AS n, number(digest, 1) % (n + 1) AS x, number(digest, 2) % (n + 1) AS y, least(x, y) AS a, greatest(x, y) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR number(digest, 3) % 100 >= $rate THEN 'plain'
      WHEN number(digest, 4) % 100 < $spm THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
apart AS (
  SELECT *, CASE WHEN form <> 'plain' THEN regexp_extract_all(text, '(?s).{{1,{RUN}}}') END AS runs FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || head(runs, a) || '<S>' || tail(runs, b) || '<M>' || between_(runs, a, b)
    ELSE '<S>' || tail(runs, b) || '<P>' || head(runs, a) || '<M>' || between_(runs, a, b) END AS output
FROM apart
"""

#: From output and form alone; the columns of the batch are kept.
RESTORE_SQL = """
SELECT * EXCLUDE (parts),
  CASE form WHEN 'plain' THEN output WHEN 'psm' THEN parts[2] || parts[4] || parts[3] ELSE parts[3] || parts[4] || parts[2] END AS restored
FROM (SELECT *, CASE WHEN form <> 'plain' THEN string_split_regex(output, '<[PSM]>') END AS parts FROM batch)
"""


@lru_cache(maxsize=1)
def engine() -> duckdb.DuckDBPyConnection:
    """The worker's DuckDB: one thread, bounded memory, no files."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
    con.execute(MACROS)
    return con


def parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of about TOGETHER bytes of a text column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > TOGETHER:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def by_sql(sql: str, column: str, values: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: every batch as table ``batch`` through the SQL."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = engine()
        for whole in it:
            for batch in parts(whole, column):
                con.register("batch", pa.Table.from_batches([batch]))
                yield from con.execute(sql, values).to_arrow_table().to_batches()
                con.unregister("batch")

    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): ``rate`` percent of the texts are cut, ``spm`` percent of these with the suffix first."""
    src = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(by_sql(CUT_SQL, "text", {"seed": str(seed), "rate": rate, "spm": spm}), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame) -> DataFrame:
    """Adds ``restored``, the text read back from ``output`` and ``form``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
    return made.mapInArrow(by_sql(RESTORE_SQL, "output", {}), f"{schema}, restored string")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, transformed and read back."""
    read = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return read.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: By substr() on whole texts; the restored text is the source.
OP11_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
k AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
    CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM h),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k),
p AS (SELECT *, substr(t, 1, a) AS prefix_, substr(t, a + 1, b - a) AS middle_, substr(t, b + 1) AS suffix_ FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix_ || '<S>' || suffix_ || '<M>' || middle_
    ELSE '<S>' || suffix_ || '<P>' || prefix_ || '<M>' || middle_ END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
SQL = {"op11_fill_in_middle": OP11_SQL}

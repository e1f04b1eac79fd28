"""Benchmark decontamination by greedy string tiling.

Texts become lower-case words.  Documents and items that share a run of ``min_match`` words are joined by the
run's rolling hash; an item that such runs could not cover far enough is let go.  On the rest, running Karp-Rabin
tiling looks for matches of falling length and marks the longest non-overlapping ones until none of ``min_match``
words is left.  The share of an item's words under tiles is its coverage, whatever order the document has them in.

Items go to all tasks in blocks of bounded size, one pass over the documents a block, one block at a time.

Defined results: null texts count as empty; items of fewer than ``min_match`` words match nothing; equal item
rows count once; a null item_id or doc_id is kept as it is; repeated document rows each give their rows; empty
inputs give no rows; further columns are kept by the filter and ignored by the query.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, table, tidy, unused, written

MIN_MATCH, COVERAGE = 5, 0.5
#: Characters of items that go to all tasks at a time.
BLOCK_CHARS = 16 << 20
#: Words of documents looked at together.
CHUNK = 1 << 19
BASE = 0x100000001B3
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def run_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """The rolling hash of every run of k ids."""
    n = max(0, len(ids) - k + 1)
    h = np.zeros(n, np.uint64)
    u = ids.astype(np.uint64)
    for j in range(k):
        h = h * np.uint64(BASE) + u[j : n + j] + np.uint64(1)
    return h


class Items:
    """A block of items: vocabulary, word ids, and the places of their runs by hash."""

    def __init__(self, rows: list[tuple[int | None, str | None]], min_match: int, coverage: float):
        self.k, self.coverage = min_match, coverage
        words = [(i, w) for i, w in ((i, words_of(t)) for i, t in rows) if len(w) >= min_match]
        self.ids = [i for i, _ in words]
        self.vocabulary = {w: n for n, w in enumerate(sorted({x for _, w in words for x in w}))}
        self.words = [np.array([self.vocabulary[x] for x in w], np.int64) for _, w in words]
        hashes = [run_hashes(w, min_match) for w in self.words]
        h = np.concatenate([np.zeros(0, np.uint64), *hashes])
        item = np.repeat(np.arange(len(words)), [len(x) for x in hashes])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(x)) for x in hashes]])
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.place = h[order], item[order], place[order]
        self.first = np.searchsorted(self.hash, self.hash)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def leaks(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text the items it covers: (item number, coverage, tiles)."""
        out: list[list[tuple]] = []
        held: list[np.ndarray] = []
        n = 0
        get = self.vocabulary.get
        stop = np.full(self.k, -1)
        for text in texts:
            ids = np.array([get(w, -1) for w in words_of(text)], np.int64)
            held += [ids, stop]
            n += len(ids)
            if n >= CHUNK:
                out += self._leaks(held)
                held, n = [], 0
        return out + self._leaks(held)

    def _leaks(self, held: list[np.ndarray]) -> list[list[tuple]]:
        """``held``: the ids of texts, each with a stop behind it, so that no run goes over two."""
        if not held:
            return []
        flat = np.concatenate(held)
        ends = np.cumsum([len(x) for x in held])[1::2]
        out: list[list[tuple]] = [[] for _ in ends]
        unknown = np.r_[0, np.cumsum(flat < 0)]
        at = np.flatnonzero(unknown[self.k :] == unknown[: -self.k]) if len(flat) >= self.k else np.zeros(0, np.int64)
        if not len(at) or not len(self.hash):
            return out
        h = run_hashes(flat, self.k)[at]
        lo, hi = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, side="right")
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        doc = np.searchsorted(ends, at, side="right")
        cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else []
        for x, y in zip(cuts[:-1], cuts[1:]):
            d = int(doc[x])
            out[d] = self._tiled(flat, at[x:y], lo[x:y], n[x:y], int(ends[d - 1]) if d else 0)
        return out

    def _tiled(self, flat: np.ndarray, at: np.ndarray, lo: np.ndarray, n: np.ndarray, start: int) -> list[tuple]:
        """The items that a document covers, from the places of its seeds and where their hash stands in the index."""
        # A run that the document repeats counts once here, so there are no more seeds than places of items.
        runs, first = np.unique(lo, return_index=True)
        c = n[first]
        seed = np.repeat(runs - np.cumsum(c) + c, c) + np.arange(c.sum())
        item, place = self.item[seed], self.place[seed]
        # Words that the seeds reach, by item: too few of them and no tiling covers enough.
        reached = np.unique(self.starts[item, None] + place[:, None] + np.arange(self.k))
        count = np.bincount(np.searchsorted(self.starts, reached, side="right") - 1, minlength=len(self.words))
        found = []
        for i in np.flatnonzero((count > 0) & (count >= self.coverage * self.sizes)).tolist():
            its = np.isin(lo, runs[np.isin(runs, self.first[seed[item == i]])])
            got = self._tile(flat, at[its], self.words[i], start)
            if got:
                found.append((i, *got))
        return found

    def _tile(self, flat: np.ndarray, at: np.ndarray, words: np.ndarray, start: int) -> tuple | None:
        # Tiles lie in the seeds' words, so only those are looked at, apart from each other.
        runs = np.unique((np.unique(at)[:, None] + np.arange(self.k)).ravel())
        gap = np.flatnonzero(np.diff(runs) > 1) + 1
        where = np.insert(runs, gap, -1)
        text = np.insert(flat[runs], gap, -1)
        tiles = [(p, int(where[t]) - start, n) for p, t, n in greedy_tiles(words, text, self.k)]
        covered = sum(n for *_, n in tiles) / len(words)
        return (covered, tiles) if covered >= self.coverage else None


class Rolling:
    """Karp-Rabin hashes of the unmarked runs of any length over ids; negative ids are marked from the start."""

    def __init__(self, ids: np.ndarray):
        self.ids = np.asarray(ids, np.int64)
        n = len(self.ids)
        x = self.ids.astype(np.uint64) + np.uint64(1)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        power, back = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        if n:
            power[0] = back[0] = 1
        self.back = np.cumprod(back, dtype=np.uint64)
        self.sums = np.r_[np.uint64(0), np.cumsum(x * np.cumprod(power, dtype=np.uint64), dtype=np.uint64)]
        self.marked = self.ids < 0

    def runs(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the unmarked runs of s ids, and their hashes."""
        if s > len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        gone = np.r_[0, np.cumsum(self.marked)]
        at = np.flatnonzero(gone[s:] == gone[:-s])
        return at, (self.sums[at + s] - self.sums[at]) * self.back[at]

    def free(self, at: int, s: int) -> bool:
        return not self.marked[at : at + s].any()


def greedy_tiles(p: np.ndarray | list[int], t: np.ndarray | list[int], k: int) -> list[tuple[int, int, int]]:
    """Tiles (place in p, place in t, length), longest first; ties to the least places.  Negative ids match nothing.

    The greatest length at which unmarked runs of both have a hash in common is looked for by halving, as a match of some
    length holds matches of all smaller ones.  All tiles of that length are taken in one pass: places of p in order, each with
    the first unmarked place of t, whose lists are only ever left behind.  So no list of pairs is made, and the work is
    that of (p + t) for each different length.
    """
    a, b = Rolling(p), Rolling(t)
    tiles: list[tuple[int, int, int]] = []

    def common(s: int) -> bool:
        return bool(np.isin(a.runs(s)[1], b.runs(s)[1]).any())

    high = min(len(a.ids), len(b.ids))
    while high >= k and common(k):
        low = k
        while low < high:  # common(low) holds
            mid = high if low == k and high - low > 1 and common(high) else (low + high + 1) // 2
            if mid == high or common(mid):
                low = mid
            else:
                high = mid - 1
        s = low
        places, hashes = b.runs(s)
        here, mine = a.runs(s)
        both = np.isin(hashes, mine)
        places, hashes = places[both], hashes[both]
        order = np.argsort(hashes, kind="stable")
        places, hashes = places[order], hashes[order]
        kinds, first = np.unique(hashes, return_index=True)
        queue = dict(zip(kinds.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(hashes)])))
        end = 0
        for i, h in zip(here.tolist(), mine.tolist()):
            if i < end or h not in queue:
                continue
            x, last = queue[h]
            while x < last:
                j = int(places[x])
                if b.free(j, s) and np.array_equal(a.ids[i : i + s], b.ids[j : j + s]):
                    a.marked[i : i + s] = b.marked[j : j + s] = True
                    tiles.append((i, j, s))
                    end = i + s
                    break
                x += 1
            queue[h] = (x, last)
        high = s - 1
    return tiles


class ItemBlocks:
    """The items (number, text) in blocks that are small enough for all tasks, each read when its turn comes."""

    def __init__(self, src: DataFrame, blocks: int):
        self.src, self.blocks = src, blocks

    def __len__(self) -> int:
        return self.blocks

    def __iter__(self) -> Iterator[list[tuple[int | None, str]]]:
        for b in range(self.blocks):
            part = self.src.filter(F.pmod(F.xxhash64("i", "t"), F.lit(self.blocks)) == b)
            yield sorted(((r.i, r.t) for r in part.collect()), key=lambda x: (x[0] is None, x))


def item_blocks(items: DataFrame, item: str, text: str) -> ItemBlocks:
    src = items.select(F.col(item).cast("long").alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).distinct()
    chars = src.agg(F.coalesce(F.sum(F.char_length("t") + 16), F.lit(0))).first()[0]
    return ItemBlocks(src, -(-chars // BLOCK_CHARS))


def contaminated(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, tiles) of documents and the items they cover; tiles in words."""
    spark = docs.sparkSession
    tile = pa.struct([("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(tile))])
    ddl = "doc_id long, item_id long, coverage double, tiles array<struct<item_word:int,doc_word:int,words:int>>"
    src = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = []
    blocks = item_blocks(items, item, item_text)
    for part in blocks:
        sent = spark.sparkContext.broadcast(Items(part, min_match, coverage))

        @tidy
        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            its = sent.value
            for batch in it:
                rows = zip(batch.column(0).to_pylist(), its.leaks(batch.column(1).to_pylist()))
                flat = ((d, its.ids[i], c, [dict(zip(("item_word", "doc_word", "words"), x)) for x in tiles]) for d, got in rows for i, c, tiles in got)
                yield from batches(flat, schema)

        mine = src.mapInArrow(run, ddl)
        if len(blocks) > 1:
            # One block at a time is alive.
            mine = written(mine, "leaks")
            sent.destroy()
        found.append(mine)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], ddl)


def clean(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that cover no item.

    One block of items filters the rows as they pass.  With more, each block's pass writes the hashes of the texts that cover one
    of its items, and the rows of these texts are left out at the end.
    """
    spark = docs.sparkSession
    blocks = item_blocks(items, item, item_text)
    if len(blocks) > 1:
        hash_of = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
        texts = docs.select(hash_of.alias("_hash"), F.col(text).cast("string").alias("text"))
        bad = reduce(DataFrame.unionByName, [written(kept_if(texts, Items(part, min_match, coverage), 1, True).select("_hash").distinct(), "leaks") for part in blocks])
        hashed = unused(docs, "_text_hash")
        return docs.withColumn(hashed, hash_of).join(bad.distinct(), F.col(hashed) == F.col("_hash"), "left_anti").select(*docs.columns)
    for part in blocks:
        docs = kept_if(docs, Items(part, min_match, coverage), docs.columns.index(text), False)
    return docs


def kept_if(docs: DataFrame, block: Items, at: int, leaks: bool) -> DataFrame:
    """The rows of docs whose text (column number ``at``) covers an item of the block, or those whose does not."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = sent.value.leaks(batch.column(at).cast(pa.string()).to_pylist())
            yield batch.filter(pa.array([bool(x) == leaks for x in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that cover half of a benchmark item or more, with the items."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), F.size("tiles").alias("n_tiles"))


QUERIES = {"op5_decontamination": op5_decontamination}
SQL: dict[str, str] = {}

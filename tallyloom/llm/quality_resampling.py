"""Quality by importance resampling.

Two generative models of hashed n-grams say how likely a document holds each: the target's, fitted on labelled good
documents that are not toxic, and the raw text's, counted over all documents.  An n-gram is a word, a punctuation run, a pair of
them, or a mark for shouting or for words said over and over.  Each distinct text is counted once in both, so that copies weigh
no more than their original.  A document's log weight is the sum over its n-grams of the log ratio of target to raw, of either
sign.  Only n-grams whose labelled good and other documents differ by more than chance are modelled, so long clean texts
gather no noise; all others have a ratio of one.  Documents are then taken by Gumbel top-k: log weight over temperature plus
Gumbel noise, the k highest.  k is the number of documents whose log weight reaches ``CUT``; noise chooses among those near it.

The target and the choice of n-grams take about ``LABELLED`` labelled documents at most, chosen by hash; all else covers every
document: the texts are read once for the n-grams they hold, from which raw counts, weights and the k-th highest key come, and
once more as documents pass.  The k-th highest key comes exactly from repeated counts by range, not from a sort.  In a task texts are
taken apart many at a time, by the kinds of their bytes, and each different word among them is hashed once.

Defined results: a null text counts as empty and weighs 0; a null doc_id has the noise of the null hash;
repeated rows get the same key and are kept or left together; keys equal to the k-th are all kept; where labels
repeat a doc_id the worst counts, and null labels are left out; without labels every weight is 0 and all documents
stay; empty input gives no rows; further columns are kept by the filter and ignored by the query.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, texts_as_bytes, tidy, unused, written

#: N-grams that a counting task holds before it hands their counts on.
HELD = 1 << 21
LABELLED = 40_000
#: A ratio below one counts if it is so many deviations and so large a log away from chance; documents added to both counts.
DEVIATIONS, LEAST_LOG, PRIOR = 3.0, 1.0, 2.0
#: A ratio above one is at most raw over target documents, so it counts by its deviations alone.
RAISING = 5.0
#: Bad documents that an n-gram must tell by itself: at least so many, and such a share of them.
SUPPORT, SHARE = 4, 0.002
CUT = -1.0
#: Noise of about 0.6 in the log weight: it chooses among documents near the cut, and strong evidence stands.
TEMPERATURE = 0.5
SEED = 17

#: The kind of a byte: a token is a run of one kind.
OTHER, WORD, SPACE = 0, 1, 2
KIND = np.array([WORD if b >= 0x80 or re.match(rb"\w", bytes([b])) else SPACE if re.match(rb"\s", bytes([b])) else OTHER for b in range(256)], np.uint8)
SHOUTING, REPEATING, DOUBLING = 1, 2, 3
#: A word said once and so many times again is repeated.
RUN = 7
#: Bytes of texts that are taken apart at a time; a longer text is taken by itself.
PORTION = 1 << 20
#: Chosen n-grams are looked for by their first bits before they are looked up.
ROUGH = 20


def portions(texts: list[bytes], size: int = PORTION) -> Iterator[tuple[int, list[bytes]]]:
    """Texts that follow each other, of about so many bytes, with the number of the first."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > size:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, texts[start:]


def ngrams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of texts, repeats included, and the number of the text that each is from."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    kind = KIND[raw]
    cuts = np.r_[0, np.flatnonzero(kind[1:] != kind[:-1]) + 1, len(raw)]
    is_token = kind[cuts[:-1]] != SPACE
    offsets = np.r_[0, np.cumsum(np.diff(cuts)[is_token])].astype(np.int32)
    tokens = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw[kind != SPACE])]).dictionary_encode()
    words, which = tokens.dictionary.to_numpy(zero_copy_only=False), tokens.indices.to_numpy()
    h = np.array([xxhash.xxh64_intdigest(w.lower()) for w in words], np.uint64)[which]
    shouted = np.array([len(w) >= 3 and w.isalpha() and w.isupper() for w in words], bool)[which]

    sizes = np.diff(np.searchsorted(cuts[:-1][is_token], np.cumsum([0, *(len(t) + 1 for t in texts)])))
    of = np.repeat(np.arange(len(texts)), sizes)
    inside = of[1:] == of[:-1]
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ np.uint64(0x85EBCA77C2B2AE63)) * np.uint64(0xC2B2AE3D27D4EB4F)
    same = inside & (h[1:] == h[:-1])
    ends = np.r_[np.flatnonzero(~same), np.arange(len(h))[-1:]]

    shouts, doubles = np.bincount(of[shouted], minlength=len(texts)), np.bincount(of[1:][same], minlength=len(texts))
    shouting = np.flatnonzero((shouts >= 3) & (shouts * 10 >= sizes))
    repeating = np.unique(of[ends[np.diff(ends, prepend=-1) > RUN]])
    doubling = np.flatnonzero((doubles >= 3) & (doubles >= sizes / 5))
    marks = np.repeat(np.array([SHOUTING, REPEATING, DOUBLING], np.uint64), [len(shouting), len(repeating), len(doubling)])
    return np.r_[h, pairs[inside], marks], np.r_[of, of[1:][inside], shouting, repeating, doubling]


def ngrams(text: bytes) -> np.ndarray:
    """The hashed n-grams of a text, repeats included."""
    return ngrams_of([text])[0]


def different_ngrams(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The hashed n-grams of each text, sorted, each once."""
    for _, some in portions(texts):
        h, of = ngrams_of(some)
        order = np.argsort(of, kind="stable")
        yield from map(np.unique, np.split(h[order], np.cumsum(np.bincount(of, minlength=len(some)))[:-1]))


def labelled_documents(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(text, good), each once, of at most about ``most`` labelled documents; only the chosen labels are sent to all tasks."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    n = one.count()
    if n > most:
        one = one.filter(F.pmod(F.xxhash64("doc_id", F.lit("label")), F.lit(1 << 30)) < int((1 << 30) * most / n))
    chosen = one.select(F.col("doc_id").alias("_label_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_label_id")).select("text", "good").distinct()


def counted(held: list[np.ndarray], good: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of texts (each once a text), sorted; how many texts hold each, and how many good ones.  Empties both lists.

    Sorted in place and counted by ends, so that little more than the n-grams themselves is held at a time.
    """
    every = np.concatenate([np.zeros(0, np.uint64), *held])
    of_good = np.concatenate([np.zeros(0, np.uint64), *(x for x, ok in zip(held, good) if ok)])
    held.clear()
    good.clear()
    every.sort()
    of_good.sort()
    ends = np.flatnonzero(np.r_[every[1:] != every[:-1], np.ones(min(1, len(every)), bool)])
    h, n = every[ends], np.diff(ends, prepend=-1)
    return h, n, np.searchsorted(of_good, h, "right") - np.searchsorted(of_good, h)


def telling_ngrams(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[np.ndarray, np.ndarray, int]:
    """The n-grams by which good and other labelled documents differ (sorted hashes), how many good ones hold each, and their number."""
    sample = written(labelled_documents(docs, labels, most), "labelled")

    @tidy
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        good: list[bool] = []

        def out() -> Iterator[pa.RecordBatch]:
            h, n, ok = counted(held, good)
            for part in np.array_split(np.arange(len(h)), len(h) // 100_000 + 1):
                yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(n[part].astype(np.int32)), pa.array(ok[part].astype(np.int32))], names=["h", "n", "good"])

        size = 0
        for batch in it:
            for grams, ok in zip(different_ngrams(texts_as_bytes(batch, "text")), batch.column("good").to_pylist()):
                held.append(grams)
                good.append(ok)
                size += len(held[-1])
                if size >= HELD:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    size = sample.agg(F.count("*").alias("n"), F.coalesce(F.count_if("good"), F.lit(0)).alias("good")).first()
    if not 0 < size.good < size.n:
        return np.zeros(0, np.uint64), np.zeros(0), size.good
    share = size.good / size.n
    least = max(SUPPORT, SHARE * (size.n - size.good))
    sums = sample.mapInArrow(count, "h long, n int, good int").groupBy("h").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    away = (F.col("n") * share - F.col("good")) / F.sqrt(F.col("n") * share * (1 - share) + 1)
    ratio = F.log((F.col("good") + PRIOR * share) / (F.col("n") * share + PRIOR * share))
    lowering = (F.col("n") - F.col("good") >= least) & (away >= DEVIATIONS) & (ratio <= -LEAST_LOG)
    # Their number is bounded by the sample: each has so many of its documents.
    rows = sums.filter(lowering | (away <= -RAISING)).select("h", "good").collect()
    h = np.array([r.h for r in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r.good for r in rows], np.float64)[order], size.good


def holdings(docs: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, held) of all documents, written: the numbers of the chosen n-grams that each holds."""
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            of, numbers = held_by(texts_as_bytes(batch, "text"), sent.value)
            ends = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), held], names=["doc_id", "text_hash", "held"])

    text = F.col("text").cast("string")
    src = docs.select(F.col("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    return written(src.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, held array<int>"), "holdings")


def raw_counts(held: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """How many distinct texts hold each of n n-grams, and how many texts there are."""
    texts = held.groupBy("text_hash").agg(F.first("held").alias("held"))
    rows = texts.select(F.explode(F.concat("held", F.array(F.lit(n)))).alias("i")).groupBy("i").count().collect()
    counts = np.zeros(n + 1)
    for r in rows:
        counts[r.i] = r["count"]
    return counts[:n], int(counts[n])


def log_ratios(good: np.ndarray, of_good: int, raw: np.ndarray, of_raw: int) -> np.ndarray:
    """log of target over raw: the good documents that hold an n-gram over those that would if they were raw text, both with a prior."""
    expected = raw * (of_good / max(of_raw, 1))
    return np.log((good + PRIOR) / (expected + PRIOR))


def fitted(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """The modelled n-grams with their log ratios, and what each document holds of them."""
    chosen, good, of_good = telling_ngrams(docs, labels, most)
    held = holdings(docs, chosen)
    raw, of_raw = raw_counts(held, len(chosen))
    return (chosen, log_ratios(good, of_good, raw, of_raw)), held


def held_by(texts: list[bytes], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the chosen n-grams (sorted hashes) texts hold: the numbers of text and n-gram, sorted, each once."""
    n, first_bits = max(len(chosen), 1), np.uint64(64 - ROUGH)
    found = [np.zeros(0, np.int64)]
    rough = np.zeros(1 << ROUGH, bool)
    rough[chosen >> first_bits] = True
    for start, some in portions(texts) if len(chosen) else ():
        h, of = ngrams_of(some)
        near = np.flatnonzero(rough[h >> first_bits])
        h, of = h[near], of[near]
        at = np.minimum(np.searchsorted(chosen, h), n - 1)
        hit = chosen[at] == h
        found.append(np.unique((of[hit] + start) * n + at[hit]))
    return np.divmod(np.concatenate(found), n)


def summed(of: np.ndarray, numbers: np.ndarray, logs: np.ndarray, texts: int) -> np.ndarray:
    """For each text the sum of the logs of the n-grams that it holds, added in their order."""
    return np.bincount(of, weights=logs[numbers], minlength=texts).astype(np.float64)


def weights_of(texts: list[bytes], chosen: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """For each text the sum of the logs of the chosen n-grams that it holds."""
    return summed(*held_by(texts, chosen), logs, len(texts))


def weigh(text: bytes, chosen: np.ndarray, logs: np.ndarray) -> float:
    """The sum of the logs of the chosen n-grams that a text holds."""
    return float(weights_of([text], chosen, logs)[0])


def held_weight(held: DataFrame, logs: np.ndarray) -> DataFrame:
    """(doc_id, log_weight) from what documents hold; the same sums as weights_of() makes."""
    sent = held.sparkSession.sparkContext.broadcast(logs)

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            of, numbers = pc.list_parent_indices(batch.column(1)).to_numpy(), pc.list_flatten(batch.column(1)).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(summed(of, numbers, sent.value, batch.num_rows))], names=["doc_id", "log_weight"])

    return held.select("doc_id", "held").mapInArrow(run, f"doc_id {held.schema['doc_id'].dataType.simpleString()}, log_weight double")


def with_log_weight(docs: DataFrame, ratios: tuple[np.ndarray, np.ndarray], name: str = "log_weight", text: str = "text") -> DataFrame:
    """docs with another column: each document's log weight."""
    at, sent = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(ratios)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [x or b"" for x in batch.column(at).cast(pa.string()).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights_of(texts, *sent.value))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def gumbel(doc: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise fixed by the document's id."""
    u = (F.shiftrightunsigned(F.xxhash64(doc, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def resampling_key(log_weight: Column, doc: Column, temperature: float = TEMPERATURE, seed: int = SEED) -> Column:
    return log_weight / temperature + gumbel(doc, seed)


def kth_highest(keys: DataFrame, k: int, column: str = "key", ranges: int = 4096) -> float:
    """The k-th highest value exactly, by counts in ever finer ranges; -inf if there are no more than k."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0
    while low < high:
        width = (high - low) / ranges
        inside = keys.filter((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)))
        if width == 0 or low + width == low:
            values = inside.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc(column)).collect()
            groups = [(r[column], r[column], r.n) for r in values]
        else:
            rows = inside.groupBy(F.floor((F.col(column) - F.lit(low)) / F.lit(width)).alias("b")).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("n")).collect()
            groups = [(r.lo, r.hi, r.n) for r in sorted(rows, key=lambda r: -r.b)]
        for lo, hi, n in groups:
            if above + n >= k:
                low, high = lo, hi
                break
            above += n
    return low


def resample(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, k: int | None = None, keep_weight: bool = False) -> DataFrame:
    """The documents taken; with ``keep_weight`` also their log_weight and key.

    ``k``: how many; None for as many as reach CUT.  Weights for the k-th key come from the n-grams that documents hold, and
    are worked out once more as the documents pass, so that no text is shuffled.
    """
    name = unused(docs, "log_weight")
    ratios, held = fitted(docs, labels)
    weighed = with_log_weight(docs, ratios, name)
    key = resampling_key(F.col(name), F.col("doc_id"), temperature)
    keys = written(held_weight(held, ratios[1]).select("log_weight", resampling_key(F.col("log_weight"), F.col("doc_id"), temperature).alias("key")), "keys")
    if k is None:
        k = keys.filter(F.col("log_weight") >= CUT).count()
    kept = weighed.filter(key >= F.lit(kth_highest(keys, k)))
    return kept.select(*docs.columns, *([F.col(name).alias("log_weight"), key.alias("key")] if keep_weight else []))


def op4_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents taken from all, with their log weights and keys."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "labels"), keep_weight=True).select("doc_id", "log_weight", "key")


QUERIES = {"op4_quality_resampling": op4_quality_resampling}
SQL: dict[str, str] = {}

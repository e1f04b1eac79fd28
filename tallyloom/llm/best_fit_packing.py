"""Best-two-fit packing of token sequences.

Documents become token ids and an end id; only those longer than a sequence are cut.  What a packing does
depends on lengths alone, so it is worked out on the counts by length (at most ``capacity`` of them, whatever
the corpus): bins are filled greedily with the longest piece that fits; then, if that leaves a gap, the bin's
smallest piece gives way to the two unpacked pieces that fill the widened gap best, if they fill it better.
Equal bins come as one pattern with a number of times.  A piece finds its bin by its rank among the pieces of its
length; ranks come from counts by (length, bucket), and every written row has a number of its own that deals it to a
bucket, so no task sees all pieces of a common length or all copies of a row.

Special tokens' strings in a text are these tokens, as the tokenizer has them when asked plainly.

Defined results: a null text counts as empty and gives one piece, the end id; a null doc_id is kept as it is;
rows with the same doc_id are separate documents; empty input gives no rows; further columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, texts_as_bytes, tidy, unused, written

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Words in each of a worker's two generations of kept ids, and the longest kept.
CACHED, LONGEST = 800_000, 48
#: Bytes of text whose words are looked up together.
TOGETHER = 2 << 20
#: Pieces in one rank bucket of one length, about.
BUCKET_ROWS = 4_000


def vocabulary_path(name: str) -> str:
    """A file by its path, or by name among the public tokenizers."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def as_bytes(words: pa.Array) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class WordIds:
    """Ids of a text as little-endian bytes, equal to those of encoding it whole.

    What the tokenizer makes of a text never crosses an ASCII space: neither composition, nor special tokens (matched in
    raw text, without spaces), nor the pattern that cuts words.  So words are encoded one by one and kept.  ASCII
    capitals are lowered first unless the word may hold a special token, or a capital before a character that may
    compose with it (some compositions exist in lower case only).
    """

    def __init__(self, vocabulary: str, cached: int = CACHED):
        self.cached = cached
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if suffix and piece.endswith(suffix)]] = True
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        heads = "|".join(re.escape(x[:2]) for x in sorted({*specials, "<|"}))
        self.delicate_texts = heads + r"|[A-Z][\xcb-\xff]"
        self.delicate = re.compile(self.delicate_texts.encode()).search
        # Letters that the tokenizer itself keeps in one word with their neighbours and apart from stops and commas.
        cut = lambda t: [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(t))]
        plain = "".join(re.escape(c) for c in map(chr, range(0x41, 0x530)) if c.isalpha() and len(cut(f"a{c}a")) == 1 and cut(f"a{c}.")[1:] == ["."] and cut(f"{c},")[1:] == [","])
        self.letters = f"^[{plain}]+$"
        # Two generations: words not asked for while the young one fills up are forgotten.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def one_by_one(self, words: list[bytes]) -> list[bytes]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        raw = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        cuts = [0, *accumulate(4 * len(x) for x in ids)]
        return [raw[i:j] for i, j in zip(cuts, cuts[1:])]

    def together(self, words: list[bytes]) -> list[bytes]:
        """Words of plain letters only, many in one go: each ends with the one token that ends a word."""
        out: list[bytes] = []
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(part):  # a vocabulary without word ends
                out += self.one_by_one(part)
                continue
            raw, cuts = ids.tobytes(), [0, *cuts.tolist()]
            out += [raw[i:j] for i, j in zip(cuts, cuts[1:])]
        return out

    def encoded(self, words: pa.Array) -> list[bytes]:
        """Ids of different words that are not kept; stops and commas behind plain letters are words of their own."""
        stems = pc.utf8_rtrim(words, ".,")
        plain = pc.match_substring_regex(stems, self.letters)
        stems = pc.if_else(plain, stems, words)
        n = pc.binary_length(stems).to_numpy().tolist()
        words, stems, plain = as_bytes(words), as_bytes(stems), plain.to_numpy(zero_copy_only=False).tolist()
        stops = [w[at:] for w, at in zip(words, n)]
        found = {s: ids for s, stop in zip(stems, stops) if stop and (ids := self.kept(s)) is not None}
        new = list(dict.fromkeys(s for s, is_plain in zip(stems, plain) if is_plain and s not in found))
        found.update(zip(new, self.together(new)))
        new = [s for s, is_plain in zip(stems, plain) if not is_plain]
        found.update(zip(new, self.one_by_one(new)))
        behind = list(set(stops))
        behind = dict(zip(behind, self.one_by_one(behind)))
        self.keep((s, found[s]) for s, stop in zip(stems, stops) if stop)
        return [found[s] + behind[stop] if stop else found[s] for s, stop in zip(stems, stops)]

    def kept(self, word: bytes) -> bytes | None:
        return self.old.get(word) if (got := self.young.get(word)) is None else got

    def keep(self, found: Iterable[tuple[bytes, bytes]]) -> None:
        if len(self.young) > self.cached:
            self.young, self.old = {}, self.young
        self.young.update((w, ids) for w, ids in found if len(w) <= LONGEST)

    def lowered(self, texts: list[bytes]) -> pa.Array:
        """The texts with the capitals lowered that may be."""
        whole = pa.array(texts, pa.string())
        out = pc.ascii_lower(whole)
        delicate = pc.match_substring_regex(whole.cast(pa.binary()), self.delicate_texts)
        if not pc.any(delicate, min_count=0).as_py():
            return out
        mixed = [b" ".join(w if self.delicate(w) else w.lower() for w in texts[i].split()) for i in pc.indices_nonzero(delicate).to_pylist()]
        return pc.replace_with_mask(out, delicate, pa.array(mixed, pa.string()))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Words are numbered, so that each different word is looked up once, and its ids are copied to all its places."""
        split = pc.ascii_split_whitespace(self.lowered(texts))
        numbered = split.flatten().dictionary_encode()
        words = as_bytes(numbered.dictionary)
        found = list(map(self.young.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            for i in new:
                found[i] = self.old.get(words[i])
            unkept = [i for i in new if found[i] is None]
            for i, ids in zip(unkept, self.encoded(numbered.dictionary.take(pa.array(unkept, pa.int64())))):
                found[i] = ids
            self.keep((words[i], found[i]) for i in new)
        at = numbered.indices.to_numpy()
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(length) - length
        n = length[at]
        ends = np.r_[0, np.cumsum(n)]
        places = np.repeat(first[at] - ends[:-1], n)
        places += np.arange(ends[-1])
        raw = np.frombuffer(b"".join(found), "<u4")[places].tobytes()
        cuts = (ends[split.offsets.to_numpy()] * 4).tolist()
        return [raw[i:j] for i, j in zip(cuts, cuts[1:])]


_LOADED: dict[tuple[str, int], WordIds] = {}


def loaded(vocabulary: str, cached: int) -> WordIds:
    if (vocabulary, cached) not in _LOADED:
        _LOADED[vocabulary, cached] = WordIds(vocabulary, cached)
    return _LOADED[vocabulary, cached]


def encoded(words: WordIds, texts: list[bytes]) -> Iterator[bytes]:
    """Ids text by text, worked out for about ``TOGETHER`` bytes of text at a time."""
    held: list[bytes] = []
    n = 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n >= TOGETHER:
            yield from words.ids(held)
            held, n = [], 0
    yield from words.ids(held)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, cached: int = CACHED, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): ids are unsigned 32-bit little-endian, the end id included."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
    end = np.array([END_ID], "<u4").tobytes()

    @tidy
    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(vocabulary, cached)
        for batch in it:
            rows: list[tuple] = []
            held = 0
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(words, texts_as_bytes(batch, "text"))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), capacity * 4)):
                    part = ids[at : at + capacity * 4]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, part))
                held += len(ids)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    src = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(make, "doc_id long, piece int, start long, length long, ids binary")


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Counts by length to patterns (times, lengths of one bin)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"no bin holds a piece of length {length}")
        left[length] = n
    places = np.arange(capacity + 1)
    patterns = []
    while left.any():
        free, bin_, gap = left.copy(), [], capacity
        top = np.maximum.accumulate(np.where(free > 0, places, 0))
        at = gap
        while at > 0 and top[at] > 0:
            length = int(top[at])
            n = min(gap // length, int(free[length]))
            bin_ += [length] * n
            free[length] -= n
            gap -= n * length
            at = min(gap, length - 1)
        if gap:
            least = bin_[-1]
            wide = gap + least
            top = np.maximum.accumulate(np.where(free > 0, places, 0))
            a = np.flatnonzero(free[: wide + 1] > 0)
            a = a[a < wide]
            if len(a):
                b = top[wide - a]
                b = np.where((b == a) & (free[a] < 2), top[a - 1], b)
                total = np.where(b > 0, a + b, 0)
                best = int(total.argmax())
                if total[best] > least:
                    bin_[-1:] = [int(a[best]), int(b[best])]
        used = np.bincount(bin_, minlength=capacity + 1)
        on = used > 0
        times = int((left[on] // used[on]).min())
        left -= used * times
        patterns.append((times, sorted(bin_, reverse=True)))
    return patterns


def slots(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of this length in a bin, place in the bin), sorted."""
    rows, next_rank, sequence = [], {}, 0
    for times, lengths in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            n = lengths.count(length)
            rank = next_rank.get(length, 0)
            rows.append((length, rank, sequence, n, offset))
            next_rank[length] = rank + times * n
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (length and any other columns, none of these two names).

    The pieces are written once, each with a number of its own: it deals equal rows over buckets and orders them.
    """
    spark = pieces.sparkSession
    if clash := {"sequence_id", "offset"} & set(pieces.columns):
        raise ValueError(f"pieces have columns of the result's names: {sorted(clash)}")
    row, bucket, own, before, rank = (unused(pieces, x) for x in ("_row", "_bucket", "_own", "_before", "_rank"))
    numbered = written(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r.n for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # One row a length, so at most ``capacity`` of them go to all tasks.
    buckets = F.broadcast(spark.createDataFrame([(n, -(-c // BUCKET_ROWS)) for n, c in counts.items()], f"length long, {own} long"))
    plan = spark.sparkContext.broadcast(slots(best_two_fit(counts, capacity)))
    dealt = numbered.withColumn("length", F.col("length").cast("long")).join(buckets, "length").withColumn(bucket, F.pmod(F.xxhash64(row), F.col(own))).drop(own)
    earlier = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", bucket).agg(F.count("*").alias(own)).select("length", bucket, F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias(before))
    ranked = dealt.withColumn(own, F.row_number().over(Window.partitionBy("length", bucket).orderBy(row))).join(offsets, ["length", bucket])
    ranked = ranked.select(*(F.col(f.name).cast(f.dataType) for f in pieces.schema.fields), (F.col(before) + F.col(own) - 1).cast("long").alias(rank))
    kept = [f for f in pieces.schema.fields]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @tidy
    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        span = int(rows[:, 1].max(initial=0)) + 1
        for batch in it:
            length, nth = batch.column("length").to_numpy().astype(np.int64), batch.column(rank).to_numpy()
            # Ranks past the last slot's start still belong to it, so keys are bounded by the span.
            at = np.searchsorted(rows[:, 0] * span + rows[:, 1], length * span + np.minimum(nth, span - 1), side="right") - 1
            _, first, sequence, n, offset = rows[at].T
            nth = nth - first
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence + nth // n), pa.array(offset + nth % n * length)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, cached: int = CACHED) -> DataFrame:
    """Pieces with the digest of their ids, and their places in sequences.  ``cached`` trades memory for time only."""
    pieces = token_pieces(docs, capacity, vocabulary, cached).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces, capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
SQL: dict[str, str] = {}

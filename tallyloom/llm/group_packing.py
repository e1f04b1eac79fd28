"""First-fit decreasing with a tournament tree, run in random groups of documents.

Documents become token ids and an end id.  What fills a sequence by itself is cut off at once; the rests (shorter than a sequence) are
dealt to groups by a hash of their own row number, so that copies of a text and hot sources spread evenly, and a group has about
GROUP_TOKENS tokens and GROUP_ROWS rests at most, whatever the corpus.  In a group the rests go longest first into the first bin
with room: a tournament tree over the bins' free room has the largest room of both halves in each node, so the first bin is found,
and its path renewed, in as many steps as the tree is deep.

Bins of a full sequence or of a power of two need no padding.  The others are tightened: the emptiest are taken apart and fill the
gaps of the fullest, with whole pieces where these fit and a cut of one piece where none does.  Gaps of up to ``slack`` tokens stay.  What
the last bin holds is cut into sequences of powers of two, so at ``slack`` 0 nothing is padded at all.

Special tokens' strings in a text are these tokens, as the tokenizer has them when asked plainly.

Defined results: a null text counts as empty and gives one piece, the end id; a null doc_id is kept; rows with the same
doc_id are separate documents; empty input gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best_fit_packing import CACHED, VOCABULARY, encoded, loaded
from .common import batches, table, texts_as_bytes, tidy, written

CAPACITY, END_ID, SLACK = 2048, 1, 0
GROUP_TOKENS, GROUP_ROWS = 1 << 20, 50_000
#: Bytes of ids in a batch that leaves a task.
TOGETHER = 8 << 20
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
PLACED = pa.schema([*PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECE_DDL = "doc_id long, start long, length long, doc_tokens long, ids binary"

#: A part of a group's rest: its number, the first token in the rest, the length.
Part = tuple[int, int, int]


class FreeRoom:
    """A tournament tree over bins: every node has the largest free room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def take(self, length: int) -> int:
        """The first bin with room for ``length``, which it loses."""
        room, at = self.room, 1
        if room[1] < length:
            raise ValueError(f"no bin has room for {length}")
        while at < self.leaves:
            at *= 2
            if room[at] < length:
                at += 1
        found = at - self.leaves
        room[at] -= length
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return found


def first_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[list[Part]]:
    """Bins of whole rests; of equal lengths the earlier comes first."""
    # Two bins in a row hold more than one's capacity, so twice the least number is enough.
    tree = FreeRoom(2 * -(-sum(lengths) // capacity) + 1, capacity)
    bins: list[list[Part]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = tree.take(lengths[i])
        if at == len(bins):
            bins.append([])
        bins[at].append((i, 0, lengths[i]))
    return bins


def filled(parts: list[Part]) -> int:
    return sum(n for _, _, n in parts)


def unpadded(n: int, capacity: int) -> bool:
    return n == capacity or n & (n - 1) == 0


def cut_off(donor: list[Part], wanted: int) -> Part:
    """Takes from the donor its largest part of ``wanted`` tokens at most, or else so many of its smallest."""
    fits = [i for i, p in enumerate(donor) if p[2] <= wanted]
    if fits:
        return donor.pop(max(fits, key=lambda i: donor[i][2]))
    i = min(range(len(donor)), key=lambda i: donor[i][2])
    item, at, n = donor[i]
    donor[i] = (item, at + wanted, n - wanted)
    return (item, at, wanted)


def tightened(bins: list[list[Part]], capacity: int = CAPACITY, slack: int = SLACK) -> list[list[Part]]:
    """The bins with gaps of at most ``slack``, by cuts of as few parts as there are gaps."""
    gap = lambda b: 0 if unpadded(filled(b), capacity) else capacity - filled(b)
    done = [b for b in bins if gap(b) <= slack]
    rest = sorted((list(b) for b in bins if gap(b) > slack), key=filled, reverse=True)
    first = 0
    while first < len(rest) - 1:
        room = capacity - filled(rest[first])
        while room and len(rest) - 1 > first:
            part = cut_off(rest[-1], room)
            rest[first].append(part)
            room -= part[2]
            if not rest[-1]:
                rest.pop()
        if room:
            break
        done.append(rest[first])
        first += 1
    for last in rest[first:]:
        if gap(last) <= slack:
            done.append(last)
            continue
        left = filled(last)
        while left:
            size = 1 << (left.bit_length() - 1)
            sequence = []
            while wanted := size - filled(sequence):
                sequence.append(cut_off(last, wanted))
            done.append(sequence)
            left -= size
    return done


def token_rows(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID, cached: int = CACHED, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): every document cut into full sequences and a rest; ids are unsigned 32-bit little-endian."""
    end, width = np.array([end_id], "<u4").tobytes(), capacity * 4

    @tidy
    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(vocabulary, cached)
        for batch in it:
            rows: list[tuple] = []
            held = 0
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(words, texts_as_bytes(batch, "text"))):
                ids += end
                total = len(ids) // 4
                rows += [(doc_id, at // 4, min(capacity, total - at // 4), total, ids[at : at + width]) for at in range(0, len(ids), width)]
                held += len(ids)
                if held > TOGETHER:
                    yield from batches(iter(rows), PIECE)
                    rows, held = [], 0
            yield from batches(iter(rows), PIECE)

    src = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(make, PIECE_DDL)


def pack_groups(rows: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, group_tokens: int = GROUP_TOKENS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """token_rows() with sequence_id and offset, rests cut further where a gap is filled.  The rows are written once."""
    numbered = written(rows.withColumn("_row", F.monotonically_increasing_id()), "token-rows")
    rests = numbered.filter(F.col("length") < capacity)
    size = rests.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    groups = max(1, -(-size["tokens"] // group_tokens), -(-size["n"] // group_rows))
    full = numbered.filter(F.col("length") == capacity).select(*PIECE.names, (F.col("_row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("_row")
        doc_id, start, length, total, ids = (group.column(x).to_pylist() for x in PIECE.names)
        number = group.column("_group")[0].as_py()
        out = []
        for k, parts in enumerate(tightened(first_fit_decreasing(length, capacity), capacity, slack)):
            offset = 0
            for i, at, n in parts:
                out.append((doc_id[i], start[i] + at, n, total[i], ids[i][at * 4 : (at + n) * 4], (number << 32 | k) * 2 + 1, offset))
                offset += n
        return pa.Table.from_batches(batches(iter(out), PLACED), PLACED)

    dealt = rests.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    return full.unionByName(dealt.groupBy("_group").applyInArrow(pack, f"{PIECE_DDL}, sequence_id long, offset long"))


def op12_group_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    placed = pack_groups(token_rows(table(spark, sf_dir, "documents")))
    return placed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op12_group_packing": op12_group_packing}
SQL: dict[str, str] = {}

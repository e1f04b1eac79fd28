"""SimHash near-duplicates: fingerprints, BK-trees by shard, components.

Fingerprints of every document are made in one pass.  Of ``radius + 2`` bands, two fingerprints that differ in at most
``radius`` bits agree in at least two, so every shard holds the fingerprints with one pair of band values (26 of 64 bits) and no
link crosses all shards.  A shard of too many fingerprints is dealt over cells, one for each pair of its parts.  In each cell a BK-tree is built (children keyed by their Hamming distance to the
parent) and searched following only edges within the radius.  The trees grow with the data, so they are not
sent to all executors: they are built where the shuffle brings their shard, and only spanning links leave.
Equal fingerprints are one node, and a subtree that lies wholly in the searcher's component is passed over, so
large groups of copies cost little and no list of their pairs is made.

Defined results: a null text counts as empty; without words the fingerprint is zero; rows with a null doc_id
take no part in links and get a null component; repeated rows get the same class; empty input gives no rows;
further columns are ignored by the query and kept by the stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_one, table, texts_as_bytes, tidy, unused, written
from .components import connected_components

SEED = 42
CHUNK = 1 << 15
#: Similarity that links in similar_classes(); with four lanes 39 bits differ at it (deviation under 6).
SIMILAR = 0.8
#: Bits that may differ in a candidate, bits that do at the similarity, the chance that bands miss such a pair, and nodes in a shard.
RADIUS_256, DIFFER, MISS, NEAR_SHARD = 58, 39, 1e-4, 256
#: Lanes and radius of the longer fingerprints that tell which candidates are compared by their shingles: at the similarity
#: some 153 bits of 1024 differ (deviation 10), so fewer true links are lost than by the radius of 256 bits.
WIDE_LANES, WIDE_RADIUS = 16, 192
#: Pairs whose distance is worked out at once.
PAIRS = 1 << 18
#: Rows of whole shards that are searched together, and rows of a shard or cell.
SHARD_ROWS, CELL_ROWS = 60_000, 200_000
#: Rows of a shard or cell in which all pairs are compared, and shingle sets and their bytes in a block.
NEAR_CELL, BLOCK_SETS, BLOCK_BYTES = 20_000, 1000, 1 << 23
#: Large shards that are sent to all tasks, 16 bytes each; beyond that a join finds them.
SENT_SHARDS = 1_000_000
#: Neighbours of a fingerprint that are confirmed first: enough that a large group of near copies becomes one before all candidates are.
NEAREST = 12


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of every run of k words (all words, if fewer), joined by one space; repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    whole = b" ".join(words)
    if len(words) <= k:
        return np.array([h(whole, SEED)], np.uint64)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    return np.array([h(whole[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :])], np.uint64)


def mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits of a hash; lane 0 is the hash itself."""
    if not lane:
        return h
    x = h + np.uint64((lane * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: bytes, k: int, lanes: int = 1, once: bool = False) -> bytes:
    """Big-endian bits; bit i is 1 if it is set in over half of the hashes, each counted ``once`` or as often as it comes."""
    h = shingle_hashes(text.lower().split(), k)
    if once:
        h = np.unique(h)
    out = b""
    for lane in range(lanes):
        votes = np.zeros(64, np.int64)
        for at in range(0, len(h), CHUNK):
            part = mixed(h[at : at + CHUNK], lane).astype(">u8")
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out += np.packbits(votes * 2 > len(h)).tobytes()
    return out


def text_hash(text: Column) -> Column:
    """With the doc_id it tells rows apart whose doc_id is repeated."""
    return F.xxhash64(text.cast("string"))


def fingerprints(docs: DataFrame, k: int, lanes: int = 1, doc: str = "doc_id", text: str = "text", once: bool = False) -> DataFrame:
    """(doc_id, text_hash, fp): fp is 8 bytes a lane."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.binary())])

    @tidy
    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = [fingerprint(t, k, lanes, once) for t in texts_as_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary())], schema=schema)

    src = docs.select(F.col(doc).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(make, "doc_id long, text_hash long, fp binary")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """One BK-tree for each shard, built and searched level by level for all shards together."""

    def __init__(self, shard: np.ndarray, points: np.ndarray):
        """``shard``: sorted shard numbers; ``points``: (n, lanes) of uint64, distinct within a shard."""
        self.points, n = points, len(points)
        self.span = points.shape[1] * 64 + 1
        parent = np.full(n, -1, np.int64)
        edge = np.zeros(n, np.int64)
        self.levels: list[np.ndarray] = []
        rest, group = np.arange(n), shard.astype(np.int64)
        self.root = np.zeros(n, np.int64)
        while len(rest):
            first = np.r_[True, group[1:] != group[:-1]]
            head = rest[first][np.cumsum(first) - 1]
            if not self.levels:
                self.root[rest] = head
            self.levels.append(rest[first])
            rest, head = rest[~first], head[~first]
            d = distance(points[rest], points[head])
            order = np.lexsort((rest, d, head))
            rest, head, d = rest[order], head[order], d[order]
            parent[rest], edge[rest] = head, d
            group = head * self.span + d
        # The last parent and edge given to a point are those of its place in the tree.
        self.parent = parent
        inner = np.flatnonzero(parent >= 0)
        key = parent[inner] * self.span + edge[inner]
        order = np.argsort(key, kind="stable")
        self.child, self.key = inner[order], key[order]

    def link(self, label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the classes of a and b in ``label`` (each entry: a smaller or the same place)."""
        while True:
            la, lb = label[a], label[b]
            m = la != lb
            if not m.any():
                return
            a, b, la, lb = a[m], b[m], la[m], lb[m]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while not np.array_equal(up := label[label], label):
                label[:] = up

    def classes(self, radius: int) -> np.ndarray:
        """For each point the first point of its class: the component of links within the radius."""
        n = len(self.points)
        label = np.arange(n)
        # Cheap links first: neighbours in a few sorted orders, within shards.
        for turn in range(0, 64, 8):
            rolled = (self.points << np.uint64(turn)) | (self.points >> np.uint64((64 - turn) % 64)) if turn else self.points
            order = np.lexsort((*rolled.T[::-1], self.root))
            a, b = order[1:], order[:-1]
            near = (self.root[a] == self.root[b]) & (distance(self.points[a], self.points[b]) <= radius)
            self.link(label, a[near], b[near])
        size = np.bincount(self.root, minlength=n)[self.root]
        # Points alone in a shard have nothing to find.
        todo = np.flatnonzero(size > 1)
        at, step = 0, 64
        while at < len(todo):
            batch = todo[at : at + step]
            at += step
            step = min(step * 2, max(64, 2_000_000 // int(size[batch].max())))
            low, high = label.copy(), label.copy()
            for level in self.levels[:0:-1]:
                np.minimum.at(low, self.parent[level], low[level])
                np.maximum.at(high, self.parent[level], high[level])
            one = low == high
            query, node = batch, self.root[batch]
            while len(query):
                skip = one[node] & (low[node] == label[query])
                query, node = query[~skip], node[~skip]
                d = distance(self.points[query], self.points[node])
                near = (d <= radius) & (query != node)
                found = (query[near], node[near])
                lo = np.searchsorted(self.key, node * self.span + np.maximum(d - radius, 0))
                hi = np.searchsorted(self.key, node * self.span + np.minimum(d + radius, self.span - 1), side="right")
                count = hi - lo
                query = np.repeat(query, count)
                skips = np.cumsum(count) - count
                node = self.child[np.repeat(lo - skips, count) + np.arange(len(query))]
                self.link(label, *found)
        return label


def band_keys(points: np.ndarray, bands: list[list[int]]) -> np.ndarray:
    """(n, bands): the number of the band, then its bits."""
    out = np.zeros((len(points), len(bands)), np.int64)
    for b, bits in enumerate(bands):
        for i in bits:
            out[:, b] = out[:, b] << 1 | ((points[:, i // 64] >> np.uint64(63 - i % 64)) & np.uint64(1)).astype(np.int64)
        out[:, b] |= b << 40
    return out


def as_points(fps: pa.Array) -> np.ndarray:
    rows = fps.to_pylist()
    return np.frombuffer(b"".join(rows), ">u8").astype(np.uint64).reshape(len(rows), -1)


def exact_bands(bits: int, radius: int, together: int = 2) -> list[list[int]]:
    """All sets of ``together`` of radius + together bands that share out the bits: links within the radius agree in one set."""
    n = radius + together
    bands = [range(bits * b // n, bits * (b + 1) // n) for b in range(n)]
    return [[i for band in some for i in band] for some in combinations(bands, together)]


def candidate_bands(nodes: int, bits: int = 256) -> list[list[int]]:
    """Bands for candidates among so many nodes: they grow wider with the nodes, so that shards do not grow, and as many more
    as keep the chance that a pair at the similarity agrees in none below MISS."""
    width = max(12, int(np.ceil(np.log2(max(nodes, 1) / NEAR_SHARD))))
    agree = (1 - DIFFER / bits) ** width
    rounds = -(-int(np.ceil(np.log(MISS) / np.log(1 - agree))) // (bits // width))
    orders = np.random.default_rng(5).permuted(np.tile(np.arange(bits), (rounds, 1)), axis=1)
    return [order[at : at + width].tolist() for order in orders for at in range(0, bits - width + 1, width)]


def spanning_links(nodes: DataFrame, radius: int, bands: list[list[int]]) -> DataFrame:
    """``nodes`` (fp, distinct) to links (u, v) that span, in every shard, the classes of links within the radius."""

    @tidy
    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                fps = batch.column(0)
                keys = band_keys(as_points(fps), bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.T.ravel()), pa.concat_arrays([fps] * len(bands))], names=["shard", "fp"])

    def search(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        fps = t.column("fp").combine_chunks()
        fps = fps if isinstance(fps, pa.Array) else pa.concat_arrays(fps.chunks)
        shard = t.column("shard").to_numpy()
        label = Forest(np.cumsum(np.r_[0, shard[1:] != shard[:-1]]), as_points(fps)).classes(radius)
        u = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([fps.take(pa.array(u)), fps.take(pa.array(label[u]))], names=["u", "v"])

    @tidy
    def by_shard(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole shards together; rows come sorted by shard."""
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in it:
            if not batch.num_rows:
                continue
            shard = batch.column(0).to_numpy()
            cut = int(np.searchsorted(shard, shard[-1]))
            if n and n + cut >= SHARD_ROWS and (cut or held[-1].column(0)[-1].as_py() != shard[0]):
                yield search([*held, batch.slice(0, cut)] if cut else held)
                held, n, batch = [], 0, batch.slice(cut)
            held.append(batch)
            n += batch.num_rows
        if held:
            yield search(held)

    shards = in_cells(nodes.mapInArrow(keyed, "shard long, fp binary"), "shard", "fp")
    return shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(by_shard, "u binary, v binary")


def in_cells(rows: DataFrame, shard: str, fp: str, most: int = 0) -> DataFrame:
    """Rows of a shard larger than ``most`` are dealt to g parts by hash and go to the g cells of pairs of parts that theirs is in.

    Each pair of rows meets in a cell and no cell holds more than about ``most``; other shards stay as they are.  Shard numbers
    of cells are hashes: two that are equal only search more together than they must.
    """
    most = most or CELL_ROWS
    large = rows.groupBy(shard).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(shard, F.ceil(F.col("_n") * 2 / most).cast("int").alias("_g"))
    part = F.pmod(F.xxhash64(fp), F.col("_g"))
    cells = F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda i: F.xxhash64(F.col(shard), F.least(i, part), F.greatest(i, part)))
    dealt = rows.join(large, shard, "left").withColumn("_cell", F.explode(F.when(F.col("_g").isNull(), F.array(F.col(shard))).otherwise(cells)))
    return dealt.withColumn(shard, F.col("_cell")).drop("_g", "_cell")


def above(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether point a is higher than point b, lane by lane."""
    out = np.zeros(len(a), bool)
    for lane in range(a.shape[1] - 1, -1, -1):
        out = (a[:, lane] > b[:, lane]) | ((a[:, lane] == b[:, lane]) & out)
    return out


def first_band(a: np.ndarray, b: np.ndarray, bands: list[list[int]]) -> np.ndarray:
    """The first band in which the points agree; that of one of them is given, so there is one."""
    masks = np.zeros((len(bands), a.shape[1]), np.uint64)
    for at, bits in enumerate(bands):
        for i in bits:
            masks[at, i // 64] |= np.uint64(1) << np.uint64(63 - i % 64)
    differ = a ^ b
    out = np.full(len(a), len(bands), np.int64)
    for at in range(len(bands) - 1, -1, -1):
        out[~(differ & masks[at]).any(axis=1)] = at
    return out


def numbered_bands(batch: pa.RecordBatch, bands: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The points of a batch (fp first) and their shard numbers, all points by the first band, then by the next."""
    points = as_points(batch.column(0))
    return points, band_keys(points, bands).T.ravel()


def large_shards(nodes: DataFrame, bands: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Shards of more than ``most`` of the nodes (fp), sorted, and into how many parts each is dealt; None if they are too many to be sent out.

    Each has more than ``most`` rows, so they are fewer than a ``most``-th of all rows.
    """

    @tidy
    def numbers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                number, n = np.unique(numbered_bands(batch, bands)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(n.astype(np.int64))], names=["shard", "n"])

    counts = nodes.select("fp").mapInArrow(numbers, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).filter(F.col("n") > most)
    found = counts.select("shard", F.ceil(F.col("n") * 2 / most).cast("long").alias("g")).limit(SENT_SHARDS + 1).collect()
    if len(found) > SENT_SHARDS:
        return None
    found = sorted((r.shard, r.g) for r in found)
    return np.array([x for x, _ in found], np.int64), np.array([g for _, g in found], np.int64)


def cells_of(shard: np.ndarray, points: np.ndarray, large: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, number): where each row goes: to its shard, or to the cells of pairs of parts that its part of a large shard is in.

    ``shard`` has all points band by band.  Numbers of cells are hashes, told from those of shards by the sign; equal ones only search more together than
    they must.
    """
    numbers, parts = large
    rows = np.arange(len(shard))
    at = np.minimum(np.searchsorted(numbers, shard), max(len(numbers) - 1, 0))
    hit = numbers[at] == shard if len(numbers) else np.zeros(len(shard), bool)
    if not hit.any():
        return rows, shard
    own = np.zeros(len(points), np.uint64)
    for lane in points.T:
        own = mixed(own ^ lane, 1)
    g = parts[at[hit]]
    row = np.repeat(rows[hit], g)
    each = np.repeat(g, g)
    other = np.arange(len(row)) - np.repeat(np.cumsum(g) - g, g)
    part = (own[row % len(points)] % each.astype(np.uint64)).astype(np.int64)
    pair = (np.minimum(part, other) << 32 | np.maximum(part, other)).astype(np.uint64)
    cell = mixed(mixed(shard[row].astype(np.uint64), 2) ^ pair, 3).astype(np.int64) | np.int64(-(2**63))
    return np.concatenate([rows[~hit], row]), np.concatenate([shard[~hit], cell])


def near_pairs(nodes: DataFrame, radius: int, bands: list[list[int]], want: str, large: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``nodes`` (fp distinct, root long) to what is wanted of pairs of different roots that share a band and differ in ``radius`` bits at most.

    ``want``: "nearest" of the neighbours in a few sorted orders, NEAREST of each u (u, v, d); "marks", the fingerprints that have
    such a pair at all (fp); "pairs", every pair, once (u, v).  Pairs are named by their first 256 bits, of which bands are made.
    ``large``: large_shards() of the nodes, whose rows go to their cells as they are made, so that they are shuffled once; without them they are found by a join.
    """
    nearest, marks = want == "nearest", want == "marks"
    sent = nodes.sparkSession.sparkContext.broadcast(large)

    @tidy
    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                points, shard = numbered_bands(batch, bands)
                row, number = (np.arange(len(shard)), shard) if sent.value is None else cells_of(shard, points, sent.value)
                place = pa.array(row % batch.num_rows)
                band = (row // batch.num_rows).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(band), *(c.take(place) for c in batch.columns)], names=["shard", "band", "fp", "root"])

    def pairs(shard: np.ndarray, root: np.ndarray, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (a, b) to compare; rows are sorted by shard and root."""
        if nearest:
            for turn in range(8):
                lane = points[:, turn % points.shape[1]]
                rolled = (lane << np.uint64(32)) | (lane >> np.uint64(32)) if turn >= 4 else lane
                order = np.lexsort((rolled, shard))
                same = shard[order[1:]] == shard[order[:-1]]
                yield order[1:][same], order[:-1][same]
            return
        new = np.r_[True, shard[1:] != shard[:-1]]
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        run = np.r_[True, new[1:] | (root[1:] != root[:-1])]
        # Each row meets the rows of its shard before those of its own root.
        count = np.flatnonzero(run)[np.cumsum(run) - 1] - start
        rows = np.flatnonzero(count)
        until = np.cumsum(count[rows])
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + PAIRS)))
            these = rows[at:to]
            c = count[these]
            yield np.repeat(these, c), np.repeat(start[these] - np.cumsum(c) + c, c) + np.arange(c.sum())
            at = to

    def search(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        fps, points = t.column("fp").chunk(0), as_points(t.column("fp").chunk(0))
        band = t.column("band").to_numpy()
        found, marked = [], np.zeros(len(points), bool)
        for a, b in pairs(t.column("shard").to_numpy(), t.column("root").to_numpy(), points):
            d = distance(points[a], points[b])
            near = (d <= radius) & (d > 0)
            a, b, d = a[near], b[near], d[near]
            high = above(points[a], points[b])
            u, v = np.where(high, a, b), np.where(high, b, a)
            if nearest:
                found.append((u, v, d))
                continue
            if marks:
                marked[u] = marked[v] = True
                continue
            # A pair that shares several bands is told by the first of them.
            once = first_band(points[u], points[v], bands) == band[u]
            yield from told(fps, u[once], v[once])
        if nearest and found:
            u, v, d = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((d, u))
            order = order[np.r_[True, u[order[1:]] != u[order[:-1]]]] if len(order) else order
            yield from told(fps, u[order], v[order], d[order])
        if marks and marked.any():
            yield pa.RecordBatch.from_arrays([pc.unique(fps.filter(pa.array(marked)))], names=["fp"])

    def told(fps: pa.Array, u: np.ndarray, v: np.ndarray, *d: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(u):
            names = [pc.binary_slice(fps.take(pa.array(x)), 0, 32) for x in (u, v)]
            yield pa.RecordBatch.from_arrays([*names, *(pa.array(x.astype(np.int32)) for x in d)], names=["u", "v", "d"][: 2 + len(d)])

    @tidy
    def by_shard(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole shards together; rows come sorted by shard."""
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in it:
            if not batch.num_rows:
                continue
            shard = batch.column(0).to_numpy()
            cut = int(np.searchsorted(shard, shard[-1]))
            if n and n + cut >= SHARD_ROWS and (cut or held[-1].column(0)[-1].as_py() != shard[0]):
                yield from search([*held, batch.slice(0, cut)] if cut else held)
                held, n, batch = [], 0, batch.slice(cut)
            held.append(batch)
            n += batch.num_rows
        if held:
            yield from search(held)

    shards = nodes.select("fp", "root").mapInArrow(keyed, "shard long, band int, fp binary, root long")
    if large is None:
        shards = in_cells(shards, "shard", "fp", NEAR_CELL)
    schema = {"nearest": "u binary, v binary, d int", "marks": "fp binary", "pairs": "u binary, v binary"}[want]
    found = shards.repartition("shard").sortWithinPartitions("shard", "root").mapInArrow(by_shard, schema)
    if nearest:
        order = Window.partitionBy("u").orderBy("d", "v")
        return found.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= NEAREST).drop("n")
    return found.distinct()


def both_ends(pairs: DataFrame, *by: str) -> DataFrame:
    """The distinct fingerprints (``by``, fp) of pairs; each end is made distinct before they meet."""
    ends = [pairs.select(*by, F.col(x).alias("fp")).distinct() for x in ("u", "v")]
    return ends[0].unionByName(ends[1]).distinct()


def shingle_sets(some: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, doc: str, text: str) -> DataFrame:
    """(fp, wide, s) of some nodes (fp distinct): the longer fingerprint and the shingle set of one text of each, as a written table."""
    ids = some.join(nodes, "fp").select(F.col("least").alias("_id")).distinct()

    @tidy
    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for t in texts_as_bytes(batch, "text"):
                wide = fingerprint(t, k, WIDE_LANES, once=True)
                shingles = np.unique(shingle_hashes(t.lower().split(), k)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (wide[:32], wide, shingles)], names=["fp", "wide", "s"])

    texts = docs.select(F.col(doc).cast("long").alias("_id"), F.col(text).cast("string").alias("text")).join(ids, "_id", "left_semi").select("text")
    # Equal fingerprints are one node, so one text stands for each.
    first = F.min(F.struct("wide", "s")).alias("x")
    return written(texts.mapInArrow(make, "fp binary, wide binary, s binary").groupBy("fp").agg(first).select("fp", "x.wide", "x.s"), "shingles")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of fingerprints whose texts have a Jaccard similarity of SIMILAR or more over their k-word shingles.

    ``sets``: shingle_sets() of all that are in pairs.  Fingerprints are dealt to blocks; a pair goes to the cell of its two
    blocks, and a shingle set once to each cell that has a pair of it, not once a pair.  Blocks are so many that the sets of a
    cell stay within BLOCK_SETS and BLOCK_BYTES on average.
    """

    @tidy
    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell, in each the sets (u, s) before the pairs (u, v)."""
        cell, sets = None, {}
        for batch in it:
            keep = []
            for c, u, v, s in zip(*(batch.column(x).to_pylist() for x in ("cell", "u", "v", "s"))):
                if c != cell:
                    cell, sets = c, {}
                if v is None:
                    sets[u] = frozenset(np.frombuffer(s, np.uint64).tolist())
                    keep.append(False)
                    continue
                x, y = sets[u], sets[v]
                near = min(len(x), len(y)) >= SIMILAR * max(len(x), len(y))
                both = len(x & y) if near else 0
                keep.append(near and both >= SIMILAR * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    total = sets.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("s")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-total["n"] // BLOCK_SETS), -(-total["b"] // BLOCK_BYTES))
    of = [F.pmod(F.xxhash64(x), F.lit(blocks)) for x in ("u", "v")]
    dealt = pairs.select((F.least(*of) * blocks + F.greatest(*of)).alias("cell"), "u", "v")
    wanted = both_ends(dealt, "cell")
    given = wanted.join(sets, "fp").select("cell", F.col("fp").alias("u"), F.lit(None).cast("binary").alias("v"), "s")
    rows = given.unionByName(dealt.withColumn("s", F.lit(None).cast("binary")))
    cells = rows.repartition("cell").sortWithinPartitions("cell", F.col("v").isNotNull())
    return written(cells.mapInArrow(judge, "u binary, v binary"), "confirmed")


def with_components(fps: DataFrame, nodes: DataFrame, stars: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, first_hash) from the first row of each node and the stars (fp, root) of linked nodes."""
    rooted = written(nodes.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    # Only nodes in components of several need another first row.
    low = stars.select("root").distinct().join(rooted, "root").groupBy("root").agg(F.min(F.struct("least", "least_hash")).alias("low"))
    of_node = join_one(rooted, low, "root", "left").select("fp", F.coalesce("low", F.struct("least", "least_hash")).alias("low"))
    got = join_one(fps, of_node, "fp", "left")
    named = F.col("doc_id").isNotNull()
    return got.select("doc_id", "text_hash", "fp", F.when(named, F.col("low.least")).alias("component_id"), F.when(named, F.col("low.least_hash")).alias("first_hash"))


def nodes_of(fps: DataFrame) -> DataFrame:
    """(fp, least, least_hash): the first row of each fingerprint."""
    first = F.min(F.struct("doc_id", "text_hash"))
    return written(fps.filter(F.col("doc_id").isNotNull()).groupBy("fp").agg(first.alias("x")).select("fp", F.col("x.doc_id").alias("least"), F.col("x.text_hash").alias("least_hash")), "nodes")


def stars_of(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("u").alias("fp"), F.col("v").alias("root"))


def simhash_classes(docs: DataFrame, k: int = 3, radius: int = 3, lanes: int = 1, bands: list[list[int]] | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, component_id, first_hash): the least doc_id reachable over fingerprints within the radius.

    ``bands``: the sets of bits by which shards are made; by default exact_bands(), which loses no link.
    """
    fps = written(fingerprints(docs, k, lanes, doc, text), "fingerprints")
    nodes = nodes_of(fps)
    links = spanning_links(nodes.select("fp"), radius, bands or exact_bands(64 * lanes, radius))
    return with_components(fps, nodes, stars_of(links))


def similar_classes(docs: DataFrame, k: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Classes of documents linked by k-word shingle sets that are similar to 0.8 or more (Jaccard, exact).

    Fingerprints of 256 bits only find candidates: pairs within a wide radius that agree in one of many bands.  As links are told by sets,
    every shingle votes once, however often a text repeats it.
    Each link is then confirmed on the shingles themselves.  First each node's nearest neighbours are tried, so that groups of copies
    become one; then all candidates between different groups, so that none is left out: those that 256 bits let through
    are held against each other by longer fingerprints, and by their shingles if these are within a radius too.
    """
    fps = written(fingerprints(docs, k, 4, doc, text, once=True), "fingerprints")
    nodes = nodes_of(fps)
    bands = candidate_bands(nodes.count())
    large = large_shards(nodes, bands, NEAR_CELL)
    first = written(near_pairs(nodes.withColumn("root", F.xxhash64("fp")), RADIUS_256, bands, "nearest", large), "nearest")
    sure = confirmed(first, shingle_sets(both_ends(first), nodes, docs, k, doc, text))
    rooted = written(nodes.join(stars_of(sure), "fp", "left").select("fp", F.xxhash64(F.coalesce("root", "fp")).alias("root")), "known")
    marked = written(near_pairs(rooted, RADIUS_256, bands, "marks", large), "marked")
    sets = shingle_sets(marked, nodes, docs, k, doc, text)
    wide = written(sets.join(rooted, "fp").select(F.col("wide").alias("fp"), "root"), "wide")
    rest = near_pairs(wide, WIDE_RADIUS, bands, "pairs", large_shards(wide, bands, NEAR_CELL)).join(first, ["u", "v"], "left_anti")
    more = confirmed(written(rest, "candidates"), sets)
    return with_components(fps, nodes, stars_of(sure.unionByName(more)))


def keep_one(docs: DataFrame, classes: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without all but the first of each class (least doc_id, then least text hash); rows without id stay.

    Rows are told apart by doc_id and text, so a row goes only if its own text is in the class of an earlier one.  Of rows
    equal in both, one stays.
    """
    hashed = unused(docs, "_text_hash")
    marked = docs.withColumn(hashed, text_hash(F.col(text)))
    rows = classes.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "component_id", "first_hash")
    first = (F.col("_d") == F.col("component_id")) & (F.col("_h") == F.col("first_hash"))
    mine = (F.col(doc).cast("long") == F.col("_d")) & (F.col(hashed) == F.col("_h"))
    kept = marked.join(rows.filter(~first).select("_d", "_h").distinct(), mine, "left_anti")
    again = written(rows.filter(first).groupBy("_d", "_h").agg(F.count("*").alias("n")).filter("n > 1"), "again")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(again, mine, "left_semi").dropDuplicates([doc, hashed])
    return kept.join(again, mine, "left_anti").unionByName(once).select(*docs.columns)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words, 64 bits, links at three or fewer differing bits, over all documents."""
    found = simhash_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash_dedup": op9_simhash_dedup}
SQL: dict[str, str] = {}

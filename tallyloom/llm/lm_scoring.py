"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

Tokens are ASCII-lower-cased words and one end a text.  The training tokens are counted exactly.  The model's
symbols are the end, the most frequent words, and groups of all other words by their last bytes; symbols of
like frequency form a class.  With weights for hashed n-gram and skip features of the symbols before it,

    P(token) = P(class | features) * P(symbol | class, features) * P(word | symbol)

where the last factor is 1 for a frequent word and (c + 0.1) / (n + 0.1 * (v + 1)) inside a group of n tokens and v
words; as in the base score, all words that training has not seen are one event there.  So the
probabilities of the events sum to one.

Weights start from the unigram model and are trained by gradient updates in one pass over all training documents, which
are shared out to rounds (each document is learnt from once): shards of a round each take AdaGrad steps over their own documents
from the same weights, and the changes are averaged by how often each weight moved.  Changes meet in two steps, both by block of weights: first those of
about as many shards as the root of their number, then these sums, so no task gets a block's changes from all shards, nor all blocks.

What is learnt grows with the training tokens N: symbols are the square of a side of about 32 * (N / 2^24)^(1/12), the rows
for pairs of symbols grow with the cube root of N, those within classes with the side; the counts of words are whole.  Counts of
frequent words (a bounded number) go to all tasks; the rest of each text's words meet their counts in a join.

Defined results: a null text counts as empty (its end is scored); rows with a null doc_id have no remainder and are
held out, with held_out true; repeated rows are each scored and each learned from; without training documents
all counts are zero; empty input gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts_as_bytes, written

#: Classes, and symbols in a class, and rows of hashed weights for pairs of symbols, at so many training tokens or fewer.
SIDE, PAIRS, FROM = 32, 4096, 1 << 24
#: Words whose counts go to all tasks, at most.
HEAD = 1 << 18
#: Tokens of one training shard, about and at least (and so many for each weight), and rounds.
SHARD_TOKENS, TOKENS_A_WEIGHT, ROUNDS = 1 << 22, 2, 2
STEP, RATE = 8192, 0.15
#: Distinct words a counting task holds before it hands them on.
HELD = 300_000
END = b""


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def is_training(doc: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc.cast("string"), "UTF-8")) % 10 != 0, F.lit(False))


def token_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over a frame's text column; the end is the empty word."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], schema=schema)

        for batch in it:
            for text in texts_as_bytes(batch, "text"):
                held.update(words_of(text))
                if len(held) > HELD:
                    yield out()
                    held.clear()
            held[END] += batch.num_rows
        if held:
            yield out()

    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word binary, c long")
    return parts.filter("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


def head_counts(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """All words at or above the least count that no more than ``most`` words reach, most frequent first."""
    size = F.floor(F.log2("c") * 16)
    levels = counts.groupBy(size.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("low")).orderBy(F.desc("level")).collect()
    total, low = 0, None
    for r in levels:
        total += r.n
        if total > most:
            break
        low = r.low
    if low is None:
        return []
    rows = counts.filter(F.col("c") >= low).collect()
    return sorted(((bytes(r.word), r.c) for r in rows), key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """Symbols, their classes, and the counts of frequent words."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        more = max(1.0, total / FROM)
        self.side = SIDE // 8 * round(8 * more ** (1 / 12))
        self.pairs = PAIRS << int(np.ceil(np.log2(more) / 3))
        size = self.side**2
        # Groups of infrequent words: by frequent endings, then by hash.
        self.n_endings, self.n_hashed = size * 7 // 64, size // 64
        groups = self.n_endings + self.n_hashed
        frequent = [w for w, _ in head if w != END][: size - groups - 1]
        chosen = set(frequent)
        rest = Counter()
        for w, c in head:
            if w != END and w not in chosen:
                rest[w[-3:]] += c
        self.endings = {e: 1 + i for i, (e, _) in enumerate(sorted(rest.items(), key=lambda x: (-x[1], x[0]))[: self.n_endings])}
        self.first_word = 1 + groups
        self.words = {w: self.first_word + i for i, w in enumerate(frequent)}
        self.words[END] = 0
        self.size = size
        self.group_n = np.zeros(groups + 1)
        self.group_v = np.zeros(groups + 1)

    def group(self, word: bytes) -> int:
        return self.endings.get(word[-3:]) or 1 + self.n_endings + crc32(word[-2:]) % self.n_hashed

    def symbol(self, word: bytes) -> int:
        s = self.words.get(word)
        return self.group(word) if s is None else s

    def finish(self, counts: dict[int, tuple[int, int]], head: list[tuple[bytes, int]]) -> None:
        """``counts``: tokens and words by symbol.  Sets classes by frequency and the lookup of frequent words."""
        n = np.zeros(self.size)
        for s, (tokens, words) in counts.items():
            n[s] = tokens
            if 0 < s < self.first_word:
                self.group_n[s], self.group_v[s] = tokens, words
        self.group_log = np.log10(self.group_n + 0.1 * (self.group_v + 1))
        live = np.zeros(self.size, bool)
        live[: self.first_word] = True
        live[list(self.words.values())] = True
        mass = np.where(live, n + 0.1, -1)
        order = np.argsort(-mass, kind="stable")
        self.cls, self.place = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.cls[order], self.place[order] = np.divmod(np.arange(self.size), self.side)
        share = np.where(live, n + 0.1, 0.0)
        by_class = np.zeros((self.side, self.side))
        by_class[self.cls, self.place] = share
        with np.errstate(divide="ignore", invalid="ignore"):
            self.class_bias = np.maximum(np.log(by_class.sum(1) / share.sum()), -80).astype(np.float32)
            self.in_bias = np.maximum(np.nan_to_num(np.log(by_class / by_class.sum(1, keepdims=True)), nan=-80, neginf=-80), -80).astype(np.float32)
        # Frequent words: an index, and arrays by it; the last entry stands for any other word.
        self.index = {w: i for i, (w, _) in enumerate(head)}
        self.index.setdefault(END, len(self.index))
        c = np.array([c for _, c in head] + [0.0] * (len(self.index) + 1 - len(head)))
        self.count = c
        self.sym = np.array([*(self.symbol(w) for w in self.index), 0], np.int64)
        self.log_base = np.log10(c + 0.1)
        in_group = (self.sym > 0) & (self.sym < self.first_word)
        self.log_in = np.where(in_group, self.log_base - self.group_log[np.minimum(self.sym, self.first_word - 1)], 0.0)
        self.log_in[-1] = self.log_base[-1] = 0.0

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Index (the last for words without one), symbols, and the words without one."""
        get, none = self.index.get, len(self.index)
        at = np.array([get(w, none) for w in words], np.int64)
        sym = self.sym[at]
        other = np.flatnonzero(at == none)
        rare = [words[i] for i in other.tolist()]
        if rare:
            ending, base, hashed = self.endings.get, 1 + self.n_endings, self.n_hashed
            sym[other] = [ending(w[-3:]) or base + crc32(w[-2:]) % hashed for w in rare]
        return at, sym, rare


class Weights:
    """Hashed weights of classes and of places within classes."""

    def __init__(self, side: int, pairs: int):
        self.side, self.pairs, self.within = side, pairs, side * 16
        self.n = side**2 + 1
        self.cls = np.zeros((3 * self.n + pairs, side), np.float32)
        self.place = np.zeros((side * 2 * self.within, side), np.float32)

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        return self.cls, self.place

    def class_rows(self, p1: np.ndarray, p2: np.ndarray, p3: np.ndarray) -> list[np.ndarray]:
        pair = (p1 * 40503 + p2 * 10007 + (p1 * p2) * 31) % self.pairs
        return [p1, self.n + p2, 2 * self.n + p3, 3 * self.n + pair]

    def place_rows(self, cls: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> list[np.ndarray]:
        at = cls * (2 * self.within)
        return [at + p1 * 7919 % self.within, at + self.within + p2 * 7919 % self.within]


def softmax(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural log of the target's probability, and all probabilities.  Biases are logs of shares and weights stay small, so
    only the upper end is held back; take() and products with ones are the fast ways for rows this short."""
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    z += bias
    np.minimum(z, 80, out=z)
    chosen = z[np.arange(len(z)), target]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], np.float32)
    z /= total[:, None]
    return chosen - np.log(total), z


def step(w: np.ndarray, speed: np.ndarray, moved: np.ndarray, rows: list[np.ndarray], p: np.ndarray, target: np.ndarray) -> None:
    """One AdaGrad step on the rows of a batch."""
    p[np.arange(len(p)), target] -= 1
    narrow = np.uint16 if len(w) <= 1 << 16 else np.uint32
    for r in rows:
        order = np.argsort(r.astype(narrow), kind="stable")
        key = r[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        # Numbers are added in twos, as complex ones.
        g = np.add.reduceat(p.take(order, axis=0).view(np.complex64), starts, axis=0).view(np.float32)
        at = key[starts]
        speed[at] += (g * g).mean(1)
        w[at] -= RATE * g / np.sqrt(speed[at] + 1.0)[:, None]
        moved[at] += np.diff(np.r_[starts, len(key)])


def contexts(symbols: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Targets and the three symbols before each, over documents whose symbols end with the end; and sizes."""
    sizes = np.array([len(s) for s in symbols])
    pad = np.full(3, start)
    flat = np.concatenate([x for s in symbols for x in (pad, s)])
    ends = np.cumsum(sizes + 3)
    real = np.ones(len(flat), bool)
    for k in range(3):
        real[ends - sizes - 3 + k] = False
    at = np.flatnonzero(real)
    return flat[at], flat[at - 1], flat[at - 2], flat[at - 3], sizes


def score_symbols(vocabulary: Vocabulary, weights: Weights, symbols: list[np.ndarray]) -> np.ndarray:
    """log10 probability of the symbols of each document."""
    y, p1, p2, p3, sizes = contexts(symbols, weights.n - 1)
    out = np.empty(len(y))
    for at in range(0, len(y), STEP):
        s = slice(at, at + STEP)
        cls = vocabulary.cls[y[s]]
        a, _ = softmax(weights.cls, vocabulary.class_bias, weights.class_rows(p1[s], p2[s], p3[s]), cls)
        b, _ = softmax(weights.place, vocabulary.in_bias[cls], weights.place_rows(cls, p1[s], p2[s]), vocabulary.place[y[s]])
        out[s] = a.astype(np.float64) + b
    return np.add.reduceat(out, np.r_[0, np.cumsum(sizes)[:-1]]) / np.log(10)


#: Rows of weights that are summed together.
BLOCK, BLOCK_TASKS = 1 << 10, 16


def train_round(texts: DataFrame, vocabulary, weights, shards: int) -> Weights:
    """One round: the shards' changes to the weights, averaged by how often each row moved."""
    voc, old = vocabulary.value, weights.value
    out_schema = pa.schema([("block", pa.int32()), ("change", pa.binary()), ("moved", pa.binary())])

    def shard(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, base = vocabulary.value, weights.value
        w = Weights(base.side, base.pairs)
        for mine, theirs in zip(w.parts(), base.parts()):
            mine[:] = theirs
        speed = [np.zeros(len(x), np.float32) for x in w.parts()]
        moved = [np.zeros(len(x), np.float32) for x in w.parts()]
        any_ = False
        held: list[np.ndarray] = []
        n = 0

        def learn() -> None:
            y, p1, p2, p3, _ = contexts(held, w.n - 1)
            for at in range(0, len(y), STEP):
                s = slice(at, at + STEP)
                cls, place = v.cls[y[s]], v.place[y[s]]
                rows = w.class_rows(p1[s], p2[s], p3[s])
                _, p = softmax(w.cls, v.class_bias, rows, cls)
                step(w.cls, speed[0], moved[0], rows, p, cls)
                rows = w.place_rows(cls, p1[s], p2[s])
                _, p = softmax(w.place, v.in_bias[cls], rows, place)
                step(w.place, speed[1], moved[1], rows, p, place)

        for batch in it:
            for text in texts_as_bytes(batch, "text"):
                _, sym, _ = v.look_up(words_of(text))
                held.append(np.r_[sym, 0])
                n += len(sym) + 1
                if n >= 8 * STEP:
                    learn()
                    held, n, any_ = [], 0, True
        if held:
            learn()
            any_ = True
        if any_:
            block, number = 0, pa.array([TaskContext.get().partitionId()], pa.int32())
            for mine, theirs, m in zip(w.parts(), base.parts(), moved):
                change = mine - theirs
                for at in range(0, len(m), BLOCK):
                    c, k = change[at : at + BLOCK] * m[at : at + BLOCK, None], m[at : at + BLOCK]
                    yield pa.RecordBatch.from_arrays([number, *(pa.array([x], f.type) for x, f in zip((block, c.tobytes(), k.tobytes()), out_schema))], names=["shard", *out_schema.names])
                    block += 1

    def total(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums as they come: a task holds one sum a block, however many shards there are."""
        sums: dict[int, list[np.ndarray]] = {}
        for batch in it:
            for block, c, k in zip(*(x.to_pylist() for x in batch.columns)):
                c, k = np.frombuffer(c, np.float32), np.frombuffer(k, np.float32)
                if block in sums:
                    sums[block][0] += c
                    sums[block][1] += k
                else:
                    sums[block] = [c.astype(np.float32), k.astype(np.float32)]
        for block, (c, k) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((block, c.tobytes(), k.tobytes()), out_schema)], schema=out_schema)

    ddl = "block int, change binary, moved binary"
    changes = texts.coalesce(shards).mapInArrow(shard, f"shard int, {ddl}")
    if shards > 2:
        groups = int(np.ceil(np.sqrt(shards)))
        changes = changes.repartition(groups * BLOCK_TASKS, "block", F.pmod(F.col("shard"), F.lit(groups)))
    sums = changes.select("block", "change", "moved").mapInArrow(total, ddl).repartition(BLOCK_TASKS, "block").mapInArrow(total, ddl).collect()
    new = Weights(old.side, old.pairs)
    found = {r.block: r for r in sums}
    block = 0
    for mine, theirs in zip(new.parts(), old.parts()):
        mine[:] = theirs
        for at in range(0, len(mine), BLOCK):
            part = mine[at : at + BLOCK]
            if block in found:
                k = np.frombuffer(found[block].moved, np.float32)
                part += np.frombuffer(found[block].change, np.float32).reshape(part.shape) / np.maximum(k, 1)[:, None]
            block += 1
    weights.unpersist()
    return new


def fit(docs: DataFrame, head_size: int = HEAD, rounds: int = ROUNDS) -> tuple:
    """(counts table, broadcast vocabulary, broadcast weights) from the training rows (doc_id, text) of docs."""
    spark = docs.sparkSession
    training = docs.filter(is_training(F.col("doc_id")))
    counts = written(token_counts(training), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    head = head_counts(counts, head_size)
    if not any(w == END for w, _ in head):
        head += [(END, r.c) for r in counts.filter(F.octet_length("word") == 0).collect()]
    voc = Vocabulary(head, total.n, total.v)

    def by_symbol(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = Counter(), Counter()
        for batch in it:
            for word, c in zip(*(x.to_pylist() for x in batch.columns)):
                s = voc.symbol(word)
                n[s] += c
                v[s] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([v[s] for s in n], pa.int64())], names=["s", "n", "v"])

    sums = counts.mapInArrow(by_symbol, "s int, n long, v long").groupBy("s").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    voc.finish({r.s: (r.n, r.v) for r in sums}, head)
    vocabulary = spark.sparkContext.broadcast(voc)
    weights = spark.sparkContext.broadcast(Weights(voc.side, voc.pairs))
    part = F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds))
    each = max(SHARD_TOKENS, TOKENS_A_WEIGHT * sum(x.size for x in weights.value.parts()))
    shards = max(1, -(-total.n // (each * rounds)))
    for r in range(rounds):
        mine = training.filter(part == r).select(F.col("text").cast("string").alias("text"))
        weights = spark.sparkContext.broadcast(train_round(mine, vocabulary, weights, shards))
    return counts, vocabulary, weights


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    counts, vocabulary, weights = model
    voc = vocabulary.value
    base_log = float(np.log10(voc.total + 0.1 * (voc.distinct + 1)))
    fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))]
    schema = pa.schema(fields)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = vocabulary.value, weights.value
        row = TaskContext.get().partitionId() << 40
        end = v.index[END]
        none = len(v.index)

        def out(held: list[tuple], symbols: list[np.ndarray]) -> pa.RecordBatch:
            logs = score_symbols(v, w, symbols)
            rows = [(*h[:4], h[4], h[5] + s, h[6], h[7]) for h, s in zip(held, logs.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        held: list[tuple] = []
        symbols: list[np.ndarray] = []
        n = 0
        for batch in it:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch, "text")):
                at, sym, rare = v.look_up(words_of(text))
                at = np.r_[at, end]
                sym = np.r_[sym, 0]
                rarely = Counter(rare)
                in_rare = sym[at == none]
                held.append((
                    row, doc_id, len(at), int((v.count[at] > 0).sum()),
                    float(v.log_base[at].sum()) - len(at) * base_log,
                    float(v.log_in[at].sum()) - float(v.group_log[in_rare].sum()),
                    list(rarely.keys()), list(rarely.values()),
                ))
                symbols.append(sym)
                row += 1
                n += len(at)
                if n >= 16 * STEP:
                    yield out(held, symbols)
                    held, symbols, n = [], [], 0
        if held:
            yield out(held, symbols)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ddl = "row long, doc_id long, n_tokens long, known long, base double, model double, words array<binary>, times array<int>"
    rows = written(src.mapInArrow(run, ddl), "scores")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    got = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce(F.col("c").cast("double"), F.lit(0.0)) + 0.1)).alias("logs"),
        F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("times"))), F.lit(0)).alias("found"),
    )
    both = rows.drop("words", "times").join(got, "row", "left")
    more = F.coalesce("logs", F.lit(0.0))
    return both.select(
        "doc_id",
        (~is_training(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"),
        F.lit(voc.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from nine tenths of the documents and scores all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs))


QUERIES = {"op7_lm_scoring": op7_lm_scoring}
SQL: dict[str, str] = {}

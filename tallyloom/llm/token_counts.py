"""Token counts by a linear longest-match automaton.

The vocabulary's pieces stand in a trie.  Each node has a failure link and the number of pieces that taking it
pops, both worked out beforehand, so one walk over a word gives the number of pieces that greedy longest-match
makes of it, without going back and without building a piece.  Pieces of the vocabulary file are byte strings;
those that end a word carry a word-end symbol, and so does every word.

Words are what the vocabulary's own pre-tokenizer makes of the lower-cased, composed text.  They never cross white
space, so the counts of white-space-separated strings are kept by each worker.

Defined results: a null text counts as empty and has no words; a word that the vocabulary cannot make is one
token; a null doc_id and repeated rows are kept as they are; empty input gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best_fit_packing import VOCABULARY, vocabulary_path
from .common import table, texts_as_bytes

END = 256
SYMBOLS = 257
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Strings kept by a worker with their counts, and the longest kept.
CACHED, LONGEST = 400_000, 48


class Automaton:
    """Longest match over symbols 0..256; node 0 is the root."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        self.go: dict[int, int] = {}
        whole = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                key = node * SYMBOLS + c
                if key not in self.go:
                    self.go[key] = len(whole)
                    whole.append(False)
                node = self.go[key]
            if node:
                whole[node] = True
        children: list[list[tuple[int, int]]] = [[] for _ in whole]
        for key, node in self.go.items():
            children[key // SYMBOLS].append((key % SYMBOLS, node))
        self.fail = [-1] * len(whole)
        self.pops = [0] * len(whole)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in children[u]:
                if whole[v]:
                    self.fail[v], self.pops[v] = 0, 1
                else:
                    z, popped = self.fail[u], self.pops[u]
                    while z >= 0 and (z * SYMBOLS + c) not in self.go:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.go[z * SYMBOLS + c], popped
                queue.append(v)

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 if it cannot be made."""
        go, fail, pops = self.go, self.fail, self.pops
        node = n = 0
        for c in (*word, END):
            while (node * SYMBOLS + c) not in go:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = go[node * SYMBOLS + c]
        while node:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary_pieces(vocabulary: str) -> list[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary file with word ends, without its special tokens."""
    with open(vocabulary_path(vocabulary), encoding="utf-8") as file:
        data = json.load(file)
    special = {t["content"] for t in data.get("added_tokens", [])}
    suffix = data["model"].get("end_of_word_suffix") or ""
    symbol = byte_symbols()
    pieces = []
    for piece in data["model"]["vocab"]:
        if piece in special:
            continue
        last = bool(suffix) and piece.endswith(suffix)
        text = piece[: -len(suffix)] if last else piece
        pieces.append((*(symbol[c] for c in text), *((END,) if last else ())))
    return pieces


def words_of(text: str) -> list[bytes]:
    return [w.encode() for w in WORD.findall(unicodedata.normalize("NFC", text).lower())]


class Counter:
    """Words and tokens of texts, as one number: words * 2^32 + tokens."""

    def __init__(self, vocabulary: str):
        self.automaton = Automaton(vocabulary_pieces(vocabulary))
        self.known: dict[bytes, int] = {}

    def of(self, string: bytes) -> int:
        words = words_of(string.decode("utf-8"))
        return (len(words) << 32) + sum(map(self.automaton.count, words))

    def total(self, text: bytes) -> int:
        known, total = self.known, 0
        if len(known) > CACHED:
            known.clear()
        for s in text.split():
            n = known.get(s)
            if n is None:
                n = self.of(s)
                if len(s) <= LONGEST:
                    known[s] = n
            total += n
        return total


_LOADED: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens)"""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = Counter(vocabulary)
        counter = _LOADED[vocabulary]
        for batch in it:
            totals = [counter.total(t) for t in texts_as_bytes(batch, "text")]
            columns = [batch.column(0), pa.array([t >> 32 for t in totals], pa.int64()), pa.array([t & 0xFFFFFFFF for t in totals], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    src = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op10_token_counts": op10_token_counts}
SQL: dict[str, str] = {}

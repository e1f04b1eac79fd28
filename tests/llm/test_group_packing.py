import random
import zlib

import numpy as np
import pytest

from tallyloom.llm import group_packing as G
from tallyloom.llm.best_fit_packing import VOCABULARY, vocabulary_path

SCHEMA = "doc_id long, text string, length string, sequence_id string, _row string, _group string"


def ids_of(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(VOCABULARY))
    return [[*e.ids, 1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def corpus():
    r = random.Random(12)
    words = ["the", "Ofthe", "été", "x1y2", "don't", "##", "zz.", "<|endoftext|>", "日本語"]
    rows = [(i, " ".join(r.choices(words, k=int(r.paretovariate(0.6) * 15) % 9000))) for i in range(250)]
    rows += [(1000, ""), (1001, None), (None, "no id"), (7, "again"), (7, "again"), (1002, "word " * 20_000)] + [(2000 + i, "same text of a copy") for i in range(300)]
    return [(d, t, "l", "s", "r", "g") for d, t in rows]


def check(got, rows, capacity=2048):
    """Every id of every row in exactly one piece, sequences without gaps; returns tokens and padding."""
    texts = [t for _, t, *_ in rows]
    left = {}
    for (d, *_), ids in zip(rows, ids_of(texts)):
        left.setdefault((d, len(ids)), []).append(ids)
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == left.keys()
    for key, docs in left.items():
        mine = pieces[key]
        assert sum(p.length for p in mine) == sum(map(len, docs))
        if len(docs) == 1:
            at = 0
            for p in sorted(mine, key=lambda p: p.start):
                assert p.start == at and p.length > 0
                at += p.length
        for p in mine:
            assert p.ids_crc32 in {zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for ids in docs}
    padding = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if G.unpadded(at, capacity) else capacity - at
    return sum(r.length for r in got), padding


def test_query_against_the_tokenizer(spark, put, monkeypatch):
    monkeypatch.setattr(G, "TOGETHER", 10_000)
    rows = corpus()
    got = G.op12_group_packing(spark, put(documents=spark.createDataFrame(rows, SCHEMA)))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    tokens, padding = check(got.collect(), rows)
    assert tokens > 100_000 and padding == 0


def test_many_groups_share_the_copies_and_pad_nothing(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    placed = G.pack_groups(G.token_rows(docs), group_tokens=8192, group_rows=60).selectExpr("*", "crc32(ids) AS ids_crc32").collect()
    _, padding = check(placed, rows)
    assert padding == 0
    copies = {r.sequence_id >> 33 for r in placed if r.sequence_id % 2 and r.doc_id is not None and r.doc_id >= 2000}
    assert len(copies) > 5
    # Documents are cut only to fill gaps: far fewer cuts than documents.
    whole = sum(-(-len(ids) // 2048) for ids in ids_of([t for _, t, *_ in rows]))
    assert len(placed) < 1.5 * whole


def plain_first_fit(lengths, capacity):
    bins = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        for b in bins:
            if sum(lengths[j] for j in b) + lengths[i] <= capacity:
                b.append(i)
                break
        else:
            bins.append([i])
    return bins


def test_the_tree_finds_the_first_bin():
    r = random.Random(3)
    for _ in range(200):
        capacity = r.choice([8, 64, 100])
        lengths = [r.randrange(1, capacity) for _ in range(r.randrange(0, 120))]
        assert [[i for i, _, _ in b] for b in G.first_fit_decreasing(lengths, capacity)] == plain_first_fit(lengths, capacity)
    with pytest.raises(ValueError):
        G.FreeRoom(2, 5).take(6)


def test_tightening_keeps_every_token_and_leaves_no_gap():
    r = random.Random(4)
    for _ in range(300):
        capacity = r.choice([8, 64, 256])
        lengths = [r.randrange(1, capacity) for _ in range(r.randrange(0, 60))]
        slack = r.choice([0, 0, 3])
        bins = G.tightened(G.first_fit_decreasing(lengths, capacity), capacity, slack)
        spans = {}
        for b in bins:
            assert b and (G.unpadded(G.filled(b), capacity) or capacity - G.filled(b) <= slack)
            for item, at, n in b:
                spans.setdefault(item, []).append((at, n))
        assert spans.keys() == set(range(len(lengths)))
        for item, parts in spans.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at and n > 0
                at += n
            assert at == lengths[item]
        assert len(bins) <= -(-sum(lengths) // capacity) + capacity.bit_length() + (len(lengths) if slack else 0)


def test_full_sequences_stand_alone(spark):
    made = [(5, 0, 8, 11, b"x" * 32), (5, 8, 3, 11, b"y" * 12)]
    got = {r.start: r for r in G.pack_groups(spark.createDataFrame(made, G.PIECE_DDL), capacity=8).collect()}
    assert (got[0].length, got[0].offset) == (8, 0) and got[0].sequence_id % 2 == 0
    assert sum(r.length for r in got.values()) == 11


def test_empty(spark, put):
    assert G.op12_group_packing(spark, put(documents=spark.createDataFrame([], SCHEMA))).count() == 0


def test_rows_ids_come_from_one_look_up_a_different_word():
    from tallyloom.llm import best_fit_packing as P
    from tallyloom.llm import group_packing as G

    class Counting(dict):
        asked = 0

        def get(self, *x):
            self.asked += 1
            return super().get(*x)

    words = P.WordIds(P.VOCABULARY)
    texts = [b"one fish, two fish" * 300, b"", b"two Fish two "]
    want = list(G.encoded(words, texts))
    words.young = Counting(words.young)
    assert list(G.encoded(words, texts)) == want
    assert words.young.asked < 20

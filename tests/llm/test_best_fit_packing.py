import random
import zlib

import numpy as np

from tallyloom.llm import best_fit_packing as P

SCHEMA = "doc_id long, text string, length long, sequence_id string"


def ids_of(text):
    from tokenizers import Tokenizer

    global TOK
    TOK = globals().get("TOK") or Tokenizer.from_file(P.vocabulary_path(P.VOCABULARY))
    return [*TOK.encode(text or "", add_special_tokens=False).ids, 0]


def corpus():
    r = random.Random(4)
    odd = ["", None, "<|endoftext|> a<|startoftext|>b", "It's we'll I'M 12 34á é", "\x1c 　x y", "ΣΑΣ İI ß", "日本語 テスト", "a" * 9000, "!!! ... \x00 ok", "x﻿y"]
    words = ["the", "Ofthe", "été", "x1y2", "don't", "##", "zz.", "ñandú"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(100 + i, " ".join(r.choices(words, k=int(r.paretovariate(0.7) * 20) % 6000))) for i in range(150)]
    return [(d, t, 1, "s") for d, t in rows + [(7, "again"), (7, "again"), (None, "no id")]]


def test_query_against_the_tokenizer(spark, put):
    rows = corpus()
    got = P.op6_best_fit_packing(spark, put(documents=spark.createDataFrame(rows, SCHEMA))).collect()
    want = []
    for d, t, *_ in rows:
        ids = ids_of(t)
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((d, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 2048) + 1


def test_ids_of_random_texts_are_the_tokenizers():
    r = random.Random(1)
    words = P.WordIds(P.VOCABULARY, cached=5000)
    special = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|", "|>", "H\u0331", "\u0130", "\u095b,", "\u092a\u095d.", "\u09df,", "\ufb2a,", "\u0f40\u0fb7.", "\u03a3", "\u03a3\u0391\u03a3.", "'LL", "\u212a"]

    def piece():
        kind = r.random()
        if kind < 0.4:
            return r.choice("abcHTWXYZ.,'0 9<|>\n")
        if kind < 0.6:
            return chr(r.randrange(0x300, 0x370) if kind < 0.5 else r.randrange(0xA0, 0x530))
        if kind < 0.7:
            return r.choice(special)
        c = r.randrange(0x10F7FF)
        return chr(c if c < 0xD800 else c + 0x800)

    texts = special + [x + "." for x in special] + ["".join(piece() for _ in range(r.randrange(1, 14))) for _ in range(100_000)]
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        got = words.ids([t.encode() for t in part])
        want = words.tokenizer.encode_batch(part, add_special_tokens=False)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]


def test_other_columns_stay_and_equal_rows_are_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 50)
    rows = [(None, 0, 0, 5, "a", 1)] * 400 + [(7, 0, 0, 3, "b", 2)] * 300
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, _bucket string, _rank int")
    got = P.pack(df, 8)
    assert got.columns == [*df.columns, "sequence_id", "offset"]
    bins = {}
    for r in got.collect():
        assert (r._bucket, r._rank) == (("a", 1) if r.doc_id is None else ("b", 2))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(map(len, bins.values())) == 700
    for b in bins.values():
        ends = [0] + [o + n for o, n in sorted(b)]
        assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= 8
    # 300 sequences of 5 + 3, then fives alone.
    assert len(bins) == 400


def test_two_replace_the_smallest():
    # Greedy gives 6+3 with a gap of 1; 2+2 instead of 3 fill it.
    assert P.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [(1, [6, 2, 2]), (1, [3])]
    assert P.best_two_fit({5: 3}, 10) == [(1, [5, 5]), (1, [5])]
    assert P.best_two_fit({}, 10) == []


def test_packing_is_whole_and_close_to_the_least():
    r = random.Random(8)
    for _ in range(60):
        cap = r.choice([10, 64, 300])
        counts = {}
        for _ in range(r.randrange(1, 400)):
            length = r.randrange(1, cap + 1)
            counts[length] = counts.get(length, 0) + r.choice([1, 1, 1, 50])
        patterns = P.best_two_fit(counts, cap)
        got = {}
        for times, lengths in patterns:
            assert times > 0 and sum(lengths) <= cap
            for x in lengths:
                got[x] = got.get(x, 0) + times
        assert got == counts
        bins = sum(t for t, _ in patterns)
        over = sum(n for x, n in counts.items() if x * 2 > cap)
        assert bins <= 1.2 * max(-(-sum(x * n for x, n in counts.items()) // cap), over) + 1


def test_empty(spark, put):
    assert P.op6_best_fit_packing(spark, put(documents=spark.createDataFrame([], SCHEMA))).count() == 0


def test_each_different_word_is_looked_up_once():
    class Counting(dict):
        asked = 0

        def get(self, *x):
            self.asked += 1
            return super().get(*x)

    words = P.WordIds(P.VOCABULARY)
    texts = [b"The river, the\tRiver.  " * 500, b"", b"river, THE river. " * 500, "été <|endoftext|> the É".encode()]
    want = [np.array(e.ids, "<u4").tobytes() for e in words.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
    assert words.ids(texts) == want
    words.young = Counting(words.young)
    assert words.ids(texts) == want
    assert words.young.asked < 20

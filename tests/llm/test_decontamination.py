import random
import time

from tallyloom.llm import decontamination as D

SCHEMA = "doc_id long, text string, item_id long, coverage string"


def brute_tiles(p, t, k):
    mp, mt, out = set(), set(), []
    while True:
        best = None
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] >= 0 and i + n not in mp and j + n not in mt:
                    n += 1
                if n >= k and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        i, j, n = best
        mp |= set(range(i, i + n))
        mt |= set(range(j, j + n))
        out.append(best)


def test_tiles_against_brute_force():
    r = random.Random(1)
    for _ in range(400):
        p = [r.randrange(r.choice([2, 4, 30])) for _ in range(r.randrange(1, 25))]
        t = [r.randrange(-1, 6) for _ in range(r.randrange(10))]
        for _ in range(3):
            a = r.randrange(len(p))
            t += p[a : a + r.randrange(1, 12)] + [r.randrange(-1, 6)]
        k = r.randrange(1, 5)
        assert D.greedy_tiles(p, t, k) == brute_tiles(p, t, k)


def test_repetitive_texts_cost_little():
    r = random.Random(3)
    for p, t in (([1, 2] * 12, [1, 2] * 40 + [3] + [2, 1] * 9), ([1] * 17, [1] * 60), ([1, 1, 2] * 7, [1, 2, 1, 1, 2, 1] * 9), ([r.randrange(2) for _ in range(24)], [r.randrange(2) for _ in range(90)])):
        assert D.greedy_tiles(p, t, 5) == brute_tiles(p, t, 5)
    began = time.perf_counter()
    assert D.greedy_tiles([1, 2] * 250, [1, 2] * 500_000, 5) == [(0, 0, 500)]
    assert sum(n for *_, n in D.greedy_tiles([1, 2, 3] * 200, ([1, 2, 3] * 30 + [4]) * 5000, 5)) == 600
    # A run that many items and all of a long document hold.
    items = D.Items([(i, f"a b c d e f{i} g{i} h{i} i{i} j{i} k{i} l{i}") for i in range(3000)], 5, 0.5)
    assert items.leaks(["a b c d e " * 100_000 + "a b c d e f7 g7"]) == [[(7, 7 / 12, [(0, 500_000, 7)])]]
    assert time.perf_counter() - began < 20


def corpus():
    r = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(r.choices(words, k=r.randrange(8, 40)))) for i in range(20)] + [(90, "w1 w2"), (91, None), (92, "a b c d e"), (92, "a b c d e"), (None, "n1 n2 n3 n4 n5 n6")]
    docs = []
    for i in range(60):
        w = r.choices(words, k=r.randrange(0, 200))
        item = items[r.randrange(20)][1].split()
        kind = i % 5
        if kind == 1:
            w[10:10] = item
        if kind == 2:  # reordered, in capitals and with stops
            h = len(item) // 2
            w = [x.upper() + "," for x in item[h:]] + w + item[:h]
        if kind == 3:
            w[5:5] = item[: len(item) // 3]
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "A, b; c. D e"), (102, "A, b; c. D e"), (103, "x " * 900 + "a b c d e " * 3), (105, " ".join(["a b c d e f"] * 40)), (106, "c d e a b " * 60), (None, "n1 n2 n3 n4 n5 n6"), (104, "a b c d")]
    return docs, items


def brute(docs, items):
    out = []
    for d, t in docs:
        for i, u in set(items):
            p, q = D.words_of(u), D.words_of(t)
            if len(p) < 5:
                continue
            ids = {w: n for n, w in enumerate(dict.fromkeys(p))}
            tiles = brute_tiles([ids[w] for w in p], [ids.get(w, -1) for w in q], 5)
            c = sum(n for *_, n in tiles) / len(p)
            if c >= 0.5:
                out.append((d, i, round(c, 6), len(tiles)))
    return sorted(out, key=repr)


def test_query_against_brute_force(spark, put, monkeypatch):
    docs, items = corpus()
    d = put(documents=spark.createDataFrame([(*x, 1, "c") for x in docs], SCHEMA), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    got = D.op5_decontamination(spark, d)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and len(want) > 20
    monkeypatch.setattr(D, "BLOCK_CHARS", 2_000)
    monkeypatch.setattr(D, "CHUNK", 50)
    assert sorted((tuple(r) for r in D.op5_decontamination(spark, d).collect()), key=repr) == want
    src = spark.read.parquet(f"{d}/documents.parquet")
    kept = D.clean(src, spark.read.parquet(f"{d}/benchmark.parquet"))
    assert kept.columns == src.columns
    lost = {x[0] for x in want}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(x for x, _ in docs if x not in lost)


def test_empty(spark, put):
    docs, items = corpus()
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert D.op5_decontamination(spark, put(documents=none, benchmark=some)).count() == 0
    full = spark.createDataFrame([(*x, 1, "c") for x in docs], SCHEMA)
    assert D.op5_decontamination(spark, put(documents=full, benchmark=some.limit(0))).count() == 0

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import simhash_dedup as S
from tallyloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, component_id string"


def brute_fp(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    named = [(d, brute_fp(t)) for d, t, *_ in rows if d is not None]
    comp = {f: f for _, f in named}
    fs = sorted(comp)

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 3:
                comp[find(a)] = find(b)
    least = {}
    for d, f in named:
        least[find(f)] = min(d, least.get(find(f), d))
    return sorted([(d, f"{f:016x}", least[find(f)]) for d, f in named] + [(None, f"{brute_fp(t):016x}", None) for d, t, *_ in rows if d is None], key=repr)


def corpus():
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = r.choices(words, k=r.choice([1, 2, 3, 40, 200]))
        rows.append((len(rows), " ".join(base)))
        for _ in range(r.choice([0, 0, 3, 12])):
            near = list(base)
            near[r.randrange(len(near))] = r.choice(words)
            rows.append((len(rows), r.choice([" ", "\n", "  "]).join(near).upper()))
    rows += [(900, None), (901, ""), (902, " \t\r\n"), (903, "É é É"), (904, "w1 " * 70_000), (5, "repeated"), (5, "repeated"), (None, "no id"), (None, None)]
    return [(d, t, "f", "c") for d, t in rows]


def test_query_against_brute_force(spark, put):
    d = put(documents=spark.createDataFrame(corpus(), SCHEMA))
    assert sorted((tuple(r) for r in S.op9_simhash_dedup(spark, d).collect()), key=repr) == brute(corpus())


def test_forest_against_all_pairs():
    r = np.random.default_rng(5)
    for n, flips, lanes, radius in ((400, 5, 1, 3), (300, 2, 1, 3), (200, 40, 4, 40), (1, 0, 1, 3)):
        centres = r.integers(0, 2**63, (7, lanes), dtype=np.uint64)
        pts = centres[r.integers(0, 7, n)]
        for i in range(n):
            for b in r.integers(0, 64 * lanes, flips):
                pts[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        shard = np.sort(r.integers(0, 3, n))
        lab = S.Forest(shard, pts).classes(radius)
        want = np.arange(n)
        near = (np.bitwise_count(pts[:, None] ^ pts[None]).sum(-1) <= radius) & (shard[:, None] == shard[None])
        while True:
            new = np.where(near, want[None], n).min(1)
            if (new == want).all():
                break
            want = new
        assert (lab == want).all()


def test_bands_lose_nothing():
    r = np.random.default_rng(6)
    a = r.integers(0, 2**63, (500, 1), dtype=np.uint64)
    b = a.copy()
    for i in range(500):
        for bit in r.integers(0, 64, 3):
            b[i, 0] ^= np.uint64(1) << np.uint64(bit)
    bands = S.exact_bands(64, 3)
    assert (S.band_keys(a, bands) == S.band_keys(b, bands)).any(1).all()


def test_components_of_a_long_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).unionByName(spark.sql("select 100L u, 100L v union all select 201L u, 200L v"))
    got = {(r.u, r.v) for r in connected_components(edges).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(201, 200)}


def test_empty_and_keep_one(spark, put):
    d = put(documents=spark.createDataFrame([], SCHEMA))
    assert S.op9_simhash_dedup(spark, d).count() == 0
    docs = spark.createDataFrame(corpus(), SCHEMA)
    kept = S.keep_one(docs, S.simhash_classes(docs))
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    # By row: of each class the least doc_id, and of its rows in the class one text; rows with a doc_id of another class stay.
    of = {}
    for (d, t, *_), (_, _, c) in zip(sorted(corpus(), key=lambda x: repr((x[0], f"{brute_fp(x[1]):016x}"))), sorted(brute(corpus()), key=lambda x: repr(x[:2]))):
        of.setdefault((c, None if c is None else d), []).append(t)
    want = {(c, d): ts for (c, d), ts in of.items() if c is None or c == d}
    # The two texts of id 5 are classes of their own that have the same least id.
    assert sum(len(ts) if c is None else 1 for (c, _), ts in want.items()) + 1 == len(got)
    assert all(t in want[None if d is None else d, d] for d, t in got)
    assert sorted(t for d, t in got if d == 5) == sorted({t for d, t, *_ in corpus() if d == 5}) and [d for d, _ in got].count(None) == 2


def test_rows_of_one_id_are_told_apart(spark):
    r = random.Random(2)
    text = [" ".join(r.choices([f"w{i}" for i in range(500)], k=80)) for _ in range(4)]
    # 7 is a copy of 1 in one of its rows only; 8 repeats a row; 9 has two texts of its own.
    rows = [(1, text[0]), (7, text[0]), (7, text[1]), (8, text[2]), (8, text[2]), (9, text[3]), (9, text[3] + " more")]
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "doc_id long, text string, _text_hash int")
    kept = S.keep_one(docs, S.similar_classes(docs))
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in kept.collect())
    assert [d for d, _ in got] == [1, 7, 8, 9] and (7, text[1]) in got


def test_large_shards_are_searched_in_cells(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL_ROWS", 20)
    r = np.random.default_rng(9)
    rows = []
    for n in range(300):
        x = 0x123456789ABCDEF0
        for bit in r.integers(0, 64, int(r.integers(0, 6))):
            x ^= 1 << int(bit)
        rows.append(x)
    rows = sorted(set(rows))
    nodes = spark.createDataFrame([(x.to_bytes(8, "big"),) for x in rows], "fp binary")
    links = S.spanning_links(nodes, 3, S.exact_bands(64, 3))
    root = {bytes(u.fp): bytes(u.root) for u in S.stars_of(links).collect()}
    got = {}
    for x in rows:
        fp = x.to_bytes(8, "big")
        got.setdefault(root.get(fp, fp), set()).add(x)
    todo, want = set(rows), []
    while todo:
        reach, new = set(), {min(todo)}
        while new:
            reach |= new
            new = {y for y in todo - reach if any((x ^ y).bit_count() <= 3 for x in new)}
        want.append(reach)
        todo -= reach
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_similar_classes_are_those_of_exact_similarity(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    rows = []
    # Pairs on both sides of 0.8: n words replaced far from each other change 5 n shingles of 200.
    for i in range(120):
        base = r.choices(words, k=204)
        near = list(base)
        for place in range(3, 3 + 30 * (2 + i % 4), 30):
            near[place + 5] = "changed"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    # A group of near copies, and rows without shingles or ids.
    base = r.choices(words, k=300)
    for i in range(40):
        base[r.randrange(300)] = r.choice(words)
        rows.append((1000 + i, " ".join(base)))
    rows += [(2000, None), (2001, ""), (None, rows[0][1])]
    got = {d: c for d, _, _, c, _ in S.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sure, want = 0, {}
    for i in range(120):
        a, b = shingles(rows[2 * i][1]), shingles(rows[2 * i + 1][1])
        j = len(a & b) / len(a | b)
        sure += 0.8 <= j < 0.85
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i + (j < 0.8)}
    assert sure >= 30 and {d: got[d] for d in want} == want
    assert {got[1000 + i] for i in range(40)} == {1000} and got[2001] == 2000 and got[None] is None


def test_first_band_and_order_of_points():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, (300, 16)).astype(np.uint64)
    b = a ^ (rng.random((300, 16)) < 0.3).astype(np.uint64) * rng.integers(0, 2**63, (300, 16)).astype(np.uint64)
    bands = S.candidate_bands(1000)
    ka, kb = S.band_keys(a, bands), S.band_keys(b, bands)
    first = [next((i for i in range(len(bands)) if x[i] == y[i]), len(bands)) for x, y in zip(ka, kb)]
    assert S.first_band(a, b, bands).tolist() == first
    assert S.above(a, b).tolist() == [x > y for x, y in zip(a.tolist(), b.tolist())]


def test_similar_classes_equal_brute_force_in_many_cells(spark, monkeypatch):
    """Many near copies around the similarity, in small blocks and cells, against all pairs."""
    monkeypatch.setattr(S, "BLOCK_SETS", 7)
    monkeypatch.setattr(S, "NEAR_CELL", 20)
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    texts = []
    for i in range(70):
        words = list(base)
        for _ in range(i % 6):
            words[r.randrange(150)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [set(S.shingle_hashes(t.encode().split(), 5).tolist()) for t in texts]
    least = list(range(70))
    while True:
        new = [min(least[j] for j in range(70) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(70)]
        if new == least:
            break
        least = new
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in S.similar_classes(docs).collect()}
    assert got == dict(enumerate(least))


def test_repeated_lines_do_not_hide_a_copy(spark):
    """Similarity is that of shingle sets, so a line said thirty times weighs as if said once or twice."""
    r = random.Random(21)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(20):
        base = r.choices(words, k=210)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + base[-10:] * 29))]
    a, b = (set(S.shingle_hashes(t.encode().split(), 5).tolist()) for _, t in rows[:2])
    assert len(a & b) > 0.95 * len(a | b)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in S.keep_one(docs, S.similar_classes(docs)).collect()) == list(range(0, 40, 2))


def test_cells_let_every_pair_of_a_large_shard_meet():
    rng = np.random.default_rng(6)
    points = rng.integers(0, 2**63, (200, 4)).astype(np.uint64)
    shard = np.r_[np.full(200, 7), 100 + np.arange(200) % 50, np.full(200, 9)].astype(np.int64)
    row, number = S.cells_of(shard, points, (np.array([7, 9, 1000]), np.array([5, 3, 4])))
    members = {}
    for r, n in zip(row.tolist(), number.tolist()):
        members.setdefault(n, set()).add(r)
    for first, parts in ((0, 5), (400, 3)):
        mine = [m for n, m in members.items() if n < 0 and min(m) >= first and max(m) < first + 200]
        assert len(mine) == parts * (parts + 1) // 2 and max(map(len, mine)) < 200
        for a in range(first, first + 200):
            assert set().union(*(m for m in mine if a in m)) == set(range(first, first + 200))
    # Other shards stay as they are.
    assert sorted(r for n, m in members.items() if n >= 0 for r in m) == list(range(200, 400))
    assert [x.tolist() for x in S.cells_of(shard, points, (np.zeros(0, np.int64), np.zeros(0, np.int64)))] == [list(range(600)), shard.tolist()]

import math
import random

from tallyloom.llm import exact_search as E

SCHEMA = "vec_id long, embedding array<float>, label int, q string, id long, dim int"


def corpus(n=600, dim=8):
    r = random.Random(9)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, 0.2) for c in r.choice(centres)]) for i in range(n)]
    rows += [(1000 + i, [1.0] * dim) for i in range(40)]
    rows += [(2000, None), (2001, [None] + [0.0] * (dim - 1)), (2002, [float("nan")] * dim), (2050, [float("inf")] * dim), (2100, []), (2101, []), (2150, [1.0, 2.0]), (3, [1.0] * dim), (3, [1.0] * dim), (None, [1.0] * dim)]
    return rows


def brute(rows):
    good = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, q in good:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in good if j != i and len(x) == len(q))
            out += [(i, n + 1, j, -v) for n, (v, j) in enumerate(s[:5])]
    return sorted(out)


def test_query_against_brute_force(spark, put):
    df = spark.createDataFrame([(*r, 0, "q", 0, 0) for r in corpus()], SCHEMA)
    d = put(embeddings=df)
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, E.op2_exact_search(spark, d).collect())) == brute(rows)


def test_blocks_and_pivots_change_nothing(spark):
    df = spark.createDataFrame([(*r, 0, "q", 0, 0) for r in corpus()], SCHEMA)
    v = E.integer_vectors(df)
    q = v.filter("id % 50 = 0")
    want = sorted(map(tuple, E.top_k(v, q).collect()))
    assert sorted(map(tuple, E.top_k(v, q, pivots=0, block=4).collect())) == want
    assert sorted(map(tuple, E.top_k(v, q, pivots=3, block=1000).collect())) == want


def test_bounds_leave_candidates_out():
    import numpy as np

    r = np.random.default_rng(1)
    x = np.floor(np.repeat(r.normal(0, 300, (10, 6)), 200, 0) + r.normal(0, 5, (2000, 6)))
    far = E.pivot_distances(x, x[:1600:100])
    best = [[] for _ in range(20)]
    n = E.search_block(x[:20], np.arange(20), far[:20], x, np.arange(2000), far, best, 5)
    assert n < 20 * 1000


def test_large_components_are_exact(spark, put):
    r = random.Random(4)
    schema = SCHEMA.replace("float", "double")
    rows = [(0, [1e7, 3.0]), (1, [1e7, 1 / 256]), (2, [1e7, 2 / 256]), (3, [9e6, -4.0])]
    rows += [(50 + i, [r.choice([1, -1]) * 2.0 ** r.uniform(-10, 23) for _ in range(2)]) for i in range(150)]
    got = sorted(map(tuple, E.op2_exact_search(spark, put(embeddings=spark.createDataFrame([(i, e, 0, "q", 0, 0) for i, e in rows], schema))).collect()))
    assert got == brute(rows) and (0, 1, 2, 6553600000000001536) in got
    # Beyond long, scores stand at its ends and ties go to the smaller id.
    rows = [(0, [1e40, -1e40]), (1, [1e40, 1e40]), (2, [-1e300, 1e300]), (3, [1.7e308, -5e-324]), (4, [2.0, 1.0]), (5, [1e200, 1e100]), (50, [1.0, 2.0]), (100, [1e308, 1e308])]
    whole = {i: [math.floor(256 * int(x)) if abs(x) > 1e300 else math.floor(256 * x) for x in e] for i, e in rows}
    clamp = lambda v: min(max(v, -(1 << 63)), (1 << 63) - 1)
    want = []
    for q in (0, 50, 100):
        s = sorted((-clamp(sum(a * b for a, b in zip(whole[q], x))), j) for j, x in whole.items() if j != q)
        want += [(q, n + 1, j, -v) for n, (v, j) in enumerate(s[:5])]
    got = sorted(map(tuple, E.op2_exact_search(spark, put(embeddings=spark.createDataFrame([(i, e, 0, "q", 0, 0) for i, e in rows], schema))).collect()))
    assert got == want


def test_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert sorted(map(tuple, E.op2_exact_search(spark, sf_dir).collect())) == sorted(con.execute(E.OP2_SQL).fetchall())


def test_empty(spark, put):
    assert E.op2_exact_search(spark, put(embeddings=spark.createDataFrame([], SCHEMA))).count() == 0


def test_queries_share_products_and_stay_exact(monkeypatch):
    import numpy as np

    r = np.random.default_rng(5)
    x = np.floor(r.normal(0, 40, (3000, 16)))
    x[100:160] = x[7]
    ids, q = r.permutation(3000), x[:200]
    pivots = E.far_apart(x[:500], 8)
    alone = []
    monkeypatch.setattr(E, "products", lambda a, b, f=E.products: alone.append(1) or f(a, b))
    best = [[] for _ in q]
    far = E.pivot_distances(x, pivots)
    for at in range(0, 3000, 1100):
        part = slice(at, at + 1100)
        E.search_block(q, ids[:200], far[:200], x[part], ids[part], far[part], best, 5)
    scores = (x @ q.T).astype(int)
    for i in range(200):
        want = sorted((scores[j, i], -ids[j]) for j in range(3000) if ids[j] != ids[i])[-5:]
        assert best[i] == want
    # Spread evenly, hardly a bound is of use, so queries must not go through the candidates one by one.
    assert len(alone) < 200

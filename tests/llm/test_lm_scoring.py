import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import lm_scoring as L

SCHEMA = "doc_id long, text string, word string, row long"


def corpus(n=400):
    r = random.Random(2)
    kinds = [[f"{p}{i}{e}" for i in range(400)] for p, e in (("a", "tion"), ("é", "eau"), ("u", "keit"))]
    rows = []
    for i in range(n):
        words = kinds[i % 3]
        rows.append((i, r.choice([" ", "\n"]).join(words[min(399, int(r.paretovariate(0.6)))] for _ in range(r.randrange(1, 120)))))
    rows += [(900, None), (901, ""), (902, "UPPER É a b \x0bx"), (903, "new " * 30_000), (5, "again"), (5, "again"), (None, "no id")]
    return [(d, t, "w", 1) for d, t in rows]


def test_base_and_counts_against_brute_force(spark, put):
    rows = corpus()
    got = L.op7_lm_scoring(spark, put(documents=spark.createDataFrame(rows, SCHEMA))).collect()
    held = lambda d: d is None or crc32(str(d).encode()) % 10 == 0
    words = lambda t: [*(t or "").encode().lower().split(), b"\0end"]
    c = Counter(w for d, t, *_ in rows if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))
    want = sorted(((d, held(d), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(base(t), 6)) for d, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert all(r.score < 0 for r in got)


def test_probabilities_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(L, "HEAD", 50)
    docs = spark.createDataFrame(corpus(90), SCHEMA)
    counts, vocabulary, weights = L.fit(docs.select("doc_id", "text"), head_size=50)
    v, w = vocabulary.value, weights.value
    known = [bytes(r.word) for r in counts.collect()]
    # Every seen word and, for every group, one unseen event, after some context.
    context = [b"a1tion", b"zzz"]
    total = 0.0
    for word in known:
        s = np.r_[v.look_up([*context, word])[1]] if word else np.r_[v.look_up(context)[1], 0]
        logs = L.score_symbols(v, w, [s]) - L.score_symbols(v, w, [s[:-1]])
        inside = 1.0
        if 0 < s[-1] < v.first_word:
            c = counts.filter(F.col("word") == F.lit(word)).first().c
            inside = (c + 0.1) / 10 ** v.group_log[s[-1]]
        total += 10 ** logs[0] * inside
    for g in range(1, v.first_word):
        s = np.r_[v.look_up(context)[1], g]
        total += 10 ** (L.score_symbols(v, w, [s]) - L.score_symbols(v, w, [s[:-1]]))[0] * 0.1 / 10 ** v.group_log[g]
    assert abs(total - 1) < 1e-4


def test_the_model_grows_with_the_training_tokens():
    sizes = []
    for n in (10**6, 10**8, 10**10, 10**13):
        v = L.Vocabulary([], n, 1)
        sizes.append((v.side, v.pairs))
        assert v.side % 4 == 0 and v.first_word < v.side**2
    assert sizes == sorted(sizes) and len(set(sizes)) == 4 and sizes[-1][0] < 128


def test_shards_meet_in_two_steps(spark, monkeypatch):
    # Many shards change the weights as their mean says, whatever way they meet.
    monkeypatch.setattr(L, "SHARD_TOKENS", 400)
    monkeypatch.setattr(L, "TOKENS_A_WEIGHT", 0)
    docs = spark.createDataFrame(corpus(), SCHEMA).select("doc_id", "text").repartition(9, "doc_id")
    _, v, w = L.fit(docs)
    got = [r for r in L.score(docs, L.fit(docs)).collect() if r.held_out]
    assert all(np.isfinite(x).all() and np.abs(x).max() > 0 for x in w.value.parts())
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_empty(spark, put):
    assert L.op7_lm_scoring(spark, put(documents=spark.createDataFrame([], SCHEMA))).count() == 0


def test_scores_by_plain_arithmetic(spark, monkeypatch):
    """Every token's probability worked out one by one from the model's parts: class, symbol in the class, word in the symbol."""
    import math
    import random
    from zlib import crc32 as crc

    monkeypatch.setattr(L, "HEAD", 60)
    r = random.Random(17)
    words = [f"w{i}{e}" for i in range(150) for e in ("ing", "ed", "s")]
    texts = [" ".join(r.choices(words[: 20 + i], k=r.randrange(0, 120))) for i in range(250)] + ["Never seen words here", "", None, "W1ing W2ED"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = L.fit(docs, head_size=60)
    v, w = model[1].value, model[2].value
    seen = {}
    for i, t in enumerate(texts):
        if crc(str(i).encode()) % 10:
            for x in [*(t or "").lower().encode().split(), b""]:
                seen[x] = seen.get(x, 0) + 1
    tokens, kinds = {}, {}
    for x, c in seen.items():
        tokens[v.symbol(x)] = tokens.get(v.symbol(x), 0) + c
        kinds[v.symbol(x)] = kinds.get(v.symbol(x), 0) + 1

    def log_share(weights, bias, rows, target):
        z = [float(b) + sum(float(weights[row][i]) for row in rows) for i, b in enumerate(bias)]
        top = max(z)
        return (z[target] - top) - math.log(sum(math.exp(x - top) for x in z))

    got = {x.doc_id: x for x in L.score(docs, model).collect()}
    assert len(got) == len(texts)
    for i in (0, 3, 50, 120, 249, 250, 251, 252, 253):
        before, want = [w.n - 1] * 3, 0.0
        for x in [*(texts[i] or "").lower().encode().split(), b""]:
            s = v.symbol(x)
            p1, p2, p3 = (np.array([p]) for p in before)
            c, place = int(v.cls[s]), int(v.place[s])
            want += log_share(w.cls, v.class_bias, [int(row[0]) for row in w.class_rows(p1, p2, p3)], c)
            want += log_share(w.place, v.in_bias[c], [int(row[0]) for row in w.place_rows(np.array([c]), p1, p2)], place)
            if 0 < s < v.first_word:
                want += math.log((seen.get(x, 0) + 0.1) / (tokens.get(s, 0) + 0.1 * (kinds.get(s, 0) + 1)))
            before = [s, *before[:2]]
        assert abs(got[i].score - want / math.log(10)) < 1e-4 * max(1, abs(want)), i

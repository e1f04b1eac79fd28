import random
import re
from functools import partial

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import quality_resampling as Q

DOCS = "doc_id long, text string, quality string, log_weight double, key string"


def corpus(n=400):
    r = random.Random(7)
    words = [f"{a}{b}" for a in "ba be bi bo bu la le li lo lu".split() for b in "na ne ni no nu ra re ri ro ru".split()]
    docs, labels = [], []
    for i in range(n):
        w = [words[min(99, int(r.paretovariate(0.5)))] for _ in range(r.randrange(8, 150))]
        kind = i % 8
        if kind == 1:
            for x in r.sample("vile nasty foul gross".split(), 3):
                w.insert(r.randrange(len(w)), x + r.choice(["", ".", ","]))
        if kind == 2:
            w = [x + r.choice(["&&&", "***"]) for x in w]
        if kind == 3 and i % 3 == 0:
            w = [x.upper() for x in w]
        docs.append((i, r.choice([" ", "\n"]).join(w), "q", 0.0, "k"))
        bad = kind == 2 or (kind == 3 and i % 3 == 0)
        if i % 3 != 1:
            labels.append((i, int(not bad), int(kind == 1)))
    good = {i for i in range(n) if i % 8 not in (1, 2) and not (i % 8 == 3 and i % 3 == 0)}
    return docs, labels, good


def test_clean_documents_stay_and_bad_ones_go(spark, put):
    docs, labels, good = corpus()
    extra = [(900, None, "q", 0.0, "k"), (901, "", "q", 0.0, "k"), (902, "bana " * 5 + "bena " * 50_000, "q", 0.0, "k"), (0, docs[0][1], "q", 0.0, "k"), (None, "bana bene", "q", 0.0, "k"), (903, "VILE " * 3, "q", 0.0, "k")]
    d = put(documents=spark.createDataFrame(docs + extra, DOCS), labels=spark.createDataFrame(labels + [(0, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int"))
    got = [r.doc_id for r in Q.op4_quality_resampling(spark, d).collect()]
    assert got.count(0) == 2 and got.count(None) == 1 and {900, 901} <= set(got) and 903 not in got
    lost = good - set(got)
    kept_bad = {x for x, *_ in docs if x not in good} & set(got)
    assert len(lost) <= 4 and len(kept_bad) <= 4
    kept = Q.resample(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    assert kept.columns == ["doc_id", "text", "quality", "log_weight", "key"]
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(map(str, got))


def test_fixed_k_at_a_high_temperature_is_the_k_highest_keys(spark):
    docs, labels, _ = corpus(200)
    df, lab = spark.createDataFrame(docs, DOCS).select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ratios, _ = Q.fitted(df, lab)
    keys = {r.doc_id: r.key for r in Q.with_log_weight(df, ratios).select("doc_id", Q.resampling_key(F.col("log_weight"), F.col("doc_id"), 2.0).alias("key")).collect()}
    got = {r.doc_id for r in Q.resample(df, lab, temperature=2.0, k=37).collect()}
    assert got == set(sorted(keys, key=keys.get)[-37:])


def test_kth_highest(spark):
    r = random.Random(1)
    for values in ([1.0] * 5 + [2.0] * 3, [r.gauss(0, 5) for _ in range(300)], [1e-300 * i for i in range(50)] + [1e300], [3.0]):
        df = spark.createDataFrame([(v,) for v in values], "key double")
        for k in (1, 2, len(values) // 2, len(values) - 1):
            if 0 < k < len(values):
                assert Q.kth_highest(df, k, ranges=4) == sorted(values)[-k]
        assert Q.kth_highest(df, len(values)) == float("-inf") and Q.kth_highest(df, 0) == float("inf")


def test_weights_against_brute_force(spark):
    docs, labels, _ = corpus(300)
    docs += [(1000 + i, docs[4][1], "q", 0.0, "k") for i in range(50)] + [(2000, None, "q", 0.0, "k")]
    df, lab = spark.createDataFrame(docs, DOCS).select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    (chosen, logs), held = Q.fitted(df, lab)
    text = {d: t or "" for d, t, *_ in docs}
    grams = {t: set(Q.ngrams(t.encode()).tolist()) for t in text.values()}
    is_good = {(text[d], bool(q and not x)) for d, q, x in labels}
    good, rest = [t for t, ok in is_good if ok], [t for t, ok in is_good if not ok]
    share, want = len(good) / len(is_good), {}
    for g in set().union(*(grams[t] for t, _ in is_good)):
        a, b = sum(g in grams[t] for t in good), sum(g in grams[t] for t in rest)
        n = a + b
        away = (n * share - a) / np.sqrt(n * share * (1 - share) + 1)
        low = np.log((a + Q.PRIOR * share) / (n * share + Q.PRIOR * share))
        if (b >= max(Q.SUPPORT, Q.SHARE * len(rest)) and away >= Q.DEVIATIONS and low <= -Q.LEAST_LOG) or away <= -Q.RAISING:
            raw = sum(g in grams[t] for t in set(text.values()))
            want[g] = np.log((a + Q.PRIOR) / (raw * len(good) / len(set(text.values())) + Q.PRIOR))
    assert want and dict(zip(chosen.tolist(), logs.round(9))) == {g: round(x, 9) for g, x in want.items()}
    weights = {r.doc_id: r.log_weight for r in Q.held_weight(held, logs).collect()}
    direct = {r.doc_id: r.log_weight for r in Q.with_log_weight(df, (chosen, logs)).collect()}
    assert weights == direct
    assert all(abs(weights[d] - sum(want.get(g, 0.0) for g in grams[t])) < 1e-9 for d, t in text.items())


def test_gumbel_noise(spark):
    g = [r.g for r in spark.range(20_000).select(Q.gumbel(F.col("id")).alias("g")).collect()]
    assert abs(np.mean(g) - 0.5772) < 0.03 and abs(np.var(g) - np.pi**2 / 6) < 0.1


def test_without_labels_and_empty(spark, put):
    docs, labels, _ = corpus(20)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    full, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], DOCS)
    assert Q.op4_quality_resampling(spark, put(documents=full, labels=lab.limit(0))).count() == 20
    assert Q.op4_quality_resampling(spark, put(documents=none, labels=lab)).count() == 0


def test_words_that_stand_beside_others_count_too(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(300):
        w = r.choices(words, k=40)
        if i % 5 == 0:
            w[7:7] = ["vile", "so"]
            w[20:20] = ["nasty"]
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 0)))
    # Copies of one bad document are one text, so what only they hold tells nothing.
    copy = " ".join(["vile", "nasty", "peculiar", *r.choices(words, k=40)])
    docs += [(500 + i, copy) for i in range(30)] + [(900, "w1 w2 nasty w3"), (901, "w1 w2 vile w3"), (902, "w1 peculiar w2 w3")]
    labels += [(500 + i, 1, 1) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id for r in Q.resample(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert not got & {900, 901} and 902 in got


def test_ratios_of_both_signs_are_weighed_and_noise_matters(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    docs, labels = [], []
    for i in range(600):
        bad = i % 2 == 0
        w = r.choices(words, k=30)
        # "odd" is in many bad documents and few good ones, "fine" the other way round.
        if r.random() < (0.5 if bad else 0.06):
            w[3:3] = ["odd"]
        if r.random() < (0.06 if bad else 0.9):
            w[20:20] = ["fine", "and", "kind", "too"]
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs += [(900, "odd one"), (901, "odd one fine and kind too")]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    (hashes, logs), _ = Q.fitted(df, lab)
    assert (logs > 0).any() and (logs < 0).any()
    weight = lambda t: Q.weigh(t.encode(), hashes, logs)
    assert weight("odd one") < Q.CUT < 0 < weight("odd one fine and kind too")
    # At the temperature used, noise decides between weights that are close and not between those far apart.
    close = spark.range(2000).select("id", Q.resampling_key(-0.5 * (F.col("id") % 2), F.col("id")).alias("key"))
    far = spark.range(2000).select("id", Q.resampling_key(-6.0 * (F.col("id") % 2), F.col("id")).alias("key"))
    odd = [df.filter(F.col("key") >= Q.kth_highest(df, 1000)).filter("id % 2 = 1").count() for df in (close, far)]
    assert odd[0] > 50 and odd[1] < 10


def plain_ngrams(text):
    """As ngrams(), a text and a token at a time."""
    found = [xxhash.xxh64_intdigest(t) for t in re.findall(rb"[\w\x80-\xff]+|[^\w\s\x80-\xff]+", text.lower())]
    out = [*found, *((a * 0x9E3779B97F4A7C15 + (b ^ 0x85EBCA77C2B2AE63) * 0xC2B2AE3D27D4EB4F) % (1 << 64) for a, b in zip(found, found[1:]))]
    shouts = len(re.findall(rb"(?<![\w\x80-\xff])[A-Z]{3,}(?![\w\x80-\xff])", text))
    runs = "".join("x" if a == b else " " for a, b in zip(found, found[1:]))
    out += [Q.SHOUTING] * (shouts >= 3 and shouts * 10 >= len(found)) + [Q.REPEATING] * ("x" * Q.RUN in runs)
    return out + [Q.DOUBLING] * (runs.count("x") >= max(3, len(found) / 5))


def odd_texts():
    r = random.Random(8)
    bits = ["A", "b", "ABC", "ABC ", "abc", " ", "  ", "\n", "!", "!! ", "é", "ABCé", "_", "A_B", "\0", "\v", "\x1c", "\u3000", "go GO go ", "no " * 7, "no " * 8]
    texts = ["".join(r.choices(bits, k=r.randrange(30))).encode() for _ in range(2000)]
    texts += [b" ".join([b"NOW"] * r.randrange(12) + [b"a", b"b"] * r.randrange(20)) for _ in range(300)]
    return texts + [b"", b" ", b"\n\n", b"", *(bytes(r.randrange(256) for _ in range(r.randrange(60))) for _ in range(500)), b""]


@pytest.mark.parametrize("size", [1, 300, 1 << 22])
def test_texts_taken_apart_together_hold_what_each_holds(size, monkeypatch):
    monkeypatch.setattr(Q, "portions", partial(Q.portions, size=size))
    texts = odd_texts()
    want = [plain_ngrams(t) for t in texts]
    assert [sorted(Q.ngrams(t).tolist()) for t in texts] == [sorted(w) for w in want]
    assert [x.tolist() for x in Q.different_ngrams(texts)] == [sorted(set(w)) for w in want]
    every = sorted(set().union(*want))
    chosen = sorted({Q.SHOUTING, Q.REPEATING, Q.DOUBLING, *every[::3]} - {max(every)})
    logs = np.random.default_rng(1).normal(size=len(chosen))
    at = {g: i for i, g in enumerate(chosen)}
    of, numbers = Q.held_by(texts, np.array(chosen, np.uint64))
    held = [sorted(at[g] for g in set(w) if g in at) for w in want]
    assert list(zip(of.tolist(), numbers.tolist())) == [(i, x) for i, xs in enumerate(held) for x in xs]
    weights = Q.weights_of(texts, np.array(chosen, np.uint64), logs)
    assert np.allclose(weights, [sum(logs[x] for x in xs) for xs in held], atol=1e-9)
    assert weights.tolist() == [Q.weigh(t, np.array(chosen, np.uint64), logs) for t in texts]
    for some in ([], [b"", b" "]):
        none = Q.weights_of(some, np.array(chosen, np.uint64), logs)
        assert none.dtype == np.float64 and none.tolist() == [0.0] * len(some) == Q.weights_of(some, np.zeros(0, np.uint64), np.zeros(0)).tolist()


def test_each_different_word_is_hashed_once(monkeypatch):
    hashed, real = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(Q.xxhash, "xxh64_intdigest", lambda w: hashed.append(w) or real(w))
    assert len(Q.ngrams(b"the same few words said " * 5000)) == 49_999 and len(hashed) == 5

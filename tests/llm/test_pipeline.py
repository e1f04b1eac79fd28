import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tallyloom.llm import best_fit_packing as P  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near(r, words, w, share):
    return [r.choice(words) if r.random() < share else x for x in w]


def corpus():
    r = random.Random(11)
    words = [f"{a}{b}{c}" for a in "ba be bi bo".split() for b in "na ne ni no nu".split() for c in ("", "s", "ta", "re", "lo")]
    items = [(i, " ".join(r.choices(words, k=30))) for i in range(5)]
    docs, labels, lost = [], [], set()
    add = lambda w: docs.append((len(docs), " ".join(w), "en", "s", 0)) or len(docs) - 1
    for i in range(300):
        w = r.choices(words, k=r.randrange(60, 300))
        kind = i % 10
        if kind == 1:
            w[3:3] = ["vile", "gross"]
        if kind == 2:
            h = items[i % 5][1].split()
            w[5:5] = h[15:] + ["zz"] + h[:15]
        n = add(w)
        labels.append((n, 1, int(kind == 1)))
        if kind in (1, 2):
            lost.add(n)
        if kind == 3:
            for _ in range(r.choice([1, 4])):
                lost.add(add(w))
        if kind == 4:
            copy = near(r, words, w, 0.003)
            n = add(copy)
            # What the stage promises: five words, similarity (Jaccard) of 0.8 or more.
            if similarity(w, copy) >= 0.8:
                lost.add(n)
    return docs, labels, items, lost


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(a & b) / len(a | b)


def test_every_stage_takes_effect_and_keeps_the_rest(spark, put):
    docs, labels, items, lost = corpus()
    d = put(documents=spark.createDataFrame(docs, SCHEMA), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    src = spark.read.parquet(f"{d}/documents.parquet")
    at = src
    for _, stage in pipeline.STAGES[:-1]:
        at = stage(spark, at, d)
        assert at.columns == src.columns
    kept = {r.doc_id for r in at.collect()}
    assert kept == {x for x, *_ in docs} - lost
    rows = pipeline.run(spark, d).collect()
    assert {r.doc_id for r in rows} == kept
    whole = P.packed_documents(src.filter(src.doc_id.isin(sorted(kept)))).collect()
    digest = lambda rs: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert digest(rows) == digest(whole)


def test_hard_rows(spark, put):
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (3, "same text here", "en", "s", 1), (3, "same text here", "en", "s", 1), (None, "no id", None, None, None), (4, "long " * 50_000, "en", "s", 1)]
    d = put(documents=spark.createDataFrame(rows, SCHEMA), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id long, text string"))
    got = [r.doc_id for r in pipeline.run(spark, d).collect()]
    # Documents 1 and 2 are both empty, so the first stays.
    assert set(got) == {1, 3, 4, None} and got.count(3) == 1
    empty = put(documents=spark.createDataFrame([], SCHEMA))
    assert pipeline.run(spark, empty).count() == 0

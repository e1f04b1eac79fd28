import random

from tallyloom.llm import token_counts as C

SCHEMA = "doc_id long, text string, n_words string, n_tokens long"


def greedy(word, pieces, longest):
    s, n, at = (*word, C.END), 0, 0
    while at < len(s):
        for end in range(min(len(s), at + longest), at, -1):
            if s[at:end] in pieces:
                break
        else:
            return 1
        n, at = n + 1, end
    return n


def test_automaton_against_greedy():
    r = random.Random(1)
    for _ in range(300):
        pieces = {tuple(r.choices([0, 1, 2], k=r.randrange(1, 6))) + ((C.END,) if r.random() < 0.4 else ()) for _ in range(r.randrange(1, 15))}
        if r.random() < 0.6:
            pieces |= {(c,) for c in (0, 1, 2)} | {(c, C.END) for c in (0, 1, 2)}
        a = C.Automaton(pieces)
        for _ in range(40):
            word = bytes(r.choices([0, 1, 2], k=r.randrange(1, 12)))
            assert a.count(word) == greedy(word, pieces, 7), (pieces, word)


def test_query_against_greedy(spark, put):
    rows = [(1, "The quick brownish été don't 1234 日本 !!! naïve"), (2, None), (3, ""), (4, "x" * 100_000), (5, " \t\r\n"), (6, "ofthe " * 50_000), (7, "É É"), (7, "É É"), (None, "<|endoftext|>")]
    d = put(documents=spark.createDataFrame([(*x, "w", 1) for x in rows], SCHEMA))
    pieces = set(C.vocabulary_pieces(C.VOCABULARY))
    longest = max(map(len, pieces))
    want = []
    for i, t in rows:
        words = C.words_of(t or "")
        want.append((i, len(words), sum(greedy(w, pieces, longest) for w in words)))
    got = sorted(map(tuple, C.op10_token_counts(spark, d).collect()), key=repr)
    assert got == sorted(want, key=repr)


def test_real_documents_and_empty(spark, sf_dir, put):
    pieces = set(C.vocabulary_pieces(C.VOCABULARY))
    longest = max(map(len, pieces))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30).collect()}
    for r in C.op10_token_counts(spark, sf_dir).collect():
        if r.doc_id in texts:
            assert r.n_tokens == sum(greedy(w, pieces, longest) for w in C.words_of(texts[r.doc_id]))
    assert C.op10_token_counts(spark, put(documents=spark.createDataFrame([], SCHEMA))).count() == 0

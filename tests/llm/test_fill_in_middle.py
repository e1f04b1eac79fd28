import hashlib
import random

import duckdb

from tallyloom.llm import fill_in_middle as M

SCHEMA = "doc_id long, text string, n string, form string, output string"
MARKS = ("<P>", "<S>", "<M>")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in MARKS) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, n, form, a, b - a, sha(out), sha(text))


def corpus():
    r = random.Random(11)
    alphabet = ["a", "é", "é", "😀", "👨‍👩‍👧", "\n", "\r", " ", "<", ">", "P", "S", "M", "<S", "\0", "日", " ", "\\", "'"]
    rows = [(i, "".join(r.choices(alphabet, k=r.randrange(0, 90)))) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (None, "no id " * 9), (2002, "x<P>"), (2003, "<M>y"), (2004, "a" * 3_000_000), (2005, "é😀" * 700_000), (-9, "negative"), (3, "again"), (3, "again")]
    rows += [(3000 + i, t * k) for i, (t, k) in enumerate((t, k) for t in ("<", "<S", "S>", ">") for k in (1, 15, 16, 17, 32, 33))]
    return [(d, t, "n", "f", "o") for d, t in rows]


def test_against_slices(spark, put, monkeypatch):
    monkeypatch.setattr(M, "TOGETHER", 5000)
    rows = corpus()
    got = M.op11_fill_in_middle(spark, put(documents=spark.createDataFrame(rows, SCHEMA)))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = [brute(d, t) for d, t, *_ in rows]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_outputs_and_rates(spark):
    docs = spark.createDataFrame([(i, "abcdefgh") for i in range(2000)], "doc_id long, text string")
    got = M.fill_in_middle(docs, rate=50, spm=100).collect()
    cut = [r for r in got if r.form != "plain"]
    assert {r.form for r in cut} == {"spm"} and 900 < len(cut) < 1100
    r = cut[0]
    text, a, b = "abcdefgh", r.prefix_chars, r.prefix_chars + r.middle_chars
    assert r.output == f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    assert all(r.output == text for r in M.fill_in_middle(docs, rate=0).collect())


def test_restoring_reads_only_output_and_form(spark):
    made = spark.createDataFrame([("psm", "<P>a<S>c<M>b", 7), ("spm", "<S><P><<M>S", 8), ("plain", "<P>a<S>c<M>b", 9)], "form string, output string, doc_id int")
    assert [(r.doc_id, r.restored) for r in M.restore(made).orderBy("doc_id").collect()] == [(7, "abc"), (8, "<S"), (9, "<P>a<S>c<M>b")]


def test_empty(spark, put):
    assert M.op11_fill_in_middle(spark, put(documents=spark.createDataFrame([], SCHEMA))).count() == 0


def test_sql(spark, sf_dir, put):
    for d in (f"{sf_dir}/documents.parquet", f"{put(documents=spark.createDataFrame(corpus(), SCHEMA))}/documents.parquet/*.parquet"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}'")
        got = M.op11_fill_in_middle(spark, d.split("/documents")[0]).collect()
        assert sorted(con.execute(M.OP11_SQL).fetchall(), key=repr) == sorted(map(tuple, got), key=repr)

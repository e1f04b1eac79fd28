import hashlib

from tallyloom.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, head string"
HARD = ["", "</s>", "[INST] ok [/INST]", "\\", "a\\", "\\\\</s>", "<\\s>", "<s>[ROLE]x[/ROLE] y", "<</s>", "a\nb\r\n", "[/ROLE] ", "é" * 5000 + "</s>", "\\[INST]", "</\\s>", "x" * 300_000]


def brute(rows):
    convs = {}
    for conv, turn, role, text, _ in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        learn = "".join(t for _, _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learn), hashlib.sha256(learn.encode()).hexdigest())
    return out


def test_round_trip_of_hard_texts(spark, put):
    rows = [(1, i, role, text, "h") for i, (role, text) in enumerate((r, t) for r in ("user", "assistant", "system", "tool", "[/ROLE] ", "r\\", None) for t in HARD)]
    rows += [(2, 0, "assistant", None, None), (2, 0, "assistant", "b", None), (2, 0, "assistant", "b", None), (2, None, "user", "first", None), (None, 3, "user", "no id", None)]
    d = put(conversations=spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.op1_chat_format(spark, d).collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]", ""), (-7, 1, "assistant", "</s>[INST] ok [/INST]", "")]
    assert got == brute(rows)


def test_controls_stand_only_where_the_grammar_has_them(spark):
    df = C.format_conversations(spark.createDataFrame([(1, 0, "user", "</s>[INST] ok [/INST]", "")], SCHEMA))
    assert df.first().formatted == "<s>[INST] <\\/s>[\\INST] ok [\\/INST]</s>"


def test_empty(spark, put):
    d = put(conversations=spark.createDataFrame([], SCHEMA))
    assert [r.conv_id for r in C.op1_chat_format(spark, d).collect()] == [-7]


def test_native(spark, sf_dir):
    plan = C.op1_chat_format(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = sorted(con.execute(C.OP1_SQL).fetchall())
    assert sorted(map(tuple, C.op1_chat_format(spark, sf_dir).collect())) == want

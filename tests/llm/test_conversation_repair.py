import hashlib
import itertools
import random
import re
import zlib

import duckdb

from tallyloom.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, kept string, counted string, nth string"
BARE = " \t\n\x0b\x0c\r"


def after_damage(rows):
    """conv -> turns after damage, in order; every conversation."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        role = "user" if kind == 4 else role
        out.setdefault(conv, [])
        out[conv] += [(turn is not None, turn or 0, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(t) for c, t in out.items()}


def faults(turns):
    seen, out = set(), []
    for _, _, role, text in turns:
        bare = text.strip(BARE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(turns):
    """Every edit at every place, without the fold's shortcuts: all strings by cost and audit."""
    states = {"": (0, "", ())}  # the initials so far, cut down to what the grammar needs
    push = lambda d, k, v: d.__setitem__(k, min(d.get(k, v), v))

    def inserted(states):
        for _ in range(3):
            for k, (c, a, o) in list(states.items()):
                role = "assistant" if k == "u" else "user"
                push(states, role[0], (c + 5, a + "I", (*o, f"{role}:")))
        return states

    for (_, _, role, text), fault in zip(turns, faults(turns)):
        new = {}
        for k, (c, a, o) in inserted(states).items():
            push(new, k, (c + 2, a + "D", o))
            if fault in ("blank", "duplicate"):
                continue
            c += 5 * (fault == "truncated")
            need = "a" if k == "u" else "u"
            if role[:1] == need or (role[:1] == "s" and k == ""):
                push(new, role[:1], (c, a + "K", (*o, f"{role}:{text}")))
            name = {"a": "assistant", "u": "user"}[need]
            push(new, need, (c + 1, a + "R", (*o, f"{name}:{text}")))
        states = new
    return min(v for k, v in inserted(states).items() if k in ("", "a"))


def brute(rows):
    out = set()
    for conv, turns in after_damage(rows).items():
        fault = faults(turns)
        numbers = [t for known, t, *_ in turns if known]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, lines = best(turns)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.add((conv, gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost, audit, digest))
    return out


def hard_rows():
    r = random.Random(13)
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "sys", "ux"]
    texts = ["Yes.", "No!", "why", "", " \t\r", None, "a.\n ", " ", "\x85", "é?", ".", "x. "]
    rows = []
    for conv in range(700):
        for turn in range(r.randrange(1, 9)):
            number = r.choice([turn, turn, turn * 2, None, 0, -turn])
            rows.append((conv, number, r.choice(roles), r.choice(texts), "k", "c", "n"))
    rows += [(None, 0, "user", "no id.", "k", "c", "n"), (None, None, None, None, None, None, None)]
    rows += [(900, i, ("user", "assistant")[i % 2], f"Turn {i}." * 50_000, None, None, None) for i in range(4)]
    rows += [(901, i % 40, ("user", "assistant", "system")[i % 3], f"{i % 97}", None, None, None) for i in range(1500)]
    # Conversations all of whose turns are dropped, and repeated rows.
    gone = [c for c in range(1000, 1200) if zlib.crc32(f"{c}:1".encode()) % 20 == 0]
    assert gone
    rows += [(c, 1, "user", "x.", None, None, None) for c in gone]
    return rows + rows[:40]


def test_against_every_edit(spark, put):
    rows = hard_rows()
    d = put(conversations=spark.createDataFrame(rows, SCHEMA))
    got = C.op13_conversation_repair(spark, d)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert set(map(tuple, got.collect())) == brute(rows)
    assert got.count() == len({r[0] for r in rows})


def test_the_repair_obeys_the_grammar_and_may_be_used_without_damage(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (2, 0, "system", "Be short."), (3, 0, "user", "a."), (3, 1, "user", "b."), (3, 2, "assistant", "c")]
    got = {r.conv_id: r for r in C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    # 1: both roles change (2), against deleting the first and adding an answer (7).
    assert (got[1].cost, got[1].audit, [tuple(t) for t in got[1].turns]) == (2, "RR", [("user", "Hello."), ("assistant", "Hi.")])
    assert (got[2].cost, got[2].audit, got[2].turns) == (2, "D", [])
    # 3: the open answer goes (2) and the second question becomes the answer (1).
    assert (got[3].cost, got[3].audit, [tuple(t) for t in got[3].turns]) == (3, "KRD", [("user", "a."), ("assistant", "b.")])


def test_empty(spark, put):
    assert C.op13_conversation_repair(spark, put(conversations=spark.createDataFrame([], SCHEMA))).count() == 0


def test_native_and_one_shuffle(spark, sf_dir):
    plan = C.op13_conversation_repair(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_sql(spark, sf_dir, put):
    for d in (sf_dir, put(conversations=spark.createDataFrame([r for r in hard_rows() if (r[0] or 0) < 900], SCHEMA))):
        con = duckdb.connect()
        path = f"{d}/conversations.parquet" + ("" if d == sf_dir else "/*.parquet")
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
        assert set(con.execute(C.OP13_SQL).fetchall()) == set(map(tuple, C.op13_conversation_repair(spark, d).collect()))

"""Conversation structure repair by a higher-order fold (native DataFrame expressions only).

Windows flag each turn's fault; a conversation's turns are collected in order; ``aggregate()`` then folds them through
four structs (cost, audit), one for each place in the grammar ``(s?(ua)+)?`` of role initials:

    none   nothing is kept yet               lead   a leading system turn is kept
    asked  the last kept turn is a user's    told   the last kept turn is an assistant's

A turn is kept (K, cost 0), gets the role user or assistant (R, 1) or goes (D, 2; the only choice for blank and duplicate
turns); an empty turn may be inserted anywhere (I, 5); a truncated turn that stays costs 5 more.  ``least`` on the structs
takes the cheapest way to each place and of equal ones the audit that is first in ASCII.  That is exact: audits that lead to
one place at one cost have read the same turns, and neither can start with the other, as each further I costs.  Of insertions only
one, just before a kept turn, has to be tried, and those that complete the end: one before a deletion moves behind it at
the same cost to an audit that is smaller, and two in a row cost more than doing without.  The audit alone tells the repair: every
role that isn't kept follows from its place.

A conversation is one row, so its turns meet in one task, and an audit is copied once a turn.

Defined results: a null role or text is one space; a null turn sorts first and takes no part in gaps; turns with equal numbers
are ordered by role, then text; repeated rows are duplicates; a null conv_id is a conversation of its own; role initials other
than s, u and a (an empty role too) can't be kept; a conversation without counted rows has zeros and an empty
repair; empty input gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import table

#: The white space that [^\x20\x09-\x0D] leaves out, and the ends of a whole text.
SPACE, STOPS = " \t\n\x0b\x0c\r", (".", "!", "?")
REROLE, DELETE, TRUNCATED, INSERT = 1, 2, 5, 5
PLACES = ("none", "lead", "asked", "told")
STATE = "struct<cost:bigint,audit:string>"
FOLLOWS = ("su", "ua", "au")


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, kept): the turns damaged by the checksum of ``conv_id:turn``; nulls are one space.

    Dropped rows stay with kept = false, so that their conversation is known.
    """
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    src = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))), F.lit(20)).alias("_kind"))
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.array_repeat(kind != 0, F.when(kind == 3, 2).otherwise(1)))
    return src.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("kept"))


def flagged(rows: DataFrame, conv: str, turn: str, role: str, text: str, counted: Column | bool) -> DataFrame:
    """The turns with nth (of equal role and text in the conversation), initial, fault, illegal and fresh (first of its number)."""
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    src = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), shown(role).alias("role"), shown(text).alias("text"), F.coalesce(F.lit(counted) if isinstance(counted, bool) else counted, F.lit(False)).alias("counted"))
    # One shuffle serves both windows and the collection.
    mine = Window.partitionBy("conv_id", "counted")
    numbered = src.repartition("conv_id").withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "counted", "role", "text").orderBy("turn")))
    bare = numbered.withColumn("initial", F.left("role", F.lit(1))).withColumn("bare", F.btrim("text", F.lit(SPACE)))
    fault = F.when(F.col("bare") == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.right("bare", F.lit(1)).isin(*STOPS), "truncated")
    order = mine.orderBy("turn", "role", "text", "nth")
    pair = F.concat(F.lag("initial").over(order), "initial")
    fresh = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order))
    return bare.select("conv_id", "turn", "role", "text", "counted", "nth", "initial", fault.alias("fault"), (~pair.isin(*FOLLOWS)).alias("illegal"), fresh.alias("fresh"))


def fold(turns: Column) -> Column:
    """(cost, audit) of the cheapest repair of turns (initial, gone, late, ...)."""

    def go(state: Column, mark: Column | str, cost: Column | int, where: Column | bool = True) -> Column:
        """The state after a step, or null where there's no such step."""
        mark = F.lit(mark) if isinstance(mark, str) else mark
        return F.when(state.isNotNull() & where, F.struct((state["cost"] + cost).cast("long").alias("cost"), F.concat(state["audit"], mark).alias("audit")))

    def step(acc: Column, turn: Column) -> Column:
        none, lead, asked, told = (acc[p] for p in PLACES)
        stays, late = ~turn["gone"], turn["late"]
        deleted = {p: go(acc[p], "D", DELETE) for p in PLACES}

        def taken(state: Column, initial: str, inserts: int = 0) -> Column:
            own = turn["initial"] == initial
            mark = F.when(own, "I" * inserts + "K").otherwise("I" * inserts + "R")
            return go(state, mark, F.when(own, 0).otherwise(REROLE) + late + inserts * INSERT, stays)

        after = {
            "none": deleted["none"],
            "lead": F.least(deleted["lead"], go(none, "K", late, stays & (turn["initial"] == "s"))),
            "asked": F.least(deleted["asked"], taken(none, "u"), taken(lead, "u"), taken(told, "u"), taken(asked, "u", 1)),
            "told": F.least(deleted["told"], taken(asked, "a"), taken(none, "a", 1), taken(lead, "a", 1), taken(told, "a", 1)),
        }
        return F.struct(*(after[p].alias(p) for p in PLACES))

    start = F.struct(F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")).cast(STATE).alias("none"), *(F.lit(None).cast(STATE).alias(p) for p in PLACES[1:]))
    end = lambda acc: F.least(acc["none"], acc["told"], go(acc["asked"], "I", INSERT), go(acc["lead"], "II", 2 * INSERT))
    return F.aggregate(turns, start, step, end)


def repaired(turns: Column, audit: Column) -> Column:
    """The turns (role, text) that an audit leaves."""
    parts, rest = F.regexp_extract_all(audit, F.lit("I*[DKR]"), F.lit(0)), F.regexp_extract(audit, "I*$", 0)
    entry = lambda role, text: F.struct(role.cast("string").alias("role"), text.alias("text"))
    inserted = lambda part: F.array_repeat(entry(F.lit(None), F.lit("")), F.length(F.regexp_replace(part, "[DKR]", "")))

    def made(turn: Column, i: Column) -> Column:
        part = F.get(parts, i)
        own = F.array_repeat(entry(F.when(part.endswith("K"), turn["role"]), turn["text"]), F.when(part.endswith("D"), 0).otherwise(1))
        return F.concat(inserted(part), own)

    out = F.concat(F.flatten(F.transform(turns, made)), inserted(rest))
    # Behind a leading system turn, users and assistants take turns.
    lead = F.coalesce(F.startswith(F.get(out, F.lit(0))["role"], F.lit("s")), F.lit(False)).cast("int")
    name = lambda i: F.when((i + lead) % 2 == 0, "user").otherwise("assistant")
    return F.transform(out, lambda x, i: entry(F.coalesce(x["role"], name(i)), x["text"]))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", counted: Column | bool = True) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns (role, text) as repaired.

    Rows for which ``counted`` doesn't hold only make their conversation known.
    """
    turns = flagged(rows, conv, turn, role, text, counted)
    is_ = lambda name: F.col("fault").eqNullSafe(name)
    count = lambda what: F.count(F.when(F.col("counted") & what, 1))
    mine = F.when(F.col("counted"), F.col("turn"))
    late = F.when(is_("truncated"), TRUNCATED).otherwise(0).alias("late")
    entry = F.struct("turn", "role", "text", "nth", "initial", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("gone"), late)
    whole = turns.groupBy("conv_id").agg(
        F.coalesce(F.max(mine) - F.min(mine) + 1 - count(F.col("fresh")), F.lit(0)).cast("long").alias("gaps"),
        *(count(is_(x)).alias(x) for x in ("blank", "duplicate", "truncated")),
        count(F.col("illegal")).alias("illegal"),
        F.sort_array(F.collect_list(F.when(F.col("counted"), entry))).alias("turns"),
    )
    best = whole.withColumn("best", fold(F.col("turns")))
    return best.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), repaired(F.col("turns"), F.col("best.audit")).alias("turns"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    found = repair(damage(table(spark, sf_dir, "conversations")), counted=F.col("kept"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.concat_ws("\n", lines), 256).alias("repaired_sha256"))


#: The checksum bit by bit; then all states and every place of an insertion, turn by turn.
OP13_SQL = """
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(
      list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, b: list_reduce(range(8), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, xor(c, b)),
      4294967295)) % 20 AS kind
  FROM conversations),
rows_ AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy_
  FROM src WHERE kind <> 0),
k AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy_) AS nth FROM rows_),
o AS (
  SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before_, left(role, 1) AS ini,
    trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth)),
f AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before_ || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM f GROUP BY conv_id),
m AS (
  SELECT conv_id, i, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS late, ini, role, text FROM f),
-- A state: cost, audit, lines so far.
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {'c': 0, 'a': '', 'o': ['']} AS n, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, o VARCHAR[])) AS s,
    CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, o VARCHAR[])) AS u, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, o VARCHAR[])) AS t
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, n2,
    list_min(list_filter([s2, sk], lambda x: x.c IS NOT NULL)),
    list_min(list_filter([u2, list_min(list_filter([nx, sx, tx], lambda x: x.c IS NOT NULL))], lambda x: x.c IS NOT NULL)),
    list_min(list_filter([t2, ux], lambda x: x.c IS NOT NULL))
  FROM (
    SELECT p.conv_id, m.i,
      {'c': p.n.c + 2, 'a': p.n.a || 'D', 'o': p.n.o} AS n2,
      {'c': p.s.c + 2, 'a': p.s.a || 'D', 'o': p.s.o} AS s2,
      {'c': p.u.c + 2, 'a': p.u.a || 'D', 'o': p.u.o} AS u2,
      {'c': p.t.c + 2, 'a': p.t.a || 'D', 'o': p.t.o} AS t2,
      CASE WHEN NOT gone AND ini = 's' THEN {'c': p.n.c + late, 'a': p.n.a || 'K', 'o': list_append(p.n.o, role || ':' || text)} END AS sk,
      CASE WHEN NOT gone THEN {'c': p.n.c + late + CASE WHEN ini = 'u' THEN 0 ELSE 1 END, 'a': p.n.a || CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END, 'o': list_append(p.n.o, CASE WHEN ini = 'u' THEN role ELSE 'user' END || ':' || text)} END AS nx,
      CASE WHEN NOT gone THEN {'c': p.s.c + late + CASE WHEN ini = 'u' THEN 0 ELSE 1 END, 'a': p.s.a || CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END, 'o': list_append(p.s.o, CASE WHEN ini = 'u' THEN role ELSE 'user' END || ':' || text)} END AS sx,
      CASE WHEN NOT gone THEN {'c': p.t.c + late + CASE WHEN ini = 'u' THEN 0 ELSE 1 END, 'a': p.t.a || CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END, 'o': list_append(p.t.o, CASE WHEN ini = 'u' THEN role ELSE 'user' END || ':' || text)} END AS tx,
      CASE WHEN NOT gone THEN {'c': p.u.c + late + CASE WHEN ini = 'a' THEN 0 ELSE 1 END, 'a': p.u.a || CASE WHEN ini = 'a' THEN 'K' ELSE 'R' END, 'o': list_append(p.u.o, CASE WHEN ini = 'a' THEN role ELSE 'assistant' END || ':' || text)} END AS ux
    FROM (
      SELECT conv_id, i, n, s, list_min(list_filter([u, ni, si, ti], lambda x: x.c IS NOT NULL)) AS u, list_min(list_filter([t, ui], lambda x: x.c IS NOT NULL)) AS t
      FROM (
        SELECT conv_id, i, n, s, u, t,
          {'c': n.c + 5, 'a': n.a || 'I', 'o': list_append(n.o, 'user:')} AS ni, {'c': s.c + 5, 'a': s.a || 'I', 'o': list_append(s.o, 'user:')} AS si,
          {'c': t.c + 5, 'a': t.a || 'I', 'o': list_append(t.o, 'user:')} AS ti, {'c': u.c + 5, 'a': u.a || 'I', 'o': list_append(u.o, 'assistant:')} AS ui
        FROM dp)) AS p
    JOIN m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i + 1)),
e AS (
  SELECT dp.conv_id, list_min(list_filter([dp.n, dp.t, {'c': dp.u.c + 5, 'a': dp.u.a || 'I', 'o': list_append(dp.u.o, 'assistant:')},
      {'c': dp.s.c + 10, 'a': dp.s.a || 'II', 'o': list_concat(dp.s.o, ['user:', 'assistant:'])}], lambda x: x.c IS NOT NULL)) AS b,
    c.gaps, c.blank, c.duplicate, c.truncated, c.illegal
  FROM dp LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE dp.i = coalesce(c.n, 0))
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(b.c AS BIGINT) AS cost, b.a AS audit,
  sha256(array_to_string(b.o[2:], chr(10))) AS repaired_sha256
FROM e
"""

QUERIES = {"op13_conversation_repair": op13_conversation_repair}
SQL = {"op13_conversation_repair": OP13_SQL}

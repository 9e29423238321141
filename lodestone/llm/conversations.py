"""Rebuilding conversations from message rows (problem 3).

The clocks of user and assistant differ by an unknown offset per conversation. Every reply gives a constraint: it comes
after the message that it answers and before the next one. With g the observed step between neighbouring turns and
s = +1 for user to assistant, -1 for the way back and 0 else, g = m + s * d + noise; the least-squares offset d has a
closed form in six sums, and the constraints bound it from both sides. Where they are broken, times of the assistant are
corrected by d, the two streams are merged by turn number and corrected time, and conversations whose constraints no
offset can meet are rejected.

Which turns are neighbours is told by turn numbers, or without them by rank: each sender's own messages are in order of
its own clock, and if there are as many replies as messages of the user, the k-th reply answers the k-th of these.

TESTDATA.md fixes the order in which p3_found judges a conversation: by turn number where it has them, else by
created_at as it stands. So p3_found drops for its listed reasons only, and offsets and infeasible clocks act on what
p3_conversations makes of the rest. All work is on sums and extremes that combine before the shuffle, or on blocks of
512 turns or one hour, so one session may hold a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.names import has_visible_text, norm_name
from lodestone.sources.tables import read_table

# Spellings of the three roles after norm_name().
USER = ("user", "human", "customer", "client")
ASSISTANT = ("assistant", "ai", "bot", "model", "agent")
SYSTEM = ("system", "sys", "developer")

BLOCK = 512
HOUR_US = 3_600_000_000


def prepared(df: DataFrame) -> DataFrame:
    """Messages with a usable session_id: session_id, id, content, t (microseconds), turn, role (1 user, 2 assistant, 3 system, 0 none), shown."""
    role = norm_name(F.col("role"))
    code = F.when(role.isin(*USER), 1).when(role.isin(*ASSISTANT), 2).when(role.isin(*SYSTEM), 3).otherwise(0)
    return df.where("session_id <> ''").select(
        "session_id",
        "id",
        "content",
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"),
        F.expr("try_cast(get_json_object(metadata_json, '$.turn') as bigint)").alias("turn"),
        code.alias("role"),
        has_visible_text(F.col("content")).alias("shown"),
    )


def per_turn(m: DataFrame) -> DataFrame:
    """One row per session and turn number (null: all messages without one), with sums and extremes only."""
    spoken = F.col("shown") & F.col("role").isin(1, 2)
    at = F.when(spoken, F.coalesce("t", F.lit(0)) * 4 + F.col("role"))
    return m.groupBy("session_id", "turn").agg(
        F.min(at).alias("lo"),
        F.max(at).alias("hi"),
        F.min(F.when(spoken & (F.col("role") == 1), F.col("t"))).alias("user_lo"),
        F.min(F.when(spoken & (F.col("role") == 2), F.col("t"))).alias("bot_lo"),
        F.max(F.when(spoken & (F.col("role") == 1), F.col("t"))).alias("user_hi"),
        F.max(F.when(spoken & (F.col("role") == 2), F.col("t"))).alias("bot_hi"),
        F.max((F.col("shown") & (F.col("role") == 0)).cast("int")).alias("bad"),
        F.sum(spoken.cast("bigint")).alias("spoken"),
    )


def fitted(steps: DataFrame) -> DataFrame:
    """session_id, d, clock_ok from steps (session_id, s, g): least squares in closed form, clipped to the bounds that the
    constraints set, less an eighth of the room between them, so that no reply falls on what it answers. Without a broken constraint the clocks agree and d is 0; clock_ok is false where the bounds
    contradict each other, and d is 0 there too."""
    x = steps.groupBy("session_id").agg(
        F.count("*").alias("n"), F.sum("s").alias("ss"), F.sum(F.abs("s")).alias("sq"), F.sum("g").alias("sg"), F.sum(F.col("s") * F.col("g")).alias("sp"),
        F.min(F.when(F.col("s") == 1, F.col("g"))).alias("top"), (-F.min(F.when(F.col("s") == -1, F.col("g")))).alias("low"),
    )
    det = F.col("n") * F.col("sq") - F.col("ss") * F.col("ss")
    fit = F.when(det > 0, (F.col("n") * F.col("sp") - F.col("ss") * F.col("sg")) / det).otherwise(F.lit(0.0))
    broken = (F.coalesce("top", F.lit(0.0)) < 0) | (F.coalesce("low", F.lit(0.0)) > 0)
    ok = F.coalesce(F.col("low") <= F.col("top"), F.lit(True))
    off = F.coalesce((F.col("top") - F.col("low")) / 8, F.lit(1.0))
    d = F.when(broken & ok, F.greatest(F.least(fit, F.col("top") - off), F.col("low") + off)).otherwise(F.lit(0.0))
    return x.select("session_id", d.cast("bigint").alias("d"), ok.alias("clock_ok"))


def clock_offsets(turns: DataFrame) -> DataFrame:
    """Offset of the assistant's clock per session with turn numbers: session_id, d (microseconds), clock_ok."""
    k = F.floor(F.col("turn") / BLOCK)
    # a turn that begins a block also ends the block before it, so no step is lost
    rows = turns.where("turn is not null and lo is not null").select(
        "session_id", "turn", (F.col("lo") % 4).alias("r"), F.floor(F.col("lo") / 4).alias("t"), F.explode(F.when(F.col("turn") % BLOCK == 0, F.array(k - 1, k)).otherwise(F.array(k))).alias("k")
    )
    w = Window.partitionBy("session_id", "k").orderBy("turn")
    step = rows.select("session_id", ((F.lead("r").over(w) - F.col("r")).alias("s")), (F.lead("t").over(w) - F.col("t")).cast("double").alias("g"), (F.lead("turn").over(w) - F.col("turn")).alias("n")).where("n = 1")
    return fitted(step)


def paired_offsets(m: DataFrame) -> DataFrame:
    """Offset of the assistant's clock per session without turn numbers: session_id, d, clock_ok; m: session_id, id, role, t.

    Ranks come from counts per hour and the place within it, so no window holds a whole session. Sessions with another
    number of replies than of messages they answer have no pairs and are left out.
    """
    x = m.where("role in (1, 2) and t is not null").withColumn("h", F.floor(F.col("t") / HOUR_US))
    hours = x.groupBy("session_id", "role", "h").agg(F.count("*").alias("c"))
    before = Window.partitionBy("session_id", "role").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("session_id", "role", "h", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("n"))
    x = x.withColumn("i", F.row_number().over(Window.partitionBy("session_id", "role", "h").orderBy("t", "id"))).join(hours, ["session_id", "role", "h"])
    x = x.select("session_id", "role", "t", (F.col("i") + F.col("n")).alias("k"))
    even = x.groupBy("session_id").agg(F.sum(F.when(F.col("role") == 1, 1).otherwise(-1)).alias("more")).where("more = 0").select("session_id")
    # a message of the user stands in its own pair, and as the next one in the pair before
    roles = F.when(F.col("role") == 1, F.array(F.struct(F.col("k").alias("k"), F.lit("u").alias("as")), F.struct((F.col("k") - 1).alias("k"), F.lit("next").alias("as")))).otherwise(F.array(F.struct(F.col("k").alias("k"), F.lit("a").alias("as"))))
    one = lambda a: F.min(F.when(F.col("as") == a, F.col("t"))).alias(a)
    pairs = x.select("session_id", "t", F.explode(roles).alias("x")).select("session_id", "t", "x.*").groupBy("session_id", "k").agg(one("u"), one("a"), one("next")).where("k > 0")
    steps = F.array(F.struct(F.lit(1).alias("s"), (F.col("a") - F.col("u")).cast("double").alias("g")), F.struct(F.lit(-1).alias("s"), (F.col("next") - F.col("a")).cast("double").alias("g")))
    return fitted(pairs.join(even, "session_id", "left_semi").select("session_id", F.explode(steps).alias("x")).select("session_id", "x.*").where("g is not null"))


def verdicts(df: DataFrame) -> DataFrame:
    """One row per session: session_id, d, clock_ok, has_turns, and the reason it is dropped for (null: kept).

    Reasons: empty (no visible message of user or assistant), bad_role, no_user_first, no_reply, turn_gap. Messages
    without visible text count for their turn number only. In a conversation with turn numbers, a message without one
    is placed by its corrected time. Repeated rows change nothing; at equal times the user comes first; null and empty
    session ids are left out; an empty table gives no rows.
    """
    turns = per_turn(prepared(df))
    off = clock_offsets(turns)
    numbered = F.col("turn").isNotNull()
    s = turns.groupBy("session_id").agg(
        F.count("turn").alias("n"), F.min("turn").alias("t0"), F.max("turn").alias("t1"), F.max("bad").alias("bad"), F.sum("spoken").alias("spoken"),
        F.min(F.when(numbered & F.col("lo").isNotNull(), F.col("turn") * 4 + F.col("lo") % 4)).alias("num_lo"),
        F.max(F.when(numbered & F.col("hi").isNotNull(), F.col("turn") * 4 + F.col("hi") % 4)).alias("num_hi"),
        *[f(F.when(numbered, F.col(c))).alias(f"n_{c}") for c, f in (("user_lo", F.min), ("bot_lo", F.min), ("user_hi", F.max), ("bot_hi", F.max))],
        *[f(F.when(~numbered, F.col(c))).alias(f"x_{c}") for c, f in (("user_lo", F.min), ("bot_lo", F.min), ("user_hi", F.max), ("bot_hi", F.max))],
    ).join(off, "session_id", "left")
    d = F.coalesce("d", F.lit(0))
    least = lambda k: F.least(F.col(f"{k}_user_lo"), F.col(f"{k}_bot_lo") - d)
    most = lambda k: F.greatest(F.col(f"{k}_user_hi"), F.col(f"{k}_bot_hi") - d)
    loose_first = F.col("num_lo").isNull() | F.coalesce(least("x") < least("n"), F.lit(False))
    loose_last = F.col("num_hi").isNull() | F.coalesce(most("x") > most("n"), F.lit(False))
    user_first = F.when(loose_first, F.coalesce(F.col("x_user_lo") <= F.col("x_bot_lo") - d, F.col("x_user_lo").isNotNull())).otherwise(F.col("num_lo") % 4 == 1)
    reply_last = F.when(loose_last, F.coalesce(F.col("x_bot_hi") - d >= F.col("x_user_hi"), F.col("x_bot_hi").isNotNull())).otherwise(F.col("num_hi") % 4 == 2)
    gap = (F.col("n") > 0) & ((F.col("t1") - F.least("t0", F.lit(1)) + 1) != F.col("n"))
    why = F.when(F.col("spoken") == 0, "empty").when(F.col("bad") == 1, "bad_role").when(~user_first, "no_user_first").when(~reply_last, "no_reply").when(gap, "turn_gap")
    return s.select("session_id", d.alias("d"), F.coalesce("clock_ok", F.lit(True)).alias("clock_ok"), (F.col("n") > 0).alias("has_turns"), why.alias("reason"))


def slotted(m: DataFrame) -> DataFrame:
    """m with slot: the turn number, and for a message without one in a numbered conversation the turn it stands behind.

    That is the last turn up to which all numbered messages are earlier by corrected time. One that is earlier than all
    numbered messages stands before the first turn, any other behind it, so both ends are those that verdicts() sees.
    Without a time it has no slot. Turns are summed up in blocks of 512 with one row a block.
    """
    loose = F.col("has_turns") & F.col("turn").isNull()
    t = m.where("turn is not null and role < 3 and at is not null").groupBy("session_id", "turn").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).withColumn("k", F.floor(F.col("turn") / BLOCK))
    t = t.withColumn("run", F.max("hi").over(Window.partitionBy("session_id", "k").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = t.groupBy("session_id", "k").agg(F.max("hi").alias("top"), F.min("lo").alias("low"), F.min("turn").alias("first"), F.max("turn").alias("last"), F.collect_list(F.struct("turn", "run")).alias("runs"))
    before = Window.partitionBy("session_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("prev", F.max("top").over(before)).withColumn("prev_last", F.max("last").over(before))
    heads = blocks.groupBy("session_id").agg(F.collect_list(F.struct("k", "prev")).alias("heads"), F.min("low").alias("least"), F.min("first").alias("start"))
    x = m.where(loose).join(heads, "session_id", "left")
    x = x.withColumn("k", F.array_max(F.transform(F.filter("heads", lambda b: b.prev.isNull() | (b.prev < F.col("at"))), lambda b: b.k)))
    x = x.join(blocks.select("session_id", "k", "runs", "prev", "prev_last"), ["session_id", "k"], "left")
    behind = F.array_max(F.transform(F.filter("runs", lambda r: F.greatest(r.run, F.col("prev")) < F.col("at")), lambda r: r.turn))
    slot = F.when(F.col("at").isNotNull(), F.coalesce(behind, "prev_last", F.when(F.col("at") < F.col("least"), F.col("start") - 1).otherwise(F.col("start"))))
    return m.where(~loose).withColumn("slot", F.col("turn")).unionByName(x.withColumn("slot", slot).select(*m.columns, "slot"))


def ordered(df: DataFrame) -> DataFrame:
    """Messages of the kept conversations in order: session_id, pos (from 1), role (code), content, at (corrected time).

    Kept are the conversations that verdicts() keeps and whose reply constraints some offset meets. Visible messages only,
    each id once. Each sender's messages keep the order of its own clock; both streams are merged by turn number, or
    without one by corrected time. Positions come from counts per block of order keys, so no task holds a whole session.
    """
    kept = verdicts(df).where("reason is null and clock_ok").select("session_id", F.col("d").alias("_d"), "has_turns")
    m = prepared(df).where("shown and role > 0").dropDuplicates(["session_id", "id", "turn", "t"]).join(kept, "session_id")
    pairs = paired_offsets(m.where("not has_turns").select("session_id", "id", "role", "t"))
    m = m.join(pairs, "session_id", "left").where("coalesce(clock_ok, true)").withColumn("d", F.coalesce("d", "_d")).drop("_d", "clock_ok")
    at = F.when(F.col("role") == 2, F.col("t") - F.col("d")).otherwise(F.col("t"))
    m = slotted(m.withColumn("at", at)).withColumn("key", F.when(F.col("has_turns"), F.col("slot")).otherwise(F.floor(F.col("at") / HOUR_US)))
    m = m.withColumn("k", F.when(F.col("has_turns"), F.floor(F.col("key") / BLOCK)).otherwise(F.col("key")))
    ahead = m.groupBy("session_id", "k").agg(F.count("*").alias("c"))
    ahead = ahead.select("session_id", "k", F.coalesce(F.sum("c").over(Window.partitionBy("session_id").orderBy(F.col("k").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n"))
    w = Window.partitionBy("session_id", "k").orderBy(F.when(F.col("has_turns"), F.col("slot")).asc_nulls_last(), F.col("has_turns") & F.col("turn").isNull(), F.col("at").asc_nulls_last(), "role", "id")
    placed = m.withColumn("i", F.row_number().over(w)).join(ahead.withColumnRenamed("k", "k2").withColumnRenamed("session_id", "s2"), (F.col("session_id") == F.col("s2")) & F.col("k").eqNullSafe(F.col("k2")))
    return placed.select("session_id", (F.col("i") + F.col("n")).cast("bigint").alias("pos"), "role", "content", F.timestamp_micros("at").alias("at"))


def conversations(df: DataFrame) -> DataFrame:
    """Kept conversations in order: session_id, part, turns (array of pos, role, text, at), in parts of 512 turns.

    A conversation of up to 512 turns is one row. Order and choice are those of ordered().
    """
    names = F.element_at(F.array(F.lit("user"), F.lit("assistant"), F.lit("system")), F.col("role"))
    turn = F.struct("pos", names.alias("role"), F.col("content").alias("text"), "at")
    return ordered(df).select("session_id", F.floor((F.col("pos") - 1) / BLOCK).cast("int").alias("part"), turn.alias("x")).groupBy("session_id", "part").agg(F.array_sort(F.collect_list("x")).alias("turns"))


def p3_found(spark, sf_dir):
    """Sessions whose conversation is to be dropped."""
    return verdicts(read_table(spark, sf_dir, "messages")).where("reason is not null").select("session_id")


def p3_conversations(spark, sf_dir):
    """The kept conversations, one row each (parts of 512 turns)."""
    return conversations(read_table(spark, sf_dir, "messages"))


def p3_order(spark, sf_dir):
    """The kept conversations message by message, with the corrected time."""
    return ordered(read_table(spark, sf_dir, "messages")).select("session_id", "pos", "role", F.sha1("content").alias("h"), F.unix_micros("at").alias("at_us"))


_ROLE = "trim(regexp_replace(lower(role), '\\s+', ' ', 'g'))"

_MSG = rf"""m as (select distinct id, session_id, created_at, try_cast(case when json_valid(metadata_json) then json_extract_string(metadata_json, '$.turn') end as bigint) turn,
  case when {_ROLE} in ('user', 'human', 'customer', 'client') then 'u' when {_ROLE} in ('assistant', 'ai', 'bot', 'model', 'agent') then 'a'
       when {_ROLE} in ('system', 'sys', 'developer') then 's' else 'x' end r, content,
  coalesce(regexp_matches(content, '[^\p{{Z}}\p{{C}}]'), false) shown from messages where session_id <> ''),
a as (select session_id, arg_min(r, (coalesce(turn, 0), created_at)) filter (shown and r in ('u', 'a')) f, arg_max(r, (coalesce(turn, 0), created_at)) filter (shown and r in ('u', 'a')) l,
  bool_or(shown and r = 'x') bad, count(distinct turn) n, least(min(turn), 1) t0, max(turn) t1 from m group by session_id)"""

P3_SQL = f"""with {_MSG}
select session_id from a where f is null or bad or f <> 'u' or l <> 'a' or (n > 0 and t1 - t0 + 1 <> n)"""

# numbered conversations have a step for each two neighbouring turns, others one for each reply and each next message
P3_ORDER_SQL = f"""with {_MSG},
k as (select session_id, n > 0 has_turns from a where not (f is null or bad or f <> 'u' or l <> 'a' or (n > 0 and t1 - t0 + 1 <> n))),
v as (select m.*, epoch_us(created_at) t, has_turns from m join k using (session_id) where shown and r <> 'x'),
q as (select session_id, turn, arg_min(r, (t, r = 'a')) r, min(t) t from v where turn is not null and r in ('u', 'a') group by 1, 2),
s1 as (select session_id, (r = 'a')::int - (lag(r) over w = 'a')::int s, t - lag(t) over w g, turn - lag(turn) over w step from q window w as (partition by session_id order by turn)),
p as (select session_id, r, t, row_number() over (partition by session_id, r order by t, id) i from v where not has_turns and r in ('u', 'a')),
e as (select session_id from p group by 1 having count(*) filter (r = 'u') = count(*) filter (r = 'a')),
s2 as (select u.session_id, 1 s, b.t - u.t g from p u join p b on u.session_id = b.session_id and u.i = b.i and u.r = 'u' and b.r = 'a'
  union all select u.session_id, -1, u.t - b.t from p u join p b on u.session_id = b.session_id and u.i = b.i + 1 and u.r = 'u' and b.r = 'a'),
st as (select session_id, s, g::double g from s1 where step = 1 union all select session_id, s, g from s2 where session_id in (select session_id from e)),
c as (select session_id, count(*)::double n, sum(s) ss, sum(abs(s)) sq, sum(g) sg, sum(s * g) sp, min(g) filter (s = 1) top, -min(g) filter (s = -1) low from st group by 1),
d as (select session_id, coalesce(low <= top, true) ok, trunc(case when (coalesce(top, 0) < 0 or coalesce(low, 0) > 0) and coalesce(low <= top, true)
  then greatest(least(case when n * sq - ss * ss > 0 then (n * sp - ss * sg) / (n * sq - ss * ss) else 0 end, top - coalesce((top - low) / 8, 1)), low + coalesce((top - low) / 8, 1)) else 0 end)::bigint d from c),
o as (select v.session_id, v.id, turn, r, content, t - case when r = 'a' then coalesce(d, 0) else 0 end tt from v left join d using (session_id) where coalesce(ok, true))
select session_id, row_number() over (partition by session_id order by turn, tt, case r when 'u' then 1 when 'a' then 2 else 3 end, id) as pos,
  (case r when 'u' then 1 when 'a' then 2 else 3 end)::int as role, sha1(content) as h, tt as at_us from o"""

QUERIES = {"p3_found": p3_found, "p3_conversations": p3_conversations, "p3_order": p3_order}
SQL = {"p3_found": P3_SQL, "p3_order": P3_ORDER_SQL}

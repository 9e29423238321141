"""Temporal facts and graph traversal (T1-T15, A8, D13-D16, J10, J11, P6, U2, U3, W1, W2, W9, ST3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.names import norm_name
from lodestone.operators.running import running
from lodestone.sources.tables import checkpointed

SINGLE_ACTIVE = ("works_for", "belongs_to", "prefers")

# Classes of entities and the words that tell them, in order of precedence.
ENTITY_WORDS = [
    ("person", ["user", "customer", "developer", "manager", "agent"]),
    ("organization", ["company", "team", "department", "organization"]),
    ("location", ["city", "country", "address", "place"]),
    ("product", ["app", "software", "tool", "service", "product"]),
    ("concept", ["idea", "topic", "subject", "concept"]),
    ("event", ["meeting", "call", "session", "event"]),
    ("skill", ["ability", "skill", "capability"]),
    ("preference", ["preference", "setting", "config"]),
]


def entity_class(c):
    """The first class one of whose words the name contains, else entity."""
    low, out = F.lower(c), None
    for name, ws in ENTITY_WORDS:
        hit = F.lit(False)
        for w in ws:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("entity")


def triple_key(*cols):
    """Deterministic identifier of a name or triple: 16 hex digits of a hash of the lower-case text."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.lower(c) for c in cols]), 256), 1, 16)


BLOCK = 100_000  # arrivals that one window may see of a key


def events(df: DataFrame) -> DataFrame:
    """Fact events with normal names: seq, s, p, o, action, t (observed, else created), valid_from, valid_to, confidence,
    session_id, arrived. Rows without subject, predicate or object, or with another action, are left out; each seq counts once."""
    x = df.select(
        F.coalesce(F.col("seq").cast("bigint"), F.lit(-1)).alias("seq"), norm_name(F.col("subject")).alias("s"), norm_name(F.col("predicate")).alias("p"), norm_name(F.col("object")).alias("o"), norm_name(F.col("action")).alias("action"),
        F.coalesce("observed_at", "created_at").alias("t"), "valid_from", "valid_to", "confidence", "session_id", F.col("created_at").alias("arrived"),
    )
    return x.where("s <> '' and p <> '' and o <> '' and t is not null and action in ('assert', 'retract')").dropDuplicates(["seq", "s", "p", "o", "action", "t"])


def upserts(df: DataFrame) -> DataFrame:
    """T1, T2, D13, D15, ST3: what each event did to the store, in order of arrival (seq), with the close_replaced events.

    Columns seq, s, p, o, action, t, arrived, valid_from, valid_to, state_active, version, status, confidence, session_id.
    An assert opens its fact, or confirms it and keeps valid_from while it is open; of a single-active predicate it closes
    the other open object, with a close_replaced event at its own time. A retract closes an open fact at its valid_to or
    its time, leaves a closed one as it is (already_inactive), and finds nothing where there never was one (not_found: no
    state, no version). valid_from falls back to t; the valid_to of an assert is checked only: where it is not after
    valid_from, the event is rejected. Every change adds one to the version. Retracts and closings carry the confidence
    that the fact had. Repeated rows change nothing, an empty log gives no rows, further columns are ignored.
    """
    start = F.coalesce("valid_from", "t")
    e = events(df).select("*", start.alias("start"), ((F.col("action") == "assert") & F.coalesce(F.col("valid_to") <= start, F.lit(False))).alias("bad"))
    e = e.withColumn("k", F.when(F.col("p").isin(*SINGLE_ACTIVE), F.lit("")).otherwise(F.col("o"))).withColumn("b", F.floor(F.col("seq") / BLOCK))
    ok, asserts = e.where("not bad"), F.col("action") == "assert"
    order = ["seq", "t", "action", "o"]
    e1 = running(ok, ["s", "p", "k"], "b", order, sums={"i": F.lit(1)}, lasts={"held": F.when(asserts, F.col("o"))}, before=True)
    ends = (F.col("action") == "retract") & (F.col("o") == F.col("held"))
    e2 = running(e1, ["s", "p", "k"], "b", order, lasts={"set_at": F.when(asserts, F.col("i")), "ended_at": F.when(ends, F.col("i"))}, before=True)
    # the object that is open when the event arrives
    e2 = e2.withColumn("held", F.when(F.col("ended_at").isNull() | (F.col("ended_at") < F.col("set_at")), F.col("held")))
    own = F.struct(F.col("o").alias("o"), F.col("action").alias("action"), F.lit(1).alias("kind"), (F.col("held") == F.col("o")).alias("open"))
    gone = F.struct(F.col("held").alias("o"), F.lit("close_replaced").alias("action"), F.lit(0).alias("kind"), F.lit(True).alias("open"))
    both = F.when(asserts & (F.col("held") != F.col("o")), F.array(gone, own)).otherwise(F.array(own))
    e3 = e2.select("seq", "s", "p", "b", "i", "t", "arrived", "start", "valid_to", "confidence", "session_id", F.explode(both).alias("x")).select("*", "x.*").drop("x").withColumn("open", F.coalesce("open", F.lit(False)))
    asserts, closes = F.col("action") == "assert", (F.col("action") != "assert") & F.col("open")
    closed_at = F.when(F.col("action") == "close_replaced", F.col("t")).otherwise(F.coalesce("valid_to", "t"))
    e4 = running(
        e3, ["s", "p", "o"], "b", ["i", "kind"], sums={"known": asserts.cast("int"), "version": (asserts | closes).cast("int")},
        lasts={"from": F.when(asserts & ~F.col("open"), F.col("start")), "to": F.when(closes, closed_at), "sure": F.when(asserts, F.col("confidence")), "where": F.when(asserts, F.col("session_id"))},
    )
    status = F.when(asserts, "asserted").when(F.col("action") == "close_replaced", "closed").when(F.col("open"), "retracted").when(F.col("known") > 0, "already_inactive").otherwise("not_found")
    has = asserts | (F.col("known") > 0)
    log = e4.select(
        "seq", "i", "kind", "s", "p", "o", "action", "t", "arrived", F.when(has, F.when(asserts, F.col("start")).otherwise(F.col("from"))).alias("valid_from"), F.when(has & ~asserts, F.col("to")).alias("valid_to"), asserts.alias("state_active"),
        F.when(has, F.col("version")).alias("version"), status.alias("status"), F.when(has, F.col("sure")).alias("confidence"), F.when(has, F.col("where")).alias("session_id"), F.when(asserts, F.col("from")).alias("open_from"),
    )
    none = [F.lit(None).cast(log.schema[c].dataType).alias(c) for c in ("valid_from", "valid_to", "version", "confidence", "open_from")]
    rejected = e.where("bad").select("seq", F.lit(0).alias("i"), F.lit(1).alias("kind"), "s", "p", "o", "action", "t", "arrived", *none[:2], F.lit(False).alias("state_active"), none[2], F.lit("rejected").alias("status"), none[3], "session_id", none[4])
    return log.unionByName(rejected)


def closings(df: DataFrame) -> DataFrame:
    """The close_replaced events: s, p, o, at, version."""
    return upserts(df).where("action = 'close_replaced'").select("s", "p", "o", F.col("t").alias("at"), "version")


def history(df: DataFrame, subject: str | None = None, predicate: str | None = None) -> DataFrame:
    """T5: every event that changed or confirmed a fact, those of one subject or predicate if given: the log of upserts()
    without rejected and unfound ones."""
    x = upserts(df).where("status not in ('rejected', 'not_found')")
    for c, v in (("s", subject), ("p", predicate)):
        x = x if v is None else x.where(F.col(c) == v.lower())
    return x


def current(df: DataFrame) -> DataFrame:
    """Facts that are open after all arrivals: s, p, o, valid_from, version, confidence, since (seconds)."""
    last = F.max_by(F.struct("state_active", "open_from", "version", "confidence"), F.struct("i", "kind"))
    x = history(df).groupBy("s", "p", "o").agg(last.alias("x")).where("x.state_active")
    return x.select("s", "p", "o", F.col("x.open_from").alias("valid_from"), "x.version", "x.confidence", F.unix_seconds("x.open_from").alias("since"))


def as_of(df: DataFrame, when: str, subject: str | None = None, predicate: str | None = None) -> DataFrame:
    """Facts by the events up to a time, late arrivals included: s, p, o, t, confidence.

    The latest event of a fact must be an assert whose valid_from (else its time) is not after then; of a single-active
    predicate only the object that was asserted last counts, so there is at most one. Filters apply before. Aggregates
    alone, so no window holds all events of a fact. As in T1 an assert's valid_to is checked and not kept.
    """
    x = events(df).where(F.col("t") <= F.lit(when).cast("timestamp"))
    for c, v in (("s", subject), ("p", predicate)):
        x = x if v is None else x.where(F.col(c) == v.lower())
    start = F.coalesce("valid_from", "t")
    x = x.where((F.col("action") != "assert") | F.coalesce(F.col("valid_to") > start, F.lit(True)))
    mark = F.struct(F.col("t").alias("t"), F.col("seq").alias("seq"), F.col("confidence").alias("confidence"), start.alias("start"))
    y = x.groupBy("s", "p", "o").agg(F.max(F.when(F.col("action") == "assert", mark)).alias("a"), F.max(F.when(F.col("action") == "retract", F.struct("t", "seq"))).alias("r")).where("a is not null")
    one = y.where(F.col("p").isin(*SINGLE_ACTIVE)).groupBy("s", "p").agg(F.max_by(F.struct("o", "a", "r"), F.struct("a.t", "a.seq", "o")).alias("x")).select("s", "p", "x.*")
    y = one.unionByName(y.where(~F.col("p").isin(*SINGLE_ACTIVE)))
    open_ = F.col("r").isNull() | (F.struct("r.t", "r.seq") < F.struct("a.t", "a.seq"))
    return y.where(open_ & (F.col("a.start") <= F.lit(when).cast("timestamp"))).select("s", "p", "o", F.col("a.t").alias("t"), F.col("a.confidence").alias("confidence"))


def timeline(df: DataFrame, limit: int = 20) -> DataFrame:
    """Per entity, on either side of its facts: events, asserts, retracts, closed (replaced), first_s, last_s,
    active_out and active_in (facts whose latest event by time leaves them open), and the counterparts of up to limit of
    these, newest first."""
    e = history(df)
    ends = F.array(F.struct(F.col("s").alias("entity"), F.lit("subject").alias("side"), F.col("o").alias("other")), F.struct(F.col("o").alias("entity"), F.lit("object").alias("side"), F.col("s").alias("other")))
    n = lambda a: F.sum((F.col("action") == a).cast("int"))
    # one row a fact first, so that an entity of many events is added up from few
    one = e.groupBy("s", "p", "o").agg(
        F.count("*").alias("n"), n("assert").alias("a"), n("retract").alias("r"), n("close_replaced").alias("c"), F.min("t").alias("t0"), F.max("t").alias("t1"),
        F.max_by(F.struct("state_active", "open_from"), F.struct("t", "arrived", "i", "kind")).alias("last"),
    )
    x = one.select(F.explode(ends).alias("x"), "p", "n", "a", "r", "c", "t0", "t1", "last").select("x.*", "p", "n", "a", "r", "c", "t0", "t1", F.col("last.state_active").alias("on"), F.col("last.open_from").alias("since"))
    sums = x.groupBy("entity").agg(
        F.sum("n").alias("total_events"), F.sum("a").alias("asserts"), F.sum("r").alias("retracts"), F.sum("c").alias("closed"), F.unix_seconds(F.min("t0")).alias("first_s"), F.unix_seconds(F.max("t1")).alias("last_s"),
        *[F.sum((F.col("on") & (F.col("side") == k)).cast("int")).alias(f"active_{d}") for k, d in (("subject", "out"), ("object", "in"))],
    )
    w = Window.partitionBy("entity").orderBy(F.desc("since"), "side", "p", "other")
    near = x.where("on").withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit).groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "other"))), lambda v: v["other"]), ", ").alias("counterparts"))
    return sums.join(near, "entity", "left")


def neighbours(edges: DataFrame, limit: int = 20) -> DataFrame:
    """Node, direction, other, label: at most limit neighbours a side, best confidence first."""
    out = edges.select(F.col("src").alias("node"), F.lit("out").alias("direction"), F.col("dst").alias("other"), "label", "confidence")
    back = edges.select(F.col("dst").alias("node"), F.lit("in").alias("direction"), F.col("src").alias("other"), "label", "confidence")
    w = Window.partitionBy("node", "direction").orderBy(F.desc("confidence"), "label", "other")
    return out.unionByName(back).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def paths(edges: DataFrame, start: DataFrame, depth: int = 3, limit: int = 20) -> DataFrame:
    """Origin, node, depth, path, confidence: a shortest path from each origin to each node in up to depth steps.

    edges: src, label, dst, confidence; start: origin. Steps go both ways, at most limit neighbours a side (fan-out, as
    T7 orders them); a step against its edge is written <-label-. Of equally short paths the least in writing is kept.
    The origin itself has depth 0 and confidence 1. Each step joins the frontier with the neighbour lists, which are
    worked out once, and leaves out what was reached before.
    """
    near = checkpointed(neighbours(edges.where("src is not null and dst is not null"), limit).select("node", "other", F.when(F.col("direction") == "out", F.concat(F.lit("-"), "label", F.lit("->"))).otherwise(F.concat(F.lit("<-"), "label", F.lit("-"))).alias("step")))
    seen = start.where("origin is not null").select("origin", F.col("origin").alias("node"), F.lit(0).alias("depth"), F.col("origin").alias("path")).distinct()
    front = seen
    for i in range(1, depth + 1):
        step = front.join(near, "node").groupBy("origin", F.col("other").alias("node")).agg(F.min(F.concat_ws(" ", "path", "step", "other")).alias("path"))
        front = checkpointed(step.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").select("origin", "node", F.lit(i).alias("depth"), "path"))
        seen = seen.unionByName(front)
    return seen.withColumn("confidence", 1 / F.greatest(F.lit(1), F.col("depth")))


def reachable(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """Origin, node, depth: closure along the edges src, dst, least number of steps up to depth.

    Each step joins the distinct frontier with the edges, which are worked out once, and leaves out what was reached before.
    """
    e = checkpointed(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    seen = start.select("origin", F.col("origin").alias("node"), F.lit(0).alias("depth")).distinct()
    front = seen
    for i in range(1, depth + 1):
        step = front.join(e, front.node == e.src).select("origin", F.col("dst").alias("node")).distinct().join(seen.select("origin", "node"), ["origin", "node"], "left_anti")
        front = checkpointed(step.withColumn("depth", F.lit(i)))
        seen = seen.unionByName(front)
    return seen


def interned(df: DataFrame) -> DataFrame:
    """Name, id, entity_type, mention_count of every subject and object of an assert."""
    e = events(df).where("action = 'assert'")
    return e.select(F.explode(F.array("s", "o")).alias("name")).groupBy("name").agg(F.count("*").alias("mention_count")).select("name", triple_key(F.col("name")).alias("id"), entity_class(F.col("name")).alias("entity_type"), "mention_count")


def search_entities(df: DataFrame, tokens: list[str], entity_type: str | None = None) -> DataFrame:
    """Entities whose name holds any token, of one class if given: name, role (subject wins over object), mentions, score."""
    e = events(df)
    sides = e.groupBy("s").agg(F.count("*").alias("n")).select(F.col("s").alias("name"), F.lit(0).alias("r"), "n").unionByName(e.groupBy("o").agg(F.count("*").alias("n")).select(F.col("o").alias("name"), F.lit(1).alias("r"), "n"))
    hits = sum(F.col("name").contains(t.lower()).cast("int") for t in tokens)
    x = sides.withColumn("hits", hits).where("hits > 0").groupBy("name").agg(F.min("r").alias("r"), F.min_by("n", "r").alias("mentions"), F.max("hits").alias("hits"))
    x = x if entity_type is None else x.where(entity_class(F.col("name")) == entity_type)
    return x.select("name", F.when(F.col("r") == 0, "subject").otherwise("object").alias("role"), "mentions", F.round(F.col("hits") + 0.01 * F.col("mentions"), 4).alias("score"))


def normal_time(c):
    """A time from ISO text: Z or an offset is honoured, naive text is UTC (the session's zone must be), anything else is null."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})?)?$"), F.try_to_timestamp(F.regexp_replace(t, "Z$", "+00:00")))


def without_session(df: DataFrame, session_id: str | None = None) -> DataFrame:
    """The log without the rows of a session, or without any row."""
    return df.where(F.lit(False)) if session_id is None else df.where(~F.col("session_id").eqNullSafe(session_id))

"""Queries of temporal facts and graph traversal with the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.names import norm_name
from lodestone.operators import facts as G
from lodestone.sources.tables import read_table as rt

WHEN = "2025-06-01 00:00:00"


def _facts(spark, d):
    return rt(spark, d, "fact_ops")


def _s(c):
    return F.unix_seconds(c)


def facts_upsert_log(spark, d):
    """T1, D13, ST3: what every event did, in order of arrival."""
    x = G.upserts(_facts(spark, d))
    return x.select("seq", "s", "p", "o", "action", "status", "version", _s("t").alias("t"), _s("valid_from").alias("from_s"), _s("valid_to").alias("to_s"), F.round("confidence", 4).alias("confidence"))


def facts_upsert_counts(spark, d):
    """How many events asserted, retracted, closed, found nothing or were rejected."""
    return G.upserts(_facts(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


def facts_as_of(spark, d):
    return G.as_of(_facts(spark, d), WHEN).select("s", "p", "o", _s("t").alias("t"), F.round("confidence", 4).alias("confidence"))


def facts_current(spark, d):
    return G.current(_facts(spark, d)).select("s", "p", "o", "since", "version", F.round("confidence", 4).alias("confidence"))


def facts_top(spark, d):
    """The surest 100 open facts, the newest first among equals (the limit is the feature)."""
    return G.current(_facts(spark, d)).select("s", "p", "o", F.round("confidence", 4).alias("confidence"), "since").orderBy(F.desc("confidence"), F.desc("since"), "s", "p", "o").limit(100)


def facts_close_replaced(spark, d):
    return G.closings(_facts(spark, d)).select("s", "p", "o", _s("at").alias("at_s"), "version")


def fact_history(spark, d):
    """T5 over every subject: all events with their place in the history of the fact."""
    return G.history(_facts(spark, d)).select("seq", "s", "p", "o", "action", _s("t").alias("t"), "state_active", "version")


def entity_timeline(spark, d):
    return G.timeline(_facts(spark, d))


def entity_facts(spark, d):
    """Current facts as sentences."""
    return G.current(_facts(spark, d)).select("s", F.concat_ws(" ", "s", "p", "o").alias("fact"))


def entity_intern(spark, d):
    return G.interned(_facts(spark, d)).select("name", "entity_type", "mention_count")


def entity_search(spark, d):
    return G.search_entities(_facts(spark, d), ["agent", "core", "desk"])


def entity_search_typed(spark, d):
    """T11 with a class."""
    return G.search_entities(_facts(spark, d), ["a", "e"], "person")


def facts_cleared(spark, d):
    """What is left of each predicate when the facts of ended sessions are cleared, with the entities that still occur."""
    gone = rt(spark, d, "sessions").where("session_status = 'ended'").select(F.col("id").alias("session_id"))
    x = G.events(_facts(spark, d)).join(gone.distinct(), "session_id", "left_anti")
    return x.groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"))


def time_normalise(spark, d):
    """T14 over times of messages in writing: with Z, with an offset, naive, and broken."""
    v = F.pmod(F.length(F.coalesce("content", F.lit(""))), F.lit(4))
    text = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(v == 0, F.concat(text, F.lit("Z"))).when(v == 1, F.concat(text, F.lit("+02:00"))).when(v == 2, F.concat(F.lit(" "), text)).otherwise(F.concat(text, F.lit(" or so")))
    return rt(spark, d, "messages").select("id", "created_at", "content").distinct().select("id", v.alias("form"), _s(G.normal_time(text)).alias("s"))


def kg_stats(spark, d):
    """Distinct names and active triples."""
    e = rt(spark, d, "triples").select("triple_id", "subject", "predicate", "object", "is_active").distinct()
    return e.agg(F.countDistinct(norm_name(F.col("subject"))).alias("subjects"), F.countDistinct(norm_name(F.col("predicate"))).alias("predicates"), F.countDistinct(norm_name(F.col("object"))).alias("objects"), F.sum(F.coalesce("is_active", F.lit(True)).cast("bigint")).alias("active"))


def _edges(spark, d):
    e = rt(spark, d, "triples")
    return e.groupBy(norm_name(F.col("subject")).alias("src"), norm_name(F.col("predicate")).alias("label"), norm_name(F.col("object")).alias("dst")).agg(F.max("confidence").alias("confidence")).where("src <> '' and dst <> '' and label <> ''")


def _origins(spark, d):
    """The stated set of starts: subjects of every 20th event."""
    return G.events(_facts(spark, d)).where("seq % 20 = 0").select(F.col("s").alias("origin")).distinct()


def neighbors_both(spark, d):
    return G.neighbours(_edges(spark, d)).withColumn("confidence", F.round("confidence", 4))


def path_min_depth(spark, d):
    """A shortest path from each origin to every node within three steps, over the triples."""
    return G.paths(_edges(spark, d), _origins(spark, d)).withColumn("confidence", F.round("confidence", 6))


def path_as_of(spark, d):
    """The same over the facts as of a time, with a fan-out of 50."""
    e = G.as_of(_facts(spark, d), WHEN).select(F.col("s").alias("src"), F.col("p").alias("label"), F.col("o").alias("dst"), "confidence")
    return G.paths(e, _origins(spark, d), limit=50).select("origin", "node", "depth", "path")


def transitive_closure(spark, d):
    """Customers, nations and regions under each region, along one predicate."""
    n, c = rt(spark, d, "nation"), rt(spark, d, "customer")
    e = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst")).unionByName(c.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst")))
    start = rt(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("origin"))
    return G.reachable(e, start, 3).groupBy("origin", "depth").agg(F.count("*").alias("nodes"))


def triples_decode(spark, d):
    """Triples with their names in dictionaries of their own, decoded by joins; rows with equal names are one."""
    t = rt(spark, d, "triples").select(*[norm_name(F.col(c)).alias(c) for c in ("subject", "predicate", "object")]).where("subject <> '' and predicate <> '' and object <> ''").distinct()
    coded = t.select(*[G.triple_key(F.col(c)).alias(f"{c}_id") for c in t.columns])
    for c in t.columns:
        coded = coded.join(t.select(G.triple_key(F.col(c)).alias(f"{c}_id"), c).distinct(), f"{c}_id")
    return coded.select("subject", "predicate", "object")


def relations_left_join(spark, d):
    """Relations with either end looked up among the interned entities, which may be missing."""
    ents = G.interned(_facts(spark, d)).select("name", "entity_type")
    e = _edges(spark, d)
    x = e.join(ents.select(F.col("name").alias("src"), F.col("entity_type").alias("src_type")), "src", "left").join(ents.select(F.col("name").alias("dst"), F.col("entity_type").alias("dst_type")), "dst", "left")
    return x.select("src", "label", "dst", "src_type", "dst_type")


def top_edges(spark, d):
    """The eight surest edges of each subject, as lines."""
    x = G.neighbours(_edges(spark, d), 8).where("direction = 'out'")
    return x.select("node", F.concat_ws(" ", "node", F.lit("-"), "label", F.lit("->"), "other").alias("line"))


QUERIES = {
    f.__name__: f
    for f in (
        facts_upsert_log, facts_upsert_counts, facts_as_of, facts_current, facts_top, facts_close_replaced, fact_history, entity_timeline, entity_facts, entity_intern, entity_search, entity_search_typed, facts_cleared, time_normalise,
        kg_stats, neighbors_both, path_min_depth, path_as_of, transitive_closure, triples_decode, relations_left_join, top_edges,
    )
}

_N = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"
_EV = f"""e as (select distinct seq, {_N.format('subject')} s, {_N.format('predicate')} p, {_N.format('object')} o, {_N.format('action')} a, coalesce(observed_at, created_at) t, valid_from vf, valid_to vt, coalesce(valid_from, observed_at, created_at) st,
  confidence cf, session_id, created_at from fact_ops), ev as (select * from e where s <> '' and p <> '' and o <> '' and t is not null and a in ('assert', 'retract'))"""
# what is open before each event, then what the event does to its own fact and to the one it replaces
_LOG = f"""{_EV}, g as (select *, case when p in ('works_for', 'belongs_to', 'prefers') then '' else o end k, coalesce(a = 'assert' and vt <= st, false) bad from ev),
g1 as (select *, row_number() over w i, last_value(case when a = 'assert' then o end ignore nulls) over (partition by s, p, k order by seq, t, a, o rows between unbounded preceding and 1 preceding) h from g where not bad window w as (partition by s, p, k order by seq, t, a, o)),
g2 as (select *, max(case when a = 'assert' then i end) over w si, max(case when a = 'retract' and o = h then i end) over w ei from g1 window w as (partition by s, p, k order by i rows between unbounded preceding and 1 preceding)),
g3 as (select * exclude (h), case when ei is null or ei < si then h end h from g2),
g4 as (select seq, i, 1 kind, s, p, o, a, t, st, vt, cf, created_at, coalesce(h = o, false) op from g3 union all select seq, i, 0, s, p, h, 'close_replaced', t, st, vt, cf, created_at, true from g3 where a = 'assert' and h <> o),
g5 as (select *, sum((a = 'assert')::int) over w known, sum((a = 'assert' or op)::int) over w ver, last_value(case when a = 'assert' and not op then st end ignore nulls) over w fr,
  last_value(case when a = 'close_replaced' then t when a = 'retract' and op then coalesce(vt, t) end ignore nulls) over w til, last_value(case when a = 'assert' then cf end ignore nulls) over w sure
  from g4 window w as (partition by s, p, o order by i, kind rows unbounded preceding)),
lg as (select seq, i, kind, s, p, o, a, t, created_at, known > 0 has, case a when 'assert' then 'asserted' when 'close_replaced' then 'closed' else case when op then 'retracted' when known > 0 then 'already_inactive' else 'not_found' end end status,
  case when known > 0 then ver end ver, case when a = 'assert' then st when known > 0 then fr end f0, case when a <> 'assert' and known > 0 then til end t1, case when known > 0 then sure end sure, a = 'assert' act, fr from g5
  union all select seq, 0, 1, s, p, o, a, t, created_at, false, 'rejected', null, null, null, null, false, null from g where bad)"""
_SEC = "floor(epoch({0}))::bigint"
_CUR = f"""{_LOG}, cu as (select s, p, o, fr, ver, sure from (select *, row_number() over (partition by s, p, o order by i desc, kind desc) k from lg where status not in ('rejected', 'not_found')) where k = 1 and act)"""
_ASOF = """at0 as (select * from ev where t <= timestamptz '2025-06-01 00:00:00+00' and not coalesce(a = 'assert' and vt <= st, false)),
at1 as (select s, p, o, max((t, seq)) filter (a = 'assert') am, arg_max(cf, (t, seq)) filter (a = 'assert') cf, arg_max(st, (t, seq)) filter (a = 'assert') st, max((t, seq)) filter (a = 'retract') rm from at0 group by 1, 2, 3 having am is not null),
at2 as (select *, row_number() over (partition by s, p order by am desc, o desc) k from at1),
aso as (select s, p, o, am[1] t, cf from at2 where (p not in ('works_for', 'belongs_to', 'prefers') or k = 1) and (rm is null or rm < am) and st <= timestamptz '2025-06-01 00:00:00+00')"""
_ED = f"""ed as (select * from (select {_N.format('subject')} src, {_N.format('predicate')} label, {_N.format('object')} dst, max(confidence) confidence from triples group by 1, 2, 3) where src <> '' and dst <> '' and label <> '')"""
_OR = "og as (select distinct s origin from ev where seq % 20 = 0)"


def _path_sql(edges: str, limit: int) -> str:
    """Three steps, each a join of the frontier with the neighbour lists."""
    out = f""", nx as (select src node, 'out' d, dst other, label, confidence from {edges} union all select dst, 'in', src, label, confidence from {edges}),
nb as (select node, other, case d when 'out' then '-' || label || '->' else '<-' || label || '-' end step from (select *, row_number() over (partition by node, d order by confidence desc nulls last, label, other) k from nx) where k <= {limit}),
b0 as (select origin, origin node, 0 depth, origin path from og)"""
    for i in (1, 2, 3):
        out += f""", f{i} as (select origin, other node, {i} depth, min(path || ' ' || step || ' ' || other) path from (select * from b{i - 1} where depth = {i - 1}) b join nb using (node) group by origin, other),
b{i} as (select * from b{i - 1} union all select * from f{i} where (origin, node) not in (select (origin, node) from b{i - 1}))"""
    return out


_CLASSES = """case when regexp_matches({0}, 'user|customer|developer|manager|agent') then 'person' when regexp_matches({0}, 'company|team|department|organization') then 'organization' when regexp_matches({0}, 'city|country|address|place') then 'location'
 when regexp_matches({0}, 'app|software|tool|service|product') then 'product' when regexp_matches({0}, 'idea|topic|subject|concept') then 'concept' when regexp_matches({0}, 'meeting|call|session|event') then 'event'
 when regexp_matches({0}, 'ability|skill|capability') then 'skill' when regexp_matches({0}, 'preference|setting|config') then 'preference' else 'entity' end"""
_IN = f"nm as (select s as name from ev where a = 'assert' union all select o from ev where a = 'assert'), it as (select name, {_CLASSES.format('name')} as entity_type, count(*) as mention_count from nm group by name)"
_SIDES = "z as (select s as name, 0 r, count(*) n from ev group by s union all select o, 1, count(*) from ev group by o)"

SQL = {
    "facts_upsert_log": f"with {_LOG} select seq, s, p, o, a as action, status, ver::bigint as version, {_SEC.format('t')} as t, {_SEC.format('f0')} as from_s, {_SEC.format('t1')} as to_s, round(sure, 4) as confidence from lg",
    "facts_upsert_counts": f"with {_LOG} select status, count(*) as n from lg group by 1",
    "facts_as_of": f"with {_EV}, {_ASOF} select s, p, o, {_SEC.format('t')} as t, round(cf, 4) as confidence from aso",
    "facts_current": f"with {_CUR} select s, p, o, {_SEC.format('fr')} as since, ver::bigint as version, round(sure, 4) as confidence from cu",
    "facts_top": f"with {_CUR} select s, p, o, round(sure, 4) as confidence, {_SEC.format('fr')} as since from cu order by 4 desc, 5 desc, s, p, o limit 100",
    "facts_close_replaced": f"with {_LOG} select s, p, o, {_SEC.format('t')} as at_s, ver::bigint as version from lg where status = 'closed'",
    "fact_history": f"with {_LOG} select seq, s, p, o, a as action, {_SEC.format('t')} as t, act as state_active, ver::bigint as version from lg where status not in ('rejected', 'not_found')",
    "entity_timeline": f"""with {_LOG}, h as (select * from lg where status not in ('rejected', 'not_found')), x as (select s entity, 'subject' side, o other, * from h union all select o, 'object', s, * from h),
l as (select entity, side, p, other, count(*) n, sum((a = 'assert')::int) a, sum((a = 'retract')::int) r, sum((a = 'close_replaced')::int) c, min(t) t0, max(t) t1, arg_max(act, (t, created_at, i, kind)) act, arg_max(coalesce(fr, timestamptz '1000-01-01 00:00:00+00'), (t, created_at, i, kind)) fr from x group by 1, 2, 3, 4),
k as (select *, row_number() over (partition by entity order by fr desc, side, p, other) k from l where act)
select entity, sum(n)::bigint as total_events, sum(a)::bigint as asserts, sum(r)::bigint as retracts, sum(c)::bigint as closed, floor(epoch(min(t0)))::bigint as first_s, floor(epoch(max(t1)))::bigint as last_s, sum((act and side = 'subject')::int)::bigint as active_out,
 sum((act and side = 'object')::int)::bigint as active_in, (select string_agg(other, ', ' order by k) from k where k <= 20 and k.entity = l.entity) as counterparts from l group by entity""",
    "entity_facts": f"with {_CUR} select s, s || ' ' || p || ' ' || o as fact from cu",
    "entity_intern": f"with {_EV}, {_IN} select * from it",
    "entity_search": f"""with {_EV}, {_SIDES}, h as (select *, contains(name, 'agent')::int + contains(name, 'core')::int + contains(name, 'desk')::int hits from z)
select name, case when min(r) = 0 then 'subject' else 'object' end as role, arg_min(n, r) as mentions, round(max(hits) + 0.01::double * arg_min(n, r), 4) as score from h where hits > 0 group by name""",
    "entity_search_typed": f"""with {_EV}, {_SIDES}, h as (select *, contains(name, 'a')::int + contains(name, 'e')::int hits from z where {_CLASSES.format('name')} = 'person')
select name, case when min(r) = 0 then 'subject' else 'object' end as role, arg_min(n, r) as mentions, round(max(hits) + 0.01::double * arg_min(n, r), 4) as score from h where hits > 0 group by name""",
    "facts_cleared": f"with {_EV} select p, count(*) as n, count(distinct s) as subjects, count(distinct o) as objects from ev where session_id is null or session_id not in (select id from sessions where session_status = 'ended') group by p",
    "time_normalise": "select id, (length(coalesce(content, '')) % 4)::int as form, case length(coalesce(content, '')) % 4 when 3 then null when 1 then floor(epoch(created_at))::bigint - 7200 else floor(epoch(created_at))::bigint end as s from (select distinct id, created_at, content from messages)",
    "kg_stats": f"with t as (select distinct triple_id, subject, predicate, object, is_active from triples) select count(distinct {_N.format('subject')}) as subjects, count(distinct {_N.format('predicate')}) as predicates, count(distinct {_N.format('object')}) as objects, sum(coalesce(is_active, true)::int)::bigint as active from t",
    "neighbors_both": f"""with {_ED}, x as (select src node, 'out' direction, dst other, label, confidence from ed union all select dst, 'in', src, label, confidence from ed),
r as (select *, row_number() over (partition by node, direction order by confidence desc nulls last, label, other) k from x) select node, direction, other, label, round(confidence, 4) as confidence from r where k <= 20""",
    "path_min_depth": f"with {_EV}, {_OR}, {_ED}{_path_sql('ed', 20)} select origin, node, depth, path, round(1::double / greatest(1, depth), 6) as confidence from b3",
    "path_as_of": f"with {_EV}, {_OR}, {_ASOF}, ee as (select s src, p as label, o dst, cf confidence from aso){_path_sql('ee', 50)} select origin, node, depth, path from b3",
    "transitive_closure": """with x as (select 'r' || n_regionkey origin, 1 depth from nation union all select 'r' || n_regionkey, 2 from nation join customer on c_nationkey = n_nationkey union all select 'r' || r_regionkey, 0 from region)
select origin, depth, count(*) as nodes from x group by origin, depth""",
    "triples_decode": f"select distinct * from (select {_N.format('subject')} as subject, {_N.format('predicate')} as predicate, {_N.format('object')} as object from triples) where subject <> '' and predicate <> '' and object <> ''",
    "relations_left_join": f"with {_EV}, {_IN}, {_ED} select src, label, dst, a.entity_type as src_type, b.entity_type as dst_type from ed left join it a on a.name = src left join it b on b.name = dst",
    "top_edges": f"with {_ED} select src as node, src || ' - ' || label || ' -> ' || dst as line from (select *, row_number() over (partition by src order by confidence desc nulls last, label, dst) k from ed) where k <= 8",
}

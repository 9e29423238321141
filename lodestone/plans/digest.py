"""Queries of short forms with the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import digest as D
from lodestone.plans.memory import _M, _messages
from lodestone.sources.tables import read_table as rt
from lodestone.sources.tables import spread


def pref_patterns(spark, d):
    """X11 over every message."""
    return D.stated_preferences(rt(spark, d, "messages").select("id", F.col("content").alias("text")))


def compress_messages(spark, d):
    """X15 over every session."""
    return D.compressed(_messages(spark, d)).select("session_id", "pos", "role", F.sha1(F.coalesce("content", F.lit(""))).alias("h"))


def tag_messages(spark, d):
    """The first messages of each session that tell a decision or a task."""
    return D.tagged(_messages(spark, d))


def hash_embed(spark, d):
    """R10 over every document."""
    return D.hash_embeddings(spread(rt(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (pref_patterns, compress_messages, tag_messages, hash_embed)}


def _q(s: str) -> str:
    return s.replace("'", "''")


_PREFS = ", ".join(f"list_transform(regexp_extract_all(t, '{_q(D.opening_pattern(o))}', 1), lambda v: {{'type': '{k}', 'value': regexp_replace(v, '^\\s+|\\s+$', '', 'g')}})" for k, o in D.PREFERENCE_OPENINGS)

SQL = {
    "pref_patterns": rf"""with {_M}, x as (select distinct id, lower(regexp_replace(coalesce(content, ''), '\s+$', '')) t from m),
y as (select id, list_slice(list_filter(flatten([{_PREFS}]), lambda r: length(r.value) > 2), 1, 10) ms from x),
z as (select id, unnest(range(1, len(ms) + 1)) pos, ms from y)
select id, pos, ms[pos].type as "type", ms[pos].value as "value" from z""",
    "compress_messages": f"""with {_M}, r as (select session_id, role, content, row_number() over (partition by session_id order by created_at nulls first, id nulls first) i,
count(*) over (partition by session_id) n from m where session_id <> ''),
u as (select session_id, 1 pos, role, content from r where i = 1 union all select session_id, 2, 'system', '{D.MARKER}' from r where i = 1 and n > 2
union all select session_id, case when n > 2 then 3 else 2 end, role, content from r where i = n and n > 1)
select session_id, pos::bigint as pos, role, sha1(coalesce(content, '')) as h from u""",
    "tag_messages": f"""with {_M}, x as (select session_id, created_at, id, lower(content) c from m where session_id <> ''),
t as (select *, 'decision' tag from x where regexp_matches(c, '{'|'.join(D.DECISION_WORDS)}') union all select *, 'task' from x where regexp_matches(c, '{'|'.join(D.TASK_WORDS)}')),
r as (select *, row_number() over (partition by session_id, tag order by created_at nulls first, id nulls first) k from t)
select session_id, tag, k as pos, substr(c, 1, 100) as content from r where k <= 5""",
}

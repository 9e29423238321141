"""Queries of context and hybrid search with the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.names import norm_name
from lodestone.operators import context as C
from lodestone.operators import search as S
from lodestone.operators.lifecycle import keep_newest
from lodestone.plans.search import _ITEMS_SQL, _TOK, _docs, _items
from lodestone.sources.tables import read_table as rt

NOW = "2026-01-01 00:00:00"
POOL = 6


def _rows(spark, d):
    """Domains of the store: lessons, episodes, workspace (other documents), kb, messages, sessions, reports, preferences, entities."""
    docs = _docs(spark, d).select("doc_kind", F.col("doc_id").cast("string").alias("id"), "path", "text")
    kind = F.when(F.col("doc_kind") == "lesson", "lessons").when(F.col("doc_kind") == "episode", "episodes").when(F.col("doc_kind") == "kb_article", "kb").otherwise("workspace")
    out = docs.select(kind.alias("domain"), "id", "path", "text", F.lit(0.0).alias("extra"))
    none = F.lit(None).cast("string").alias("path")
    m = rt(spark, d, "messages").select(F.lit("messages").alias("domain"), "id", none, F.col("content").alias("text"), F.lit(0.0).alias("extra"))
    s = rt(spark, d, "sessions").select(F.lit("sessions").alias("domain"), "id", none, F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))).alias("text"), F.lit(0.0).alias("extra"))
    r = rt(spark, d, "session_reports").select(F.lit("reports").alias("domain"), F.col("session_id").alias("id"), none, F.col("summary").alias("text"), F.lit(0.0).alias("extra"))
    f = rt(spark, d, "triples").select(norm_name(F.col("subject")).alias("s"), norm_name(F.col("predicate")).alias("p"), norm_name(F.col("object")).alias("o")).where("s <> '' and o <> ''").distinct()
    p = f.where("p = 'prefers'").select(F.lit("prefs").alias("domain"), F.concat_ws("/", "s", "o").alias("id"), none, F.concat_ws("\n", "s", "o").alias("text"), F.lit(0.0).alias("extra"))
    e = f.groupBy("s").agg(F.count("*").alias("n")).select(F.lit("entities").alias("domain"), F.col("s").alias("id"), none, F.col("s").alias("text"), F.round(0.01 * F.col("n"), 4).alias("extra"))
    for x in (m, s, r, p, e):
        out = out.unionByName(x)
    return out


def domain_search(spark, d):
    """The best of nine domains for each evaluation question, the top 30 of them all."""
    x = C.domain_hits(_rows(spark, d), _items(spark, d), POOL)
    return S.top_k(x.withColumn("key", F.concat_ws("|", "domain", "id")), 30, tie="key").select("qid", "domain", "id", "score", "rank")


def lessons_search(spark, d):
    """Lessons of a query of two words by full text over path and text, scored; recent ones where full text finds none."""
    lessons = _docs(spark, d).where("doc_kind = 'lesson'").select("doc_id", F.concat_ws("\n", F.coalesce("path", F.lit("")), F.coalesce("text", F.lit(""))).alias("text"), "created_at")
    q = _items(spark, d).select("qid", F.array_join(F.slice(T.query_tokens("text"), 1, 2), " ").alias("text")).unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("qid"), F.lit("memory server").alias("text")))
    pool = S.top_k(S.full_text(lessons, q).withColumn("score", F.round("score", 6)), 60).select("qid", "doc_id", F.lit(1.0).alias("more"))
    recent = lessons.select("doc_id", "created_at").orderBy(F.desc_nulls_last("created_at"), "doc_id").limit(100)
    rest = q.join(pool.select("qid").distinct(), "qid", "left_anti").select("qid").crossJoin(recent.select("doc_id")).withColumn("more", F.lit(0.0))
    x = pool.unionByName(rest).join(lessons.select("doc_id", "text"), "doc_id").join(q.select("qid", F.col("text").alias("phrase"), T.query_tokens("text").alias("tokens")), "qid")
    x = x.select("qid", "doc_id", F.round(C.pair_score(F.col("text"), F.col("phrase"), F.col("tokens")) + F.col("more"), 4).alias("score")).where("score > 0")
    return S.top_k(x, 20)


def _queries(spark, d):
    """The stated set of queries by example: every 20th document that has a vector, with its first four words."""
    v = rt(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = _docs(spark, d).where("doc_id % 20 = 0").select("doc_id", F.array_join(F.slice(T.query_tokens("text"), 1, 4), " ").alias("text")).join(v, "doc_id")
    return q.select(F.col("doc_id").alias("qid"), "text", "embedding"), v


def hybrid_pool(spark, d):
    """R16 up to the pool: both legs with their bonuses."""
    q, v = _queries(spark, d)
    return C.hybrid_pool(_docs(spark, d), q, v, NOW)


def hybrid_search(spark, d):
    """R15, R16 whole."""
    q, v = _queries(spark, d)
    return C.hybrid(_docs(spark, d), q, v, NOW)


def _hits(spark, d):
    x = C.domain_hits(_rows(spark, d), _items(spark, d), POOL)
    source = F.when(F.col("domain") == "workspace", "hybrid").when(F.col("domain") == "messages", "stm").otherwise(F.col("domain"))
    return x.select("qid", source.alias("source"), "id", "path", F.substring("text", 1, 800).alias("text"), "score")


def context_gather(spark, d):
    """R28, K6, W8."""
    return C.gathered(_hits(spark, d)).select("qid", "pos", "source", "id", "score")


def context_pack(spark, d):
    """R29."""
    return C.packed(C.gathered(_hits(spark, d))).select("qid", F.length("context").cast("bigint").alias("chars"), F.sha1("context").alias("h"))


def hits_filled(spark, d):
    """The best three hits of a question by full text, filled up to eight from its best by BM25."""
    docs, q = _docs(spark, d), _items(spark, d)
    short = q.select("qid", F.array_join(F.slice(T.query_tokens("text"), 1, 2), " ").alias("text"))
    best = lambda hits, k: S.top_k(hits.withColumn("score", F.round("score", 6)), k).join(docs.select("doc_id", "text"), "doc_id").select("qid", F.col("doc_id").alias("id"), "text", F.col("rank").alias("pos"))
    return C.filled(best(S.full_text(docs, short), 3), best(S.bm25(docs, q), 12), 8).select("qid", "id", "pos")


def excerpt_lines(spark, d):
    """R26 and R13 over every document, around the first place of a word."""
    at = T.match_at("text", ["memory", "server", "retention"])
    plain, numbered = C.excerpt(F.col("text"), at - 40, at + 160), C.excerpt(F.col("text"), at - 40, at + 160, numbered=True)
    return _docs(spark, d).where("text is not null").select("doc_id", F.sha1(plain).alias("plain"), F.sha1(numbered).alias("numbered"), F.sha1(C.snippet(F.col("text"))).alias("snippet"))


def memory_bundle(spark, d):
    """For each session its first messages as lines, and the newest five lessons as a list."""
    m = rt(spark, d, "messages").where("session_id <> '' and content is not null").select("session_id", "id", F.unix_micros("created_at").alias("t"), F.concat(F.lit("- "), F.coalesce("role", F.lit("?")), F.lit(": "), F.substring("content", 1, 80)).alias("line")).distinct()
    first = keep_newest(m.where("t is not null"), "session_id", ["t", "id", "line"], 10)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "id", "line"))), lambda v: v["line"]), "\n")
    lessons = _docs(spark, d).where("doc_kind = 'lesson' and text is not null").orderBy(F.desc_nulls_last("created_at"), "doc_id").limit(5).agg(F.array_join(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))), ", ").alias("lessons"))
    return first.groupBy("session_id").agg(F.sha1(lines).alias("h"), F.count("*").alias("n")).crossJoin(F.broadcast(lessons))


QUERIES = {f.__name__: f for f in (domain_search, lessons_search, hybrid_pool, hybrid_search, context_gather, context_pack, hits_filled, excerpt_lines, memory_bundle)}

_N = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"
_ROWS = f"""fx as (select distinct {_N.format('subject')} s, {_N.format('predicate')} p, {_N.format('object')} o from triples),
dr as (select case doc_kind when 'lesson' then 'lessons' when 'episode' then 'episodes' when 'kb_article' then 'kb' else 'workspace' end as domain, doc_id::varchar id, path, text, 0.0::double extra from documents
 union all select 'messages', id, null, content, 0.0 from messages union all select 'sessions', id, null, coalesce(title, '') || chr(10) || coalesce(summary, ''), 0.0 from sessions union all select 'reports', session_id, null, summary, 0.0 from session_reports
 union all select 'prefs', s || '/' || o, null, s || chr(10) || o, 0.0 from fx where s <> '' and o <> '' and p = 'prefers' union all select 'entities', s, null, s, round(0.01::double * count(*), 4) from fx where s <> '' and o <> '' group by s),
rw as (select domain || '|' || id as doc_id, domain, id, max(text) text, arg_max(path, (text, path)) path, max(extra) extra from dr where id is not null group by 1, 2, 3)"""


def _bm25(src: str, q: str, name: str) -> str:
    """CTEs that end in {name} (qid, doc_id, score) over src (doc_id, text)."""
    return rf"""{name}_q as ({q}), {name}_qq as (select qid, term, count(*) qtf from (select qid, unnest({_TOK.format('text')}) term from {name}_q) group by 1, 2),
{name}_b as (select doc_id, {_TOK.format('text')} t from {src}), {name}_st as (select count(*) n, greatest(avg(len(t)), 1.0) avgdl from {name}_b),
{name}_tf as (select doc_id, dl, term, count(*) tf from (select doc_id, len(t) dl, unnest(t) term from {name}_b) where term in (select term from {name}_qq) group by 1, 2, 3), {name}_df as (select term, count(*) df from {name}_tf group by 1),
{name} as (select qid, doc_id, round(sum(qtf * ln((n - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 6) score from {name}_tf join {name}_df using (term) join {name}_qq using (term) cross join {name}_st group by 1, 2)"""


def _fts(src: str, q: str, name: str) -> str:
    """The same for documents that hold every term."""
    return rf"""{name}_q as ({q}), {name}_qq as (select distinct qid, unnest({_TOK.format('text')}) term from {name}_q), {name}_qn as (select qid, count(*) nt from {name}_qq group by 1),
{name}_b as (select doc_id, {_TOK.format('text')} t from {src}), {name}_st as (select count(*) n, greatest(avg(len(t)), 1.0) avgdl from {name}_b),
{name}_tf as (select doc_id, dl, term, count(*) tf from (select doc_id, len(t) dl, unnest(t) term from {name}_b) where term in (select term from {name}_qq) group by 1, 2, 3), {name}_df as (select term, count(*) df from {name}_tf group by 1),
{name} as (select qid, doc_id, round(sum(greatest(ln((n - df + 0.5::double) / (df + 0.5::double)), 1e-6::double) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))), 6) score
  from {name}_tf join {name}_df using (term) join {name}_qq using (term) join {name}_qn using (qid) cross join {name}_st group by 1, 2 having count(*) = any_value(nt))"""



def _qtok(c: str, n: int) -> str:
    t = _TOK.format(c)
    return rf"list_transform(list_slice(list_sort(list_transform(list_distinct({t}), lambda x: {{'i': list_position({t}, x), 'x': x}})), 1, {n}), lambda s: s.x)"


def _pair(t: str, phrase: str, toks: str) -> str:
    low = f"lower(coalesce({t}, ''))"
    return f"""(case when {phrase} <> '' and contains({low}, lower({phrase})) then 3.0::double else 0.0::double end + len(list_filter({toks}, lambda k: instr({low}, k) > 0)) + 0.15::double * len(list_filter({toks}, lambda k: instr({low}, k) between 1 and 33))
 + len(list_filter({toks}, lambda k: instr({low}, k) > 0)) * 0.25::double / greatest(len({toks}), 1))"""


_DOMAINS = f"""{_ROWS}, {_bm25('rw', _ITEMS_SQL, 'bm')}, qt as (select qid, text phrase, {_qtok('text', 12)} toks from bm_q),
bp as (select qid, rw.doc_id, rw.domain, id, path, text, extra, b.score bm25 from (select *, row_number() over (partition by qid, split_part(doc_id, '|', 1) order by score desc, doc_id) k from bm where score > 0) b join rw on b.doc_id = rw.doc_id where k <= {POOL}),
dh as (select qid, domain, id, path, text, round(case when domain = 'workspace' then bm25 + 0.2::double * {_pair('text', 'phrase', 'toks')} else {_pair('text', 'phrase', 'toks')} end + case domain when 'lessons' then 1.0::double else 0.0::double end + extra, 4) score from bp join qt using (qid)),
hx as (select qid, case domain when 'workspace' then 'hybrid' when 'messages' then 'stm' else domain end source, id, path, substr(text, 1, 800) text, score from dh where score > 0)"""
_GATHER = rf"""{_DOMAINS}, pr as (select *, case source when 'prefs' then 0 when 'wm' then 1 when 'stm' then 2 when 'lessons' then 3 when 'episodes' then 4 else 10 end pri, regexp_replace(regexp_replace(regexp_replace(lower(substr(coalesce(text, ''), 1, 800)), '^\s+', ''), '\s+$', ''), '\s+', ' ', 'g') f from hx),
g0 as (select *, row_number() over (partition by qid, source, f order by pri, score desc, source, id) r from pr), ga as (select qid, source, id, path, text, score, row_number() over (partition by qid order by pri, score desc, source, id) pos from g0 where r = 1)"""
_TURN = """{1} as (select *, '[' || source || ' score=' || printf('%.4f', score) || ' path=' || coalesce(path, '') || ']' || chr(10) || coalesce(text, '') || chr(10) block from (select *, min(pos) over (partition by qid, coalesce(path, '(no-path)')) first, row_number() over (partition by qid, coalesce(path, '(no-path)') order by pos) turn from ga where {0}) where turn <= 2),
{1}u as (select *, row_number() over w place, sum(length(block)) over (w rows unbounded preceding) upto from {1} window w as (partition by qid order by turn, first))"""
_PACK = rf"""{_GATHER}, {_TURN.format("source <> 'hybrid'", 'pa')}, {_TURN.format("source = 'hybrid'", 'pb')},
ka as (select qid, 0 part, place, case when upto <= 1400 then block else substr(block, 1, (1400 - upto + length(block))::int) end block from pau where upto <= 1400 or 1400 - upto + length(block) > 80),
us as (select qid, sum(length(block)) used from ka group by 1), bb as (select pbu.*, 4000 - coalesce(used, 0) lim from pbu left join us using (qid)),
kb as (select qid, 1 part, place, case when upto <= lim then block else substr(block, 1, (lim - upto + length(block))::int) end block from bb where upto <= lim or lim - upto + length(block) > 80),
pp as (select qid, part, regexp_replace(regexp_replace(string_agg(block, chr(10) order by place), '^\s+', ''), '\s+$', '') t from (select * from ka union all select * from kb) group by 1, 2), cx as (select qid, string_agg(t, chr(10) || chr(10) order by part) c from pp group by 1)"""
_LS = "ls as (select doc_id, coalesce(path, '') || chr(10) || coalesce(text, '') as text, created_at from documents where doc_kind = 'lesson')"
_LQ = f"select qid, array_to_string({_qtok('text', 2)}, ' ') as text from ({_ITEMS_SQL}) union all select -1, 'memory server'"
_HQ = f"select doc_id qid, array_to_string({_qtok('text', 4)}, ' ') as text from documents where doc_id % 20 = 0 and doc_id in (select vec_id from embeddings)"
_AT = "coalesce(least(nullif(instr(lower(text), 'memory'), 0), nullif(instr(lower(text), 'server'), 0), nullif(instr(lower(text), 'retention'), 0)) - 1, 0)"
_TRIM = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"

SQL = {
    "domain_search": f"with {_DOMAINS} select qid, domain, id, score, rank from (select *, (row_number() over (partition by qid order by score desc, domain || '|' || id))::int rank from dh where score > 0) where rank <= 30",
    "lessons_search": f"""with {_LS}, {_fts('ls', _LQ, 'ft')}, pl as (select qid, doc_id, 1.0::double more from (select *, row_number() over (partition by qid order by score desc, doc_id) k from ft) where k <= 60),
al as (select * from pl union all select qid, doc_id, 0.0::double from ft_q, (select doc_id from ls order by created_at desc nulls last, doc_id limit 100) where qid not in (select qid from pl)),
sc as (select qid, doc_id, round({_pair('ls.text', 'ft_q.text', _qtok('ft_q.text', 12))} + more, 4) score from al join ls using (doc_id) join ft_q using (qid))
select qid, doc_id, score, rank from (select *, (row_number() over (partition by qid order by score desc, doc_id))::int rank from sc where score > 0) where rank <= 20""",
    "hybrid_pool": f"""with {_bm25('documents', _HQ, 'bm')}, lf as (select qid, doc_id, score, 'fts' leg from (select *, row_number() over (partition by qid order by score desc, doc_id) k from bm where score > 0) where k <= 24),
cs as (select q.vec_id qid, v.vec_id doc_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) score from embeddings q, embeddings v where q.vec_id in (select qid from bm_q)),
lv as (select qid, doc_id, round(score, 6), 'vector' from (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) k from cs) where k <= 24), lg as (select * from lf union all select * from lv),
nm as (select *, case when max(score) over w = min(score) over w then 1.0::double else (score - min(score) over w) / (max(score) over w - min(score) over w) end norm from lg window w as (partition by qid, leg)),
dd as (select doc_id, path, (1767225600 - floor(epoch(created_at))) / 86400.0::double age from documents)
select qid, doc_id, leg, round(norm + case when len(list_filter(list_slice(list_distinct(list_filter({_TOK.format('bm_q.text')}, lambda k: length(k) >= 3)), 1, 40), lambda k: contains(lower(coalesce(path, '')), k))) > 0 then 0.15::double else 0.0::double end
 + case when age between 0 and 365 then 0.12::double * exp(-age / 30) else 0.0::double end, 5) as score from nm join dd using (doc_id) join bm_q using (qid)""",
    "context_gather": f"with {_GATHER} select qid, pos::int as pos, source, id, score from ga",
    "context_pack": f"with {_PACK} select qid, length(c) as chars, sha1(c) as h from cx",
    "hits_filled": rf"""with {_fts('documents', f"select qid, array_to_string({_qtok('text', 2)}, ' ') as text from ({_ITEMS_SQL})", 'ft')}, {_bm25('documents', _ITEMS_SQL, 'bm')},
u as (select qid, doc_id, 0 l, row_number() over (partition by qid order by score desc, doc_id) pos from ft qualify pos <= 3 union all select qid, doc_id, 1, row_number() over (partition by qid order by score desc, doc_id) pos from bm where score > 0 qualify pos <= 12),
f as (select u.*, regexp_replace({_TRIM.format("lower(substr(coalesce(text, ''), 1, 1200))")}, '\s+', ' ', 'g') f from u join documents using (doc_id)), o as (select *, row_number() over (partition by qid, f order by l, pos, doc_id) r from f)
select qid, id, pos from (select qid, doc_id as id, (row_number() over (partition by qid order by l, pos, doc_id))::int pos from o where r = 1) where pos <= 8""",
    "excerpt_lines": rf"""with p as (select doc_id, text, greatest(0, {_AT} - 40) a, least(length(text), {_AT} + 160) z from documents where text is not null),
q as (select *, case when contains(substr(text, 1, a), chr(10)) then a - length(regexp_extract(substr(text, 1, a), '[^\n]*$')) else a end a2, case when contains(substr(text, z + 1), chr(10)) then z + instr(substr(text, z + 1), chr(10)) - 1 else z end z2 from p),
c as (select doc_id, text, regexp_replace(case when z > a then substr(text, a2 + 1, z2 - a2) else '' end, '\r\n?', chr(10), 'g') c, len(string_split(regexp_replace(substr(text, 1, a2), '\r\n?', chr(10), 'g'), chr(10))) n from q),
l as (select *, string_split(c, chr(10)) ls from c), k as (select *, case when len(ls) > 80 then list_append(list_slice(ls, 1, 80), '…') else ls end ks from l), s as (select *, {_TRIM.format("regexp_replace(text, '\\r?\\n', ' ', 'g')")} sn from k)
select doc_id, sha1({_TRIM.format('c')}) as plain, sha1(case when c <> '' then regexp_replace(array_to_string(list_transform(ks, lambda x, i: lpad((n + i - 1)::varchar, length((n + len(ks) - 1)::varchar)::int, ' ') || ': ' || x), chr(10)), '\s+$', '') else '' end) as numbered,
 sha1(case when length(sn) > 240 then substr(sn, 1, 240) || '…' else sn end) as snippet from s""",
    "memory_bundle": """with m as (select distinct session_id, id, epoch_us(created_at) t, '- ' || coalesce(role, '?') || ': ' || substr(content, 1, 80) line from messages where session_id <> '' and content is not null and created_at is not null),
r as (select *, row_number() over (partition by session_id order by t, id, line) k from m), l as (select string_agg(doc_id, ', ' order by doc_id) ids from (select doc_id::varchar doc_id from documents where doc_kind = 'lesson' and text is not null order by created_at desc nulls last, documents.doc_id limit 5))
select session_id, sha1(string_agg(line, chr(10) order by k)) as h, count(*) as n, (select ids from l) as lessons from r where k <= 10 group by 1""",
}

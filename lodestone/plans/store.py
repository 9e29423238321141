"""Queries of stored rows, files and housekeeping with the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.names import norm_name
from lodestone.operators import extract as X
from lodestone.operators import lifecycle as L
from lodestone.operators import store as W
from lodestone.plans.search import _CHUNK_SQL, _chunks, _docs
from lodestone.sources import files as Y
from lodestone.sources.tables import read_table as rt

NOW = "2026-01-01 00:00:00"
DENY = ("/runbooks/*", "*.secret", "/notes/[0-3]*", "/transcripts/?a*")


def _reports(spark, d):
    return rt(spark, d, "session_reports").select("session_id", "created_at", F.col("writer").alias("title"), "summary").distinct()


def episodes_insert(spark, d):
    """Reports as episodes with expiry, fingerprint and document."""
    x = W.episodes(_reports(spark, d))
    return x.select("session_id", "fingerprint", F.unix_seconds("expires_at").alias("expires_s"), F.sha1("doc").alias("h"), F.length("path").cast("bigint").alias("path_chars"))


def messages_add(spark, d):
    """Sessions that messages create, with the number of messages they came with."""
    m, new = W.added_messages(rt(spark, d, "messages").select("id", "session_id", "created_at", "content").distinct(), rt(spark, d, "sessions"))
    return new.join(m.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("messages")), "id").select("id", F.unix_micros("created_at").alias("created_us"), "messages")


def kb_add(spark, d):
    """Articles by format with their titles, to be indexed."""
    p = Y.parsed(_docs(spark, d).where("doc_kind = 'kb_article' and text is not null").select(F.coalesce("path", F.lit("untitled.txt")).alias("path"), "text").distinct())
    return p.select("path", "format", F.coalesce("title", F.lit("Untitled")).alias("title"), F.sha1("body").alias("h"), F.lit(False).alias("indexed"))


def _graph(spark, d):
    t = rt(spark, d, "triples").select(norm_name(F.col("subject")).alias("src"), norm_name(F.col("predicate")).alias("label"), norm_name(F.col("object")).alias("dst"), F.coalesce("confidence", F.lit(0.0)).alias("weight"), F.coalesce(F.unix_micros("updated_at"), F.lit(0)).alias("at")).where("src <> '' and dst <> '' and label <> ''")
    return W.graph(t.withColumn("src_type", F.lit("subject")).withColumn("dst_type", F.lit("object")))


def graph_nodes(spark, d):
    """D12, T16."""
    return _graph(spark, d)[0]


def graph_edges(spark, d):
    """The latest weight of every edge."""
    return _graph(spark, d)[1].withColumn("weight", F.round("weight", 4))


def memories_store(spark, d):
    """Stored memories per type with their source texts clipped."""
    x = W.stored_memories(_docs(spark, d).select("doc_id", F.col("source").alias("entity_id"), "text"))
    return x.groupBy("entity_id", "memory_type").agg(F.countDistinct("id").alias("n"), F.max(F.length("source_text")).alias("longest"))


def import_actions(spark, d):
    """Every other session's title imported over the others', with replacement; archived sessions are locked."""
    s = rt(spark, d, "sessions").select("id", "title", "archived", F.ascii(F.right("id", F.lit(1))).alias("c"))
    old = s.where("c % 3 > 0").select(F.col("id").alias("key"), F.col("title").alias("value"), F.col("archived").alias("locked"))
    new = s.where("c % 2 = 0").select(F.col("id").alias("key"), F.concat(F.coalesce("title", F.lit("")), F.when(F.col("c") % 4 == 0, F.lit("!")).otherwise(F.lit(""))).alias("value"))
    return W.imported(old, new, mode="replace").select("key", F.coalesce("value", F.lit("")).alias("value"), "action")


def import_merge(spark, d):
    """D22 in the mode that only adds."""
    s = rt(spark, d, "sessions").select("id", "title", F.ascii(F.right("id", F.lit(1))).alias("c"))
    x = W.imported(s.where("c % 3 > 0").select(F.col("id").alias("key"), F.col("title").alias("value"), F.lit(False).alias("locked")), s.where("c % 2 = 0").select(F.col("id").alias("key"), F.col("title").alias("value")))
    return x.groupBy("action").agg(F.count("*").alias("n"))


def export_documents(spark, d):
    """Fields read back from every session's document."""
    x = W.exported(rt(spark, d, "sessions"), rt(spark, d, "messages"))
    got = F.from_json("document", "schema int, session struct<title:string,status:string>, messages array<struct<id:string,role:string,content:string>>")
    y = x.select("id", got.alias("g"))
    return y.select("id", F.col("g.session.title").alias("title"), F.col("g.session.status").alias("status"), F.coalesce(F.size("g.messages"), F.lit(0)).alias("n"), F.sha1(F.array_join(F.transform("g.messages", lambda m: F.coalesce(m["content"], F.lit(""))), "|")).alias("h"))


def _ended(spark, d):
    return rt(spark, d, "sessions").where("session_status = 'ended'").select(F.col("id").alias("session_id"))


def gdpr_erase_all(spark, d):
    """Rows that are left of every table that knows the ended sessions."""
    tables = {"sessions": "id", "messages": "session_id", "session_reports": "session_id", "fact_ops": "session_id", "triples": "session_id"}
    left = W.erasure({t: (rt(spark, d, t).select(k), k) for t, k in tables.items()}, _ended(spark, d))
    return W.report(left).withColumnRenamed("step", "name")


def gdpr_pseudonymise(spark, d):
    """The log of facts with the ended sessions' names replaced, counted per name."""
    x = W.pseudonymous(rt(spark, d, "fact_ops").select("seq", "session_id").distinct(), _ended(spark, d), "session_id")
    return x.groupBy("session_id").agg(F.count("*").alias("n"))


def gdpr_anonymise(spark, d):
    """Sessions with title and summary of the ended ones replaced."""
    return W.anonymous(rt(spark, d, "sessions").select("id", "title", "summary", "client"), _ended(spark, d), "id", ["title", "summary"]).select("id", "title", F.sha1("summary").alias("h"), "client")


def episodes_prune(spark, d):
    """Sessions of a client by age and count."""
    x = rt(spark, d, "sessions").select("id", F.coalesce("client", F.lit("")).alias("session_id"), "created_at")
    return W.pruned_episodes(x, "2026-03-01 00:00:00", 120, 50).select("id", "fate")


def log_prune(spark, d):
    """The event log by age, per user, and in all."""
    x = rt(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), "ts")
    return W.pruned_log(x, "2024-01-31 00:00:00", 20, 40, 1500).select("id")


def housekeeping(spark, d):
    """What is left after each step of a run."""
    ev = rt(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), "ts")
    docs = _docs(spark, d).select("doc_id", "created_at")
    return W.report({"log": W.pruned_log(ev, "2024-01-31 00:00:00", 20, 40, 1500), "lessons": L.alive(docs, F.col("created_at") + F.expr("interval 90 days"), NOW), "messages": rt(spark, d, "messages").select("id").distinct()})


def decay_report(spark, d):
    """Lessons by what a maintenance run makes of them: merged into a copy, pruned by age, faded or kept."""
    x = _docs(spark, d).where("doc_kind = 'lesson'").select("doc_id", "created_at", "text")
    x = x.join(L.duplicate_lessons(x), "doc_id", "left").withColumn("score", L.decayed(F.col("created_at"), NOW))
    fate = F.when(F.col("winner").isNotNull(), "merged").when(F.col("created_at").isNull(), "undated").when(F.col("created_at") < F.lit("2025-01-01").cast("timestamp"), "pruned").when(F.col("score") < 0.5, "faded").otherwise("kept")
    return x.groupBy(fate.alias("fate")).agg(F.count("*").alias("n"))


def correction_fold(spark, d):
    """Preferences from the log of facts, snapshots being automatic writes, with a correction for some subjects."""
    n = norm_name
    log = rt(spark, d, "fact_ops").where("seq is not null").select(n(F.col("subject")).alias("key"), "seq", F.when(F.col("source_type") == "manual", "manual").otherwise("auto").alias("source"), n(F.col("object")).alias("value"), n(F.col("predicate")).alias("p"), n(F.col("action")).alias("a")).where("p = 'prefers' and a = 'assert' and key <> '' and value <> ''").distinct()
    fix = log.where("seq % 50 = 0").select("key", F.concat(F.lit("corrected "), "key").alias("value")).distinct()
    return L.locked_preferences(W.corrected(log, fix))


def pref_capture(spark, d):
    """Preferences that documents state, captured per workspace; the newest document's holds."""
    wish = F.when(F.lower("lang") == "en", "Answer in English").when(F.lower("lang") == "ru", "Отвечай на русском").otherwise("Prices in UAH")
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), "source", wish.alias("text"))
    got = X.inferred_preferences(docs.select("id", "text")).join(docs.select("id", F.coalesce("source", F.lit("")).alias("source")), "id")
    log = got.select(F.concat_ws(":", "source", "key").alias("key"), F.col("id").alias("seq"), F.lit("auto").alias("source"), "value")
    return L.locked_preferences(log)


def consolidate_heuristic(spark, d):
    """X10 over every document."""
    return W.heuristic_consolidation(_docs(spark, d).select("doc_id", "text")).select("doc_id", "topic", "keywords", F.sha1("summary").alias("h"), "preferences")


def feedback_parse(spark, d):
    """X17 over every message."""
    x = rt(spark, d, "messages").select("id", F.col("content").alias("text")).distinct()
    return W.feedback(x).select("id", F.sha1("key").alias("k"), F.sha1(F.coalesce("value", F.lit("null"))).alias("v"))


def json_decode(spark, d):
    """Turn of messages and number of observations of sessions, damaged JSON as none."""
    m = rt(spark, d, "messages").select("id", "metadata_json").distinct().select(F.lit("message").alias("kind"), "id", F.coalesce(F.expr("try_cast(get_json_object(metadata_json, '$.turn') as bigint)"), F.lit(-1)).alias("n"))
    s = rt(spark, d, "sessions").select(F.lit("session").alias("kind"), "id", F.size(W.decoded(F.col("observations_json"), "array<string>", F.array().cast("array<string>"))).cast("bigint").alias("n"))
    return m.unionByName(s)


def prefix_list(spark, d):
    """Keys with a prefix."""
    return _docs(spark, d).where(F.startswith(F.col("path"), F.lit("/lessons/"))).select("doc_id", "path")


def index_status(spark, d):
    """Documents, chunks and characters of every kind."""
    c = _chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))
    return _docs(spark, d).select("doc_id", "doc_kind").join(c, "doc_id", "left").groupBy("doc_kind").agg(F.count("*").alias("documents"), F.count("chunks").alias("indexed"), F.sum("chunks").alias("chunks"), F.sum("chars").alias("chars"))


def _files(spark, d):
    """Documents as files: path, modified, length, content; some hold a zero byte."""
    body = F.when(F.col("doc_id") % 97 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("\x00"))).otherwise(F.coalesce("text", F.lit(""))).cast("binary")
    return _docs(spark, d).where("path is not null").select("path", F.col("created_at").alias("modified"), F.octet_length(body).cast("bigint").alias("length"), body.alias("content"))


def file_scan(spark, d):
    """Files of a scan with deny patterns, a size and an ending, no binaries."""
    return Y.scanned(_files(spark, d), DENY, 2000, ["md"]).select("path", "length").distinct()


def file_changes(spark, d):
    """Of the files on a list, those that are new or changed since an index of the older ones."""
    x = _files(spark, d)
    index = x.where("modified < timestamp'2025-10-01 00:00:00'").select("path", "modified", F.when(F.col("length") % 5 == 0, F.col("length") + 1).otherwise(F.col("length")).alias("length"))
    return Y.changed(Y.scanned(x, paths=x.where("length > 100").select("path")), index).select("path").distinct()


def file_missing(spark, d):
    """Entries of an index whose files a scan did not see."""
    x = _files(spark, d).select("path", "modified", "length")
    return Y.missing(x.select("path").distinct(), x.where("modified >= timestamp'2025-10-01 00:00:00'"))


def code_imports(spark, d):
    """Modules that texts import; every document ends with an import of its workspace."""
    own = F.concat(F.coalesce("text", F.lit("")), F.lit("\nfrom "), F.col("doc_kind"), F.lit("."), F.col("source"), F.lit(" import all"))
    return Y.imports(_docs(spark, d).select(F.col("doc_id").alias("path"), own.alias("text")))


def query_sanitise(spark, d):
    """Questions without signs, and their scores in their own fields."""
    return rt(spark, d, "eval_items").select("item_id", T.sanitized("question").alias("query"), F.round(T.fields_score(["question", "answer"], "memory", ["the", "не"]), 4).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        episodes_insert, messages_add, kb_add, graph_nodes, graph_edges, memories_store, import_actions, import_merge, export_documents, gdpr_erase_all, gdpr_pseudonymise, gdpr_anonymise, episodes_prune, log_prune, housekeeping, decay_report,
        correction_fold, pref_capture, consolidate_heuristic, feedback_parse, json_decode, prefix_list, index_status, file_scan, file_changes, file_missing, code_imports, query_sanitise,
    )
}

_N = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"
_GONE = "(select id from sessions where session_status = 'ended')"
_TR = f"tr as (select *, 'gn_' || substr(sha256('subject:' || s), 1, 24) si, 'gn_' || substr(sha256('object:' || o), 1, 24) oi from (select {_N.format('subject')} s, {_N.format('predicate')} p, {_N.format('object')} o, coalesce(confidence, 0) w, coalesce(epoch_us(updated_at), 0) upd from triples) where s <> '' and p <> '' and o <> '')"
_TRIM = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_LOG = "lp as (select event_id, user_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from events where ts >= timestamp '2024-01-11 00:00:00') where k <= 40 order by ts desc, event_id desc limit 1500)"
_FILES = "fl as (select path, created_at m, doc_id % 97 = 0 zero, coalesce(text, '') t, octet_length(encode(coalesce(text, ''))) + (doc_id % 97 = 0)::int n from documents where path is not null)"
_COR = "not =not |cannot=cannot|won't=won't|don't want=don't want|don't like=don't like|this is not=this is not|changed my mind=changed my mind|не =not |нельзя=cannot|не буду=won't|не хочу=don't want|не люблю=don't like|это не=this is not|передумал=changed my mind|передумала=changed my mind|не можна=cannot|це не=this is not|передумав=changed my mind"
_ADD = "i |my |i work|i live|я |мой |моя |моё |я работаю|я живу|мій |моє |я працюю"
_KEYS = "love=like|work at=work_at|live in=live_in|люблю=like|нравится=like|ненавижу=hate|предпочитаю=prefer|работаю в=work_at|живу в=live_in|подобається=like|ненавиджу=hate|віддаю перевагу=prefer|працюю в=work_at"


def _key(c: str) -> str:
    c = f"regexp_replace(lower(trim({c})), '[?!.]', '', 'g')"
    for pair in _KEYS.split("|"):
        a, b = pair.split("=")
        c = f"replace({c}, '{a}', '{b}')"
    return rf"nullif(substr(array_to_string(list_slice(list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> ''), 1, 3), '_'), 1, 50), '')"


def _feedback_sql() -> str:
    out = []
    for i, pair in enumerate(_COR.split("|")):
        a, b = (x.replace("'", "''") for x in pair.split("="))
        out.append(f"select id, {i} i, {_key(f'''substr(low, 1, (instr(low, '{a}') - 1)::int)''')} k, lower(trim(replace(substr(low, (instr(low, '{a}') + {len(pair.split('=')[0])})::int), '{a}', '{b}'))) v, true c from m where instr(low, '{a}') > 0")
    for i, a in enumerate(_ADD.split("|")):
        after = f"trim(substr(t, (instr(low, '{a}') + {len(a)})::int))"
        out.append(f"select id, {100 + i}, {_key(after)}, trim(split_part({after}, ',', 1)), false from m where instr(low, '{a}') > 0")
    pos, neg = "coffee|tea|yes|true|кофе|чай|да|правда|кава|так", "no|false|нет|ложь|ні"
    return f"""with m as (select distinct id, content t, lower(content) low from messages where content <> ''), f as ({' union all '.join(out)}),
o as (select *, row_number() over (partition by id order by i) r from f where k is not null)
select id, sha1(k) as k, sha1(coalesce(case when not c then v when regexp_matches(v, '{pos}') then 'false' when regexp_matches(v, '{neg}') then 'true' when v <> '' then v end, 'null')) as v from o where r = 1"""


SQL = {
    "episodes_insert": """with r as (select distinct session_id, created_at, writer, summary, sha256(lower(coalesce(writer, '')) || chr(10) || lower(coalesce(summary, ''))) fp from session_reports where session_id is not null), e as (select *, row_number() over (partition by session_id, fp order by created_at nulls first, writer nulls first, summary nulls first) k from r)
select session_id, fp as fingerprint, floor(epoch(created_at))::bigint + 60 * 86400 as expires_s, sha1('# ' || coalesce(writer, '') || chr(10) || chr(10) || coalesce(summary, '')) as h, (9 + length(session_id) + 1 + 19 + 3)::bigint as path_chars from e where k = 1""",
    "messages_add": "select session_id as id, epoch_us(min(created_at)) as created_us, count(*) as messages from (select distinct id, session_id, created_at, content from messages where session_id <> '') where session_id not in (select id from sessions) group by 1",
    "graph_nodes": f"with {_TR} select distinct si as id, s as label, 'subject' as type from tr union select oi, o, 'object' from tr",
    "graph_edges": f"with {_TR} select si as source_id, oi as target_id, p as relation, round(arg_max(w, (upd, w)), 4) as weight from tr group by 1, 2, 3",
    "import_actions": """with s as (select id, title, coalesce(archived, false) l, ascii(right(id, 1)) c from sessions), a as (select * from s where c % 3 > 0), b as (select id, coalesce(title, '') || case when c % 4 = 0 then '!' else '' end v from s where c % 2 = 0)
select coalesce(a.id, b.id) as key, case when a.id is null then v when b.id is null or a.title is not distinct from v or l then coalesce(title, '') else v end as value,
 case when a.id is null then 'added' when b.id is null then 'kept' when a.title is not distinct from v then 'skipped' when l then 'skipped_locked' else 'updated' end as action from a full join b on a.id = b.id""",
    "import_merge": """with s as (select id, ascii(right(id, 1)) c from sessions) select case when c % 3 > 0 and c % 2 = 0 then 'skipped' when c % 3 > 0 then 'kept' else 'added' end as action, count(*) as n from s where c % 3 > 0 or c % 2 = 0 group by 1""",
    "gdpr_erase_all": " union all ".join(f"select '{t}' as name, count(*) as n from {t} where {k} is null or {k} not in {_GONE}" for t, k in (("sessions", "id"), ("messages", "session_id"), ("session_reports", "session_id"), ("fact_ops", "session_id"), ("triples", "session_id"))),
    "gdpr_pseudonymise": f"select case when session_id in {_GONE} then '[DELETED]' else session_id end as session_id, count(*) as n from (select distinct seq, session_id from fact_ops) group by 1",
    "gdpr_anonymise": "select id, case when session_status = 'ended' then '[ANONYMIZED]' else title end as title, sha1(case when session_status = 'ended' then '[ANONYMIZED]' else summary end) as h, client from sessions",
    "episodes_prune": """with x as (select id, coalesce(client, '') c, created_at, coalesce(created_at < timestamptz '2026-03-01 00:00:00+00' - interval 120 day, false) old from sessions)
select id, case when old then 'by_age' when row_number() over (partition by c, old order by created_at desc nulls last, id) > 50 then 'by_count' else 'kept' end as fate from x""",
    "log_prune": f"with {_LOG} select event_id as id from lp",
    "housekeeping": f"with {_LOG} select 'log' as step, count(*) as n from lp union all select 'lessons', count(*) from documents where created_at is null or created_at + interval 90 day > timestamptz '2026-01-01 00:00:00+00' union all select 'messages', count(distinct id) from messages",
    "decay_report": rf"""with x as (select doc_id, created_at, regexp_replace({_TRIM.format("lower(coalesce(text, ''))")}, '\s+', ' ', 'g') f from documents where doc_kind = 'lesson'),
w as (select *, f <> '' and row_number() over (partition by f order by coalesce(epoch_us(created_at), -1) desc, doc_id) > 1 dup, pow(0.9::double, (1767225600 - floor(epoch(created_at))) / 2592000.0::double) score from x)
select case when dup then 'merged' when created_at is null then 'undated' when created_at < timestamptz '2025-01-01 00:00:00+00' then 'pruned' when score < 0.5 then 'faded' else 'kept' end as fate, count(*) as n from w group by 1""",
    "correction_fold": f"""with l as (select distinct {_N.format('subject')} k, seq, coalesce(source_type = 'manual', false) man, {_N.format('object')} v from fact_ops where {_N.format('predicate')} = 'prefers' and {_N.format('action')} = 'assert' and {_N.format('subject')} <> '' and {_N.format('object')} <> '' and seq is not null),
a as (select * from l union all select distinct k, (select max(seq) + 1 from l), true, 'corrected ' || k from l where seq % 50 = 0)
select k as key, coalesce(arg_max(v, seq) filter (man), arg_max(v, seq)) as value, max(man::int) as locked from a group by 1""",
    "pref_capture": """with w as (select coalesce(source, '') || ':' || case when lower(lang) in ('en', 'ru') then 'style.language' else 'finance.currency' end as key, doc_id, case when lower(lang) in ('en', 'ru') then lower(lang) else 'UAH' end v from documents)
select key, arg_max(v, doc_id) as value, 0 as locked from w group by 1""",
    "feedback_parse": _feedback_sql(),
    "json_decode": """select distinct 'message' as kind, id, coalesce(try_cast(case when json_valid(metadata_json) then json_extract_string(metadata_json, '$.turn') end as bigint), -1) as n from messages
 union all select 'session', id, case when observations_json is not null and json_valid(observations_json) and json_type(observations_json::json) = 'ARRAY' then json_array_length(observations_json::json)::bigint else 0 end from sessions""",
    "prefix_list": "select doc_id, path from documents where starts_with(path, '/lessons/')",
    "index_status": f"""with c as (select doc_id, count(*) n, sum(length(c)) chars from ({_CHUNK_SQL}) group by 1) select doc_kind, count(*) as documents, count(n) as indexed, sum(n)::bigint as chunks, sum(chars)::bigint as chars from documents left join c using (doc_id) group by 1""",
    "file_scan": f"with {_FILES} select distinct path, n::bigint as length from fl where not zero and n <= 2000 and path like '%.md' and not (path like '/runbooks/%' or path like '%.secret' or regexp_matches(path, '^/?notes/[0-3]') or regexp_matches(path, '^/?transcripts/.a'))",
    "file_changes": f"with {_FILES} select distinct path from fl where not zero and n <= 512000 and path in (select path from fl where n > 100) and (path, m, n) not in (select path, m, case when n % 5 = 0 then n + 1 else n end from fl where m < timestamptz '2025-10-01 00:00:00+00')",
    "file_missing": f"with {_FILES} select distinct path from fl where path not in (select path from fl where m >= timestamptz '2025-10-01 00:00:00+00')",
    "code_imports": r"select distinct doc_id as path, unnest(regexp_extract_all(coalesce(text, '') || chr(10) || 'from ' || doc_kind || '.' || source || ' import all', '(?m)^[ \t]*(?:from|import)[ \t]+([\w.]+)', 1)) as module from documents",
    "query_sanitise": r"""select item_id, trim(regexp_replace(coalesce(question, ''), '[^\p{L}\p{N}_]+', ' ', 'g')) as query, round(case when contains(t, 'memory') then 3.0::double else 0 end + contains(t, 'the')::int + contains(t, 'не')::int + 0.15::double * ((instr(t, 'the') between 1 and 33)::int + (instr(t, 'не') between 1 and 33)::int)
 + 0.125::double * (contains(t, 'the')::int + contains(t, 'не')::int), 4) as score from (select item_id, question, lower(coalesce(question, '') || chr(10) || coalesce(answer, '')) t from eval_items)""",
}

"""Queries of extraction, sessions and lifecycle with the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import extract as X
from lodestone.operators import lifecycle as L
from lodestone.operators import sessions as Q
from lodestone.sources.tables import read_table as rt

NOW = "2026-01-01 00:00:00"


# --- extraction --------------------------------------------------------------------------------------------------------


def _docs(spark, d):
    return rt(spark, d, "documents")


def extract_memories(spark, d):
    return X.memories(_docs(spark, d)).groupBy("doc_id", "memory_type").agg(F.count("*").alias("n"), F.min(F.sha1("content")).alias("h"))


def extraction_stats(spark, d):
    """A5."""
    return X.memories(_docs(spark, d)).groupBy("memory_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def extract_triples(spark, d):
    return X.triples(_docs(spark, d)).groupBy("doc_id", "predicate").agg(F.count("*").alias("n"), F.min(F.sha1(F.concat_ws("|", "subject", "object"))).alias("h"))


def infer_prefs(spark, d):
    """X3 over every document, its label put into words before it as a wish."""
    wish = F.when(F.lower("lang") == "en", "Answer in English").when(F.lower("lang") == "ru", "Отвечай на русском").when(F.lower("lang") == "uk", "Відповідай українською").when(F.col("lang").isNull(), "All code must be in English").otherwise("Prices in UAH")
    return X.inferred_preferences(_docs(spark, d).select(F.col("doc_id").alias("id"), F.concat_ws(". ", wish, "text").alias("text")))


def lesson_mining(spark, d):
    return X.lessons(_docs(spark, d)).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.sha1("lesson").alias("h"), "score")


def propose_lessons(spark, d):
    return X.proposals(_docs(spark, d)).select("key", "lesson", "score", "mentions")


def propose_prefs(spark, d):
    """The same wishes, added up."""
    wish = F.when(F.lower("lang") == "en", "Answer in English").when(F.lower("lang") == "ru", "Отвечай на русском").when(F.lower("lang") == "uk", "Відповідай українською").when(F.col("lang").isNull(), "All code must be in English").otherwise("Prices in UAH")
    return X.preference_proposals(_docs(spark, d).select(F.col("doc_id").alias("id"), F.col("created_at").alias("at"), wish.alias("text")))


def keywords_topn(spark, d):
    return X.keywords(_docs(spark, d))


def identifiers_topn(spark, d):
    return X.identifiers(_docs(spark, d))


def entity_heuristics(spark, d):
    return X.entity_hints(_docs(spark, d))


# --- sessions ----------------------------------------------------------------------------------------------------------


def _messages(spark, d, *cols):
    """Messages without repeated rows, in the columns asked for."""
    x = rt(spark, d, "messages")
    return (x.select("id", *cols) if cols else x).distinct()


def conv_stats(spark, d):
    """A3."""
    x = _messages(spark, d, "role", "session_id", F.length("content").alias("chars"))
    return x.groupBy(F.coalesce("role", F.lit("")).alias("role")).agg(F.count("*").alias("messages"), F.countDistinct("session_id").alias("sessions"), F.sum("chars").alias("chars"))


def kb_stats(spark, d):
    """A4."""
    return _docs(spark, d).groupBy("doc_kind", F.col("n_chars").isNotNull().alias("counted")).agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.sum(F.length("text")).alias("chars"))


def table_counts(spark, d):
    """The rows of every table of the store."""
    out = None
    for t in ("sessions", "session_reports", "messages", "fact_ops", "triples", "documents", "eval_items", "events"):
        x = rt(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = x if out is None else out.unionByName(x)
    return out


def session_stats(spark, d):
    """Sessions and reports by status."""
    s = rt(spark, d, "sessions")
    r = rt(spark, d, "session_reports").select(F.col("session_id").alias("id")).distinct().withColumn("has", F.lit(1))
    return s.join(r, "id", "left").groupBy("session_status").agg(F.count("*").alias("sessions"), F.count("has").alias("reported"), F.sum(F.coalesce("archived", F.lit(False)).cast("bigint")).alias("archived"))


def reports_of_closed(spark, d):
    """Reports of sessions that are completed or ended."""
    closed = rt(spark, d, "sessions").where("session_status in ('completed', 'ended')").select(F.col("id").alias("session_id"))
    return rt(spark, d, "session_reports").select("session_id", "writer", "entries_stored").distinct().join(closed, "session_id", "left_semi")


def sessions_without_messages(spark, d):
    """J6, U6."""
    return rt(spark, d, "sessions").select("id").join(rt(spark, d, "messages").select(F.col("session_id").alias("id")), "id", "left_anti")


def messages_page(spark, d):
    """K1: the second page of 50 messages, newest first."""
    return _messages(spark, d, F.unix_micros("created_at").alias("t")).orderBy(F.desc("t"), "id").offset(50).limit(50)


def session_gap20(spark, d):
    return Q.gap_sessions(rt(spark, d, "events"), "user_id", "ts")


def session_end_marker(spark, d):
    """ST5 on message texts; a closed session says so at its end."""
    m = _messages(spark, d, "session_id", F.col("created_at").alias("ts"), Q.is_end(F.col("content")).alias("end")).where("session_id <> ''")
    ends = rt(spark, d, "sessions").where("ended_at is not null").select(F.concat(F.lit("end-"), "id").alias("id"), F.col("id").alias("session_id"), F.col("ended_at").alias("ts"), Q.is_end(F.lit("Session ended.")).alias("end"))
    return Q.ended_by_marker(m.unionByName(ends), "session_id", "ts", F.col("end"), "id")


def session_summary(spark, d):
    """The titles (roles and the first words of the text) of the first ten messages of each session, in order."""
    m = rt(spark, d, "messages").where("session_id <> '' and created_at is not null").select("id", "session_id", "created_at", F.concat_ws(": ", F.coalesce("role", F.lit("?")), F.substring(F.coalesce("content", F.lit("")), 1, 40)).alias("title")).distinct()
    x = L.keep_newest(m, "session_id", ["created_at", "id", "title"], 10)
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "title"))), lambda v: v["title"]), " | ")
    return x.groupBy("session_id").agg(F.count("*").alias("n"), F.sha1(titles).alias("h"))


def context_budget(spark, d):
    """Documents of each workspace, newest first, until 4000 characters are used."""
    x = _docs(spark, d).where("source is not null and text is not null").select("source", "doc_id", "created_at", "text")
    y = Q.budget(x, "source", "created_at", "doc_id", "text", 4000)
    return y.select("source", "doc_id", F.length("text").cast("bigint").alias("chars"))


def rate_window(spark, d):
    """ST6: calls that a limit of two an hour and five a day denies, per user."""
    x = Q.rate_limited(rt(spark, d, "events"), "user_id", "ts", "event_id", ((3600, 2), (86400, 5)))
    return x.groupBy("user_id").agg(F.sum((~F.col("allowed")).cast("bigint")).alias("denied"), F.count("*").alias("calls"), F.sum(F.col("left").cast("bigint")).alias("left_after"))


def rate_fixed_window(spark, d):
    """ST7: users and days with more than three events; denied ones count."""
    x = rt(spark, d, "events").groupBy("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("day")).agg(F.count("*").alias("n"))
    return x.where("n > 3")


def metrics_by_type(spark, d):
    """A15."""
    return rt(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most"))


# --- lifecycle ---------------------------------------------------------------------------------------------------------


def metrics_error_rate(spark, d):
    """Calls and share of errors per user."""
    return rt(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("error_rate"))


def ttl_cleanup(spark, d):
    """What a time to live of 15 days keeps of each type, and what is over."""
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return rt(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("ts") + F.expr("interval 15 days") > now).alias("alive"), F.count_if(F.col("ts") + F.expr("interval 15 days") <= now).alias("expired"))


def keep_newest_n(spark, d):
    return L.keep_newest(rt(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


def age_prune(spark, d):
    return rt(spark, d, "events").where("ts >= timestamp'2024-01-20 00:00:00'").select("event_id")


def decay_score(spark, d):
    return _docs(spark, d).select("doc_id", F.round(L.decayed(F.col("created_at"), NOW), 6).alias("score"))


def lessons_dedupe_strict(spark, d):
    return L.duplicate_lessons(_docs(spark, d))


def lessons_dedupe_loose(spark, d):
    return L.duplicate_lessons(_docs(spark, d), loose=True)


def latest_wins_upsert(spark, d):
    x = rt(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return Q.latest(x, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def pref_lock_fold(spark, d):
    log = rt(spark, d, "events").select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 0, "manual").otherwise("auto").alias("source"), F.col("event_id").cast("string").alias("value"))
    return L.locked_preferences(log)


def import_merge_actions(spark, d):
    c = rt(spark, d, "customer")
    incoming = c.where("c_custkey > 10").select((F.col("c_custkey") + 5).alias("c_custkey"), F.when(F.col("c_custkey") % 3 == 0, F.lit("CHANGED")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return L.merged(c, incoming, "c_custkey", "c_mktsegment")


def audit_filter(spark, d):
    """Only the given conditions are applied."""
    x = rt(spark, d, "events")
    for col, v in (("event_type", "error"), ("user_id", None)):
        x = x if v is None else x.where(F.col(col) == v)
    return x.where("ts >= timestamp'2024-01-10 00:00:00' and ts < timestamp'2024-01-20 00:00:00'").select("event_id", "user_id")


def gdpr_erase(spark, d):
    """What is left of messages after the archived or ended sessions' rows are erased."""
    gone = rt(spark, d, "sessions").where("session_status = 'ended'").select(F.col("id").alias("session_id"))
    return L.erased(_messages(spark, d), gone, "session_id").groupBy("session_id").agg(F.count("*").alias("messages"))


def episode_fingerprints(spark, d):
    """Sessions whose title and summary another one has too."""
    x = rt(spark, d, "sessions").select("id", L.fingerprint(F.col("title"), F.col("summary")).alias("h"))
    return x.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1").select("id", "n")


def working_memory(spark, d):
    x = L.working_memory(_messages(spark, d).where("session_id <> ''"), "session_id", "created_at", "content")
    return x.select("session_id", F.length("content").cast("bigint").alias("chars"), F.sha1("content").alias("h"))


def session_export(spark, d):
    """One JSON document per session with its counts."""
    x = rt(spark, d, "sessions").select("id", "title", "session_status")
    m = _messages(spark, d).groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("messages"))
    return x.join(m, "id", "left").select("id", F.to_json(F.struct("session_status", F.coalesce("messages", F.lit(0)).alias("messages"))).alias("json"))


QUERIES = {
    f.__name__: f
    for f in (
        extract_memories, extraction_stats, extract_triples, infer_prefs, lesson_mining, propose_lessons, propose_prefs, keywords_topn, identifiers_topn, entity_heuristics, conv_stats, kb_stats, table_counts, session_stats, reports_of_closed,
        sessions_without_messages, messages_page, session_gap20, session_end_marker, session_summary, context_budget, rate_window, rate_fixed_window, metrics_by_type, metrics_error_rate, ttl_cleanup, keep_newest_n, age_prune, decay_score,
        lessons_dedupe_strict, lessons_dedupe_loose, latest_wins_upsert, pref_lock_fold, import_merge_actions, audit_filter, gdpr_erase, episode_fingerprints, working_memory, session_export,
    )
}

_M = "m as (select distinct * from messages)"


def _strip(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '^\s+', ''), '\s+$', '')"


def _esc(p: str) -> str:
    return p.replace("'", "''")


_MEM = " union all ".join(rf"select doc_id, '{k}' memory_type, {_strip('c')} c from (select doc_id, unnest(regexp_extract_all(text, '(?i){_esc(p)}')) c from documents)" for k, ps in X.MEMORIES for p in ps)
_TRI = " union all ".join(rf"select doc_id, '{k}' predicate, lower({_strip('a')}) s, lower({_strip('b')}) o from (select doc_id, unnest(regexp_extract_all(text, '(?i){_esc(p)}', 1)) a, unnest(regexp_extract_all(text, '(?i){_esc(p)}', 2)) b from documents)" for k, p in X.TRIPLES)
_DUP = r"""with x as (select doc_id, first_value(doc_id) over (partition by n order by coalesce(epoch_us(created_at), -1) desc, doc_id) winner from (select doc_id, created_at, {0} n from documents) where n <> '') select doc_id, winner from x where doc_id <> winner"""
_STRICT = rf"regexp_replace({_strip('lower(coalesce(text, chr(39)||chr(39)))'.replace('chr(39)||chr(39)', chr(39) * 2))}, '\s+', ' ', 'g')"
_LOOSE = rf"trim(regexp_replace(regexp_replace({_STRICT}, '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"
# the lists in their own words; RE2 knows no word ends beside letters outside ASCII
_SIGNS = {
    r"(^|\W)(never|must|should|do not)($|\W)": 0.25, r"(^|\W)(don't\s+need|cannot|always|never)($|\W)": 0.25, r"(^|[^\p{L}\p{N}_])(не\s+надо|нельзя|всегда|никогда)($|[^\p{L}\p{N}_])": 0.25,
    r"(^|[^\p{L}\p{N}_])(не\s+потрібно|не\s+можна|завжди|ніколи)($|[^\p{L}\p{N}_])": 0.25, r"(^|[^\p{L}\p{N}_])(bug|fix|error[\p{L}\p{N}_]*|repair[\p{L}\p{N}_]*)($|[^\p{L}\p{N}_])": 0.15,
    r"(^|[^\p{L}\p{N}_])(ошибк|почин|помилк|виправ)": 0.15,
}
_MARK = r"(?i)^\s*(lesson|rule|note|fix|decision|takeaway|important|conclusion|важно|вывод|правило|заметка|решение|важливо|висновок|нотатка|рішення)\s*[:\-—]+\s*"
_LESSON = rf"""l0 as (select doc_id, unnest(range(0, len(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))))) line_no, unnest(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))) raw from documents),
l1 as (select doc_id, line_no, {_strip('raw')} a from l0), l2 as (select *, {_strip(f"regexp_replace(a, '{_MARK}', '')")} b from l1 where a <> ''), l3 as (select *, {_strip("regexp_replace(b, '^[-*•]\\s+', '')")} c from l2),
l4 as (select doc_id, line_no, regexp_replace(c, '\s+', ' ', 'g') lesson, round(case when a <> b then 0.8::double else 0 end + case when b <> c then 0.4::double else 0 end {''.join(f" + case when regexp_matches(c, '(?i){_esc(p)}') then {n}::double else 0 end" for p, n in _SIGNS.items())}, 2) score from l3),
l5 as (select doc_id, line_no, case when length(lesson) > 320 then {_strip('substr(lesson, 1, 320)')} || '…' else lesson end lesson, score from l4 where length(lesson) >= 18 and regexp_matches(lesson, '\p{{L}}'))"""
_STOP = """this that what how where when why because therefore was will have has been being make done это что как где когда почему потому было будет есть быть иметь сделать
 це як де коли чому тому було буде бути мати зробити"""
_WISH = "case when lower(lang) = 'en' then 'style.language' when lower(lang) = 'ru' then 'style.language' when lower(lang) = 'uk' then 'style.language' when lang is null then 'style.code_language' else 'finance.currency' end"
_WISHED = "case when lower(lang) in ('en', 'ru', 'uk') then lower(lang) when lang is null then 'en' else 'UAH' end"

SQL = {
    "extract_memories": f"with m as ({_MEM}) select doc_id, memory_type, count(*) as n, min(sha1(c)) as h from m where length(c) between 11 and 499 group by 1, 2",
    "extraction_stats": f"with m as ({_MEM}) select memory_type, count(*) as n, count(distinct doc_id) as documents from m where length(c) between 11 and 499 group by 1",
    "extract_triples": f"with t as (select distinct * from ({_TRI}) where length(s) > 2 and length(o) > 2) select doc_id, predicate, count(*) as n, min(sha1(s || '|' || o)) as h from t group by 1, 2",
    "infer_prefs": f"""with w as (select doc_id, 1 i, {_WISH} k, {_WISHED} v from documents union all select doc_id, 2, 'style.language', 'en' from documents where lang is null union all
 select doc_id, 3, 'finance.currency', 'UAH' from documents where regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(гривн|грн($|[^\\p{{L}}\\p{{N}}_])|uah($|[^\\p{{L}}\\p{{N}}_]))'))
select doc_id as id, k as key, arg_max(v, i) as value from w group by 1, 2""",
    "lesson_mining": f"with {_LESSON} select doc_id, line_no, sha1(lesson) as h, score from l5",
    "propose_lessons": f"with {_LESSON} select 'lesson:' || substr(sha1(lower(lesson)), 1, 12) as key, lower(lesson) as lesson, max(score) as score, count(*) as mentions from l5 group by 1, 2 order by score desc, mentions desc, lesson limit 10",
    "propose_prefs": f"""with w as (select doc_id, created_at t, {_WISH} k, {_WISHED} v from documents union all select doc_id, created_at, 'style.language', 'en' from documents where lang is null)
select k as key, arg_max(v, (coalesce(epoch_us(t), -1), doc_id)) as value, round(count(*) * 0.2::double, 4) as score from w group by 1""",
    "identifiers_topn": r"""with t as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z_][a-z0-9_\-]{2,}')) word from documents),
g as (select doc_id, word, count(*) n from t where word not in ('the', 'and', 'for', 'with', 'that', 'this', 'from', 'return', 'import', 'const', 'function', 'class', 'async', 'await', 'true', 'false', 'none', 'null') group by 1, 2)
select doc_id, word, n, rank from (select *, (row_number() over (partition by doc_id order by n desc, word))::int rank from g) where rank <= 8""",
    "keywords_topn": rf"""with t as (select doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}{{4,}}'), lambda w: not list_contains(string_split_regex('{_STOP}', '\s+'), w)) l from documents),
w as (select doc_id, unnest(l) word, unnest(range(0, len(l))) i from t), g as (select doc_id, word, count(*) n, min(i) i from w group by 1, 2), r as (select *, row_number() over (partition by doc_id order by n desc, i) k from g)
select doc_id, word, n, k::int as rank from r where k <= 10""",
    "entity_heuristics": r"""select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2}'))), ',') as dates,
 len(list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: regexp_matches(w, '^\p{Lu}(?s:.{3})')))) as names,
 array_to_string(list_filter(['created', 'updated', 'delete', 'added', 'configured', 'started', 'done'], lambda a: contains(lower(coalesce(text, '')), a)), ',') as actions from documents""",
    "conv_stats": f"with {_M} select coalesce(role, '') as role, count(*) as messages, count(distinct session_id) as sessions, sum(length(content))::bigint as chars from m group by 1",
    "kb_stats": "select doc_kind, n_chars is not null as counted, count(*) as documents, count(distinct source) as sources, sum(length(text))::bigint as chars from documents group by 1, 2",
    "reports_of_closed": "select distinct session_id, writer, entries_stored from session_reports where session_id in (select id from sessions where session_status in ('completed', 'ended'))",
    "metrics_error_rate": "select user_id, count(*) as calls, round(avg((event_type = 'error')::int::double), 6) as error_rate from events group by 1",
    "table_counts": " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in ("sessions", "session_reports", "messages", "fact_ops", "triples", "documents", "eval_items", "events")),
    "session_stats": "select session_status, count(*) as sessions, count(r.session_id) as reported, sum(coalesce(archived, false)::int)::bigint as archived from sessions s left join (select distinct session_id from session_reports) r on s.id = r.session_id group by 1",
    "sessions_without_messages": "select id from sessions where id not in (select session_id from messages where session_id is not null)",
    "messages_page": f"with {_M} select id, epoch_us(created_at) as t from m order by t desc, id limit 50 offset 50",
    "session_gap20": """with x as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts) > ts - interval 20 minute then 0 else 1 end n from events), y as (select *, sum(n) over (partition by user_id order by ts) g from x)
select user_id, floor(epoch(min(ts)))::bigint as start_s, floor(epoch(max(ts)))::bigint as end_s, count(*) as events from y group by user_id, g""",
    "session_end_marker": """with x as (select distinct id, session_id, created_at ts, regexp_matches(lower(coalesce(content, '')), 'session ended|session complete|сессия закончена|сессия окончена|сесію завершено|сесія завершена')::int e from messages where session_id <> '' and created_at is not null
 union all select 'end-' || id, id, ended_at, 1 from sessions where ended_at is not null), y as (select *, coalesce(sum(e) over (partition by session_id order by ts, id rows between unbounded preceding and 1 preceding), 0)::bigint as session from x)
select session_id, session, count(*) as rows, max(e) as closed from y group by 1, 2""",
    "session_summary": """with m as (select distinct id, session_id, created_at, coalesce(role, '?') || ': ' || substr(coalesce(content, ''), 1, 40) title from messages where session_id <> '' and created_at is not null),
r as (select *, row_number() over (partition by session_id order by created_at, id, title) k from m) select session_id, count(*) as n, sha1(string_agg(title, ' | ' order by k)) as h from r where k <= 10 group by 1""",
    "context_budget": """with x as (select source, doc_id, length(text) n, coalesce(sum(length(text)) over (partition by source order by created_at desc nulls last, doc_id rows between unbounded preceding and 1 preceding), 0) used from documents where source is not null and text is not null)
select source, doc_id, least(n, 4000 - used)::bigint as chars from x where used < 4000""",
    "rate_window": """with recursive x as (select user_id, epoch_us(ts) t, row_number() over (partition by user_id order by ts, event_id) i from events where user_id is not null and ts is not null),
r as (select user_id, i, [t] kept, true ok, 1 used from x where i = 1 union all
 select user_id, i, case when ok then list_append(kept, t) else kept end, ok, hr + ok::int from (select *, hr < 2 and len(list_filter(kept, lambda u: u > t - 86400000000)) < 5 ok from (select x.user_id, x.i, x.t, r.kept, len(list_filter(r.kept, lambda u: u > x.t - 3600000000)) hr from r join x on x.user_id = r.user_id and x.i = r.i + 1)))
select user_id, sum((not ok)::int)::bigint as denied, count(*) as calls, sum(greatest(0, 2 - used))::bigint as left_after from r group by 1""",
    "rate_fixed_window": "select user_id, floor(epoch(ts) / 86400)::bigint as day, count(*) as n from events group by 1, 2 having count(*) > 3",
    "metrics_by_type": "select event_type, count(*) as n, round(avg(value), 4) as mean, round(min(value), 4) as least, round(max(value), 4) as most from events group by 1",
    "ttl_cleanup": "select event_type, count(*) filter (ts + interval 15 day > timestamp '2024-01-20 00:00:00') as alive, count(*) filter (ts + interval 15 day <= timestamp '2024-01-20 00:00:00') as expired from events group by 1",
    "keep_newest_n": "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from events) where k <= 5",
    "age_prune": "select event_id from events where ts >= timestamp '2024-01-20 00:00:00'",
    "decay_score": "select doc_id, round(pow(0.9::double, (1767225600 - floor(epoch(created_at))) / (86400.0::double * 30)), 6) as score from documents",
    "lessons_dedupe_strict": _DUP.format(_STRICT),
    "lessons_dedupe_loose": _DUP.format(_LOOSE),
    "latest_wins_upsert": "select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id from events group by 1, 2",
    "pref_lock_fold": """with l as (select user_id || ':' || event_type as key, event_id seq, event_id % 7 = 0 lk from events)
select key, coalesce(max(seq) filter (lk), max(seq))::varchar as value, max(lk::int) as locked from l group by key""",
    "import_merge_actions": """with i as (select c_custkey + 5 k, case when (c_custkey + 5) % 3 = 0 and false then '' when c_custkey % 3 = 0 then 'CHANGED' else c_mktsegment end v from customer where c_custkey > 10)
select case when c.c_custkey is null then 'created' when i.k is null then 'kept' when c.c_mktsegment is not distinct from i.v then 'unchanged' else 'updated' end as action, count(*) as n from customer c full join i on c.c_custkey = i.k group by 1""",
    "audit_filter": "select event_id, user_id from events where event_type = 'error' and ts >= timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-20 00:00:00'",
    "gdpr_erase": f"with {_M} select session_id, count(*) as messages from m where session_id is null or session_id not in (select id from sessions where session_status = 'ended') group by 1",
    "episode_fingerprints": "select min(id) as id, count(*) as n from sessions group by lower(coalesce(title, '')), lower(coalesce(summary, '')) having count(*) > 1",
    "working_memory": f"""with {_M}, x as (select session_id, string_agg(content, chr(10) order by created_at, id) t from m where session_id <> '' and content is not null group by 1) select session_id, length(right(t, 12000)) as chars, sha1(right(t, 12000)) as h from x""",
    "session_export": f"""with {_M}, c as (select session_id, count(*) n from m group by 1) select id, case when session_status is null then '{{"messages":' else '{{"session_status":"' || session_status || '","messages":' end || coalesce(n, 0) || '}}' as json from sessions left join c on session_id = id""",
}

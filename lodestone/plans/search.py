"""Queries of search, retrieval and text operators with the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import search as S
from lodestone.sources.tables import read_table as rt

PHRASE = "memory server"
TOKENS = ["memory", "server", "retention"]
QUERY = "memory server returns pending corrections retention job"

_TOK = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]{{2,}}')"


def _docs(spark, d):
    return rt(spark, d, "documents")


def _one(spark):
    return spark.createDataFrame([(1, QUERY)], "qid bigint, text string")


def _items(spark, d):
    return rt(spark, d, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), F.col("question").alias("text"))


def _scored(hits):
    return hits.withColumn("score", F.round("score", 6))


def _bm25_sql(q: str, k: int, k1=1.5, both=False) -> str:
    idf = "greatest(ln((n - df + 0.5::double) / (df + 0.5::double)), 1e-6::double)" if both else "ln((n - df + 0.5::double) / (df + 0.5::double) + 1)"
    w = "" if both else "qtf * "
    having = "having count(*) = any_value(nt)" if both else ""
    return rf"""with q as ({q}), qt as (select qid, unnest({_TOK.format('text')}) term from q), qq as (select qid, term, count(*) qtf from qt group by 1, 2),
qn as (select qid, count(*) nt from qq group by 1),
b as (select doc_id, {_TOK.format('text')} t from documents), st as (select count(*) n, greatest(avg(len(t)), 1.0) avgdl from b),
tk as (select doc_id, len(t) dl, unnest(t) term from b), tf as (select doc_id, dl, term, count(*) tf from tk where term in (select term from qq) group by 1, 2, 3),
df as (select term, count(*) df from tf group by 1),
s as (select qid, doc_id, round(sum({w}{idf} * tf * ({k1}::double + 1) / (tf + {k1}::double * (0.25::double + 0.75::double * dl / avgdl))), 6) score
  from tf join df using (term) join qq using (term) join qn using (qid) cross join st group by 1, 2 {having}),
r as (select *, row_number() over (partition by qid order by score desc, doc_id) rank from s where score > 0)
select qid, doc_id, score, rank::int as rank from r where rank <= {k}"""


_ONE_SQL = f"select 1::bigint qid, '{QUERY}' as text"
_ITEMS_SQL = "select item_id qid, question as text from eval_items where item_id % 20 = 0"


def bm25_topk(spark, d):
    """Flagship: BM25 top 50 of one query over all documents."""
    return S.top_k(_scored(S.bm25(_docs(spark, d), _one(spark))), 50)


def bm25_multi_query(spark, d):
    return S.top_k(_scored(S.bm25(_docs(spark, d), _items(spark, d))), 10)


def fts_rank(spark, d):
    return S.top_k(_scored(S.full_text(_docs(spark, d), _one(spark))), 1000)


def lexical_score(spark, d):
    x = rt(spark, d, "messages").select("id", F.round(T.lexical_score("content", PHRASE, TOKENS), 4).alias("score")).distinct()
    return x.where("score > 0")


_LEX = r"""round((case when instr(t, 'memory server') > 0 then 3.0::double else 0 end) + (case when instr(t, 'memory') > 0 then 1.25::double else 0 end - case when instr(t, 'memory') > 0 then 0.25::double - 0.25::double / 3 else 0 end)
 + (case when instr(t, 'server') > 0 then 1.0::double + 0.25::double / 3 else 0 end) + (case when instr(t, 'retention') > 0 then 1.0::double + 0.25::double / 3 else 0 end)
 + (case when instr(t, 'memory') between 1 and 33 then 0.15::double else 0 end) + (case when instr(t, 'server') between 1 and 33 then 0.15::double else 0 end) + (case when instr(t, 'retention') between 1 and 33 then 0.15::double else 0 end), 4)"""


def like_any_token(spark, d):
    return _docs(spark, d).where(T.like_tokens(["text", "path"], TOKENS, False)).select("doc_id")


def like_all_tokens(spark, d):
    return _docs(spark, d).where(T.like_tokens(["text", "path"], TOKENS, True)).select("doc_id")


def pool_then_rerank(spark, d):
    """K2, K5: the newest 600 messages that match, scored and cut to 100 (both limits are the feature)."""
    x = rt(spark, d, "messages").select("id", "created_at", "content").distinct().where(T.like_tokens(["content"], TOKENS, False)).orderBy(F.desc("created_at"), "id").limit(600)
    return x.select("id", F.round(T.lexical_score("content", PHRASE, TOKENS), 4).alias("score"), F.unix_seconds("created_at").alias("at")).orderBy(F.desc("score"), F.desc("at"), "id").limit(100)


def query_tokens(spark, d):
    return rt(spark, d, "eval_items").select("item_id", F.array_join(T.query_tokens("question"), " ").alias("tokens"))


def query_rewrite(spark, d):
    return rt(spark, d, "eval_items").select("item_id", T.rewritten_query("question").alias("query"))


def query_expand(spark, d):
    return S.expanded(_docs(spark, d).select(F.col("doc_id").alias("qid"), "text"))


def snippet_kb(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.sha1(T.kb_snippet("text", PHRASE, TOKENS)).alias("h"))


def excerpt_window(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", T.match_at("text", TOKENS).cast("bigint").alias("at"), F.sha1(T.clipped("text", T.match_at("text", TOKENS))).alias("h"))


def _chunks(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(T.chunks("text")).alias("c")).select("doc_id", "c.*")


def chunk_text(spark, d):
    return _chunks(spark, d).select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.sha1("content").alias("h"))


_CHUNK_SQL = r"""select doc_id, (row_number() over (partition by doc_id order by i) - 1)::bigint as chunk_index, c from (
 select doc_id, i, regexp_replace(regexp_replace(substr(t, (i * 1050 + 1)::int, 1200), '^\s+', ''), '\s+$', '') c from (
  select doc_id, t, unnest(range(0, case when length(t) <= 1200 then 1 else ceil((length(t) - 1200) / 1050.0)::bigint + 1 end)) i from (
   select doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') t from documents))) where c <> ''"""


def chunk_neighbors(spark, d):
    ch = _chunks(spark, d)
    x = S.neighbours(ch, ch.where("doc_id % 20 = 0").select("doc_id", "chunk_index"))
    return x.select("doc_id", F.col("hit").cast("bigint").alias("hit"), F.sha1("text").alias("h"))


def vec_norms(spark, d):
    return rt(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 5).alias("norm"))


def vec_cosine_topk(spark, d):
    v = rt(spark, d, "embeddings")
    x = S.cosine_topk(v, v.where("vec_id % 20 = 0"), 10)
    return x.select("qid", "vec_id", F.round("score", 5).alias("score"), "rank")


def minmax_fusion(spark, d):
    return S.min_max(_scored(S.bm25(_docs(spark, d), _items(spark, d)))).select("qid", "doc_id", F.round("norm", 5).alias("norm"))


def _hybrid(spark, d):
    """BM25 and full text of each query from one set of postings, each to 0..1, weighted, plus the path bonus."""
    docs, q = _docs(spark, d), _one(spark)
    posts = S.postings(docs, S.query_terms(q))
    a = S.min_max(_scored(S.bm25(docs, q, posts=posts)), out="v").select("qid", "doc_id", F.col("v").alias("bm25"), F.lit(0.0).alias("fts"))
    b = S.min_max(_scored(S.full_text(docs, q, posts=posts)), out="v").select("qid", "doc_id", F.lit(0.0).alias("bm25"), F.col("v").alias("fts"))
    x = a.unionByName(b).groupBy("qid", "doc_id").agg(F.sum("bm25").alias("bm25"), F.sum("fts").alias("fts")).join(docs.select("doc_id", "path"), "doc_id")
    score = 0.3 * F.col("bm25") + 0.5 * F.col("fts") + T.path_bonus(F.coalesce("path", F.lit("")), ["memory", "lessons", "notes"])
    return x.select("qid", "doc_id", F.round(score, 5).alias("score"))


def hybrid_weighted(spark, d):
    return _hybrid(spark, d).select("qid", "doc_id", "score")


def _hybrid_sql() -> str:
    a, b = _bm25_sql(_ONE_SQL, 10**9), _bm25_sql(_ONE_SQL, 10**9, 1.2, True)
    return f"""select coalesce(a.qid, b.qid) qid, doc_id, round(0.3::double * coalesce(a.v, 0) + 0.5::double * coalesce(b.v, 0)
 + case when regexp_matches(lower(coalesce(path, '')), 'memory|lessons|notes') then 0.15::double else 0 end, 5) score
from (select qid, doc_id, case when max(score) over () = min(score) over () then 1 else (score - min(score) over ()) / (max(score) over () - min(score) over ()) end v from ({a})) a
full join (select qid, doc_id, case when max(score) over () = min(score) over () then 1 else (score - min(score) over ()) / (max(score) over () - min(score) over ()) end v from ({b})) b using (doc_id)
join documents using (doc_id)"""


def hybrid_mmr(spark, d):
    """The hybrid hits, diversified."""
    x = S.top_k(_hybrid(spark, d), 120).join(_docs(spark, d).select("doc_id", T.token_set("text").alias("toks")), "doc_id")
    return S.mmr(x.select("qid", "doc_id", "score", "toks"))


def recency_bonus(spark, d):
    """0.12 e^(-age/30) for ages of up to 365 days; none without a time."""
    age = (F.lit(1767225600) - F.unix_seconds("created_at")) / 86400.0
    return _docs(spark, d).select("doc_id", F.round(F.when(age.between(0, 365), 0.12 * F.exp(-age / 30)).otherwise(0.0), 6).alias("bonus"))


def score_threshold(spark, d):
    return S.thresholded(_scored(S.bm25(_docs(spark, d), _items(spark, d))), 2.0, 0.5).select("qid", "doc_id", "score")


def per_path_cap(spark, d):
    x = _scored(S.bm25(_docs(spark, d), _items(spark, d))).join(_docs(spark, d).select("doc_id", F.col("source").alias("path")), "doc_id")
    return S.capped(x).select("qid", "doc_id", "path", "score")


def context_pack_round_robin(spark, d):
    x = S.top_k(_scored(S.bm25(_docs(spark, d), _items(spark, d))), 100).join(_docs(spark, d).select("doc_id", F.col("source").alias("path")), "doc_id")
    return S.round_robin(x.where("path is not null")).select("qid", "doc_id", "path", "turn", "pos")


def exact_dedupe(spark, d):
    """The least document of every text in normal form, and how many share it."""
    x = _docs(spark, d).where("text is not null").select("doc_id", F.sha1(T.strict_form("text")).alias("h"))
    return x.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def hit_first_occurrence(spark, d):
    """The first document of each source and 800-character preview."""
    x = _docs(spark, d).where("text is not null and source is not null").select("source", "doc_id", F.sha1(T.strict_form(F.substring("text", 1, 800))).alias("h"))
    return x.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id"))


def redact_secrets(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.sha1(T.redacted("text")).alias("h"))


def redact_quoted(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.sha1(T.redacted("text", quoted=True)).alias("h"))


def summary_first_sentences(spark, d):
    return _docs(spark, d).select("doc_id", F.sha1(T.first_sentences("text")).alias("h"))


def markdown_clean(spark, d):
    return _docs(spark, d).select("doc_id", F.sha1(T.markdown_text("text")).alias("h"), T.markdown_title("text").alias("title"))


def text_title(spark, d):
    return _docs(spark, d).select("doc_id", T.text_title("text").alias("title"))


def html_to_text(spark, d):
    return _docs(spark, d).select("doc_id", F.sha1(T.html_text("text")).alias("h"), T.html_title("text").alias("title"), F.array_join(T.html_links("text"), " ").alias("links"))


def federated_top(spark, d):
    """The best hits over documents, messages, sessions and reports together; the top 60 are the feature."""
    parts = [("document", "documents", "cast(doc_id as string)", "text"), ("message", "messages", "id", "content"), ("session", "sessions", "id", "concat_ws('\\n', coalesce(title, ''), coalesce(summary, ''))"), ("report", "session_reports", "session_id", "summary")]
    out = None
    for name, table, key, text in parts:
        x = rt(spark, d, table).select(F.lit(name).alias("source"), F.expr(key).alias("id"), F.expr(text).alias("t")).where("id is not null")
        x = x.select("source", "id", F.round(T.lexical_score("t", PHRASE, TOKENS), 4).alias("score")).groupBy("source", "id").agg(F.max("score").alias("score")).where("score > 0")
        out = x if out is None else out.unionByName(x)
    return out.orderBy(F.desc("score"), "source", "id").limit(60)


_S = "regexp_replace(regexp_replace(lower(coalesce({0}, '')), '^\\s+', ''), '\\s+$', '')"
_STRICT = f"regexp_replace({_S}, '\\s+', ' ', 'g')"


def _sql_redact(quoted: bool) -> str:
    t = "text"
    rules = [(p, r) for p, r in [*([T.QUOTED_SECRET] if quoted else []), *T.SECRETS] if "(?<" not in p]
    for p, r in rules:
        t = f"regexp_replace({t}, '{p.replace(chr(39), chr(39) * 2)}', '{r.replace('$1', chr(92) + '1')}', 'g')"
    return f"select doc_id, sha1({t}) as h from documents where text is not null"


def _sql_chain(c: str, rules) -> str:
    for p, r in rules:
        c = f"regexp_replace({c}, '{p.replace(chr(39), chr(39) * 2)}', '{r.replace('$1', chr(92) + '1').replace(chr(39), chr(39) * 2)}', 'g')"
    return f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"


_TEXT = "coalesce(text, '')"
_MD = [(r"(?m)^#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1"), (r"(?s)```.*?```", ""), (r"`([^`]+)`", "$1"), (r"\[([^\]]+)\]\([^\)]+\)", "$1"), (r"!\[([^\]]*)\]\([^\)]+\)", "$1"), (r"\n{3,}", "\n\n")]
_HTML = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"), (r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""), ("<[^>]+>", " "), (r"\s{2,}", " ")]
_AT = "coalesce(least(nullif(instr(lower(text), 'memory'), 0), nullif(instr(lower(text), 'server'), 0), nullif(instr(lower(text), 'retention'), 0)) - 1, 0)"
# the dictionaries in their own words: head=members
_GROUPS = """файл=документ,данные,file файлы=документы,данные,files код=исходник,скрипт,code память=memory,хранение,запоминание поиск=найти,отыскать,search тест=тестирование,проверка,unit ошибка=баг,проблема,error
функция=метод,процедура,function класс=объект,сущность,class данные=информация,контент,data настройка=конфиг,параметр,setting пользователь=юзер,клиент,user сервер=бэкенд,служба,server запрос=request,вызов ответ=response,результат
файл=документ,дані,file файли=документи,дані,files код=скрипт,програма,code память=memory,зберігання,запам'ятовування пошук=знайти,відшукати,search тест=тестування,перевірка,unit помилка=баг,проблема,error
функція=метод,процедура,function клас=об'єкт,сутність,class дані=інформація,контент,data налаштування=конфіг,параметр,setting користувач=клієнт,user,account сервер=бекенд,служба,server запит=request,виклик відповідь=response,результат
file=doc,document,data code=source,script,program memory=storage,save search=find,lookup,query test=testing,check,unit error=bug,issue,problem function=method,procedure class=object,entity data=info,information config=setting,option,parameter
user=client,enduser server=backend,service client=frontend request=call,invoke response=result,return"""
_EXT = "py=python js=javascript ts=typescript json=json md=markdown txt=text html=html css=css sql=sql yml=yaml yaml=yaml xml=xml sh=shell bash=shell zsh=shell go=go rs=rust java=java c=c cpp=cpp h=header hpp=cpp"

QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_multi_query, fts_rank, lexical_score, like_any_token, like_all_tokens, pool_then_rerank, query_tokens, query_rewrite, query_expand, snippet_kb, excerpt_window, chunk_text, chunk_neighbors,
        vec_norms, vec_cosine_topk, minmax_fusion, hybrid_weighted, hybrid_mmr, recency_bonus, score_threshold, per_path_cap, context_pack_round_robin, exact_dedupe, hit_first_occurrence, redact_secrets, redact_quoted,
        summary_first_sentences, markdown_clean, text_title, html_to_text, federated_top,
    )
}

_ALL_BM25 = _bm25_sql(_ITEMS_SQL, 10**9)
SQL = {
    "bm25_topk": _bm25_sql(_ONE_SQL, 50),
    "bm25_multi_query": _bm25_sql(_ITEMS_SQL, 10),
    "fts_rank": _bm25_sql(_ONE_SQL, 1000, 1.2, True),
    "lexical_score": f"select distinct id, score from (select id, {_LEX} score from (select id, lower(coalesce(content, '')) t from messages)) where score > 0",
    "like_any_token": "select doc_id from documents where regexp_matches(lower(coalesce(text, '')), 'memory|server|retention') or regexp_matches(lower(coalesce(path, '')), 'memory|server|retention')",
    "like_all_tokens": "select doc_id from documents where " + " and ".join(f"(contains(lower(coalesce(text, '')), '{k}') or contains(lower(coalesce(path, '')), '{k}'))" for k in TOKENS),
    "pool_then_rerank": f'''select id, {_LEX} score, a0 as "at" from (select id, floor(epoch(created_at))::bigint a0, lower(content) t from (select distinct id, created_at, content from messages where regexp_matches(lower(content), 'memory|server|retention') order by created_at desc, id limit 600)) order by score desc, a0 desc, id limit 100''',
    "query_tokens": rf"select item_id, array_to_string(list_transform(list_slice(list_sort(list_transform(list_distinct({_TOK.format('question')}), lambda x: {{'i': list_position({_TOK.format('question')}, x), 'x': x}})), 1, 12), lambda s: s.x), ' ') as tokens from eval_items",
    "query_rewrite": rf"""with t as (select item_id, question, list_distinct({_TOK.format('question')}) u, {_TOK.format('question')} f from eval_items),
r as (select item_id, question, len(u) n, array_to_string(list_transform(list_slice(list_sort(list_transform(u, lambda x: {{'l': -length(x), 'i': list_position(f, x), 'x': x}})), 1, 12), lambda s: s.x), ' ') q from t)
select item_id, case when n >= 3 and length(q) >= 6 and q <> lower(question) then q end as query from r""",
    "query_expand": rf"""with g as (select split_part(x, '=', 1) head, string_split(split_part(x, '=', 2), ',') ms from (select unnest(regexp_split_to_array('{_GROUPS.replace("'", "''")}', '\s+')) x)),
p as (select head term, unnest(ms) other from g union select m, o from (select unnest(ms) m, ms from g) t, unnest(t.ms) u(o)),
t as (select distinct doc_id qid, unnest(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[''’]', '', 'g')), '[\p{{L}}\p{{N}}]{{2,}}')) term from documents),
e as (select split_part(x, '=', 1) ext, split_part(x, '=', 2) stands from (select unnest(string_split('{_EXT}', ' ')) x)),
o as (select qid, other from t join p using (term) union select doc_id, stands from documents join e on contains(lower(coalesce(text, '')), ext))
select qid, array_to_string(list_slice(list_sort(list(distinct other)), 1, 5), ' ') as terms from o group by qid""",
    "snippet_kb": "select doc_id, sha1(case when a0 >= 0 then substr(text, greatest(0, a0 - 50)::int + 1, (a0 - greatest(0, a0 - 50) + 63)::int) else substr(text, 1, 100) end) as h from (select doc_id, text, case when instr(lower(text), 'memory server') > 0 then instr(lower(text), 'memory server') else instr(lower(text), 'memory') end - 1 a0 from documents where text is not null)",
    "excerpt_window": f'''select doc_id, a0::bigint as "at", sha1(substr(text, greatest(0, least(a0 - 120, length(text) - 240))::int + 1, 240)) as h from (select doc_id, text, {_AT} a0 from documents where text is not null)''',
    "chunk_text": f"select doc_id, chunk_index, sha1(c) as h from ({_CHUNK_SQL})",
    "chunk_neighbors": f"""with ch as ({_CHUNK_SQL}), h as (select doc_id, chunk_index hit from ch where doc_id % 20 = 0)
select doc_id, hit, sha1(substr(string_agg('--- chunk ' || chunk_index || ' ---' || chr(10) || c, chr(10) || chr(10) order by chunk_index), 1, 1400)) as h from h join ch using (doc_id) where abs(chunk_index - hit) <= 1 group by doc_id, hit""",
    "vec_norms": "select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 5) as norm from embeddings",
    "vec_cosine_topk": """with s as (select q.vec_id qid, v.vec_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) score from embeddings q, embeddings v where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by qid order by round(score, 9) desc, vec_id) rank from s) select qid, vec_id, round(score, 5) as score, rank::int as rank from r where rank <= 10""",
    "minmax_fusion": f"select qid, doc_id, round(case when max(score) over w = min(score) over w then 1.0::double else (score - min(score) over w) / (max(score) over w - min(score) over w) end, 5) as norm from ({_ALL_BM25}) window w as (partition by qid)",
    "hybrid_weighted": _hybrid_sql(),
    "recency_bonus": "select doc_id, round(case when a between 0 and 365 then 0.12::double * exp(-a / 30) else 0.0::double end, 6) as bonus from (select doc_id, (1767225600 - floor(epoch(created_at))) / 86400.0::double a from documents)",
    "score_threshold": f"select qid, doc_id, score from (select *, max(score) over (partition by qid) top, max((score >= 2.0)::int * (score >= 0.5::double * mx)::int) over (partition by qid) som from (select *, max(score) over (partition by qid) mx from ({_ALL_BM25}))) where (score >= 2.0 and score >= 0.5::double * top) or som = 0",
    "per_path_cap": f"select qid, doc_id, source as path, score from (select *, row_number() over (partition by qid, source order by score desc, doc_id) k from (select * from ({_ALL_BM25}) join documents using (doc_id))) where k <= 2",
    "context_pack_round_robin": f"""with h as (select qid, doc_id, score, source path from ({_bm25_sql(_ITEMS_SQL, 100)}) join documents using (doc_id) where source is not null),
t as (select *, row_number() over (partition by qid, path order by score desc, doc_id) turn, max(score) over (partition by qid, path) best from h)
select qid, doc_id, path, turn::int as turn, row_number() over (partition by qid order by turn, best desc, path)::int as pos from t""",
    "exact_dedupe": f"select sha1({_STRICT.format('text')}) as h, min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by 1",
    "hit_first_occurrence": f"select source, sha1({_STRICT.format('substr(text, 1, 800)')}) as h, min(doc_id) as doc_id from documents where text is not null and source is not null group by 1, 2",
    "redact_secrets": _sql_redact(False),
    "redact_quoted": _sql_redact(True),
    "summary_first_sentences": r"with s as (select doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') l from documents) select doc_id, case when len(l) > 0 then sha1(array_to_string(list_slice(l, 1, 2), '. ') || '.') end as h from s",
    "markdown_clean": rf"select doc_id, sha1({_sql_chain(_TEXT, _MD)}) as h, nullif(regexp_replace(regexp_replace(regexp_extract(coalesce(text, ''), '(?m)^# +(.+)$', 1), '^\s+', ''), '\s+$', ''), '') as title from documents",
    "text_title": r"with f as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '')[1] t from documents) select doc_id, case when length(t) < 100 then t end as title from f",
    "html_to_text": rf"""select doc_id, sha1({_sql_chain(_TEXT, _HTML)}) as h, coalesce(nullif(regexp_extract(coalesce(text, ''), '(?i)<title>([^<]+)</title>', 1), ''), 'Untitled') as title,
array_to_string(regexp_extract_all(coalesce(text, ''), '(?i)href=["'']([^"'']+)["'']', 1), ' ') as links from documents""",
    "federated_top": f"""select source, id, score from (select source, id, max(score) score from (select source, id, {_LEX} score from (
 select 'document' as source, doc_id::varchar id, lower(coalesce(text, '')) t from documents union all select 'message', id, lower(coalesce(content, '')) from messages
 union all select 'session', id, lower(coalesce(title, '') || chr(10) || coalesce(summary, '')) from sessions union all select 'report', session_id, lower(coalesce(summary, '')) from session_reports)) where id is not null group by 1, 2) where score > 0 order by score desc, source, id limit 60""",
}

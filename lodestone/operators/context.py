"""Context for a query: scores of pairs, hybrid pools, gathering, packing, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import search as S

# Sources in order of priority; others come behind them, and count as workspace or memory for the budgets.
PRIORITY = {"prefs": 0, "wm": 1, "stm": 2, "lessons": 3, "episodes": 4}
WORKSPACE = ("fts", "vector", "hybrid")


def pair_score(text: Column, phrase: Column, tokens: Column) -> Column:
    """R2, R3 for a query of its own on every row: phrase +3, each token found +1 and +0.15 within the first 33 characters,
    share of tokens found times 0.25. Null texts score 0."""
    t = F.lower(F.coalesce(text, F.lit("")))
    places = F.transform(tokens, lambda k: F.position(k, t))
    hits, early = F.size(F.filter(places, lambda i: i > 0)), F.size(F.filter(places, lambda i: i.between(1, 33)))
    whole = F.when((phrase != "") & F.contains(t, F.lower(phrase)), 3.0).otherwise(0.0)
    return whole + hits + 0.15 * early + hits * 0.25 / F.greatest(F.size(tokens), F.lit(1))


def domain_hits(rows: DataFrame, queries: DataFrame, pool: int) -> DataFrame:
    """The best pool of every domain for each query, scored: qid, domain, id, path, text, score.

    rows: domain, id, path, text, extra (added to the score); queries: qid, text. Candidates come from one set of postings
    over all domains (the pool is the feature), so no query meets every row. A lesson gets one more, as its full-text rank
    is never positive; a workspace hit counts a fifth of its lexical score.
    """
    docs = rows.where("id is not null").select(F.concat_ws("|", "domain", "id").alias("doc_id"), "text").groupBy("doc_id").agg(F.max("text").alias("text"))
    hits = S.bm25(docs, queries).withColumn("score", F.round("score", 6)).withColumn("domain", F.substring_index("doc_id", "|", 1))
    w = Window.partitionBy("qid", "domain").orderBy(F.desc("score"), "doc_id")
    best = hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= pool).select("qid", "doc_id", F.col("score").alias("bm25"))
    one = rows.where("id is not null").withColumn("doc_id", F.concat_ws("|", "domain", "id")).groupBy("doc_id", "domain", "id").agg(F.max_by("path", F.struct("text", "path")).alias("path"), F.max("text").alias("text"), F.max("extra").alias("extra"))
    q = queries.select("qid", F.col("text").alias("phrase"), T.query_tokens("text").alias("tokens"))
    x = best.join(one, "doc_id").join(q, "qid")
    lexical = pair_score(F.col("text"), F.col("phrase"), F.col("tokens"))
    score = F.when(F.col("domain") == "workspace", F.col("bm25") + 0.2 * lexical).otherwise(lexical) + F.when(F.col("domain") == "lessons", 1.0).otherwise(0.0) + F.coalesce("extra", F.lit(0.0))
    return x.select("qid", "domain", "id", "path", "text", F.round(score, 4).alias("score")).where("score > 0")


def hybrid_pool(docs: DataFrame, queries: DataFrame, vectors: DataFrame, now: str, limit: int = 24) -> DataFrame:
    """Qid, doc_id, leg, score: the best limit of full text and of vectors for each query, each leg to 0..1, with the
    path and recency bonus. A document may be in both legs, with a row each.

    docs: doc_id, text, path, created_at; queries: qid, text, embedding; vectors: doc_id, embedding.
    """
    text = queries.select("qid", "text")
    fts = S.top_k(S.bm25(docs, text).withColumn("score", F.round("score", 6)), limit).select("qid", "doc_id", "score", F.lit("fts").alias("leg"))
    vec = S.cosine_topk(vectors, queries.select(F.col("qid").alias("doc_id"), "embedding"), limit, key="doc_id").select("qid", "doc_id", F.round("score", 6).alias("score"), F.lit("vector").alias("leg"))
    both = S.min_max(fts.unionByName(vec), group=("qid", "leg")).join(docs.select("doc_id", "path", "created_at"), "doc_id").join(text.select("qid", F.array_distinct(F.filter(T.all_tokens("text"), lambda k: F.length(k) >= 3)).alias("tokens")), "qid")
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("created_at")) / 86400.0
    recent = F.when(age.between(0, 365), 0.12 * F.exp(-age / 30)).otherwise(0.0)
    path = F.when(F.exists(F.slice("tokens", 1, 40), lambda k: F.contains(F.lower(F.coalesce("path", F.lit(""))), k)), 0.15).otherwise(0.0)
    return both.select("qid", "doc_id", "leg", F.round(F.col("norm") + path + recent, 5).alias("score"))


def hybrid(docs: DataFrame, queries: DataFrame, vectors: DataFrame, now: str, limit: int = 8, cap: int = 2) -> DataFrame:
    """Qid, doc_id, score, pos: the pool above both thresholds, diversified, near-copies passed
    over, at most cap of a path, cut to limit."""
    pool = S.thresholded(hybrid_pool(docs, queries, vectors, now).groupBy("qid", "doc_id").agg(F.max("score").alias("score")))
    chosen = S.mmr(pool.join(docs.select("doc_id", T.token_set("text").alias("toks")), "doc_id"), limit=120)
    x = chosen.join(pool, ["qid", "doc_id"]).join(docs.select("doc_id", F.coalesce("path", F.concat(F.lit("#"), F.col("doc_id").cast("string"))).alias("path")), "doc_id")
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "path").orderBy("pos"))).where(F.col("_n") <= cap)
    return x.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("pos"))).where(F.col("pos") <= limit).select("qid", "doc_id", "score", "pos")


def _priority(source: Column) -> Column:
    out = F.lit(10)
    for name, n in PRIORITY.items():
        out = F.when(source == name, n).otherwise(out)
    return out


def gathered(hits: DataFrame) -> DataFrame:
    """Hits (qid, source, id, path, text, score) in order of source priority and score, then by source and id, the first of those with one
    source and one text (normal form of 800 characters): with pos."""
    order = [_priority(F.col("source")), F.desc("score"), F.col("source"), F.col("id")]
    form = F.sha1(T.strict_form(F.substring(F.coalesce("text", F.lit("")), 1, 800)))
    x = hits.withColumn("_f", form).withColumn("_r", F.row_number().over(Window.partitionBy("qid", "source", "_f").orderBy(*order))).where("_r = 1").drop("_f", "_r")
    return x.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


def _turns(hits: DataFrame, cap: int) -> DataFrame:
    """Blocks of a bucket in the order in which paths take turns, at most cap of a path: with block, place, upto (characters to its end)."""
    x = hits.withColumn("_p", F.coalesce("path", F.lit("(no-path)"))).withColumn("_first", F.min("pos").over(Window.partitionBy("qid", "_p"))).withColumn("_turn", F.row_number().over(Window.partitionBy("qid", "_p").orderBy("pos"))).where(F.col("_turn") <= cap)
    block = F.concat(F.lit("["), "source", F.lit(" score="), F.format_string("%.4f", "score"), F.lit(" path="), F.coalesce("path", F.lit("")), F.lit("]\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    order = Window.partitionBy("qid").orderBy("_turn", "_first")
    x = x.withColumn("block", block).withColumn("place", F.row_number().over(order))
    return x.withColumn("upto", F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def _within(x: DataFrame, budget: Column, tail: int) -> DataFrame:
    """Blocks up to a budget of characters; the first that exceeds it is cut if more than tail characters are left for it."""
    start = F.col("upto") - F.length("block")
    rest = (budget - start).cast("int")
    return x.where((F.col("upto") <= budget) | (start <= budget) & (rest > tail)).withColumn("block", F.when(F.col("upto") <= budget, F.col("block")).otherwise(F.substr(F.col("block"), F.lit(1), rest)))


def packed(hits: DataFrame, budget: int = 4000, memory_share: float = 0.35, cap: int = 2, tail: int = 80) -> DataFrame:
    """Qid, context: gathered hits (with pos) as one text of at most budget characters, line breaks between blocks aside.

    Memory sources have a share of the budget; what they leave goes to the workspace. In each part paths take turns, at
    most cap blocks each; the first block that does not fit is cut, and ends its part. Hits are bounded by their pools.
    """
    mem_budget = int(budget * memory_share)
    work = F.col("source").isin(*WORKSPACE)
    a = _within(_turns(hits.where(~work), cap), F.lit(mem_budget), tail)
    used = a.groupBy("qid").agg(F.sum(F.length("block")).alias("_used"))
    b = _turns(hits.where(work), cap).join(used, "qid", "left")
    b = _within(b, F.lit(budget - mem_budget) + F.lit(mem_budget) - F.coalesce("_used", F.lit(0)), tail)
    both = a.select("qid", F.lit(0).alias("part"), "place", "block").unionByName(b.select("qid", F.lit(1).alias("part"), "place", "block"))
    one = both.groupBy("qid", "part").agg(F.array_sort(F.collect_list(F.struct("place", "block"))).alias("x")).select("qid", "part", T.trimmed(F.array_join(F.transform("x", lambda v: v["block"]), "\n")).alias("t"))
    return one.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "t"))), lambda v: v["t"]), "\n\n").alias("context"))


def filled(primary: DataFrame, fallback: DataFrame, limit: int) -> DataFrame:
    """Qid, id, text, pos: hits of the first list, then those of the second that repeat no text, up to limit a query."""
    x = primary.select("qid", "id", "text", "pos", F.lit(0).alias("_l")).unionByName(fallback.select("qid", "id", "text", "pos", F.lit(1).alias("_l")))
    x = x.withColumn("_f", F.sha1(T.strict_form(F.substring(F.coalesce("text", F.lit("")), 1, 1200)))).withColumn("_r", F.row_number().over(Window.partitionBy("qid", "_f").orderBy("_l", "pos", "id"))).where("_r = 1")
    return x.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("_l", "pos", "id"))).where(F.col("pos") <= limit).select("qid", "id", "text", "pos")


def snippet(c: Column, size: int = 240) -> Column:
    """Line breaks as spaces, cut with an ellipsis."""
    t = T.trimmed(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r?\n", " "))
    return F.when(F.length(t) > size, F.concat(F.substring(t, 1, size), F.lit("…"))).otherwise(t)


def excerpt(c: Column, start: Column, end: Column, numbered: bool = False, most_lines: int = 80) -> Column:
    """Characters start to end (from 0), widened to whole lines; with line numbers, lines beyond most_lines are an ellipsis."""
    t = F.coalesce(c, F.lit(""))
    a, z = F.greatest(F.lit(0), start), F.least(F.length(t), end)
    before, behind = F.substr(t, F.lit(1), a), F.substr(t, z + 1)
    a2 = F.when(F.contains(before, F.lit("\n")), a - F.length(F.substring_index(before, "\n", -1))).otherwise(a)
    z2 = F.when(F.contains(behind, F.lit("\n")), z + F.length(F.substring_index(behind, "\n", 1))).otherwise(z)
    chunk = F.when(z > a, F.regexp_replace(F.substr(t, a2 + 1, z2 - a2), "\r\n?", "\n")).otherwise("")
    if not numbered:
        return T.trimmed(chunk)
    lines = F.split(chunk, "\n")
    first = F.size(F.split(F.regexp_replace(F.substr(t, F.lit(1), a2), "\r\n?", "\n"), "\n"))
    kept = F.when(F.size(lines) > most_lines, F.concat(F.slice(lines, 1, most_lines), F.array(F.lit("…")))).otherwise(lines)
    width = F.length((first + F.size(kept) - 1).cast("string"))
    out = F.array_join(F.transform(kept, lambda x, i: F.concat(F.lpad((first + i).cast("string"), width, F.lit(" ")), F.lit(": "), x)), "\n")
    return F.when(chunk != "", F.regexp_replace(out, r"\s+$", "")).otherwise("")

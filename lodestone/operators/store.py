"""Changes of stored rows as DataFrames: inserts, imports, exports, erasure, retention, consolidation (D5, D6, D8, D10-D12, D17,
D20-D22, D28, A18, P1, P5, X2, X6, X10, X17, X18, X20-X23, X25)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import first_sentences, redacted
from lodestone.operators import digest, extract
from lodestone.operators.lifecycle import fingerprint, keep_newest

DELETED, ANONYMIZED = "[DELETED]", "[ANONYMIZED]"  # fixed values


def short_id(prefix: str, *cols: Column) -> Column:
    """A deterministic identifier: the prefix and 16 hex digits of a hash."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256), 1, 16))


# --- inserts -----------------------------------------------------------------------------------------------------------


def episodes(rows: DataFrame, days: int = 60) -> DataFrame:
    """Episodes from rows session_id, created_at, title, summary, one for each fingerprint of a session, the first:
    id, session_id, created_at, expires_at, title, summary, fingerprint, path and doc of its searchable form."""
    x = rows.where("session_id is not null").select("session_id", "created_at", "title", "summary", fingerprint(F.col("title"), F.col("summary")).alias("fingerprint"))
    x = x.groupBy("session_id", "fingerprint").agg(F.min(F.struct("created_at", "title", "summary")).alias("x")).select("session_id", "fingerprint", "x.*")
    x = x.withColumn("id", short_id("ep_", F.col("session_id"), F.col("fingerprint"))).withColumn("expires_at", F.col("created_at") + F.make_interval(days=F.lit(days)))
    doc = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("summary", F.lit("")))
    return x.withColumn("path", F.concat_ws("/", F.lit("episodes"), "session_id", F.concat("id", F.lit(".md")))).withColumn("doc", doc)


def added_messages(messages: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The messages with secrets redacted, and the sessions to create for them: id, created_at of the first message."""
    new = messages.where("session_id <> ''").groupBy(F.col("session_id").alias("id")).agg(F.min("created_at").alias("created_at")).join(sessions.select("id"), "id", "left_anti")
    return messages.withColumn("content", redacted("content")), new


def graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes id, label, type and edges source_id, target_id, relation, weight from rows src, src_type, label, dst,
    dst_type, weight, at; ids are hashes of type and label, the latest weight of an edge holds."""
    node = lambda kind, label: F.concat(F.lit("gn_"), F.substring(F.sha2(F.concat_ws(":", kind, label), 256), 1, 24))
    ends = F.array(F.struct(F.col("src").alias("label"), F.col("src_type").alias("type")), F.struct(F.col("dst").alias("label"), F.col("dst_type").alias("type")))
    nodes = edges.select(F.inline(ends)).where("label is not null and type is not null").distinct().select(node("type", "label").alias("id"), "label", "type")
    e = edges.select(node("src_type", "src").alias("source_id"), node("dst_type", "dst").alias("target_id"), F.col("label").alias("relation"), "weight", "at")
    return nodes, e.groupBy("source_id", "target_id", "relation").agg(F.max_by("weight", F.struct("at", "weight")).alias("weight"))


def stored_memories(docs: DataFrame) -> DataFrame:
    """Id, entity_id (unknown if none), memory_type, content, confidence, source_text (the first 1000 characters)."""
    m = extract.memories(docs).distinct().join(docs.select("doc_id", "entity_id", F.substring("text", 1, 1000).alias("source_text")).distinct(), "doc_id")
    return m.select(short_id("mem_", F.col("doc_id"), F.col("memory_type"), F.col("content")).alias("id"), "doc_id", F.coalesce("entity_id", F.lit("unknown")).alias("entity_id"), "memory_type", "content", "confidence", "source_text")


def corrected(log: DataFrame, corrections: DataFrame) -> DataFrame:
    """A log of writes (key, seq, source, value) with corrections (key, value) behind it, as manual writes."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_last"))
    return log.select("key", "seq", "source", "value").unionByName(corrections.crossJoin(F.broadcast(last)).select("key", (F.col("_last") + 1).alias("seq"), F.lit("manual").alias("source"), "value"))


# --- import and export -------------------------------------------------------------------------------------------------


def imported(existing: DataFrame, incoming: DataFrame, mode: str = "merge", override_locked: bool = False) -> DataFrame:
    """Key, value, action after an import into rows key, value, locked: added, updated, skipped, skipped_locked or kept.

    merge only adds what is missing; replace overwrites, but a locked row only if override_locked. Of several incoming
    rows of a key the greatest value counts; incoming values are redacted; null keys are left out.
    """
    a = existing.where("key is not null").select("key", F.col("value").alias("_old"), F.coalesce("locked", F.lit(False)).alias("_locked"), F.lit(True).alias("_a"))
    b = incoming.where("key is not null").groupBy("key").agg(F.max(redacted("value")).alias("_new")).withColumn("_b", F.lit(True))
    act = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "kept").when(F.lit(mode != "replace") | F.col("_old").eqNullSafe(F.col("_new")), "skipped")
    act = act.when(F.col("_locked") & F.lit(not override_locked), "skipped_locked").otherwise("updated")
    x = a.join(b, "key", "full").withColumn("action", act)
    return x.select("key", F.when(F.col("action").isin("added", "updated"), F.col("_new")).otherwise(F.col("_old")).alias("value"), "action")


def exported(sessions: DataFrame, messages: DataFrame, newest: int = 20) -> DataFrame:
    """Id, document: one JSON document per session with its row and its newest messages, secrets redacted in all texts."""
    m = keep_newest(messages.where("session_id <> ''").select("session_id", "id", "created_at", "role", redacted("content").alias("content")).distinct(), "session_id", [F.desc_nulls_last("created_at"), "id"], newest)
    m = m.groupBy(F.col("session_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "role", "content"))).alias("messages"))
    s = sessions.select("id", F.struct(redacted("title").alias("title"), redacted("summary").alias("summary"), F.col("session_status").alias("status"), "created_at").alias("session"))
    return s.join(m, "id", "left").select("id", F.to_json(F.struct(F.lit(1).alias("schema"), "session", "messages")).alias("document"))


# --- erasure -----------------------------------------------------------------------------------------------------------


def erasure(tables: dict[str, tuple[DataFrame, str]], users: DataFrame) -> dict[str, DataFrame]:
    """Every table (rows and the name of its session column) without the rows of the users (session_id)."""
    gone = users.select("session_id").where("session_id is not null").distinct()
    return {name: df.join(gone.withColumnRenamed("session_id", key), key, "left_anti") for name, (df, key) in tables.items()}


def pseudonymous(log: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """A log that is kept, with the users' names replaced."""
    gone = users.select(F.col("session_id").alias(key), F.lit(True).alias("_gone")).where(F.col(key).isNotNull()).distinct()
    return log.join(gone, key, "left").withColumn(key, F.when(F.col("_gone"), F.lit(DELETED)).otherwise(F.col(key))).drop("_gone")


def anonymous(df: DataFrame, users: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The users' rows with the given columns replaced; others stay."""
    gone = users.select(F.col("session_id").alias(key), F.lit(True).alias("_gone")).where(F.col(key).isNotNull()).distinct()
    x = df.join(gone, key, "left")
    return x.select(*[F.when(F.col("_gone"), F.lit(ANONYMIZED)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- retention ---------------------------------------------------------------------------------------------------------


def pruned_episodes(df: DataFrame, now: str, days: int, most: int) -> DataFrame:
    """Id, session_id, fate of rows id, session_id, created_at: by_age (older than days), by_count (beyond the newest most
    of a session), kept. Documents derived from what goes are dropped by an anti join on the id. A row without time is oldest."""
    old = F.coalesce(F.col("created_at") < F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)), F.lit(False))
    w = Window.partitionBy("session_id", old).orderBy(F.desc_nulls_last("created_at"), "id")
    return df.select("id", "session_id", F.when(old, "by_age").when(F.row_number().over(w) > most, "by_count").otherwise("kept").alias("fate"))


def pruned_log(df: DataFrame, now: str, days: int, per_session: int, most: int) -> DataFrame:
    """What is left of a log id, session_id, ts by age, then the newest per session, then the newest of all."""
    x = df.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))
    return keep_newest(keep_newest(x, "session_id", [F.desc("ts"), F.desc("id")], per_session), None, [F.desc("ts"), F.desc("id")], most)


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """Step, n: the rows that every step of a housekeeping run leaves."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n") for name, df in parts.items()])


# --- consolidation -----------------------------------------------------------------------------------------------------


def heuristic_consolidation(texts: DataFrame) -> DataFrame:
    """doc_id, topic, keywords, summary, preferences: the topic of the most frequent keyword, the first five keywords, the
    first three sentences and the number of preferences (at most five)."""
    k = extract.keywords(texts, 5).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("k"))
    p = digest.stated_preferences(texts.select(F.col("doc_id").alias("id"), "text"), 5).groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("preferences"))
    x = texts.select("doc_id", first_sentences("text", 3).alias("summary")).join(k, "doc_id", "left").join(p, "doc_id", "left")
    return x.select("doc_id", F.concat(F.lit("topic_"), F.col("k")[0]["word"]).alias("topic"), F.array_join(F.transform("k", lambda v: v["word"]), ", ").alias("keywords"), "summary", F.coalesce("preferences", F.lit(0)).alias("preferences"))


# Phrases that correct something with what they become, in order; openings that add something; what stands for a
# part of a key; values that a correction turns to false and to true.
CORRECTIONS = [
    ("not ", "not "), ("cannot", "cannot"), ("won't", "won't"), ("don't want", "don't want"), ("don't like", "don't like"), ("this is not", "this is not"), ("changed my mind", "changed my mind"),
    ("не ", "not "), ("нельзя", "cannot"), ("не буду", "won't"), ("не хочу", "don't want"), ("не люблю", "don't like"), ("это не", "this is not"), ("передумал", "changed my mind"), ("передумала", "changed my mind"),
    ("не ", "not "), ("не можна", "cannot"), ("не буду", "won't"), ("не хочу", "don't want"), ("не люблю", "don't like"), ("це не", "this is not"), ("передумав", "changed my mind"), ("передумала", "changed my mind"),
]
ADDITIONS = ["i ", "my ", "i work", "i live", "я ", "мой ", "моя ", "моё ", "я работаю", "я живу", "я ", "мій ", "моя ", "моє ", "я працюю", "я живу"]
KEY_PARTS = [
    ("like", "like"), ("love", "like"), ("hate", "hate"), ("prefer", "prefer"), ("work at", "work_at"), ("live in", "live_in"), ("люблю", "like"), ("нравится", "like"), ("ненавижу", "hate"), ("предпочитаю", "prefer"),
    ("работаю в", "work_at"), ("живу в", "live_in"), ("подобається", "like"), ("ненавиджу", "hate"), ("віддаю перевагу", "prefer"), ("працюю в", "work_at"),
]
POSITIVE = ["coffee", "tea", "yes", "true", "кофе", "чай", "да", "правда", "кава", "так"]
NEGATIVE = ["no", "false", "нет", "ложь", "ні"]


def _key_of(c: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(c)), "[?!.]", "")
    for a, b in KEY_PARTS:
        t = F.replace(t, F.lit(a), F.lit(b))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.substring(F.array_join(F.slice(words, 1, 3), "_"), 1, 50))


def _any_of(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def feedback(texts: DataFrame) -> DataFrame:
    """Id, key, value of what a feedback text (id, text) corrects or adds; texts that say nothing of the kind have no row.

    The first phrase of a correction that leaves a key before it decides; its value is turned round (false, true) or taken
    as it stands. Else the first opening that leaves a key behind it does, with the words up to a comma.
    """
    low, text = F.lower(F.col("text")), F.col("text")

    def part(i: int, phrase: str, becomes: str | None) -> Column:
        at = F.instr(low, phrase)
        behind = F.substr(low if becomes is not None else text, at + F.lit(len(phrase)))
        value = F.lower(F.trim(F.replace(behind, F.lit(phrase), F.lit(becomes)))) if becomes is not None else F.trim(F.substring_index(F.trim(behind), ",", 1))
        named = F.substr(low, F.lit(1), at - 1) if becomes is not None else F.trim(behind)
        return F.when(at > 0, F.struct(F.lit(i).alias("i"), F.lit(becomes is not None).alias("corrects"), named.alias("named"), value.alias("value")))

    parts = [part(i, a, b) for i, (a, b) in enumerate(dict.fromkeys(CORRECTIONS))] + [part(100 + i, a, None) for i, a in enumerate(dict.fromkeys(ADDITIONS))]
    x = texts.where("text <> ''").select("id", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p")).select("id", "p.*")
    x = x.select("id", "i", "corrects", "value", _key_of(F.col("named")).alias("key")).where("key is not null")
    x = x.groupBy("id").agg(F.min_by(F.struct("corrects", "key", "value"), "i").alias("x")).select("id", "x.*")
    turned = F.when(_any_of(F.col("value"), POSITIVE), "false").when(_any_of(F.col("value"), NEGATIVE), "true").when(F.col("value") != "", F.col("value"))
    return x.select("id", "key", F.when(F.col("corrects"), turned).otherwise(F.col("value")).alias("value"))


# --- JSON --------------------------------------------------------------------------------------------------------------


def decoded(c: Column, schema: str, default: Column) -> Column:
    """A JSON text by its schema; the default where it is null, damaged or of another form."""
    return F.coalesce(F.from_json(c, schema), default)


def clean_json(c: Column) -> Column:
    """A JSON text with secrets redacted and NaN and infinities as null."""
    return redacted(F.regexp_replace(c, r"(?<=[:\[,])(\s*)-?(?:NaN|Infinity)(?=\s*[,\]}])", "$1null"), quoted=True)

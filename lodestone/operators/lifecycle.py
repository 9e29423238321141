"""Retention and change of stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import loose_form, strict_form
from lodestone.operators.sessions import newest_within
from lodestone.sources.tables import checkpointed, spread


def alive(df: DataFrame, expires, now: str) -> DataFrame:
    """Rows without expiry or that expire after now."""
    return df.where(expires.isNull() | (expires > F.lit(now).cast("timestamp")))


def keep_newest(df: DataFrame, key: str | None, order: list, n: int) -> DataFrame:
    """The newest n rows of each key, or of all; Spark keeps n a task before it shuffles."""
    if key is None:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def decayed(c, now: str, rate: float = 0.9, days: float = 30.0):
    """rate^(age in days / 30)."""
    return F.pow(F.lit(rate), (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(c)) / (86400.0 * days))


def duplicate_lessons(df: DataFrame, loose: bool = False) -> DataFrame:
    """A10: texts of one normal form: the newest row wins (then the lower id): doc_id, winner of every other row."""
    form = F.sha2(loose_form("text") if loose else strict_form("text"), 256)
    # the forms are worked out once, where the texts lie; what is left of them is a hash
    x = checkpointed(spread(df.select("doc_id", "created_at", "text")).select("doc_id", "created_at", form.alias("h"))).where(F.col("h") != F.sha2(F.lit(""), 256))
    newest = F.max_by("doc_id", F.struct(F.coalesce(F.unix_micros("created_at"), F.lit(-1)), -F.col("doc_id")))
    best = x.groupBy("h").agg(newest.alias("winner"), F.count("*").alias("n")).where("n > 1")
    return x.join(best, "h").where("doc_id <> winner").select("doc_id", "winner")


def locked_preferences(log: DataFrame) -> DataFrame:
    """Key, value after a log of writes (key, seq, source, value): an automatic write does not overwrite a locked row,
    and manual and system writes lock. So the last locking write holds, and only without one the last automatic write.
    """
    lock = F.col("source") != "auto"
    return log.groupBy("key").agg(F.coalesce(F.max_by(F.when(lock, F.col("value")), F.when(lock, F.col("seq"))), F.max_by("value", "seq")).alias("value"), F.max(lock.cast("int")).alias("locked"))


def merged(existing: DataFrame, incoming: DataFrame, key: str, value: str) -> DataFrame:
    """How many rows an import adds, changes, leaves or keeps: action, n."""
    a, b = existing.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), incoming.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    x = a.join(b, key, "full")
    act = F.when(F.col("_in_a").isNull(), "created").when(F.col("_in_b").isNull(), "kept").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("updated")
    return x.groupBy(act.alias("action")).agg(F.count("*").alias("n"))


def erased(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the given keys removed."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def fingerprint(title, summary):
    """One fingerprint for storing and importing."""
    return F.sha2(F.concat(F.lower(F.coalesce(title, F.lit(""))), F.lit("\n"), F.lower(F.coalesce(summary, F.lit("")))), 256)


def working_memory(df: DataFrame, key: str, order: str, text: str, limit: int = 12_000) -> DataFrame:
    """The last limit characters of each key's texts, joined by line breaks in order. Rows that lie wholly before
    them are left out before anything is gathered, so no list exceeds the limit by more than a row."""
    after = Window.partitionBy(key).orderBy(F.desc(order), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    x = newest_within(df.where(F.col(text).isNotNull()), key, order, text, limit).withColumn("_after", F.coalesce(F.sum(F.length(text) + 1).over(after), F.lit(0))).where(F.col("_after") < limit)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "id", text))), lambda s: s[text]), "\n")
    return x.groupBy(key).agg(F.right(joined, F.lit(limit)).alias("content"))

"""Sessions, messages and rates (A17, D1, D3, D7, D18, ST4-ST7, W6, P12)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.running import running

# Texts that end a session (ST5).
END_MARKERS = ["session ended", "session complete", "сессия закончена", "сессия окончена", "сесію завершено", "сесія завершена"]


def gap_sessions(df: DataFrame, key: str, ts: str, minutes: int = 20) -> DataFrame:
    """ST4: sessions of events less than minutes apart: key, start_s, end_s, events. Null keys and times are left out.

    Spark merges the windows of a key before and after the shuffle, so a busy key crosses it with its sessions only.
    """
    m = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    x = m.groupBy(key, F.session_window(ts, f"{minutes} minutes").alias("w")).agg(F.min(F.unix_micros(F.col(ts).cast("timestamp"))).alias("a"), F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("b"), F.count("*").alias("events"))
    return x.select(F.col(key), F.floor(F.col("a") / 1_000_000).alias("start_s"), F.floor(F.col("b") / 1_000_000).alias("end_s"), "events")


def is_end(c):
    """ST5: texts that hold a marker of the end of a session, in either case."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for m in END_MARKERS:
        out = out | low.contains(m)
    return out


def ended_by_marker(df: DataFrame, key: str, ts: str, marker, tie: str) -> DataFrame:
    """ST5: per key, the sessions that marker rows close: key, session (from 0), rows, closed.

    The number of markers before a row is its session; days carry their counts over, so no window holds more than one
    day of a key or one row a day. Rows without key or time are left out.
    """
    x = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, ts, tie, F.coalesce(marker, F.lit(False)).cast("int").alias("end"), F.to_date(ts).alias("_d"))
    x = running(x, [key], "_d", [ts, tie], sums={"session": F.col("end")}, before=True)
    return x.groupBy(key, "session").agg(F.count("*").alias("rows"), F.max("end").alias("closed"))


def rate_limited(df: DataFrame, key: str, ts: str, tie: str, rules: tuple[tuple[int, int], ...] = ((60, 60), (3600, 1000))) -> DataFrame:
    """ST6: key, tie, allowed, left: what a sliding limiter answers; denied calls are not recorded and count for nothing.

    rules are pairs of seconds and calls; a recorded call counts while it is less than that many seconds old. left is
    what the first rule still allows after the call. The fold depends on its own answers, so calls are taken in order, by
    batches and with no more state than the largest rule has calls; a key begins anew after a gap as long as the longest
    rule, and such stretches are worked on apart. Rows without key or time are left out; ties go by the tie column.
    """
    longest = max(s for s, _ in rules) * 1_000_000
    x = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(tie).alias("tie"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).withColumn("d", F.floor(F.col("t") / 86_400_000_000))
    x = running(x, ["key"], "d", ["t", "tie"], lasts={"prev": F.col("t")}, before=True)
    x = running(x.withColumn("new", F.coalesce(F.col("t") - F.col("prev") >= longest, F.lit(True)).cast("int")), ["key"], "d", ["t", "tie"], sums={"part": F.col("new")})
    types = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, kept = None, deque()
        for d in batches:
            allowed, left = [], []
            for k, part, t in zip(d["key"], d["part"], d["t"], strict=True):
                if at != (k, part):
                    at, kept = (k, part), deque()
                while kept and kept[0] <= t - longest:
                    kept.popleft()
                counts = [sum(1 for u in kept if u > t - s * 1_000_000) for s, _ in rules]
                ok = all(c < n for c, (_, n) in zip(counts, rules, strict=True))
                if ok:
                    kept.append(t)
                allowed.append(ok)
                left.append(max(0, rules[0][1] - counts[0] - ok))
            yield pd.DataFrame({key: d["key"], tie: d["tie"], "allowed": allowed, "left": left})

    y = x.repartition("key", "part").sortWithinPartitions("key", "part", "t", "tie")
    return y.select("key", "part", "t", "tie").mapInPandas(run, f"`{key}` {types[key]}, `{tie}` {types[tie]}, allowed boolean, left int")


def newest_within(df: DataFrame, group: str, ts: str, text: str, limit: int) -> DataFrame:
    """Rows of the days that the newest limit characters of each group can reach: sums per day decide, so that a group
    of any size goes into the window after this with one day more than its budget at most. Rows without time come last."""
    x = df.withColumn("_d", F.to_date(ts))
    days = x.groupBy(group, "_d").agg(F.sum(F.coalesce(F.length(text), F.lit(0))).alias("_n"))
    later = Window.partitionBy(group).orderBy(F.col("_d").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    near = days.withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0))).where(F.col("_later") < limit)
    near = near.select(F.col(group).alias("_g"), F.col("_d").alias("_e"))
    return x.join(near, (F.col(group) == F.col("_g")) & F.col("_d").eqNullSafe(F.col("_e")), "left_semi").drop("_d")


def budget(df: DataFrame, group: str, ts: str, tie: str, text: str, limit: int) -> DataFrame:
    """The newest rows of each group until limit characters are used; the last one is cut."""
    before = Window.partitionBy(group).orderBy(F.col(ts).desc_nulls_last(), tie).rowsBetween(Window.unboundedPreceding, -1)
    x = newest_within(df, group, ts, text, limit).withColumn("_used", F.coalesce(F.sum(F.length(text)).over(before), F.lit(0))).where(F.col("_used") < limit)
    return x.withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(limit) - F.col("_used")).cast("int"))).drop("_used")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key (null-safe), by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    x = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order and dict(df.dtypes)[c] != "map"])).alias("_x"))
    return x.select(*keys, "_x.*")

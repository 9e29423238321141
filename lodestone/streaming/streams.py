"""Streams of events and facts (ST1-ST4, ST7, ST9, ST12, ST13)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.functions.names import norm_name
from lodestone.operators.facts import SINGLE_ACTIVE


def read_files(spark: SparkSession, folder: str, schema: T.StructType, files: int = 100) -> DataFrame:
    """ST9: new Parquet files of a folder, a bounded number of them in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def gap_sessions(events: DataFrame, key: str, ts: str, minutes: int = 20, late: str = "1 hour") -> DataFrame:
    """ST4: sessions of events less than minutes apart, given out once the watermark has passed them."""
    x = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, f"{minutes} minutes").alias("w"))
    return x.agg(F.count("*").alias("events")).select(key, F.unix_seconds("w.start").alias("start_s"), F.unix_seconds("w.end").alias("end_s"), "events")


def hourly_counts(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """ST7: events per key and fixed hour."""
    x = events.withWatermark(ts, late).groupBy(key, F.window(ts, "1 hour").alias("w"))
    return x.agg(F.count("*").alias("n")).select(key, F.unix_seconds("w.start").alias("start_s"), "n")


def fact_log(rows: DataFrame, late: str = "7 days") -> DataFrame:
    """ST1: usable fact events in normal form, each seq once within the watermark on arrival."""
    x = rows.select("seq", norm_name(F.col("subject")).alias("s"), norm_name(F.col("predicate")).alias("p"), norm_name(F.col("object")).alias("o"), norm_name(F.col("action")).alias("action"), F.coalesce("observed_at", "created_at").alias("t"), "created_at")
    x = x.where("s <> '' and p <> '' and o <> '' and action in ('assert', 'retract')")
    return x.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["seq"])


def _folded(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One group's events of a micro-batch in order of arrival, with what each did to the open object and the versions."""
    held, known = json.loads(state.get[0]) if state.exists else (None, {})
    rows, d = [], pd.concat(list(batches)).sort_values(["seq", "action", "o"])
    for seq, o, action, t in zip(d["seq"], d["o"], d["action"], d["t"], strict=True):
        if action == "assert":
            if held is not None and held != o:
                known[held] += 1
                rows.append((seq, *key[:2], held, "close_replaced", "closed", t, known[held]))
            known[o] = known.get(o, 0) + 1
            held = o
            rows.append((seq, *key[:2], o, action, "asserted", t, known[o]))
        elif o == held:
            known[o] += 1
            held = None
            rows.append((seq, *key[:2], o, action, "retracted", t, known[o]))
        else:
            rows.append((seq, *key[:2], o, action, "already_inactive" if o in known else "not_found", t, known.get(o)))
    state.update((json.dumps([held, known]),))
    yield pd.DataFrame(rows, columns=["seq", "s", "p", "o", "action", "status", "t", "version"]).astype({"version": "Int64"})


def fact_fold(rows: DataFrame) -> DataFrame:
    """ST2, ST3: T1 over a stream of fact events: seq, s, p, o, action, status, t, version of every event and closing.

    Events are folded in order of arrival within a micro-batch and micro-batch by micro-batch, as the store takes them;
    late ones change what is open now, and an as-of query over the output sorts by t. The state of a group is its open
    object and the version of each object it ever had. Give it the output of fact_log(), in which every seq occurs once.
    """
    k = F.when(F.col("p").isin(*SINGLE_ACTIVE), F.lit("")).otherwise(F.col("o"))
    out = "seq bigint, s string, p string, o string, action string, status string, t timestamp, version bigint"
    return rows.select("s", "p", k.alias("k"), "o", "action", "seq", "t").groupBy("s", "p", "k").applyInPandasWithState(_folded, out, "state string", "append", GroupStateTimeout.NoTimeout)


def run(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """ST12, ST13: give every micro-batch to a function until the input at hand is used up."""
    df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()

"""Overlapping and gapped intervals: continuous periods and the gaps between them.

A mergeable aggregate holds sorted disjoint intervals. Partial lists are built where the rows lie; the lists of a key
and block of start times are combined by linear merges, two and two, in a reduction tree; and at its top the blocks are
joined by what reaches over their borders alone: one row per block. No task ever holds the whole list of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.names import norm_name, seconds
from lodestone.sources.tables import checkpointed

OPEN = 2**62
DAY_US = 86_400_000_000
LISTS = "s string, p string, b bigint, fs array<bigint>, ts array<bigint>"

List = tuple[np.ndarray, np.ndarray]


def closed_up(f: np.ndarray, t: np.ndarray) -> List:
    """Disjoint intervals from intervals in order of their starts: touching and overlapping ones become one."""
    reach = np.maximum.accumulate(t)
    new = np.concatenate([[True], f[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return f[at], np.maximum.reduceat(t, at)


def merged(x: List, y: List) -> List:
    """Two lists of disjoint intervals as one, in linear time: each interval's place is its own plus that in the other list."""
    a, b = np.arange(len(x[0])) + np.searchsorted(y[0], x[0], "left"), np.arange(len(y[0])) + np.searchsorted(x[0], y[0], "right")
    f, t = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int64)
    f[a], t[a], f[b], t[b] = *x, *y
    return closed_up(f, t)


def reduced(lists: list[List]) -> List:
    """All lists as one, merged two and two until one is left."""
    while len(lists) > 1:
        lists = [merged(*lists[i : i + 2]) if i + 1 < len(lists) else lists[i] for i in range(0, len(lists), 2)]
    return lists[0]


def partial_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One list per key and block of a batch of rows s, p, b, f, t in any order."""
    for d in batches:
        d = d.sort_values(["s", "p", "b", "f"], kind="stable")
        if not len(d):
            continue
        new = ((d["s"] != d["s"].shift()) | (d["p"] != d["p"].shift()) | (d["b"] != d["b"].shift())).to_numpy()
        at = np.flatnonzero(new)
        lists = [closed_up(f, t) for f, t in zip(np.split(d["f"].to_numpy(), at[1:]), np.split(d["t"].to_numpy(), at[1:]), strict=True)]
        heads = d.iloc[at]
        yield pd.DataFrame({"s": heads["s"], "p": heads["p"], "b": heads["b"], "fs": [x for x, _ in lists], "ts": [y for _, y in lists]})


def combined_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One list per key and block from partial lists in order of these; the last one of a batch waits for the next batch."""
    key, held = None, []
    for d in batches:
        rows = []
        for s, p, b, f, t in zip(d["s"], d["p"], d["b"], d["fs"], d["ts"], strict=True):
            if key != (s, p, b):
                if held:
                    rows.append((*key, *reduced(held)))
                key, held = (s, p, b), []
            held.append((np.asarray(f), np.asarray(t)))
        yield pd.DataFrame(rows, columns=["s", "p", "b", "fs", "ts"])
    if held:
        yield pd.DataFrame([(*key, *reduced(held))], columns=["s", "p", "b", "fs", "ts"])


def disjoint(df: DataFrame) -> DataFrame:
    """Disjoint intervals per (s, p, b) from rows s, p, b, f, t, as two arrays in order: fs, ts."""
    return df.mapInPandas(partial_lists, LISTS).repartition("s", "p", "b").sortWithinPartitions("s", "p", "b").mapInPandas(combined_lists, LISTS)


def periods_and_gaps(df: DataFrame, block_days: int = 14) -> DataFrame:
    """s, p, kind ('period', 'gap'), f, t (microseconds; t null while open) per subject and predicate.

    Intervals run from valid_from up to, not including, valid_to; null valid_to is open. Rows without valid_from, with
    valid_to not after it, or without a subject or predicate do not count. Touching periods are one. Repeated rows and
    ties change nothing, an empty table gives no rows, further columns are ignored.
    """
    rows = df.select(
        norm_name(F.col("subject")).alias("s"),
        norm_name(F.col("predicate")).alias("p"),
        F.unix_micros(F.col("valid_from").cast("timestamp")).alias("f"),
        F.when(F.col("valid_to").isNull(), F.lit(OPEN)).otherwise(F.unix_micros(F.col("valid_to").cast("timestamp"))).alias("t"),
    ).where("s <> '' and p <> '' and f is not null and t > f")
    # the lists are built once; their last ends, one row a block, meet across the blocks, and the lists meet the result
    lists = checkpointed(disjoint(rows.select("s", "p", F.floor(F.col("f") / (block_days * DAY_US)).cast("bigint").alias("b"), "f", "t")))
    before = Window.partitionBy("s", "p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    top = F.element_at("ts", -1)
    reach = lists.select("s", "p", "b", top.alias("top")).select("s", "p", "b", F.max("top").over(before).alias("carry"), F.max("top").over(Window.partitionBy("s", "p")).alias("end"))
    none = F.array(F.lit(None).cast("bigint"))
    shifted = lists.select("s", "p", "b", "fs", "ts", F.concat(none, "fs").alias("fp"), F.concat(none, "ts").alias("tp"))
    x = shifted.join(reach, ["s", "p", "b"]).select("s", "p", "carry", "end", F.element_at("fs", -1).alias("last"), F.inline(F.arrays_zip("fs", "ts", "fp", "tp"))).where("fs is not null and (carry is null or fs > carry)")
    # what ends before an interval begins: its forerunner in the block, or what reaches into the block
    x = x.select("s", "p", "end", F.col("fs").alias("f"), F.col("ts").alias("t"), F.greatest("tp", "carry").alias("prev"), (F.col("fs") == F.col("last")).alias("z"), (F.col("fp").isNull() | F.coalesce(F.col("fp") <= F.col("carry"), F.lit(False))).alias("a"))
    # the last interval of a block goes on until the first one of a later block begins; two rows a block tell
    edge = x.where("a or z").withColumn("next", F.lead("prev").over(Window.partitionBy("s", "p").orderBy("f"))).withColumn("t", F.when(F.col("z"), F.coalesce("next", "end")).otherwise(F.col("t")))
    whole = x.where("not (a or z)").select("s", "p", "f", "prev", "t").unionByName(edge.select("s", "p", "f", "prev", "t"))
    kinds = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("f").alias("f"), F.when(F.col("t") < OPEN, F.col("t")).alias("t")),
        F.struct(F.lit("gap").alias("kind"), F.col("prev").alias("f"), F.col("f").alias("t")),
    )
    return whole.select("s", "p", F.inline(kinds)).where("f is not null")


def found_periods(df: DataFrame) -> DataFrame:
    """subject, predicate, kind, from_s, to_s; to_s is 0 while open."""
    x = periods_and_gaps(df)
    return x.select(F.col("s").alias("subject"), F.col("p").alias("predicate"), "kind", seconds(F.col("f")).alias("from_s"), F.coalesce(seconds(F.col("t")), F.lit(0)).cast("bigint").alias("to_s"))

"""History of changing entity attributes, from an event log of assertions and retractions.

The log is split into blocks of time. Inside a block, a window orders the events of one entity and attribute and
yields the versions that begin there; only one summary row per block, and one per block and retracted value, then
meets the rows of other blocks. So an entity that holds a third of the log is worked on in as many tasks as it has
blocks, and no window sees more than one block of it or one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.names import norm_name, seconds
from lodestone.operators.running import running
from lodestone.sources.tables import checkpointed

DAY_US = 86_400_000_000


def change_log(df: DataFrame, attributes: Sequence[str] | None, block_days: int = 7) -> DataFrame:
    """Usable events: s, p, o, is_assert, t (microseconds), seq, b (time block).

    Rows take effect at observed_at, or created_at where that is null; rows with neither, without a usable subject,
    predicate or object, or with another action are left out, as they change nothing.
    """
    t = F.unix_micros(F.coalesce("observed_at", "created_at").cast("timestamp"))
    log = df.select(
        norm_name(F.col("subject")).alias("s"),
        norm_name(F.col("predicate")).alias("p"),
        norm_name(F.col("object")).alias("o"),
        norm_name(F.col("action")).alias("a"),
        t.alias("t"),
        F.coalesce(F.col("seq").cast("bigint"), F.lit(-1)).alias("seq"),
    ).where("s <> '' and p <> '' and o <> '' and t is not null and a in ('assert', 'retract')")
    if attributes is not None:
        log = log.where(F.col("p").isin(list(attributes)))
    return log.select("s", "p", "o", (F.col("a") == "assert").alias("is_assert"), "t", "seq", F.floor(F.col("t") / (block_days * DAY_US)).alias("b"))


def versions(df: DataFrame, attributes: Sequence[str] | None = None, block_days: int = 7) -> DataFrame:
    """Every version of every entity attribute: s, p, o, t0, t1 (microseconds; t1 null while open).

    An assert sets the value; a retract of the value that holds ends it. At equal times the higher seq comes later.
    Touching versions of one value are one; versions of no duration are none. Repeated rows change nothing, an empty
    log gives no rows, null or blank fields make a row unusable, and further columns are ignored.
    """
    log = change_log(df, attributes, block_days)
    inner = Window.partitionBy("s", "p", "b").orderBy("t", "seq", "is_assert", "o")
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = (
        log.withColumn("seg", F.sum(F.col("is_assert").cast("int")).over(upto))
        .withColumn("v", F.last(F.when(F.col("is_assert"), F.col("o")), ignorenulls=True).over(upto))
        .where("is_assert or seg = 0 or o = v")
        .groupBy("s", "p", "b", "seg", "o")
        .agg(F.min(F.when(F.col("is_assert"), F.col("t"))).alias("t0"), F.min(F.when(~F.col("is_assert"), F.col("t"))).alias("r"))
    )
    heads = runs.where("seg = 0").select("s", "p", "b", "o", F.col("r").alias("t"))
    by_seg = Window.partitionBy("s", "p", "b").orderBy("seg")
    begun = runs.where("seg > 0").withColumn("next", F.lead("t0").over(by_seg)).withColumn("first", F.min("t0").over(Window.partitionBy("s", "p", "b")))
    closed = begun.where("r is not null or next is not null").select("s", "p", "b", "o", "t0", F.coalesce("r", "next").alias("t1"))
    last = begun.where("next is null")
    blocks = last.withColumn("later", F.lead("first").over(Window.partitionBy("s", "p").orderBy("b"))).where("r is null")
    marks = blocks.select("s", "p", "o", "b", F.lit(1).alias("k"), "t0", "later", F.lit(None).cast("bigint").alias("t")).unionByName(
        heads.select("s", "p", "o", "b", F.lit(0).alias("k"), F.lit(None).cast("bigint").alias("t0"), F.lit(None).cast("bigint").alias("later"), "t")
    )
    ahead = Window.partitionBy("s", "p", "o").orderBy("b", "k").rowsBetween(1, Window.unboundedFollowing)
    opened = marks.withColumn("gone", F.min("t").over(ahead)).where("k = 1").select("s", "p", "b", "o", "t0", F.least("gone", "later").alias("t1"))
    return coalesce_versions(closed.unionByName(opened))


def coalesce_versions(df: DataFrame) -> DataFrame:
    """Join touching versions of one value, first inside each block b, then across the blocks' outer ones."""
    df = df.where("t1 is null or t1 > t0")
    inner = Window.partitionBy("s", "p", "b").orderBy("t0")
    touch = (F.lag("o").over(inner) == F.col("o")) & (F.lag("t1").over(inner) == F.col("t0"))
    island = df.withColumn("new", F.when(F.coalesce(touch, F.lit(False)), 0).otherwise(1)).withColumn("g", F.sum("new").over(inner))
    joined = island.groupBy("s", "p", "b", "g").agg(F.min("o").alias("o"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.max(F.col("t1").isNull()).alias("open"))
    joined = joined.withColumn("n", F.max("g").over(Window.partitionBy("s", "p", "b"))).withColumn("t1", F.when(~F.col("open"), F.col("t1")))
    outer = joined.where("g = 1 or g = n")
    chain = Window.partitionBy("s", "p").orderBy("t0")
    touch = (F.lag("o").over(chain) == F.col("o")) & (F.lag("t1").over(chain) == F.col("t0"))
    outer = outer.withColumn("c", F.sum(F.when(F.coalesce(touch, F.lit(False)), 0).otherwise(1)).over(chain))
    outer = outer.groupBy("s", "p", "c").agg(F.min("o").alias("o"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.max(F.col("t1").isNull()).alias("open"))
    return outer.select("s", "p", "o", "t0", F.when(~F.col("open"), F.col("t1")).alias("t1")).unionByName(joined.where("g > 1 and g < n").select("s", "p", "o", "t0", "t1"))


def found_versions(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """subject, predicate, object, from_s, to_s of every version; to_s is 0 while open."""
    v = versions(df, attributes)
    return v.select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), seconds(F.col("t0")).alias("from_s"), F.coalesce(seconds(F.col("t1")), F.lit(0)).cast("bigint").alias("to_s"))


def combined_history(df: DataFrame, attributes: Sequence[str], block_days: int = 7) -> DataFrame:
    """One row per entity and longest period in which all its attributes stood still.

    The periods are cut at the union of the attributes' boundaries; a value carries over block borders by one summary
    row per block. Columns: subject, one per attribute (null where it had no value), from_s, to_s (0 while open).
    Periods in which no attribute had a value are left out. As the versions of each attribute are coalesced, something
    changes at every boundary, so no two neighbouring periods are alike.
    """
    v = checkpointed(versions(df, attributes, block_days))
    ends = F.array(F.struct(F.col("t0").alias("t"), F.col("o").alias("v")), F.struct(F.col("t1").alias("t"), F.lit(None).cast("string").alias("v")))
    marks = v.select("s", "p", F.inline(ends)).where("t is not null")
    # an end and a begin at one time: the begin wins, as it is the greater one
    points = marks.groupBy("s", "t").agg(*[F.max(F.when(F.col("p") == a, F.struct(F.col("v").isNotNull().alias("y"), F.col("v").alias("v")))).alias(f"_{a}") for a in attributes])
    points = points.withColumn("b", F.floor(F.col("t") / (block_days * DAY_US))).withColumn("back", -F.col("t")).withColumn("b_back", -F.col("b"))
    x = running(points, ["s"], "b", ["t"], lasts={a: F.col(f"_{a}") for a in attributes})
    x = running(x, ["s"], "b_back", ["back"], lasts={"u": F.col("t")}, before=True)
    x = x.select("s", "t", "u", *[F.col(a)["v"].alias(a) for a in attributes]).where(F.coalesce(*[F.col(a) for a in attributes]).isNotNull())
    return x.select(F.col("s").alias("subject"), *attributes, seconds(F.col("t")).alias("from_s"), F.coalesce(seconds(F.col("u")), F.lit(0)).cast("bigint").alias("to_s"))

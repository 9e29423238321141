"""Running sums and last values over groups of any size, in two levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: bool = False) -> DataFrame:
    """df with running sums and last non-null values per key, up to each row or (before) up to the row ahead of it.

    block is a column that never falls along the order; a window sees the rows of one block of a key, and another one
    its blocks with one row each, so a key that holds a third of all rows is worked on in as many tasks as it has blocks.
    Rows that are equal in order come in any order.
    """
    sums, lasts = sums or {}, lasts or {}
    group = [*keys, block]
    inner = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    x = df.select("*", *[F.sum(c).over(inner).alias(f"_s_{n}") for n, c in sums.items()], *[F.last(c, ignorenulls=True).over(inner).alias(f"_l_{n}") for n, c in lasts.items()])
    place = F.struct(*order)
    tops = df.groupBy(*group).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()], *[F.max_by(c, F.when(c.isNotNull(), place)).alias(f"_t_{n}") for n, c in lasts.items()])
    ahead = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*group, *[F.sum(f"_t_{n}").over(ahead).alias(f"_c_{n}") for n in sums], *[F.last(f"_t_{n}", ignorenulls=True).over(ahead).alias(f"_c_{n}") for n in lasts])
    new = [(F.coalesce(f"_s_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in sums] + [F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in lasts]
    return x.join(carried, group).select(*df.columns, *new)

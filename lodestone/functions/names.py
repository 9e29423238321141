"""Normal forms of names, times and invisible text used as comparison keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A pattern that matches when at least one character is visible. Separators (Z), controls and format
# characters (C) and the four blank letters below print nothing.
VISIBLE = r"[^\p{Z}\p{C}⠀ㅤᅟᅠ]"


def norm_name(c: Column) -> Column:
    """Lower case, no white space at the ends, one space for each inner run; null stays null."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def has_visible_text(c: Column) -> Column:
    """True where the text prints something; null counts as invisible."""
    return F.coalesce(c.rlike(VISIBLE), F.lit(False))


def seconds(us: Column) -> Column:
    """Whole seconds of a microsecond count."""
    return F.floor(us / F.lit(1_000_000)).cast("bigint")

"""Joins of moments with the intervals that hold them, by equality.

An interval [start, end) of whole numbers is cut into dyadic cells, the largest blocks [i * 2**level, (i + 1) * 2**level)
that tile it: at most two of each level. A moment lies in one block of each level, so it meets an interval under exactly
one cell, and the join is one of (level, cell): it shuffles and splits like any other, and compares no pairs in vain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of blocks: whole numbers up to 2 ** 41 on either side of zero, seconds of over 60 000 years.
LEVELS = 42
FAR = 1 << 41


def dyadic_cells(start: Column, end: Column) -> Column:
    """array<struct<level, cell>> that tile [start, end); a null start or end is open, an empty interval has no cells."""
    a = F.greatest(F.coalesce(start.cast("bigint"), F.lit(-FAR)), F.lit(-FAR))
    b = F.least(F.coalesce(end.cast("bigint"), F.lit(FAR)), F.lit(FAR))
    right = lambda x, n: F.call_function("shiftright", x, n)

    def of(level: Column) -> Column:
        low, high = -right(-a, level), right(b, level)  # the blocks that lie within
        cell = lambda here, x: F.when(here & (low < high), F.struct(level.alias("level"), x.alias("cell")))
        return F.array(cell(low.bitwiseAND(F.lit(1)) == 1, low), cell(high.bitwiseAND(F.lit(1)) == 1, high - 1))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of)), lambda c: c.isNotNull())


def join_moments(intervals: DataFrame, start: Column, end: Column, moments: DataFrame, at: Column) -> DataFrame:
    """Each row of ``intervals`` with each row of ``moments`` that lies in its [start, end), given as whole numbers.

    Rows have the columns of both, which must differ. Moments spread to the levels that the intervals have, at most
    LEVELS, which are all that the driver sees.
    """
    cut = intervals.withColumn("__c", F.explode(dyadic_cells(start, end))).withColumns({"__level": F.col("__c.level"), "__cell": F.col("__c.cell")}).drop("__c")
    levels = sorted(r[0] for r in cut.select("__level").distinct().collect())
    spread = F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))
    there = moments.withColumn("__at", at.cast("bigint")).where("__at is not null").withColumn("__level", spread)
    there = there.withColumn("__cell", F.call_function("shiftright", F.col("__at"), F.col("__level"))).drop("__at")
    return cut.join(there, ["__level", "__cell"]).drop("__level", "__cell")

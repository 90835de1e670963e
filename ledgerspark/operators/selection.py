"""Exact values at given ranks of large groups, without sorting a group.

A group's rows are first counted by value (map-side combined), the values then by range.
Cumulative counts over the ranges, whose number does not depend on the rows, tell in which
range each wanted rank lies; only the values of those ranges are put in order. Ranges of one
group are spread over the tasks like any other key, so a hot group is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MANTISSA = 10              # bits of a value that its range keeps


def money_range(amount: Column) -> Column:
    """Ranges of cents that grow with the amount, in its order: as long as 2^-10 of it, so
    amounts up to 10 million make some 20 000 ranges of at most 1 000 000 cents."""
    cents = (F.abs(amount) * 100).cast("long")
    bits = F.greatest(F.lit(0), F.length(F.bin(cents)) - (MANTISSA + 1))
    step = F.pow(F.lit(2.0), bits).cast("long")
    key = F.shiftleft(bits.cast("long"), MANTISSA + 1) + F.floor(cents / step)
    return F.when(amount < 0, -key).otherwise(key)


def value_counts(rows: DataFrame, keys: list[str], value: str, range_of) -> DataFrame:
    """(keys, value, range, k) of the rows with a value."""
    return (rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("k"))
            .withColumn("range", range_of(F.col(value))))


def at_ranks(counts: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(keys, one column per rank): the values at the 0-based ``ranks``, given as columns
    of ``tot``, the group's number of rows. ``counts`` comes from :func:`value_counts`."""
    by_range = Window.partitionBy(*keys).orderBy("range")
    ranges = (counts.groupBy(*keys, "range").agg(F.sum("k").alias("kr"))
              .withColumn("before", F.sum("kr").over(by_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("kr"))
              .withColumn("tot", F.sum("kr").over(Window.partitionBy(*keys))))

    def holds(rank, start, k):
        return (F.col(start) <= rank) & (rank < F.col(start) + F.col(k))
    wanted = F.lit(False)
    for rank in ranks.values():
        wanted = wanted | holds(rank, "before", "kr")
    inside = Window.partitionBy(*keys, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = (counts.join(ranges.filter(wanted).drop("kr"), [*keys, "range"])
             .withColumn("start", F.col("before") + F.sum("k").over(inside) - F.col("k")))
    return found.groupBy(*keys).agg(*[F.max(F.when(holds(rank, "start", "k"), F.col(value))).alias(name)
                                      for name, rank in ranks.items()])

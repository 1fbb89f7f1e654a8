"""Global ranks without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.staging import stage


def lookup(values: list, index: Column, kind: str = "long") -> Column:
    """values[index] as a column; the list is a literal that is parsed once."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>"), (index + 1).cast("int"))


def count_below(ordered: Column, value: Column, most: int = 1 << 24) -> Column:
    """How many elements of a sorted array column, of at most so many, are below a value, by binary search."""
    steps = [1 << i for i in reversed(range(most.bit_length()))]
    return F.when(F.size(ordered) == 0, 0).otherwise(F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, s: F.when(F.get(ordered, n + s - 1) < value, n + s).otherwise(n)))


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with a gapless rank from 0. Rows are dealt by ranges of the order; each range is ranked by itself and starts
    after the rows of the ranges before it, of which only the counts go to the driver."""
    dealt = stage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = dict(dealt.groupBy("__part").count().collect())
    before, n = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(n)
        n += counts.get(p, 0)
    if not n:
        return dealt.withColumn(name, F.lit(0).cast("long")).drop("__part")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn(name, own - 1 + lookup(before, F.col("__part"))).drop("__part")

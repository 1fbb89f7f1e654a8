"""Order over a whole table without one task that sees all of it.

Rows are dealt by ranges of the order; each range is worked on by itself and starts after those before it, of which only
one number each goes to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.staging import stage


def before(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of a value over the rows before a row in the order."""
    dealt = stage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("__part").agg(*[F.sum(v).cast("double").alias(n) for n, v in values.items()]).collect()
    start: dict[str, dict[int, float]] = {n: {} for n in values}
    for name in values:
        total = 0.0
        for r in sorted(sums, key=lambda r: r["__part"]):
            start[name][r["__part"]] = total
            total += r[name] or 0.0
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    known = lambda n: F.element_at(F.from_json(F.lit(str({str(k): v for k, v in start[n].items()} or {"0": 0.0}).replace("'", '"')), "map<string,double>"), F.col("__part").cast("string"))
    return dealt.withColumns({n: F.coalesce(F.sum(v).over(own), F.lit(0)) + F.coalesce(known(n), F.lit(0.0)) for n, v in values.items()}).drop("__part")


def percent_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the share of the other rows whose value is smaller, from counts of distinct values."""
    n = df.groupBy(value).agg(F.count("*").alias("__c"))
    ranked = before(n, [F.col(value)], {"__below": F.col("__c")})
    total = n.agg(F.sum("__c").alias("__n"))
    share = F.when(F.col("__n") > 1, F.col("__below") / (F.col("__n") - 1)).otherwise(0.0)
    return df.join(ranked.crossJoin(F.broadcast(total)).select(F.col(value).alias("__v"), share.alias(name)), F.col(value).eqNullSafe(F.col("__v"))).drop("__v")


def with_total(df: DataFrame, value: str, name: str = "total") -> DataFrame:
    """df with the sum of a column over all rows, joined as one row."""
    return df.crossJoin(F.broadcast(df.agg(F.sum(value).alias(name))))

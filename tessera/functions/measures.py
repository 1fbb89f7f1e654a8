"""Measures of scores against labels, from counts of distinct scores: no row is compared with another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ranks import before

col = F.col


def separation(df: DataFrame, score: str, y: str) -> DataFrame:
    """(pairs, positives, auc, ap): the area under the ROC curve, ties counting half, and the step-wise average precision."""
    n = df.groupBy(F.col(score).alias("s")).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    ranked = before(n, [col("s").desc()], {"tp": col("pos"), "fp": col("neg")})
    total = n.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    auc = F.sum(col("neg") * (col("tp") + col("pos") / 2))
    ap = F.sum(col("pos") * (col("tp") + col("pos")) / (col("tp") + col("fp") + col("pos") + col("neg")))
    return ranked.crossJoin(F.broadcast(total)).groupBy("p", "n").agg(auc.alias("auc"), ap.alias("ap")).select((col("p") + col("n")).alias("pairs"), col("p").alias("positives"), F.try_divide("auc", col("p") * col("n")).alias("auc"), F.try_divide("ap", "p").alias("ap"))


def separation_sql(rows: str, score: str, y: str = "y") -> str:
    """The same in SQL: one row of pairs, positives, auc, ap."""
    return f"""(SELECT any_value(p) + any_value(n) AS pairs, any_value(p) AS positives, sum(neg * (tp + pos / 2)) / nullif(any_value(p) * any_value(n), 0) AS auc, sum(pos * (tp + pos) / (tp + fp + pos + neg)) / nullif(any_value(p), 0) AS ap FROM (
        SELECT pos, neg, coalesce(sum(pos) OVER w, 0) AS tp, coalesce(sum(neg) OVER w, 0) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM (SELECT {score} AS s, sum({y})::DOUBLE AS pos, sum(1 - {y})::DOUBLE AS neg FROM {rows} GROUP BY 1)
        WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


def confusion(df: DataFrame, predicted, y: str) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of a predicted condition."""
    yes, true = predicted, F.col(y) == 1
    c = df.agg(F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & true).alias("fn"))
    of = lambda b: F.coalesce(F.try_divide(col("tp").cast("double"), b), F.lit(0.0))
    return c.select("tp", "fp", "fn", of(col("tp") + col("fp")).alias("precision"), of(col("tp") + col("fn")).alias("recall"), F.coalesce(F.try_divide(2.0 * col("tp"), 2 * col("tp") + col("fp") + col("fn")), F.lit(0.0)).alias("f1"))


def adjusted_rand(df: DataFrame, truth: str, found: str) -> DataFrame:
    """(items, ari) from counts of (truth, cluster) cells."""
    two = lambda c: F.sum(col(c) * (col(c) - 1) / 2)
    cell = df.groupBy(truth, found).agg(F.count("*").alias("n"))
    both = cell.agg(F.sum("n").alias("items"), two("n").alias("both"))
    a = cell.groupBy(truth).agg(F.sum("n").alias("n")).agg(two("n").alias("a"))
    b = cell.groupBy(found).agg(F.sum("n").alias("n")).agg(two("n").alias("b"))
    x = both.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b)).withColumn("chance", F.try_divide(col("a") * col("b"), col("items") * (col("items") - 1) / 2))
    return x.select("items", F.coalesce(F.try_divide(col("both") - col("chance"), (col("a") + col("b")) / 2 - col("chance")), F.lit(1.0)).alias("ari"))

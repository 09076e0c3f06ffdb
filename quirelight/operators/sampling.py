"""Samples for checks by hand: a fixed number of each stratum, the same on every run, and what their verdicts say of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Standard errors of an interval of 95 percent.
Z = 1.96


def rank_key(identity: Column) -> Column:
    """The order in which rows are drawn: MD5 of what names them."""
    return F.md5(identity.cast("string"))


def stratified(rows: DataFrame, identity: str, stratum: Column, quota: Column) -> DataFrame:
    """rows with stratum, draw (from 1 in each stratum): the first quota of each by rank_key. Ranks are cut in each task before the shuffle.

    A null stratum is one of its own; a quota that is null or below 1 draws nothing.
    """
    order = Window.partitionBy("stratum").orderBy("__key", identity)
    ranked = rows.withColumn("stratum", stratum).withColumn("__key", rank_key(F.col(identity))).withColumn("draw", F.row_number().over(order))
    return ranked.where(F.col("draw") <= quota).drop("__key")


def shares(rows: DataFrame, stratum: Column, total: int) -> DataFrame:
    """stratum, n_rows, quota: total dealt to the strata in proportion, by largest remainders, at least one each (so the sum may be larger)."""
    counts = rows.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n_rows"))
    every = counts.agg(F.sum("n_rows").alias("n"))
    # strata are few
    fair = counts.crossJoin(F.broadcast(every)).withColumn("exact", F.col("n_rows") * total).withColumn("whole", F.expr("exact div n")).withColumn("rest", F.col("exact") % F.col("n"))
    left = fair.agg((F.lit(total) - F.sum("whole")).alias("left"))
    place = F.row_number().over(Window.orderBy(F.desc("rest"), F.asc_nulls_first("stratum")))
    dealt = fair.withColumn("place", place).crossJoin(F.broadcast(left))
    return dealt.select("stratum", "n_rows", F.least("n_rows", F.greatest(F.lit(1), F.col("whole") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0))).alias("quota"))


def success(checked: DataFrame, passed: Column) -> DataFrame:
    """stratum, n_checked, n_passed, rate, low, high: the share that passed in each stratum, with Wilson's interval."""
    rows = checked.groupBy("stratum").agg(F.count("*").alias("n_checked"), F.count_if(passed).alias("n_passed"))
    n, p, zz = F.col("n_checked").cast("double"), F.col("n_passed") / F.col("n_checked").cast("double"), Z * Z
    middle, reach = p + zz / 2 / n, F.sqrt(p * (1 - p) / n + zz / 4 / (n * n)) * Z
    return rows.select("stratum", "n_checked", "n_passed", p.alias("rate"), ((middle - reach) / (1 + zz / n)).alias("low"), ((middle + reach) / (1 + zz / n)).alias("high"))

"""Competition features: how a pair stands among the pairs of its s1 and of its pool record.

All are whole-group windows over (s1, pool, ...) rows; ties are broken by the other id, so results do not depend on
row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_gap(pairs: DataFrame, group: str, score: str) -> DataFrame:
    """Adds <group>_rank (equal scores share the smallest) and <group>_gap to the group's best."""
    w = W.partitionBy(group)
    return pairs.withColumn(f"{group}_rank", F.rank().over(w.orderBy(F.desc(score)))).withColumn(f"{group}_gap", F.max(score).over(w) - F.col(score))


def counts(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("n_pool", F.count("*").over(W.partitionBy("s1"))).withColumn("n_s1", F.count("*").over(W.partitionBy("pool")))


def s1_context(pairs: DataFrame, prob: str = "prob") -> DataFrame:
    """Rank, best, gap, sum, number over a half, and second best (0 without one) within the s1."""
    w = W.partitionBy("s1")
    out = pairs.withColumn("rn", F.row_number().over(w.orderBy(F.desc(prob), F.asc("pool"))))
    second = F.coalesce(F.max(F.when(F.col("rn") == 2, F.col(prob))).over(w), F.lit(0.0))
    return out.select("*", F.max(prob).over(w).alias("best"), (F.max(prob).over(w) - F.col(prob)).alias("gap"), F.sum(prob).over(w).alias("total"), F.count_if(F.col(prob) > 0.5).over(w).alias("n_half"), second.alias("second"))


def pool_context(pairs: DataFrame, prob: str = "prob", least: float = 0.001) -> DataFrame:
    """Competition for the pool record among pairs of at least `least`: how many, best other, margin, is_top."""
    w = W.partitionBy("pool")
    rows = pairs.where(F.col(prob) >= least).withColumn("rn", F.row_number().over(w.orderBy(F.desc(prob), F.asc("s1"))))
    best, second = F.max(prob).over(w), F.coalesce(F.max(F.when(F.col("rn") == 2, F.col(prob))).over(w), F.lit(0.0))
    other = F.when(F.col("rn") == 1, second).otherwise(best)
    return rows.select("*", F.count("*").over(w).alias("n_rivals"), other.alias("best_other"), (F.col(prob) - other).alias("margin"), (F.col(prob) >= best).cast("int").alias("is_top")).drop("rn")


def mutual_best(pairs: DataFrame, score: str) -> DataFrame:
    """Zero-based places on both sides and whether both are first."""
    a = F.row_number().over(W.partitionBy("s1").orderBy(F.desc(score), F.asc("pool"))) - 1
    b = F.row_number().over(W.partitionBy("pool").orderBy(F.desc(score), F.asc("s1"))) - 1
    return pairs.withColumn("place_s1", a).withColumn("place_pool", b).withColumn("mutual", ((F.col("place_s1") == 0) & (F.col("place_pool") == 0)).cast("int"))


def siblings(pairs: DataFrame, prob: str, confident: float, least: float) -> DataFrame:
    """For pairs of at least `least`: confident other pairs of the same s1 (number, largest probability), and whether
    the pool record is confidently another s1's. Sums and maxima over the group less the row itself, no self-join."""
    rows = pairs.where(F.col(prob) >= least)
    sure = F.col(prob) >= confident
    w, v = W.partitionBy("s1"), W.partitionBy("pool")
    ranked = rows.withColumn("rn", F.row_number().over(w.orderBy(F.desc(prob), F.asc("pool")))).withColumn("pn", F.row_number().over(v.orderBy(F.desc(prob), F.asc("s1"))))
    n = F.count_if(sure).over(w) - F.when(sure, 1).otherwise(0)
    top = F.when(F.col("rn") == 1, F.max(F.when((F.col("rn") == 2) & sure, F.col(prob))).over(w)).otherwise(F.max(F.when(sure, F.col(prob))).over(w))
    other = F.when(F.col("pn") == 1, F.max(F.when(F.col("pn") == 2, F.col(prob))).over(v)).otherwise(F.max(prob).over(v))
    return ranked.select(*pairs.columns, n.alias("n_sure"), F.coalesce(top, F.lit(0.0)).alias("sure_best"), (F.coalesce(other, F.lit(0.0)) >= confident).cast("int").alias("elsewhere"))

"""Splits, partitions and label-free vocabulary statistics."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold(key: Column, n: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % n


def stratified(rows: DataFrame, stratum: list[str], order: Column, names: tuple[str, ...] = ("fit", "dev", "lockbox"), shares: tuple[float, ...] = (0.7, 0.85)) -> DataFrame:
    """Adds split: each stratum is ordered and cut at shares of its size, halves rounded up: in decimals, as 0.7 * 45
    is less than 31.5 in doubles."""
    w = W.partitionBy(*stratum)
    place, size = F.row_number().over(w.orderBy(order)), F.count("*").over(w)
    first, second = (F.round(size.cast("decimal(19,0)") * F.lit(Decimal(str(x)))) for x in shares)
    split = F.when(place <= first, names[0]).when(place <= second, names[1]).otherwise(names[2])
    return rows.withColumn("split", split)


def assign(records: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds part: country|state where at least this share of a country's s1 records have a state, else country|*;
    pool records without usable address (or, there, without state) go to country|POOL."""
    has = F.col("state") != ""
    share = records.where("is_s1").groupBy("country").agg(F.avg(has.cast("double")).alias("share"))
    rows = records.join(F.broadcast(share), "country", "left").withColumn("by_state", F.coalesce(F.col("share") >= least, F.lit(False)))
    own = F.when(F.col("by_state") & has, F.concat_ws("|", "country", "state")).otherwise(F.concat(F.col("country"), F.lit("|*")))
    lost = ~F.col("is_s1") & (~F.col("addr_ok") | (F.col("by_state") & ~has))
    return rows.withColumn("part", F.when(lost, F.concat(F.col("country"), F.lit("|POOL"))).otherwise(own)).drop("share", "by_state")


def choose(sizes: DataFrame, frac: float, order: Column) -> DataFrame:
    """Whole partitions (part, n) in a fixed order until their sum reaches the share."""
    w = W.partitionBy().orderBy(order)
    before = F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("before", before).withColumn("total", F.sum("n").over(W.partitionBy())).where(F.col("before") < frac * F.col("total")).select("part", "n")


def fillers(docs: DataFrame, least: int, share: float, ratio: float) -> DataFrame:
    """(country, term, df1, df2): terms frequent in the pool and several times as frequent as in s1."""
    terms = docs.select("country", "is_s1", F.explode(F.array_distinct("toks")).alias("term")).groupBy("country", "term").agg(F.count_if("is_s1").alias("df1"), F.count_if(~F.col("is_s1")).alias("df2"))
    sizes = docs.groupBy("country").agg(F.count_if("is_s1").alias("n1"), F.count_if(~F.col("is_s1")).alias("n2"))
    rows = terms.join(F.broadcast(sizes), "country").where(F.col("df2") >= F.greatest(F.lit(float(least)), share * F.col("n2")))
    return rows.where((F.col("df2") / F.col("n2")) >= ratio * (F.col("df1") + 1) / F.col("n1")).select("country", "term", "df1", "df2")


def same_names(records: DataFrame) -> DataFrame:
    """Adds how many s1 and pool records have the same country and name."""
    n = records.groupBy("country", "name").agg(F.count_if("is_s1").alias("n_s1_same"), F.count_if(~F.col("is_s1")).alias("n_pool_same"))
    return records.join(n, ["country", "name"])


def cooccurring(pairs: DataFrame, least: int, share: float) -> DataFrame:
    """(x, y, n): for word lists a and b of matched records, each word x of a its best y of b, seen often enough."""
    words = pairs.select(F.array_distinct("a").alias("a"), F.array_distinct("b").alias("b"))
    both = words.select(F.explode("a").alias("x"), "b").select("x", F.explode("b").alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"))
    freq = words.select(F.explode("a").alias("x")).groupBy("x").agg(F.count("*").alias("fx"))
    best = both.withColumn("rn", F.row_number().over(W.partitionBy("x").orderBy(F.desc("n"), F.asc("y")))).where("rn = 1")
    return best.join(freq, "x").where((F.col("n") >= least) & (F.col("n") >= share * F.col("fx"))).select("x", "y", "n")

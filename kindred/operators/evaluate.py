"""Exact evaluation: F0.5 of every s1, reports, sweeps, errors, resampling, ranking quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def f05(tp: Column, gold: Column, pred: Column) -> Column:
    """1 if both sets are empty, 0 if only one is."""
    return F.when((gold == 0) & (pred == 0), 1.0).otherwise(1.25 * tp / (0.25 * gold + pred))


def per_s1(s1: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(s1 columns, n_gold, n_pred, tp, f05) for every s1: gold and pred hold (s1, pool)."""
    both = gold.select("s1", "pool", F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select("s1", "pool", F.lit(0).alias("g"), F.lit(1).alias("p")))
    pairs = both.groupBy("s1", "pool").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    sums = pairs.groupBy("s1").agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"), F.sum(F.col("g") * F.col("p")).alias("tp"))
    out = s1.join(sums, "s1", "left").na.fill(0, ["n_gold", "n_pred", "tp"])
    return out.withColumn("f05", f05(F.col("tp"), F.col("n_gold"), F.col("n_pred")))


def report(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Macro F0.5, pair precision and recall, F0.5 of s1 without and with several matches."""
    rows = scored.groupBy(by) if by else scored.groupBy()
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("f05"), 6).alias("macro_f05"), ratio(F.sum("tp"), F.sum("n_pred")).alias("precision"), ratio(F.sum("tp"), F.sum("n_gold")).alias("recall"), F.round(F.avg(F.when(F.col("n_gold") == 0, F.col("f05"))), 6).alias("f05_none"), F.round(F.avg(F.when(F.col("n_gold") > 1, F.col("f05"))), 6).alias("f05_many"))


def sweep(s1: DataFrame, gold: DataFrame, pairs: DataFrame, taus: list[float], by: list[str] | None = None) -> DataFrame:
    """(by.., tau, macro_f05): every threshold over the same pairs (s1, pool, prob, label) in one pass.

    A pair counts for every threshold up to its probability, so pairs are first summed by s1 and largest threshold
    they reach; thresholds then add up from above within an s1.
    """
    n = len(taus)
    grid = F.array(*[F.lit(t) for t in taus])
    reach = F.size(F.filter(grid, lambda t: t <= F.col("prob")))
    sums = pairs.withColumn("slot", reach).where("slot > 0").groupBy("s1", "slot").agg(F.count("*").alias("c"), F.sum("label").alias("h"))
    above = W.partitionBy("s1").orderBy(F.desc("slot"))
    steps = sums.select("s1", "slot", F.sum("c").over(above).alias("n_pred"), F.sum("h").over(above).alias("tp"), F.lag("slot").over(above).alias("higher"), F.lead("slot").over(above).alias("lower"))
    gold_n = gold.groupBy("s1").agg(F.count("*").alias("n_gold"))
    base = s1.join(gold_n, "s1", "left").na.fill(0, ["n_gold"])
    keys = by or []
    # a step holds for the thresholds from the next lower slot (exclusive) up to its own
    spans = steps.join(base, "s1").select(*keys, F.explode(F.sequence(F.coalesce("lower", F.lit(0)) + 1, F.col("slot"))).alias("slot"), (f05(F.col("tp"), F.col("n_gold"), F.col("n_pred")) - F.when(F.col("n_gold") == 0, 1.0).otherwise(0.0)).alias("gain"))
    gains = spans.groupBy(*keys, "slot").agg(F.sum("gain").alias("gain"))
    totals = base.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("n_gold") == 0).alias("empty"))
    slots = totals.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(n))))
    full = slots.join(gains, [*keys, "slot"], "left").na.fill(0.0, ["gain"])
    return full.select(*keys, F.element_at(grid, F.col("slot")).alias("tau"), F.round((F.col("empty") + F.col("gain")) / F.col("n"), 6).alias("macro_f05"))


def errors(scored: DataFrame, missed: DataFrame) -> DataFrame:
    """(cause, n, loss, share): lost F0.5 by cause; missed: (s1, n_missed) gold pairs that were never candidates."""
    fp, fn = F.col("n_pred") - F.col("tp"), F.col("n_gold") - F.col("tp")
    cause = F.when(F.col("n_gold") == 0, "fp_on_singleton").when(F.col("n_pred") == 0, "empty_pred_on_match").when((fp > 0) & (fn > 0), "fp_and_fn").when(fp > 0, "fp_only").otherwise("fn_only")
    rows = scored.join(missed, "s1", "left").na.fill(0, ["n_missed"]).withColumn("loss", 1 - F.col("f05")).where("loss > 0").withColumn("cause", cause).withColumn("fn", fn)
    out = rows.groupBy("cause").agg(F.count("*").alias("n"), F.sum("loss").alias("loss"), F.sum("n_missed").alias("fn_blocking"), F.sum(F.col("fn") - F.col("n_missed")).alias("fn_filter"))
    return out.select("cause", "n", F.round("loss", 6).alias("loss"), F.round(F.col("loss") / F.sum("loss").over(W.partitionBy()), 6).alias("share"), "fn_blocking", "fn_filter")


def recall(gold: DataFrame, candidates: DataFrame, ranks: list[int]) -> DataFrame:
    """(k, recall): share of gold pairs among the candidates of rank k at most."""
    hit = gold.join(candidates.select("s1", "pool", "rank"), ["s1", "pool"], "left")
    grid = F.explode(F.array(*[F.lit(k) for k in ranks])).alias("k")
    return hit.select(grid, "rank").groupBy("k").agg(F.round(F.avg(F.when(F.col("rank") <= F.col("k"), 1.0).otherwise(0.0)), 6).alias("recall"))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by rank sums over distinct probabilities (ties count half), summed in slots of a thousandth
    first, so that no task has to sort them all; and the log loss."""
    grouped = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"), F.sum(label).alias("pos")).withColumn("slot", F.floor(F.col("s") * 1024))
    before = lambda w: F.coalesce(F.sum("wrong").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    grouped = grouped.withColumn("wrong", F.col("n") - F.col("pos"))
    slots = grouped.groupBy("slot").agg(F.sum("wrong").alias("wrong"))  # a thousand rows for probabilities
    slots = slots.select("slot", before(W.partitionBy().orderBy("slot")).alias("lower"))
    below = F.col("lower") + before(W.partitionBy("slot").orderBy("s"))
    part = grouped.join(F.broadcast(slots), "slot").withColumn("won", F.col("pos") * (below + 0.5 * F.col("wrong")))
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("s")))
    loss = -(F.col("pos") * F.ln(p) + (F.col("n") - F.col("pos")) * F.ln(1 - p))
    return part.withColumn("loss", loss).agg(F.round(F.sum("won") / (F.sum("pos") * (F.sum("n") - F.sum("pos"))), 6).alias("auc"), F.round(F.sum("loss") / F.sum("n"), 6).alias("log_loss"))


def bootstrap(scored: DataFrame, rounds: int = 1000, seed: int = 7) -> DataFrame:
    """(low, high): 95 % interval of the macro F0.5 by Poisson resampling with hashed, repeatable weights."""
    u = F.pmod(F.xxhash64("s1", "round", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    weight = sum((F.when(u >= t, 1).otherwise(0) for t in (0.367879, 0.735759, 0.919699, 0.981012, 0.99634, 0.999406)), F.lit(0))
    draws = scored.select("s1", "f05", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("w", weight)
    means = draws.groupBy("round").agg((F.sum(F.col("w") * F.col("f05")) / F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def churn(a: DataFrame, b: DataFrame) -> DataFrame:
    """Between two sets of matches (s1, pool): changed s1, pairs added and removed."""
    both = a.select("s1", "pool", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select("s1", "pool", F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy("s1", "pool").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    each = both.groupBy("s1").agg(F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(0)).alias("added"), F.sum(F.when(F.col("a") > F.col("b"), 1).otherwise(0)).alias("removed"))
    return each.agg(F.count_if((F.col("added") > 0) | (F.col("removed") > 0)).alias("changed"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))

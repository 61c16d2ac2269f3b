"""Decisions: which candidate pairs are matches. Rows are (s1, pool, prob); ties go to smaller ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.functions.similarity import logit, sigmoid


def one_to_one(pairs: DataFrame, prob: str = "prob") -> DataFrame:
    """Each pool record stays with the s1 of its largest probability."""
    w = W.partitionBy("pool").orderBy(F.desc(prob), F.asc("s1"))
    return pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def threshold_ratio(pairs: DataFrame, t: float, r: float, prob: str = "prob") -> DataFrame:
    """prob >= t, and >= r times the s1's best."""
    best = F.max(prob).over(W.partitionBy("s1"))
    return pairs.withColumn("best", best).where((F.col(prob) >= t) & (F.col(prob) >= r * F.col("best"))).drop("best")


def expected_prefix(pairs: DataFrame, alpha: float, prob: str = "prob") -> DataFrame:
    """The prefix of an s1's pairs, by falling probability, of largest expected F0.5: nothing scores alpha times the
    chance that none matches, the first k 1.25 * sum(first k) / (0.25 * sum(all) + k). Equal scores keep the shorter."""
    w = W.partitionBy("s1")
    o = w.orderBy(F.desc(prob), F.asc("pool"))
    rows = pairs.withColumn("k", F.row_number().over(o)).withColumn("run", F.sum(prob).over(o.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("e", F.round(1.25 * F.col("run") / (0.25 * F.sum(prob).over(w) + F.col("k")), 9))
    none = F.sum(F.ln(F.greatest(1 - F.col(prob), F.lit(1e-300)))).over(w)
    rows = rows.withColumn("e0", F.round(alpha * F.exp(none), 9)).withColumn("best", F.max("e").over(w))
    stop = F.min(F.when(F.col("e") == F.col("best"), F.col("k"))).over(w)
    return rows.withColumn("stop", stop).where((F.col("best") > F.col("e0")) & (F.col("k") <= F.col("stop"))).drop("k", "run", "e", "e0", "best", "stop")


def exact_prefix_length(probs: Column, alpha: float, most: int = 15) -> Column:
    """Length of the prefix of largest exact expected F0.5 for probabilities in falling order: the numbers of hits in
    the prefix and in the rest are Poisson-binomial, built by folding the array."""
    p = F.slice(probs, 1, most)

    def spread(ps: Column) -> Column:
        def step(d: Column, x: Column) -> Column:
            padded, shifted = F.concat(d, F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), d)
            return F.zip_with(padded, shifted, lambda stay, hit: stay * (1 - x) + hit * x)

        return F.aggregate(ps, F.array(F.lit(1.0)), step)

    def value(k: Column) -> Column:
        hits, rest = spread(F.slice(p, F.lit(1), k)), spread(F.slice(p, k + 1, F.greatest(F.size(p) - k, F.lit(0))))
        each = F.transform(hits, lambda ph, a: ph * F.aggregate(F.transform(rest, lambda pr, b: pr * F.when(a > 0, 1.25 * a / (0.25 * (a + b) + k)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x))
        return F.round(F.aggregate(each, F.lit(0.0), lambda s, x: s + x), 12)

    nothing = F.round(alpha * F.aggregate(p, F.lit(1.0), lambda s, x: s * (1 - x)), 12)
    scores = F.concat(F.array(nothing), F.transform(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1))), value))
    return F.when(F.size(p) == 0, 0).otherwise((F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def expected_keep(pairs: DataFrame, gamma: float, lam: float, miss: float, least: float = 0.01, most: int = 40, prob: str = "prob") -> DataFrame:
    """One-to-one pairs of an s1, sharpened to q = prob ** gamma: the k best of largest
    1.25 * sum(q_i / (0.25 * (1 + Q - q_i + miss) + k)), nothing if its own score plus lam is as large."""
    kept = one_to_one(pairs, prob).where(F.col(prob) >= least).withColumn("q", F.pow(F.col(prob), F.lit(gamma)))
    w = W.partitionBy("s1")
    rows = kept.withColumn("k", F.row_number().over(w.orderBy(F.desc("q"), F.asc("pool")))).withColumn("all", F.sum("q").over(w)).withColumn("e0", F.exp(F.sum(F.ln(1 - F.least(F.col("q"), F.lit(1 - 1e-7)))).over(w)))
    lists = rows.groupBy("s1").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", "q")))), lambda x: x["q"]).alias("qs"), F.max("all").alias("all"), F.max("e0").alias("e0"))

    def value(k: Column) -> Column:
        part = F.transform(F.slice("qs", F.lit(1), k), lambda q: q / (0.25 * (1 + F.col("all") - q + miss) + k))
        return F.round(1.25 * F.aggregate(part, F.lit(0.0), lambda s, x: s + x), 9)

    scored = lists.withColumn("es", F.transform(F.sequence(F.lit(1), F.size("qs")), value))
    best = F.array_max("es")
    stop = scored.select("s1", F.when(F.round(F.col("e0") + lam, 9) >= best, 0).otherwise(F.array_position("es", best)).cast("int").alias("stop"))
    return rows.join(stop, "s1").where(F.col("k") <= F.col("stop")).select("s1", "pool", prob)


def by_country(pairs: DataFrame, taus: dict[str, float], prob: str = "prob") -> DataFrame:
    """One-to-one pairs over their country's threshold; a country without one keeps all."""
    table = F.create_map(*[F.lit(x) for kv in taus.items() for x in kv])
    return one_to_one(pairs, prob).where(F.col(prob) >= F.coalesce(F.element_at(table, F.col("country")), F.lit(0.0)))


def shifted(p: Column, by: Column) -> Column:
    return sigmoid(logit(p) + by)


def blend(scores: list[Column]) -> Column:
    """Mean of logits, back as a probability."""
    total = sum((logit(s) for s in scores[1:]), logit(scores[0]))
    return sigmoid(total / len(scores))


def contested(a: Column, b: Column, low: float = 0.02, high: float = 0.98) -> Column:
    return sigmoid(0.5 * logit(a) + 0.5 * logit(b)).between(low, high)


def pseudo_labels(pairs: DataFrame, scores: list[str], sure: float, decoy: float, easy: float) -> DataFrame:
    """kind: positive (all scores >= sure), decoy (the pool record is another s1's positive, some score >= decoy), easy
    (all <= easy and no such owner); other pairs are left out."""
    rows = pairs.withColumn("lo", F.least(*scores)).withColumn("hi", F.greatest(*scores))
    owner = rows.where(F.col("lo") >= sure).groupBy("pool").agg(F.min("s1").alias("owner"))
    rows = rows.join(owner, "pool", "left")
    other = F.coalesce(F.col("owner") != F.col("s1"), F.lit(False))
    kind = F.when(F.col("lo") >= sure, "positive").when(other & (F.col("hi") >= decoy), "decoy").when(~other & (F.col("hi") <= easy), "easy")
    return rows.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("s1", "pool", "kind")


def union_merge(base: DataFrame, candidates: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs of another matcher that were never candidates and whose pool record is free; one s1 a pool record."""
    used = base.select("pool").distinct()
    new = other.join(candidates.select("s1", "pool"), ["s1", "pool"], "left_anti").join(used, "pool", "left_anti")
    return new.groupBy("pool").agg(F.min("s1").alias("s1")).select("s1", "pool")


def rescue_merge(base: DataFrame, candidates: DataFrame, other: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs of another matcher that were candidates, not chosen, whose pool record is free and prob >= least."""
    new = other.select("s1", "pool").join(candidates.where(F.col("prob") >= least).select("s1", "pool"), ["s1", "pool"], "left_semi").join(base.select("pool").distinct(), "pool", "left_anti")
    return new.groupBy("pool").agg(F.min("s1").alias("s1")).select("s1", "pool")


def override(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Scores of base, replaced where changes has the pair, and the pairs that only changes has."""
    both = base.select("s1", "pool", F.col("prob").alias("a")).join(changes.select("s1", "pool", F.col("prob").alias("b")), ["s1", "pool"], "full_outer")
    return both.select("s1", "pool", F.coalesce("b", "a").alias("prob"), F.col("a").isNull().alias("is_new"))


def first_of(tables: list[DataFrame]) -> DataFrame:
    """Score tables in order of priority: the first that has a pair gives its score."""
    rows = None
    for i, t in enumerate(tables):
        one = t.select("s1", "pool", F.lit(i).alias("order"), "prob")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("s1", "pool").agg(F.min_by("prob", "order").alias("prob"))

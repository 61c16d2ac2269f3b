"""Tables about data and decisions: grids, histograms, ceilings, changes of words, quality of words and parsers,
samples by a repeatable hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.functions.similarity import jaccard
from kindred.operators.evaluate import f05, per_s1


def hashed(key: Column, seed: int = 42) -> Column:
    """A repeatable uniform number of a key, 0 to 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("double") / 2**32


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by the order of their key's hash; the same rows whatever the partitions."""
    return rows.withColumn("_u", hashed(F.col(key), seed)).orderBy("_u", key).limit(n).drop("_u")


def thinned(rows: DataFrame, kind: str, shares: dict[str, float], key: Column, seed: int = 42) -> DataFrame:
    """Of each kind the share of rows whose hash falls under it; kinds without a share stay whole."""
    share = reduce(lambda c, k: c.when(F.col(kind) == k[0], F.lit(k[1])), shares.items(), F.when(F.lit(False), F.lit(1.0))).otherwise(F.lit(1.0))
    return rows.where(hashed(key, seed) < share)


def capped(rows: DataFrame, kind: str, caps: dict[str, int], key: Column, seed: int = 42) -> DataFrame:
    """At most so many rows of each kind, by the order of their key's hash; kinds without a cap stay whole."""
    drawn = rows.withColumn("_u", hashed(key, seed))
    parts = [drawn.where(F.col(kind) == k).orderBy("_u").limit(n) for k, n in caps.items()] + [drawn.where(~F.col(kind).isin(*caps))]
    return reduce(DataFrame.unionByName, parts).drop("_u")


def decision_grid(s1: DataFrame, gold: DataFrame, pairs: DataFrame, taus: list[float], ratios: list[float], by: list[str] | None = None) -> DataFrame:
    """(by.., tau, ratio, macro_f05) for every threshold and every share of an s1's best: each s1's pairs (s1, pool,
    prob, label) are gathered once and all settings read from the list. Numbers of pairs only depend on the larger of
    the two bounds, so an s1 gives one row a setting, summed before the shuffle."""
    lists = pairs.groupBy("s1").agg(F.collect_list(F.struct("prob", "label")).alias("ps"), F.max("prob").alias("best"))
    base = s1.join(gold.groupBy("s1").agg(F.count("*").alias("n_gold")), "s1", "left").join(lists, "s1", "left").na.fill(0, ["n_gold"])
    grid = F.array(*[F.struct(F.lit(t).alias("tau"), F.lit(r).alias("ratio")) for t in taus for r in ratios])
    rows = base.select(*(by or []), "n_gold", "ps", "best", F.explode(grid).alias("g"))
    kept = F.filter(F.coalesce("ps", F.array().cast("array<struct<prob: double, label: int>>")), lambda x: (x["prob"] >= F.col("g.tau")) & (x["prob"] >= F.col("g.ratio") * F.col("best")))
    rows = rows.withColumn("kept", kept).withColumn("tp", F.size(F.filter("kept", lambda x: x["label"] == 1)))
    return rows.groupBy(*(by or []), F.col("g.tau").alias("tau"), F.col("g.ratio").alias("ratio")).agg(F.round(F.avg(f05(F.col("tp"), F.col("n_gold"), F.size("kept"))), 6).alias("macro_f05"))


def cross_fit(grid: DataFrame) -> DataFrame:
    """Each half's best setting and its score on the other half; grid: (half, tau, ratio, macro_f05)."""
    order = W.partitionBy("half").orderBy(F.desc("macro_f05"), "tau", "ratio")
    best = grid.withColumn("_n", F.row_number().over(order)).where("_n = 1").select((1 - F.col("half")).alias("half"), "tau", "ratio", F.col("macro_f05").alias("fitted"))
    return best.join(grid, ["half", "tau", "ratio"]).select("half", "tau", "ratio", "fitted", F.col("macro_f05").alias("held_out"))


def in_bins(value: Column, edges: list[float]) -> Column:
    """The number of the bin, closed on the right, that a value falls in: from 1, or null outside."""
    return reduce(lambda c, i: c.when((value > edges[i]) & (value <= edges[i + 1]), i + 1), range(1, len(edges) - 1), F.when((value > edges[0]) & (value <= edges[1]), 1))


def error_histogram(pairs: DataFrame, chosen: DataFrame, edges: list[float]) -> DataFrame:
    """(kind, bin, n): probabilities of gold pairs not chosen and of chosen ones that are not gold."""
    rows = pairs.join(chosen.select("s1", "pool", F.lit(1).alias("_c")), ["s1", "pool"], "left")
    kind = F.when((F.col("label") == 1) & F.col("_c").isNull(), "missed").when((F.col("label") == 0) & F.col("_c").isNotNull(), "wrong")
    return rows.select(kind.alias("kind"), in_bins(F.col("prob"), edges).alias("bin")).where("kind is not null").groupBy("kind", "bin").agg(F.count("*").alias("n"))


def ceilings(s1: DataFrame, gold: DataFrame, base: DataFrame, subsets: dict[str, DataFrame]) -> DataFrame:
    """(subset, n, macro_f05, gain): what the decisions would score if the gold pairs of a subset were added."""
    plain = per_s1(s1, gold, base).select(F.col("f05").alias("b"), F.lit(None).cast("double").alias("m"), F.lit(0).alias("one"))
    out = []
    for name, pairs in subsets.items():
        more = pairs.select("s1", "pool").join(gold, ["s1", "pool"], "left_semi")
        scored = per_s1(s1, gold, base.select("s1", "pool").unionByName(more).distinct()).select(F.lit(None).cast("double").alias("b"), F.col("f05").alias("m"), F.lit(0).alias("one"))
        count = more.select(F.lit(None).cast("double").alias("b"), F.lit(None).cast("double").alias("m"), F.lit(1).alias("one"))
        row = plain.unionByName(scored).unionByName(count)
        out.append(row.agg(F.lit(name).alias("subset"), F.sum("one").alias("n"), F.round(F.avg("m"), 6).alias("macro_f05"), F.round(F.avg("m") - F.avg("b"), 6).alias("gain")))
    return reduce(DataFrame.unionByName, out)


def added_stats(s1: DataFrame, gold: DataFrame, added: DataFrame) -> DataFrame:
    """(country, n, tp, fp_single): pairs added in a country, right ones, and wrong ones of an s1 without gold."""
    rows = added.select("s1", "pool").join(gold.select("s1", "pool", F.lit(1).alias("hit")), ["s1", "pool"], "left").join(gold.select("s1").distinct().withColumn("some", F.lit(1)), "s1", "left").join(s1, "s1")
    return rows.groupBy("country").agg(F.count("*").alias("n"), F.count("hit").alias("tp"), F.count_if(F.col("hit").isNull() & F.col("some").isNull()).alias("fp_single"))


def token_changes(pairs: DataFrame, a: str = "a_toks", b: str = "b_toks") -> DataFrame:
    """(kind, old, new, n): words that true pairs swap (one on each side), add or lose."""
    left, right = F.array_except(a, b), F.array_except(b, a)
    swap = pairs.where((F.size(left) == 1) & (F.size(right) == 1)).select(F.lit("swapped").alias("kind"), F.get(left, F.lit(0)).alias("old"), F.get(right, F.lit(0)).alias("new"))
    added = pairs.where(F.size(left) == 0).select(F.lit("added").alias("kind"), F.lit("").alias("old"), F.explode(right).alias("new"))
    lost = pairs.where(F.size(right) == 0).select(F.lit("lost").alias("kind"), F.explode(left).alias("old"), F.lit("").alias("new"))
    return swap.unionByName(added).unionByName(lost).groupBy("kind", "old", "new").agg(F.count("*").alias("n"))


def word_quality(terms: DataFrame, edges: list[int]) -> DataFrame:
    """(class, words, mentions) of (term, df): words by how many records have them."""
    kind = reduce(lambda c, e: c.when(F.col("df") < e, f"under {e}"), edges[1:], F.when(F.col("df") < edges[0], f"under {edges[0]}")).otherwise(f"{edges[-1]} or more")
    return terms.groupBy(kind.alias("class")).agg(F.count("*").alias("words"), F.sum("df").alias("mentions"))


def candidate_quantiles(pairs: DataFrame, by: str) -> DataFrame:
    """(by, s1, median, p90, most): how many candidates an s1 has."""
    n = pairs.groupBy(by, "s1").agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.count("*").alias("records"), F.percentile("n", 0.5).alias("median"), F.percentile("n", 0.9).alias("p90"), F.max("n").alias("most"))


def crosstab(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of a column's values (n_<value>) by another's."""
    return rows.groupBy(row).agg(F.count("*").alias("n"), *[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def same_code(s1: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(s1, pool, score, rank): of the pool records with an s1's code the k of most alike words; (id, code, toks)."""
    a, b = (t.select(F.col("id").alias(key), "code", F.col("toks").alias(f"_{key}")) for t, key in ((s1, "s1"), (pool, "pool")))
    rows = a.where("code is not null").join(b, "code").withColumn("score", F.round(jaccard(F.col("_s1"), F.col("_pool")), 9))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("s1").orderBy(F.desc("score"), "pool"))).where(F.col("rank") <= k).select("s1", "pool", "score", "rank")


def parser_quality(p: DataFrame, by: str = "a_country") -> DataFrame:
    """By country of true pairs (a_*, b_*): shares without an address, of words and of raw text in common, of numbers
    on both sides, in common, equal at first."""
    both = (F.size("a_nums") > 0) & (F.size("b_nums") > 0)
    words = F.when((F.size("a_words") > 0) & (F.size("b_words") > 0), jaccard(F.col("a_words"), F.col("b_words")))
    share = lambda c, given=None: F.round(F.avg(F.when(F.lit(True) if given is None else given, c.cast("double"))), 6)
    return p.groupBy(F.col(by).alias("country")).agg(
        F.count("*").alias("n"), share(~F.col("b_has_addr")).alias("no_addr"), F.round(F.avg(words), 6).alias("word_jacc"), share(both).alias("num_both"),
        share(F.arrays_overlap("a_nums", "b_nums"), both).alias("num_share"), share(F.get("a_nums", F.lit(0)) == F.get("b_nums", F.lit(0)), both).alias("num_first"),
    )


def compared(p: DataFrame, versions: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(version, same_set, jaccard, some, none) of true pairs: how far each way to normalise brings them together."""
    out = []
    for name, (a, b) in versions.items():
        j = jaccard(a, b)
        rows = p.select(j.alias("j"))
        out.append(rows.agg(F.lit(name).alias("version"), F.round(F.avg((F.col("j") == 1).cast("double")), 6).alias("same_set"), F.round(F.avg("j"), 6).alias("jaccard"), F.round(F.avg((F.col("j") > 0).cast("double")), 6).alias("some"), F.round(F.avg((F.col("j") == 0).cast("double")), 6).alias("none")))
    return reduce(DataFrame.unionByName, out)


def key_recovery(p: DataFrame, by: str = "a_country") -> DataFrame:
    """By country of true pairs: which kinds of key would bring them together: a shared word, equal glued names, their
    first six letters, a third of their letter triples, any of these."""
    from kindred.operators.pairs import glue

    grams = lambda g: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(g) - 2, F.lit(1))), lambda i: F.substring(g, i, F.lit(3))))
    a, b = glue("a_toks"), glue("b_toks")
    kinds = {"shared": F.arrays_overlap("a_toks", "b_toks"), "glued": a == b, "head": F.substring(a, 1, 6) == F.substring(b, 1, 6), "triples": jaccard(grams(a), grams(b)) >= 0.3}
    kinds["any"] = reduce(lambda x, y: x | y, kinds.values())
    return p.groupBy(F.col(by).alias("country")).agg(F.count("*").alias("n"), *[F.round(F.avg(c.cast("double")), 6).alias(k) for k, c in kinds.items()])


def universe(records: DataFrame, prefilter: str, states: dict[str, list[str]]) -> DataFrame:
    """Records (id, is_s1, country, state, address, has_addr) of chosen states, with the split each state belongs to;
    those without an address stay, in every split's country. A text pattern goes before the parsed state."""
    split = reduce(lambda c, k: c.when(F.col("state").isin(*k[1]), k[0]), list(states.items())[1:], F.when(F.col("state").isin(*next(iter(states.values()))), next(iter(states))))
    there = records.where(F.col("has_addr") & F.col("address").rlike(prefilter)).withColumn("split", split).where("split is not null")
    return there.unionByName(records.where(~F.col("has_addr")).withColumn("split", F.lit("any")))


def compose(results: DataFrame, other: DataFrame, countries: list[str]) -> DataFrame:
    """Decisions (s1, pool, country), those of some countries taken from another result."""
    return results.where(~F.col("country").isin(*countries)).unionByName(other.where(F.col("country").isin(*countries)))


def looked_up(pairs: DataFrame, scores: DataFrame, covered: DataFrame, missing: float = 1e-4) -> DataFrame:
    """Pairs of covered s1 records with another matcher's score; a pair that it does not have scores `missing`."""
    return pairs.join(covered.select("s1").distinct(), "s1", "left_semi").join(scores.select("s1", "pool", F.col("prob").alias("_p")), ["s1", "pool"], "left").select("s1", "pool", F.coalesce("_p", F.lit(missing)).alias("prob"))


def accepted(scored: dict[str, DataFrame], least: float = 0.0005) -> DataFrame:
    """(stage1, stage2, gain, keep) of two score tables' results (s1, f05): the second stands if it gains enough."""
    a, b = (F.avg(F.when(F.col("_k") == i, F.col("f05"))) for i in range(2))
    rows = reduce(DataFrame.unionByName, [d.select("f05", F.lit(i).alias("_k")) for i, d in enumerate(scored.values())])
    return rows.agg(F.round(a, 6).alias("stage1"), F.round(b, 6).alias("stage2"), F.round(b - a, 6).alias("gain"), (b - a > least).alias("keep"))


def comparison(s1: DataFrame, gold: DataFrame, chosen: DataFrame) -> DataFrame:
    """(s1, truth, chosen): both id lists of every s1, comma-joined."""
    lists = lambda d, name: d.groupBy("s1").agg(F.array_join(F.transform(F.sort_array(F.collect_set("pool")), lambda x: x.cast("string")), ",").alias(name))
    return s1.select("s1").join(lists(gold, "truth"), "s1", "left").join(lists(chosen, "chosen"), "s1", "left").na.fill("", ["truth", "chosen"])


def error_sample(gold: DataFrame, chosen: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(kind, s1, pool, s1_text, pool_text): n wrong and n missed pairs, by hash, with their texts (id, text)."""
    kinds = {"wrong": chosen.join(gold, ["s1", "pool"], "left_anti"), "missed": gold.join(chosen, ["s1", "pool"], "left_anti")}
    rows = reduce(DataFrame.unionByName, [sampled(d.select("s1", "pool", F.concat_ws("-", "s1", "pool").alias("_k")), "_k", n).select(F.lit(k).alias("kind"), "s1", "pool") for k, d in kinds.items()])
    side = lambda key: texts.select(F.col("id").alias(key), F.col("text").alias(f"{key}_text"))
    return rows.join(side("s1"), "s1", "left").join(side("pool"), "pool", "left").select("kind", "s1", "pool", "s1_text", "pool_text")


def field_profile(records: DataFrame, checks: dict[str, tuple[str, str]], by: list[str]) -> DataFrame:
    """Percentages of records whose field a check's pattern finds, names in capitals, and median numbers of words."""
    share = lambda c: F.round(100 * F.avg(c.cast("double")), 1)
    words = lambda c: F.percentile(F.size(F.filter(F.split(c, " "), lambda w: w != "")), 0.5)
    upper = (F.col("name") == F.upper("name")) & F.col("name").rlike("[A-Za-z]")
    return records.groupBy(*by).agg(F.count("*").alias("n"), *[share(F.col(c).rlike(p)).alias(k) for k, (c, p) in checks.items()], share(upper).alias("name_all_upper"), words("name").alias("name_words"), words("addr").alias("addr_words"))


def matches_histogram(s1: DataFrame, gold: DataFrame) -> DataFrame:
    """(matches, n): how many s1 records have so many matches."""
    n = s1.select("s1").join(gold.groupBy("s1").agg(F.count("*").alias("n")), "s1", "left")
    return n.groupBy(F.coalesce("n", F.lit(0)).alias("matches")).agg(F.count("*").alias("n"))


def gold_facts(gold: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Of gold pairs: how many, pool records under several s1, and the share within one country; (s1 or pool, country)."""
    owners = gold.groupBy("pool").agg(F.countDistinct("s1").alias("owners"))
    rows = gold.join(owners, "pool").join(s1.select("s1", F.col("country").alias("_a")), "s1").join(pool.select("pool", F.col("country").alias("_b")), "pool")
    return rows.agg(F.count("*").alias("pairs"), F.countDistinct(F.when(F.col("owners") > 1, F.col("pool"))).alias("shared_pool"), F.round(F.avg((F.col("_a") == F.col("_b")).cast("double")), 6).alias("same_country"))

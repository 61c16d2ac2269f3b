"""Candidate generation: capped equality keys, rare-token cosine top-k, exact nearest neighbours, unions of passes.

Country is a hard block and stands in every join key; records of a country without pool rows search the whole pool
(searched). Every cap is the operator's own rule (a term or key that too
many records share says nothing about identity), applied by frequency before the join, which bounds its output.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.operators.vectors import nearest, top_k


def term_counts(docs: DataFrame) -> DataFrame:
    """(country, term, df) over records (id, country, toks), each term once a record."""
    return docs.select("country", F.explode(F.array_distinct("toks")).alias("term")).groupBy("country", "term").agg(F.count("*").alias("df"))


def idf_postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, country, term, w): L2-normalised idf weights of a record's kept terms; terms: (country, term, idf)."""
    rows = docs.select("id", "country", F.explode(F.array_distinct("toks")).alias("term")).join(terms, ["country", "term"])
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(W.partitionBy("country", "id"))) + 1e-6
    return rows.select("id", "country", "term", (F.col("idf") / norm).alias("w"))


def rare_terms(pool: DataFrame, max_df: int) -> DataFrame:
    """(country, term, idf) of pool terms in at most max_df records: idf = ln(1 + N / df)."""
    size = pool.groupBy("country").agg(F.count("*").alias("n"))
    return term_counts(pool).where(F.col("df") <= max_df).join(F.broadcast(size), "country").select("country", "term", F.log1p(F.col("n") / F.col("df")).alias("idf"))


#: The block of s1 records whose country has no pool row; no country has this name.
WHOLE_POOL = "\0whole pool"


def searched(s1: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with s1 records of a country that has no pool row moved to a block of the whole pool, which exists
    only if there are any. A null country has no rows of its own."""
    here = pool.where("country is not null").select(F.col("country").alias("_here")).distinct()
    asked = s1.select(F.col("country").alias("_asked")).distinct()
    lost = [r[0] for r in asked.join(here, F.col("_asked") == F.col("_here"), "left_anti").collect()]  # countries
    if not lost:
        return s1, pool
    away = F.col("country").isNull() | F.col("country").isin(*[c for c in lost if c is not None])
    return s1.withColumn("country", F.when(away, F.lit(WHOLE_POOL)).otherwise(F.col("country"))), pool.unionByName(pool.withColumn("country", F.lit(WHOLE_POOL)))


def token_top_k(s1: DataFrame, pool: DataFrame, k: int, max_df: int) -> DataFrame:
    """(s1, pool, score, rank): the k most similar pool records by cosine over rare terms; ties to smaller ids."""
    s1, pool = searched(s1, pool)
    terms = rare_terms(pool, max_df)
    return nearest(_vectors(s1, terms), _vectors(pool, terms), k, 0.0)


def _vectors(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """One row a record that has a kept term: id, part (its country), terms with their weights, as idf_postings."""
    rows = docs.select("id", "country", F.explode(F.array_distinct("toks")).alias("term")).join(terms, ["country", "term"])
    each = rows.groupBy("id", F.col("country").alias("part")).agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("t"), (F.sqrt(F.sum(F.col("idf") * F.col("idf"))) + 1e-6).alias("norm"))
    return each.select("id", "part", F.transform("t", lambda x: F.struct(x["term"].alias("term"), (x["idf"] / F.col("norm")).alias("w"))).alias("terms"))


def exact_nearest(queries: DataFrame, pool: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(s1, pool, score, rank) by inner product within a country: (id, country, v array<double>).

    Pool records are dealt into blocks of about `block` within their country, queries into lots as large, and each
    lot meets each block; a task multiplies matrices and gives k rows a query and block, so pairs are never emitted.
    """
    queries, pool = searched(queries, pool)
    size = pool.groupBy("country").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    size = size.join(queries.groupBy("country").agg(F.ceil(F.count("*") / block).cast("int").alias("lots")), "country")
    parts = pool.join(F.broadcast(size), "country").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    parts = parts.withColumn("block", F.pmod(F.xxhash64("id"), "blocks") * F.col("lots") + F.col("lot"))
    asks = queries.join(F.broadcast(size), "country").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asks = asks.withColumn("block", F.col("block") * F.col("lots") + F.pmod(F.xxhash64("id"), "lots"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"s1": [], "pool": [], "score": []})
        x, ids = np.stack(right["v"].to_list()), right["id"].to_numpy()
        out: list[pd.DataFrame] = []
        for i in range(0, len(left), 512):
            part = left.iloc[i : i + 512]
            s = np.round(np.stack(part["q_v"].to_list()) @ x.T, 9)
            for q, row in zip(part["q_id"], s, strict=True):
                best = np.lexsort((ids, -row))[:k]
                out.append(pd.DataFrame({"s1": q, "pool": ids[best], "score": row[best]}))
        return pd.concat(out)

    asks = asks.select(*[F.col(c).alias(f"q_{c}") for c in ("country", "block", "id", "v")])
    left = asks.groupBy("q_country", "q_block")
    hits = left.cogroup(parts.select("country", "block", "id", "v").groupBy("country", "block")).applyInPandas(search, "s1 long, pool long, score double")
    return top_k(hits, "s1", [F.desc("score"), F.asc("pool")], k)


def union_passes(passes: dict[str, DataFrame], cap: int, missing_rank: int = 999) -> DataFrame:
    """Passes (s1, pool, score, rank) side by side: <pass>_score (0 if missing), <pass>_rank (999), best_rank; the
    cap best of each s1 by best_rank, ties to smaller pool ids."""
    rows = None
    for name, df in passes.items():
        one = df.select("s1", "pool", F.lit(name).alias("pass"), F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"))
        rows = one if rows is None else rows.unionByName(one)
    aggs = []
    for name in passes:
        here = F.col("pass") == name
        aggs += [F.coalesce(F.max(F.when(here, F.col("score"))), F.lit(0.0)).alias(f"{name}_score"), F.coalesce(F.min(F.when(here, F.col("rank"))), F.lit(missing_rank)).alias(f"{name}_rank")]
    wide = rows.groupBy("s1", "pool").agg(*aggs, F.min("rank").alias("best_rank"))
    return top_k(wide, "s1", [F.asc("best_rank"), F.asc("pool")], cap).drop("rank")


def key_pairs(keys: DataFrame, cap: int) -> DataFrame:
    """(s1, pool, bits) of records that share a key: keys (id, is_s1, part, family int, key). A key of over cap pool
    records is no key. bits has a bit for each family."""
    rows = keys.distinct()
    sizes = rows.groupBy("part", "family", "key").agg(F.count_if(~F.col("is_s1")).alias("n"), F.count_if("is_s1").alias("m"))
    good = sizes.where(F.col("n").between(1, cap) & (F.col("m") > 0)).select("part", "family", "key")
    kept = rows.join(good.hint("merge"), ["part", "family", "key"], "left_semi")  # keys grow with the records: not for a broadcast
    a = kept.where("is_s1").select("part", "family", "key", F.col("id").alias("s1"))
    b = kept.where(~F.col("is_s1")).select("part", "family", "key", F.col("id").alias("pool"))
    return a.join(b.hint("merge"), ["part", "family", "key"]).groupBy("s1", "pool").agg(F.expr("bit_or(shiftleft(1, family))").alias("bits"))


def word_pairs(words: Column) -> Column:
    """All unordered pairs of the words, sorted, as 'a b'."""
    w = F.array_sort(F.array_distinct(words))
    return F.flatten(F.transform(w, lambda a, i: F.transform(F.slice(w, i + 2, F.greatest(F.size(w) - i - 1, F.lit(0))), lambda b: F.concat_ws(" ", a, b))))


def rarest(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(id, rare): each record's k terms of least df, ties by the term; terms: (country, term, df)."""
    rows = docs.select("id", "country", F.explode(F.array_distinct("toks")).alias("term")).join(terms, ["country", "term"])
    first = top_k(rows, "id", [F.asc("df"), F.asc("term")], k)
    return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "term"))), lambda x: x["term"]).alias("rare"))


def expand(seeds: DataFrame, keys: DataFrame, candidates: DataFrame, cap: int, most: int) -> DataFrame:
    """(s1, pool, via_kind) of pool records that share a key with a seed record of the s1 and are no candidates yet.

    seeds: (s1, seed, via: 0 for the s1 itself, 1 for a sure match of it), keys: (id, is_s1, kind, key); keys of over
    cap pool records are none; at most `most` a s1, address keys first, then smaller via, then smaller ids.
    """
    pool = keys.where(~F.col("is_s1")).select("kind", "key", F.col("id").alias("pool")).distinct()
    good = pool.groupBy("kind", "key").count().where(F.col("count") <= cap).select("kind", "key")
    pool = pool.join(good, ["kind", "key"], "left_semi")
    found = seeds.join(keys.select(F.col("id").alias("seed"), "kind", "key").distinct(), "seed").join(pool, ["kind", "key"])
    fresh = found.where(F.col("pool") != F.col("seed")).groupBy("s1", "pool").agg(F.max(F.when(F.col("kind") == "addr", 1).otherwise(0)).alias("by_addr"), F.min("via").alias("via")).join(candidates.select("s1", "pool"), ["s1", "pool"], "left_anti")
    return top_k(fresh, "s1", [F.desc("by_addr"), F.asc("via"), F.asc("pool")], most)


def idf_overlap(pairs: DataFrame, toks: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs (s1, pool) with idf_jaccard, max_shared_idf, pool_only_idf; toks: (id, country, toks). A record's terms
    are one row, each term with its weight in one text, so that a pair's common ones are found by hashing and no pair
    is taken apart. Pairs without any kept term are left out."""
    rows = toks.select("id", "country", F.explode(F.array_distinct("toks")).alias("term")).join(terms, ["country", "term"])
    mine = rows.groupBy("id").agg(F.collect_list(F.concat_ws("\t", "term", F.col("idf").cast("string"))).alias("ts"), F.sum("idf").alias("all"))
    side = lambda key, p: mine.select(F.col("id").alias(key), F.col("ts").alias(f"{p}_ts"), F.col("all").alias(f"{p}_all"))
    both = pairs.join(side("s1", "a"), "s1", "left").join(side("pool", "b"), "pool", "left").na.fill(0.0, ["a_all", "b_all"])
    none = F.array().cast("array<string>")
    shared = F.transform(F.array_intersect(F.coalesce("a_ts", none), F.coalesce("b_ts", none)), lambda x: F.split_part(x, F.lit("\t"), F.lit(2)).cast("double"))
    both = both.withColumn("shared", shared).withColumn("common", F.aggregate("shared", F.lit(0.0), lambda s, x: s + x))
    total = F.col("a_all") + F.col("b_all") - F.col("common")
    rest = F.when(F.size("shared") == F.size(F.coalesce("b_ts", none)), 0.0).otherwise(F.col("b_all") - F.col("common"))
    return both.where(total > 0).select("s1", "pool", (F.col("common") / total).alias("idf_jaccard"), F.coalesce(F.array_max("shared"), F.lit(0.0)).alias("max_shared_idf"), rest.alias("pool_only_idf"))

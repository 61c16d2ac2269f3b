"""TF-IDF vectors of names (letters) and addresses (words), the nearest of the pool by both, the block job that puts
them beside the keys, and the similarity of given pairs.

A vector is one row: id, part and an array of (term, w). Nearest records are found within a part: pool records are
dealt into blocks, each block's terms become postings in a task's memory, and a part's queries stream past them, so
products of pairs are never rows and only the k best of a query and block leave the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries of a lot: a part's queries are dealt in lots, so that a part of few blocks is more than a few tasks.
LOT = 4096
TERMS = "array<struct<term: string, w: double>>"


def letter_grams(words: Column, n: int = 3) -> Column:
    """Runs of n letters of each word with a blank on either side; a shorter one is a run of its own."""

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))

    return F.flatten(F.transform(words, of))


def tfidf(docs: DataFrame, least: int = 2) -> DataFrame:
    """(id, part, terms) for (id, part, terms array<string>): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), of length
    one; terms of `least` records of a part, or of any where a part has none such. A record without terms has an
    empty vector. Spark takes exploded rows for as few as their records, so the join's kind is given: it would send
    them to the driver for a broadcast."""
    size = docs.groupBy("part").agg(F.count("*").alias("n"))
    tf = docs.select("id", "part", F.explode("terms").alias("term")).groupBy("part", "id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("part", "term").agg(F.count_if(F.col("tf") > 0).alias("df"))  # reads tf, so that tf's shuffle is used again
    some = df.groupBy("part").agg(F.max("df").alias("most"))
    df = df.join(F.broadcast(some.join(size, "part")), "part").where((F.col("df") >= least) | (F.col("most") < least))
    df = df.select("part", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(df.hint("merge"), ["part", "term"]).select("part", "id", F.struct("term", ((1 + F.log("tf")) * F.col("idf")).alias("w")).alias("x"))
    every = docs.select("part", "id", F.lit(None).cast("struct<term: string, w: double>").alias("x"))
    vectors = w.unionByName(every).groupBy("part", "id").agg(F.sqrt(F.sum(F.col("x.w") * F.col("x.w"))).alias("norm"), F.sort_array(F.collect_list("x")).alias("t"))
    return vectors.select("id", "part", F.transform("t", lambda x: F.struct(x["term"].alias("term"), (x["w"] / F.col("norm")).alias("w"))).alias("terms"))


def both(names: DataFrame, addresses: DataFrame) -> DataFrame:
    """Name and address vectors as one of length one: their product is the mean of the two products."""
    mark = lambda c, p: F.transform(c, lambda x: F.struct(F.concat(F.lit(p), x["term"]).alias("term"), (x["w"] / F.sqrt(F.lit(2.0))).alias("w")))
    b = addresses.select("id", "part", F.col("terms").alias("more"))
    return names.join(b.hint("merge"), ["id", "part"]).select("id", "part", F.concat(mark("terms", "n:"), mark("more", "a:")).alias("terms"))


def product(a: Column, b: Column) -> Column:
    """The product of two vectors: an array of (term, w) and a map."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.try_element_at(b, x["term"]), F.lit(0.0)))


def top_k(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank (Spark limits each group before the shuffle)."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


class Block:
    """Pool vectors of one unit, taken up as they come, then asked: the postings of their terms."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.n, self.ready = 0, False

    def add(self, ids: np.ndarray, counts: np.ndarray, terms: pa.Array, w: np.ndarray) -> None:
        self.held.append((np.repeat(self.n + np.arange(len(ids)), counts), terms, w))
        self.ids.append(ids)
        self.n += len(ids)
        self.ready = False

    def settle(self) -> None:
        if not self.ready and self.held:
            owner, terms, w = zip(*self.held, strict=True)
            coded = pa.chunked_array(terms).combine_chunks().dictionary_encode()
            code = coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            self.terms, self.names = coded.dictionary, np.concatenate(self.ids)
            self.owner, self.w = np.concatenate(owner)[order], np.concatenate(w)[order]
            self.begin = np.searchsorted(code[order], np.arange(len(self.terms) + 1))
            self.ready = True

    def best(self, code: np.ndarray, w: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k members of largest product with one vector (its terms' codes, -1: not here)."""
        code, w = code[code >= 0], w[code >= 0]
        n = self.begin[code + 1] - self.begin[code]
        pick = np.repeat(self.begin[code] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        score = np.round(np.bincount(self.owner[pick], self.w[pick] * np.repeat(w, n), minlength=self.n), 9)
        over = np.flatnonzero(score > least)
        if len(over) > 4 * k:  # all that tie with the k-th stay
            over = over[score[over] >= np.partition(score[over], len(over) - k)[len(over) - k]]
        over = over[np.lexsort((self.names[over], -score[over]))[:k]]
        return self.names[over], score[over]


def nearest(queries: DataFrame, pool: DataFrame, k: int, least: float = 0.05, block: int = 32_768, sides: DataFrame | None = None) -> DataFrame:
    """(s1, pool, score, rank): for each query vector the k of largest product in its part, over `least`; ties to
    smaller ids. Products are rounded to nine digits. sides: (part, asks boolean) of all vectors, if that is had for
    less than the vectors."""
    if sides is None:
        sides = queries.select("part", F.lit(True).alias("asks")).unionByName(pool.select("part", F.lit(False).alias("asks")))
    size = _sizes(sides, block)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    members = pool.join(F.broadcast(size), "part").select("part", dealt("blocks").alias("block"), each("lots").alias("lot"), F.lit(0).alias("side"), "id", "terms")
    asking = queries.join(F.broadcast(size), "part").select("part", each("blocks").alias("block"), dealt("lots").alias("lot"), F.lit(1).alias("side"), "id", "terms")
    return _asked(members.unionByName(asking), k, least)  # a block is lent to several lots of queries


def nearest_among(vectors: DataFrame, k: int, least: float = 0.05, block: int = 32_768, sides: DataFrame | None = None) -> DataFrame:
    """As nearest(), of vectors that are queries or pool by a column: (id, part, terms, asks boolean; null: neither).
    They are read once, where nearest() has the plan of its vectors twice, and twice more to count them without
    sides: the driver plans all of it again after each stage, in its memory."""
    size = _sizes(vectors.select("part", "asks") if sides is None else sides, block)
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    unit = lambda b, q: F.struct(b.alias("block"), q.alias("lot"))
    asking, lent = every("blocks", lambda b: unit(b, own("lots"))), every("lots", lambda q: unit(own("blocks"), q))
    dealt = vectors.where("asks is not null").join(F.broadcast(size), "part")
    units = dealt.select("part", F.explode(F.when(F.col("asks"), asking).otherwise(lent)).alias("u"), F.col("asks").cast("int").alias("side"), "id", "terms")
    return _asked(units.select("part", "u.block", "u.lot", "side", "id", "terms"), k, least)


def _sizes(sides: DataFrame, block: int) -> DataFrame:
    """(part, blocks, lots) of the parts that have both sides."""
    count = lambda c, n: F.ceil(F.count_if(c) / n).cast("int")
    return sides.groupBy("part").agg(count(~F.col("asks"), block).alias("blocks"), count(F.col("asks"), LOT).alias("lots")).where("blocks > 0 and lots > 0")


def _asked(units: DataFrame, k: int, least: float) -> DataFrame:
    """The k nearest of each query: units are (part, block, lot, side: 1 asks, id, terms)."""

    def run(batches):  # noqa: ANN001, ANN202
        at, held = None, Block()
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("part", "block", "lot", "side")), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                rows = b.slice(i, j - i)
                if keys[i][:3] != at:
                    at, held = keys[i][:3], Block()
                ids, lists = rows.column("id").to_numpy(), rows.column("terms")
                counts, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
                terms, w = flat.field("term"), flat.field("w").to_numpy()
                if keys[i][3] == 0:
                    held.add(ids, counts, terms, w)
                    continue
                if not held.n:
                    continue
                held.settle()
                codes = pc.fill_null(pc.index_in(terms, value_set=held.terms), -1).to_numpy()
                ends = np.cumsum(counts)
                found = [held.best(codes[e - n : e], w[e - n : e], k, least) for n, e in zip(counts, ends, strict=True)]
                out = np.repeat(ids, [len(f[0]) for f in found])
                if len(out):
                    yield pa.record_batch([pa.array(out), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], names=["s1", "pool", "score"])

    dealt = units.repartition("part", "block", "lot").sortWithinPartitions("part", "block", "lot", "side", "id")
    hits = dealt.mapInArrow(run, "s1 long, pool long, score double")
    return top_k(hits, "s1", [F.desc("score"), F.asc("pool")], k)


def similarities(pairs: DataFrame, names: DataFrame, addresses: DataFrame) -> DataFrame:
    """Pairs with sn and sa, the products of their name and address vectors (id, terms). A record's two vectors go
    together, so pairs are moved twice; none of it is for a broadcast, whatever Spark takes the sizes for."""
    split = lambda v, p: v.select("id", F.col("terms.term").alias(f"{p}t"), F.col("terms.w").alias(f"{p}w"))  # noqa: E731  half the bytes of structs
    both = split(names, "n").join(split(addresses, "a").hint("merge"), "id")
    side = lambda key, p: both.select(F.col("id").alias(key), *[F.col(c).alias(f"_{p}{c}") for c in ("nt", "nw", "at", "aw")]).hint("merge")
    out = pairs.join(side("s1", "a"), "s1").join(side("pool", "b"), "pool")
    mine = lambda p: F.arrays_zip(F.col(f"_a{p}t").alias("term"), F.col(f"_a{p}w").alias("w"))
    dot = lambda p: F.round(product(mine(p), F.map_from_arrays(f"_b{p}t", f"_b{p}w")), 9)
    return out.select(*pairs.columns, dot("n").alias("sn"), dot("a").alias("sa"))


def block_job(records: DataFrame, key_pairs: DataFrame, with_address: bool, near: int, keep: int) -> DataFrame:
    """One job's candidates: s1, pool, bits, knn, sn, sa, no_addr. records: (id, is_s1, part, toks, words, nums) of all
    its parts; vectors are fitted on each part. Pairs that share a key (key_pairs: s1, pool, bits) and the `near`
    nearest are ranked by their similarity, and each s1 keeps the first."""
    names = tfidf(records.select("id", "part", letter_grams(F.col("toks")).alias("terms")))
    addresses = tfidf(records.select("id", "part", F.concat("words", "nums").alias("terms")))
    vectors = both(names, addresses) if with_address else names
    own = records.select("id", "part", "is_s1")
    tagged = vectors.join(own.hint("merge"), ["id", "part"])
    close = nearest(tagged.where("is_s1").drop("is_s1"), tagged.where(~F.col("is_s1")).drop("is_s1"), near, sides=records.select("part", F.col("is_s1").alias("asks")))
    found = key_pairs.select("s1", "pool", "bits", F.lit(False).alias("knn")).unionByName(close.select("s1", "pool", F.lit(0).alias("bits"), F.lit(True).alias("knn")))
    found = found.groupBy("s1", "pool").agg(F.max("bits").alias("bits"), F.max("knn").alias("knn"))
    scored = similarities(found, names, addresses)
    order = F.col("sn") + F.col("sa") if with_address else F.col("sn")
    return top_k(scored.withColumn("_o", F.round(order, 9)), "s1", [F.desc("_o"), F.asc("pool")], keep).drop("rank", "_o").withColumn("no_addr", F.lit(not with_address))


def block_all(records: DataFrame, key_pairs: DataFrame, pool_pairs: DataFrame, near: tuple[int, int] = (20, 10), keep: tuple[int, int] = (30, 5)) -> DataFrame:
    """All jobs: within each part, and all of a country's s1 records against its pool records without an address
    (part country|POOL), by name only. A pair of both jobs counts for the first. records: (id, is_s1, country, part,
    toks, words, nums); key_pairs and pool_pairs: the keys' pairs of either job."""
    lost = F.col("part").endswith("|POOL")
    main = block_job(records.where(~lost), key_pairs, True, near[0], keep[0])
    rest = block_job(records.where("is_s1").unionByName(records.where(lost)).withColumn("part", F.col("country")), pool_pairs, False, near[1], keep[1])
    first = W.partitionBy("s1", "pool").orderBy("no_addr")
    return main.unionByName(rest).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")

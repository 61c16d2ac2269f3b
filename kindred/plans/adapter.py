"""The driver's tables read as linkage tables. Every row of a table takes part, in one role or another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

S1_SOURCES = [f"src{i}" for i in range(7)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: id, is_s1, source 1 to 3, country (language), name (first line), addr (last line), text."""
    d = table(spark, sf_dir, "documents")
    first = F.col("source").isin(*S1_SOURCES)
    return d.select(F.col("doc_id").alias("id"), first.alias("is_s1"), F.when(first, 1).otherwise(2 + F.col("doc_id") % 2).cast("int").alias("source"), F.col("lang").alias("country"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("name"), F.split_part("text", F.lit("\n"), F.lit(-1)).alias("addr"), "text")


def entity_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1, pool): equal texts, each pool record under its smallest s1."""
    e = entities(spark, sf_dir).select("id", "is_s1", F.md5("text").alias("h"))
    owner = e.where("is_s1").groupBy("h").agg(F.min("id").alias("s1"))
    return e.where(~F.col("is_s1")).join(owner, "h").select("s1", F.col("id").alias("pool"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as scored pairs: s1 (order), pool (part), prob, prob2, label."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("s1"), F.col("l_partkey").alias("pool")).agg(
        F.max(F.round((F.col("l_quantity") - 0.5) / 50.0, 6)).alias("prob"), F.max(F.round(1 - F.col("l_discount") * 5, 6)).alias("prob2"), F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("label")
    )


def s1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1"), F.col("o_orderpriority").alias("country"))


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part: id, is_s1, country (brand), name, toks."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3 == 0).alias("is_s1"), F.col("p_brand").alias("country"), F.lower("p_name").alias("name"), plain_tokens(F.col("p_name")).alias("toks"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as prepared records: id, is_s1, source, country (brand), name, toks, ftoks (with the type's word), words,
    nums, units, has_addr, family, legal. Four of five have an address; some names are glued."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    has, none = F.col("p_size") % 5 != 0, F.array().cast("array<string>")
    kind, text = F.lower("p_type"), lambda c: c.cast("string")
    toks = F.when(key % 11 == 0, F.array(F.replace(F.lower("p_name"), F.lit(" "), F.lit("")))).otherwise(plain_tokens(F.col("p_name")))
    legal = F.when(key % 5 == 1, F.array(F.lit("limited"), F.lit("private"))).when(key % 5 == 2, F.array(F.lit("limited"))).when(key % 5 == 3, F.array(F.lit("limited"), F.lit("public"))).otherwise(none)
    return p.select(
        key.alias("id"), (key % 3 == 0).alias("is_s1"), F.when(key % 3 == 0, 1).otherwise(2 + key % 2).cast("int").alias("source"), F.col("p_brand").alias("country"), F.lower("p_name").alias("name"),
        toks.alias("toks"), F.concat(toks, F.array(kind)).alias("ftoks"), F.when(has, F.array(kind, F.concat(F.lit("w"), text(F.col("p_size") % 7)))).otherwise(none).alias("words"),
        F.when(has, F.array(text(F.col("p_size")), text(key % 120))).otherwise(none).alias("nums"), F.when(has & (key % 2 == 0), F.array(text(F.col("p_size") % 6))).otherwise(none).alias("units"), has.alias("has_addr"),
        F.when(key % 7 == 1, "corp").when(key % 7 == 2, "ltd").when(key % 7 == 3, "inc").otherwise("").alias("family"), legal.alias("legal"),
    )


STREETS = ["North Main Street", "rue de la Paix", "Twenty First Avenue", "Lake Drive, Suite 5B", "Oak Road, 3rd Floor"]


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as raw records: id, is_s1, name, address, country (US or India); one in nine has no address."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    us = key % 4 != 0
    form = F.element_at(F.array(*[F.lit(x) for x in ("Pvt. Ltd.", "L.L.C.", "& Sons Inc", "(ID: 55) Corp")]), (key % 4 + 1).cast("int"))
    street = F.element_at(F.array(*[F.lit(x) for x in STREETS]), (key % 5 + 1).cast("int"))
    place = F.when(us, F.element_at(F.array(F.lit("Austin, TX"), F.lit("Reno, Nevada")), (key % 2 + 1).cast("int"))).otherwise("Pune, Maharashtra")
    address = F.when(key % 9 == 0, "").otherwise(F.concat_ws(", ", F.concat_ws(" ", (F.col("p_size") * 7 + key % 100).cast("string"), street), place))
    return p.select(key.alias("id"), (key % 3 == 0).alias("is_s1"), F.concat_ws(" ", "p_name", form).alias("name"), address.alias("address"), F.when(us, "US").otherwise("India").alias("country"))


def prepared_pairs(spark: SparkSession, sf_dir: str, cap: int = 200) -> DataFrame:
    """s1 and pool records of a brand that share all words or the first (bits), and a made-up probability."""
    from kindred.operators.blocking import key_pairs

    r = prepared(spark, sf_dir)
    key = lambda family, c: r.select("id", "is_s1", F.col("country").alias("part"), F.lit(family).alias("family"), c.alias("key"))
    found = key_pairs(key(0, F.array_join(F.array_sort("toks"), " ")).unionByName(key(1, F.get("toks", F.lit(0)))), cap)
    return found.withColumn("prob", F.round((F.col("s1") * 7 + F.col("pool") * 13) % 100 / 100.0, 2))

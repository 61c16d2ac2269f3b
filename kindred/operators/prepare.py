"""Raw records to prepared ones: names and addresses taken apart, Indic words resolved against the vocabulary of the
s1 names, fillers removed; and what is learned from the words alone: syllables of invented names, glued words.

The vocabulary is a table and stays one: words that need it are joined to it, distinct ones only, and the answers are
joined back to the records that hold such words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.functions import lexicon as L
from kindred.functions import records as rc
from kindred.functions import similarity as sim
from kindred.functions import text as tx

#: What a vocabulary word needs to stand for an Indic one: its count, its likeness, and the weight of its count.
LEAST_COUNT, LEAST_RATIO, COUNT_WEIGHT, KEPT = 20, 75, 10, 8


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n): stems of the Latin words of s1 names, once a mention; words: (toks)."""
    each = words.select(F.explode("toks").alias("word")).where(~tx.has_indic(F.col("word")))
    return each.select(tx.stem(F.col("word")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def by_sound(voc: DataFrame, voiced: bool = False, kept: int = KEPT) -> DataFrame:
    """(sound, word, n): of each skeleton the words of largest count, ties by the word."""
    rows = voc.where(F.col("word").rlike("^[a-z]+$")).withColumn("sound", tx.skeleton_2(F.col("word"), voiced))
    order = W.partitionBy("sound").orderBy(F.desc("n"), F.asc("word"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= kept).select("sound", "word", "n")


def resolved(indic: DataFrame, voc: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(word, latin, means) of distinct Indic words: their transliteration, and the word they mean: the dictionary's
    (word, means), null for a designator, else a frequent vocabulary word of equal skeleton and like spelling, else
    one of equal voiced skeleton, else the transliteration."""
    base = indic.select("word").distinct().withColumn("latin", rc.in_latin(F.col("word")))
    base = base.withColumn("sound", tx.skeleton_2(F.col("latin"))).withColumn("voiced", tx.skeleton_2(F.col("latin"), True))
    legal = F.col("latin").isin(*L.LEGAL_SHORT) | ((F.length("latin") <= L.LEGAL_LONGEST) & F.col("latin").rlike(f"^[{L.LEGAL_LETTERS}]*l[{L.LEGAL_LETTERS}]*$")) | F.col("sound").isin(*sorted({rc.sound_2(w) for w in L.LEGAL_SOUNDS_2}))

    def picked(key: str, voiced: bool, name: str) -> DataFrame:
        near = by_sound(voc, voiced).where(F.col("n") >= LEAST_COUNT).withColumnRenamed("sound", key).withColumnRenamed("word", "of")
        rows = base.join(near, key).withColumn("ratio", 100 * sim.ratio(F.col("latin"), F.col("of")))
        best = rows.groupBy("word").agg(F.max_by(F.struct("of", "ratio"), F.struct(F.col("ratio") + COUNT_WEIGHT * F.log10("n"), F.col("n"))).alias("best"))
        return best.where(F.col("best.ratio") >= LEAST_RATIO).select("word", F.col("best.of").alias(name))

    out = base.join(picked("sound", False, "one"), "word", "left").join(picked("voiced", True, "two"), "word", "left")
    means = F.when(~legal, F.coalesce("one", "two", "latin"))
    if dictionary is not None:
        out = out.join(dictionary.withColumnRenamed("means", "listed"), "word", "left")
        means = F.coalesce(F.col("listed"), means)
    return out.select("word", "latin", means.alias("means"))


def final_words(words: DataFrame) -> DataFrame:
    """(id, toks): stems of (id, at, word), in order, without fillers, credentials, designators and single letters."""
    word = tx.stem(F.col("word"))
    drop = [*L.NAME_FILLERS, *L.CREDENTIALS, *L.LEGAL_FORMS, *L.HONORIFICS]
    kept = words.withColumn("word", word).where(~F.col("word").isin(*drop) & ((F.length("word") > 1) | F.col("word").rlike("^[0-9]$")))
    return kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("toks"))


def prepare(records: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Raw records (id, is_s1, name, address, country) as prepared ones: id, is_s1, country, state, toks, words, nums,
    units, has_addr, addr_ok, name_indic, name_domain, family, legal. A null name or address is empty."""
    name, addr = F.coalesce("name", F.lit("")), F.coalesce("address", F.lit(""))
    rows = records.select("id", "is_s1", "country", name.alias("name"), addr.alias("address"), rc.name_parts(F.replace(name, F.lit("ॐ"), F.lit(" om "))).alias("n"), rc.address_tokens(addr).alias("parts"))
    voc = vocabulary(rows.where("is_s1").select(F.col("n.words").alias("toks")))
    words = rows.select("id", F.posexplode("n.words").alias("at", "word"))
    places = rows.where(F.col("address").rlike("[\\u0900-\\u0DFF]")).select("id", F.posexplode("parts").alias("part", "toks")).select("id", "part", F.posexplode("toks").alias("at", "word"))
    foreign = tx.has_indic(F.col("word"))
    known = resolved(words.where(foreign).select("word").unionByName(places.where(foreign).select("word")), voc, dictionary)
    named = words.where(~foreign).unionByName(words.where(foreign).join(known, "word").where("means is not null").select("id", "at", F.col("means").alias("word")))
    read = places.join(known, "word", "left").select("id", "part", "at", F.coalesce("means", "latin", "word").alias("word"))
    read = read.groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("toks")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "toks"))).alias("p"))
    read = read.select("id", F.transform("p", lambda p: F.transform(p["toks"], lambda x: x["word"])).alias("read"))
    full = rows.join(final_words(named), "id", "left").join(read, "id", "left").withColumn("a", rc.parsed_address(F.coalesce("read", "parts"), F.col("country")))
    has = F.trim("address") != ""
    return full.select(
        "id", "is_s1", "country", "a.state", F.coalesce("toks", F.array().cast("array<string>")).alias("toks"), "a.words", "a.nums", "a.units", has.alias("has_addr"), (has & ((F.size("a.words") > 0) | (F.size("a.nums") > 0))).alias("addr_ok"),
        tx.has_indic(F.col("name")).alias("name_indic"), F.col("name").rlike(L.SITE_FLAG).alias("name_domain"), F.col("n.family").alias("family"), F.col("n.legal").alias("legal"),
    )


def without_fillers(records: DataFrame, fillers: DataFrame) -> DataFrame:
    """Records (country, toks) without their country's fillers (country, term); all tokens stay in ftoks. A country
    has few: each stands in a fixed share of its pool records at least."""
    lists = fillers.groupBy("country").agg(F.collect_set("term").alias("_bad"))
    rows = records.withColumn("ftoks", F.col("toks")).join(F.broadcast(lists), "country", "left")
    return rows.withColumn("toks", F.when(F.col("_bad").isNull(), F.col("toks")).otherwise(F.filter("toks", lambda t: ~F.array_contains("_bad", t)))).drop("_bad")


def learned_syllables(words: DataFrame, seed: list[str] = L.SYLLABLES, rounds: int = 3, least: int = 25, common: int = 50) -> list[str]:
    """The inventory grown from distinct words (word, n_s1): in each round, pieces that are the one unknown part of
    `least` words or more and are no common s1 word join it."""
    known = set(seed)
    rows = words.where(F.col("word").rlike("^[a-z]{5,24}$") & (F.col("n_s1") < 5)).select("word")
    usual = words.where(F.col("n_s1") >= common).select(F.col("word").alias("piece"))
    for _ in range(rounds):
        now = frozenset(known)
        part = rows.select(rc.column(lambda w, now=now: rc.pieces(w, now), "string", F.col("word")).alias("piece")).where("piece is not null")
        counts = part.groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        new = {r.piece for r in counts.join(usual, "piece", "left_anti").select("piece").collect()} - known  # syllables: a few hundred
        if not new:
            break
        known |= new
    return sorted(known)


def unglued(words: DataFrame, voc: DataFrame, shortest: int = 7, least: int = 3) -> DataFrame:
    """(word, parts): words of `shortest` letters or more that the vocabulary (word, n) does not hold, cut into words
    that it holds; those without such a cut are left out. The stretches of a word are joined to the vocabulary."""
    usual = voc.where((F.col("n") >= least) & F.col("word").rlike("^[a-z]{3,}$")).select("word", "n")
    rows = words.select("word").distinct().where(F.col("word").rlike(f"^[a-z]{{{shortest},}}$")).join(usual, "word", "left_anti")
    n = F.length("word")
    stretches = F.flatten(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.transform(F.sequence(F.lit(3), F.least(F.lit(20), n - i + 1)), lambda k: F.substring("word", i, k))))
    ends = F.transform(F.filter(stretches, lambda s: F.endswith("word", s)), tx.stem)
    parts = rows.select(F.col("word").alias("whole"), F.explode(F.array_distinct(F.concat(stretches, ends))).alias("word"))
    held = parts.join(usual, "word").groupBy("whole").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("held"))
    cut = held.select(F.col("whole").alias("word"), rc.column(lambda w, h: rc.unglued(w, {x["word"]: x["n"] for x in h}), "array<string>", F.col("whole"), F.col("held")).alias("parts"))
    return cut.where(F.size("parts") > 1)


def concat_candidates(tables: list[DataFrame], flags: list[str]) -> DataFrame:
    """Candidates of several passes under one another; flags that a pass lacks are 0."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return out.fillna(0, subset=[f for f in flags if f in out.columns])

"""Features of record pairs as Column expressions: equality flags, overlap and glue, numbers, units, designators,
counts of names, invented names.

A pair is a row with columns a_* (the s1 record) and b_* (the pool record); see beside(). Lists are arrays of strings;
a record without an address has empty lists of words, numbers and units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.functions import lexicon as L
from kindred.functions import text as tx
from kindred.functions.similarity import house, jaccard, token_set_ratio


def beside(pairs: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (s1, pool, ..) with the records' columns as a_* and b_*; records: (id, columns)."""
    side = lambda p, key: records.select(F.col("id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return pairs.join(side("a", "s1"), "s1").join(side("b", "pool"), "pool")


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _set(c: str) -> Column:
    return F.array_sort(F.array_distinct(c))


def _any(c: str) -> Column:
    return F.size(c) > 0


def _share(part: Column, whole: Column, missing: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(missing)


def _jaccard(a: str, b: str, missing: float = 0.0) -> Column:
    return _share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)), missing)


def glue(toks: str) -> Column:
    return tx.ocr_fold(F.array_join(toks, ""))


def equality(p: DataFrame) -> DataFrame:
    """Exact flags and lengths: names, their sets with and without fillers, numbers in order, whole addresses."""
    words = _any("a_words") & (_set("a_words") == _set("b_words"))
    same_nums = F.col("a_nums") == F.col("b_nums")
    return p.select(
        "s1", "pool", _flag(F.col("a_name") == F.col("b_name")).alias("n_exact"), _flag((glue("a_toks") != "") & (glue("a_toks") == glue("b_toks"))).alias("glue_equal"),
        _flag((_any("a_toks") | _any("b_toks")) & (_set("a_toks") == _set("b_toks"))).alias("set_equal"), _flag((_any("a_ftoks") | _any("b_ftoks")) & (_set("a_ftoks") == _set("b_ftoks"))).alias("full_equal"),
        _flag(_any("a_nums") & same_nums).alias("num_seq_equal"), _flag(words).alias("addr_words_equal"), _flag(words & _any("a_nums") & same_nums).alias("addr_exact"),
        F.length("a_name").alias("len_name_a"), F.length("b_name").alias("len_name_b"), F.col("b_source").alias("source"),
    )


def overlap(p: DataFrame, fillers: list[str]) -> DataFrame:
    """Containment, glued names, full tokens, what is left on each side and its closest pair."""
    inter = F.size(F.array_intersect("a_toks", "b_toks"))
    a, b = glue("a_toks"), glue("b_toks")
    shorter = F.least(F.length(a), F.length(b))
    both = shorter > 0
    alike = F.size(F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    left_a, left_b = F.array_except("a_ftoks", "b_ftoks"), F.array_except("b_ftoks", "a_ftoks")
    return p.select(
        "s1", "pool", _share(inter, F.size(F.array_distinct("a_toks"))).alias("cont_a"), _share(inter, F.size(F.array_distinct("b_toks"))).alias("cont_b"),
        _flag(both & (shorter >= 4) & (F.contains(a, b) | F.contains(b, a))).alias("glue_contain"), F.when(both, alike / shorter).otherwise(0.0).alias("glue_prefix"),
        _jaccard("a_ftoks", "b_ftoks").alias("full_jacc"), F.size(left_a).alias("extra_a_full"), F.size(left_b).alias("extra_b_full"),
        F.size(F.filter(left_b, lambda t: t.isin(*fillers))).alias("b_filler_extra"), closest(left_a, left_b).alias("min_char_dist"), _jaccard("a_words", "b_words").alias("w_jacc"),
    )


def closest(left: Column, right: Column) -> Column:
    """The least normalised edit distance of a word of each side; 0 if a side has none left."""
    each = F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))))
    return F.coalesce(F.array_min(each), F.lit(0.0))


def numbers(p: DataFrame) -> DataFrame:
    """House numbers: shared exactly, or but for one digit; the first ones' difference; units. -1 where a side has
    none (for the features that say how far apart, not whether)."""
    both = _any("a_nums") & _any("b_nums")
    exact = F.arrays_overlap("a_nums", "b_nums")
    near = F.arrays_overlap(F.flatten(F.transform("a_nums", lambda n: tx.one_digit_less(n, 2))), F.flatten(F.transform("b_nums", lambda n: tx.one_digit_less(n, 2))))
    x, y = F.get("a_nums", F.lit(0)), F.get("b_nums", F.lit(0))
    small = lambda n: n.cast("double")
    cut = (x != y) & (x.startswith(y) | y.startswith(x) | x.endswith(y) | y.endswith(x))
    differing = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1))))
    units = _any("a_units") & _any("b_units")
    shared = F.arrays_overlap("a_units", "b_units")
    of = lambda c: _flag(both & c)
    return p.select(
        "s1", "pool", F.size("a_nums").alias("a_nnum"), F.size("b_nums").alias("b_nnum"), of(exact).alias("num_exact"), of(~exact & near).alias("num_del1"), of(x == y).alias("num_first_eq"), of(~exact & ~near).alias("num_conflict"),
        F.when(both, F.log1p(F.abs(small(x) - small(y)))).otherwise(-1.0).alias("num_first_absdiff"), of(cut).alias("num_first_trunc"), F.when(both, F.abs(F.length(x) - F.length(y))).otherwise(-1).alias("num_first_lendiff"),
        F.when(both & (F.length(x) == F.length(y)), differing).otherwise(-1).alias("num_first_diffpos"), of(F.size(F.array_except("b_nums", "a_nums")) == 0).alias("num_b_subset_a"),
        F.when(both, _jaccard("a_nums", "b_nums")).otherwise(-1.0).alias("num_set_jacc"), F.when(both, F.size(F.array_except("b_nums", "a_nums"))).otherwise(-1).alias("num_b_unmatched"),
        _flag(units).alias("unit_both"), _flag(units & shared).alias("unit_share"), _flag(units & ~shared).alias("unit_conflict"),
    )


def designators(p: DataFrame) -> DataFrame:
    """Families (a_family, b_family, '' without) and order-free sets (a_legal, b_legal, arrays) of designators."""
    a, b = F.col("a_family") != "", F.col("b_family") != ""
    changed, no_addr = a & b & (F.col("a_family") != F.col("b_family")), ~F.col("b_has_addr")
    has = lambda s, w: F.array_contains(f"{s}_legal", w)
    both = (F.size(F.array_remove("a_legal", "public")) > 0) & (F.size(F.array_remove("b_legal", "public")) > 0)
    differ = both & (_set("a_legal") != _set("b_legal"))
    return p.select(
        "s1", "pool", _flag(a).alias("legal_a_present"), _flag(b).alias("legal_b_present"), _flag(changed).alias("legal_changed"), _flag(changed & no_addr).alias("legal_changed_no_addr"), _flag((a != b) & no_addr).alias("legal_asym_no_addr"),
        _flag(has("a", "private")).alias("priv_a"), _flag(has("b", "private")).alias("priv_b"), _flag(both & (has("a", "private") != has("b", "private"))).alias("priv_conflict"), _flag(both & (has("a", "public") != has("b", "public"))).alias("pub_conflict"),
        _flag(differ).alias("lseq_diff"), _flag(differ & no_addr).alias("lseq_diff_no_addr"),
    )


def decoys(p: DataFrame) -> DataFrame:
    """What speaks for another business of like name: words by sound that only one side has, in names and addresses
    (-1 where a side has no address words), designators (-1 without both), house numbers."""
    sounds = lambda c: F.array_distinct(F.transform(c, tx.skeleton))
    a, b, x, y = (sounds(c) for c in ("a_toks", "b_toks", "a_words", "b_words"))
    both, legal = _any("a_words") & _any("b_words"), (F.size("a_legal") > 0) & (F.size("b_legal") > 0)
    more = F.size(F.array_except(y, x))
    first = lambda c: F.coalesce(F.get(F.col(c), F.lit(0)), F.lit(""))
    return p.select(
        "s1", "pool", F.size(F.array_except(b, a)).alias("n_extra_b"), F.size(F.array_except(a, b)).alias("n_extra_a"), F.coalesce(F.array_max(F.transform(F.array_except(b, a), F.length)), F.lit(0)).alias("n_extra_b_len"),
        F.when(both, more).otherwise(-1).alias("a_extra_b"), F.when(both, F.size(F.array_except(x, y))).otherwise(-1).alias("a_extra_a"), F.when(both, more / F.size(y)).otherwise(-1.0).alias("a_extra_b_frac"),
        _flag(legal).alias("legal_both"), F.when(legal, _flag(~F.arrays_overlap("a_legal", "b_legal"))).otherwise(-1.0).alias("legal_conflict"), *[c.alias(k) for k, c in house(first("a_nums"), first("b_nums")).items()],
    )


def name_counts(p: DataFrame) -> DataFrame:
    """How many records have each side's name, on a logarithmic scale, and which blocking families found the pair."""
    bit = lambda i: F.shiftright("bits", i).bitwiseAND(F.lit(1)).cast("double")
    return p.select("s1", "pool", *[F.log1p(F.col(c).cast("double")).alias(n) for c, n in (("a_n_s1_same", "a_name_n1"), ("b_n_s1_same", "b_name_n1"), ("b_n_pool_same", "b_name_n23"))], bit(0).alias("f_set"), bit(1).alias("f_pair"), bit(2).alias("f_glue"))


def invented(tok: Column, syllables: list[str] = L.SYLLABLES, common: Column | None = None) -> Column:
    """Whether a word of five letters or more falls into two syllables or more of an inventory whole (each two to six
    letters long) and is not common."""
    whole = (F.length(tok) >= 5) & tok.rlike("^(?:" + "|".join(sorted(syllables)) + "){2,}$")
    return whole if common is None else whole & ~common


def invented_share(toks: Column, syllables: list[str] = L.SYLLABLES) -> Column:
    return F.when(F.size(toks) > 0, F.size(F.filter(toks, lambda t: invented(t, syllables))) / F.size(toks)).otherwise(0.0)


def name_address(name: Column, address: Column) -> Column:
    """One score of a name's and an address's similarity."""
    return 0.6 * name + 0.4 * address


def evidence(p: DataFrame) -> DataFrame:
    """String evidence of raw names and addresses: token-set ratios of names, of addresses, of addresses without their
    digits, and of the name with the other's alias (-1 without one); numbers equal or in conflict; one score of both."""
    name, addr = token_set_ratio(F.col("a_name"), F.col("b_name")), token_set_ratio(F.col("a_addr"), F.col("b_addr"))
    street = token_set_ratio(street_text(F.col("a_addr")), street_text(F.col("b_addr")))
    both = _any("a_nums") & _any("b_nums")
    out = p.select("s1", "pool", name.alias("r_name_tset"), _flag(F.col("a_name") == F.col("b_name")).alias("r_name_eq"), addr.alias("r_addr_tset"), street.alias("r_street_tset"), _flag(both & (_set("a_nums") == _set("b_nums"))).alias("r_num_eq"), _flag(both & ~F.arrays_overlap("a_nums", "b_nums")).alias("r_num_conflict"), F.when(F.col("b_alias") == "", -1.0).otherwise(token_set_ratio(F.col("a_name"), F.col("b_alias"))).alias("alias_tset"))
    return out.withColumn("name_addr", name_address(F.col("r_name_tset"), F.col("r_addr_tset")))


def street_text(address: Column) -> Column:
    return F.regexp_replace(address, "[0-9]+", " ")


def siblings(pairs: DataFrame, records: DataFrame, prob: str = "prob", least: float = 0.05, sure: float = 0.5) -> DataFrame:
    """For pairs of at least `least`: places and gaps on both sides, the record's best elsewhere, and how it compares
    with the other confident candidates of its s1, with the record that another s1 claims at its address, and with
    the s1 records that hold it confidently. records: (id, toks, words, nums)."""
    own, other = W.partitionBy("s1"), W.partitionBy("pool")
    p = F.col(prob)
    ranked = pairs.select("s1", "pool", p.alias("p1")).withColumn("p1_r1", F.row_number().over(own.orderBy(F.desc("p1"), "pool")) - 1).withColumn("p1_r2", F.row_number().over(other.orderBy(F.desc("p1"), "s1")) - 1)
    ranked = ranked.withColumn("p1_gap1", F.max("p1").over(own) - F.col("p1")).withColumn("p1_gap2", F.max("p1").over(other) - F.col("p1"))
    second = F.coalesce(F.max(F.when(F.col("p1_r2") == 1, F.col("p1"))).over(other), F.lit(0.0))
    ranked = ranked.withColumn("p1_other_best", F.when(F.col("p1_r2") == 0, second).otherwise(F.max("p1").over(other)))
    ranked = ranked.withColumn("b_conf_elsewhere", F.count_if(F.col("p1") >= sure).over(other) - F.when(F.col("p1") >= sure, 1).otherwise(0))
    place = F.when((F.size("words") > 0) | (F.size("nums") > 0), F.concat_ws("|", F.array_join("words", " "), F.array_join("nums", " ")))
    seen = records.select(F.col("id").alias("pool"), "toks", "words", "nums", place.alias("place"))
    rows = ranked.where(F.col("p1") >= least).join(seen, "pool")
    claims = rows.where((F.col("p1") >= sure) & (F.col("p1_r1") == 0) & F.col("place").isNotNull()).groupBy("place").agg(F.max_by(F.struct("s1", "p1"), F.struct(F.col("p1"), -F.col("s1"))).alias("claim"))
    rows = rows.join(claims, "place", "left")
    rows = rows.withColumn("sib_addr_conflict", F.when(F.col("claim.s1") != F.col("s1"), F.col("claim.p1")).otherwise(0.0))
    sibling = rows.where(F.col("p1") >= sure).select("s1", *[F.col(c).alias(f"o_{c}") for c in ("pool", "p1", "toks", "words", "nums")])
    near = rows.join(sibling, "s1").where(F.col("pool") != F.col("o_pool"))  # confident candidates of one s1 are few
    some = (F.size("words") > 0) & (F.size("o_words") > 0)
    same_words = (F.size("words") > 0) & (_set("words") == _set("o_words"))
    found = near.groupBy("s1", "pool").agg(
        F.count("*").alias("sib_n"), F.max("o_p1").alias("sib_maxp"), F.max(jaccard(F.col("toks"), F.col("o_toks"))).alias("sib_name_jacc"), F.max(_flag((glue("toks") != "") & (glue("toks") == glue("o_toks")))).alias("sib_glue_eq"),
        F.max(F.when(some, jaccard(F.col("words"), F.col("o_words"))).otherwise(0.0)).alias("sib_addr_jacc"), F.max(_flag((F.size("nums") > 0) & (F.col("nums") == F.col("o_nums")))).alias("sib_num_eq"), F.max(_flag(same_words & (F.col("nums") == F.col("o_nums")))).alias("sib_addr_exact"),
    )
    names = ["sib_n", "sib_maxp", "sib_name_jacc", "sib_glue_eq", "sib_addr_jacc", "sib_num_eq", "sib_addr_exact"]
    kept = ["s1", "pool", "p1", "p1_r1", "p1_gap1", "p1_r2", "p1_gap2", "p1_other_best", "sib_addr_conflict", "b_conf_elsewhere"]
    return rows.select(*kept).join(found, ["s1", "pool"], "left").select(*kept, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])


def competition(pairs: DataFrame, score: str) -> DataFrame:
    """Zero-based places, gaps to the best and numbers of pairs on both sides, and whether both are first."""
    out = pairs
    for key, tie, n in (("s1", "pool", 1), ("pool", "s1", 2)):
        w = W.partitionBy(key)
        out = out.withColumn(f"r{n}", F.row_number().over(w.orderBy(F.desc(score), tie)) - 1).withColumn(f"gap{n}", F.max(score).over(w) - F.col(score)).withColumn(f"n_c{n}", F.count("*").over(w))
    return out.withColumn("mutual", _flag((F.col("r1") == 0) & (F.col("r2") == 0)))


def logit_context(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """For each logit: place, gap, best, number over zero and second best within the s1; and its pool competition."""
    out = pairs
    for c in columns:
        w, v = W.partitionBy("s1"), W.partitionBy("pool")
        out = out.withColumn(f"{c}_rank", F.row_number().over(w.orderBy(F.desc(c), "pool"))).withColumn(f"{c}_max", F.max(c).over(w))
        out = out.withColumn(f"{c}_gap", F.col(f"{c}_max") - F.col(c)).withColumn(f"{c}_npos", F.count_if(F.col(c) > 0).over(w)).withColumn(f"{c}_second", F.max(F.when(F.col(f"{c}_rank") == 2, F.col(c))).over(w))
        out = out.withColumn(f"{c}_pool_gap", F.max(c).over(v) - F.col(c))
    return out

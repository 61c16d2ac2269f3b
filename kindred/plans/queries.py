"""The linkage operators over the driver's tables, as named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.functions import similarity as sim
from kindred.functions import text as tx
from kindred.operators import blocking as bl
from kindred.operators import decide as de
from kindred.operators import evaluate as ev
from kindred.operators import features as fe
from kindred.operators import partition as pt
from kindred.plans.adapter import entities, entity_gold, pairs, part_records, plain_tokens, s1_records, table
from kindred.sources import tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The reference's caps: candidates of a record, and pool records of a language that may share a term.
TOP_K, MAX_DF = 12, 3000
#: Of nearest vectors, of the union of passes, of a key's pool records, of new pairs; the least probability of a seed.
VECTOR_K, UNION_CAP, KEY_CAP, NEW_PAIRS, SURE = 20, 25, 200, 20, 0.7
TAUS = [round(0.01 * i, 2) for i in range(5, 96)]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _r(name: str, c=None):  # noqa: ANN001, ANN202
    return F.round(F.col(name) if c is None else c, 6).alias(name)


def _records(s: SparkSession, d: str) -> DataFrame:
    return entities(s, d).select("id", "is_s1", "country", plain_tokens(F.col("text")).alias("toks"))


def _token_candidates(s: SparkSession, d: str, k: int = TOP_K, max_df: int = MAX_DF) -> DataFrame:
    r = _records(s, d)
    return bl.token_top_k(r.where("is_s1"), r.where(~F.col("is_s1")), k, max_df)


def _gold(s: SparkSession, d: str) -> DataFrame:
    return pairs(s, d).where("label = 1").select("s1", "pool")


@query
def q01_source_union(s, d):  # noqa: ANN001, ANN201
    e = entities(s, d)
    parts = {k: e.where(F.col("source") == k).drop("source", "text") for k in (1, 2, 3)}
    return src.union_sources(parts).groupBy("source", "country").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query
def q02_gold_pairs(s, d):  # noqa: ANN001, ANN201
    lists = src.id_lists(entities(s, d).where("is_s1").select(F.col("id").alias("s1")), entity_gold(s, d))
    return src.explode_ids(lists, "s1", "ids").select("s1", F.col("pool").cast("long").alias("pool"))


@query
def q03_name_views(s, d):  # noqa: ANN001, ANN201
    return entities(s, d).select("id", tx.name_views(F.col("name")).alias("v")).select("id", "v.*")


@query
def q04_legal_forms(s, d):  # noqa: ANN001, ANN201
    t = plain_tokens(F.col("name"))
    return entities(s, d).select("id", tx.legal_family(t).alias("family"), tx.legal_set(t).alias("legal"))


@query
def q05_token_forms(s, d):  # noqa: ANN001, ANN201
    words = _records(s, d).select(F.explode("toks").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return words.select("t", "n", tx.skeleton(F.col("t")).alias("skel"), tx.stem(F.col("t")).alias("stem"), tx.fix_ocr(F.col("t")).alias("ocr"), tx.ocr_fold(F.col("t")).alias("folded"))


@query
def q06_address_views(s, d):  # noqa: ANN001, ANN201
    return entities(s, d).select("id", tx.address_views(F.col("addr"))).select("id", "a.*")


@query
def q07_site_names(s, d):  # noqa: ANN001, ANN201
    return table(s, d, "pages").select("page_id", tx.host_name(F.col("url")).alias("site"))


@query
def q08_hash_folds(s, d):  # noqa: ANN001, ANN201
    """Folds by crc32 of the id; SQL engines differ in having it, so rows only."""
    return s1_records(s, d).select("s1", pt.fold(F.col("s1"), 5).alias("fold"), pt.fold(F.reverse(F.col("s1").cast("string")), 4).alias("quarter"))


@query
def q09_stratified_split(s, d):  # noqa: ANN001, ANN201
    n = _gold(s, d).groupBy("s1").agg(F.count("*").alias("n"))
    rows = s1_records(s, d).join(n, "s1", "left").withColumn("many", F.least(F.coalesce("n", F.lit(0)), F.lit(4)))
    return pt.stratified(rows, ["country", "many"], F.col("s1")).select("s1", "country", "many", "split")


@query
def q10_term_counts(s, d):  # noqa: ANN001, ANN201
    return bl.term_counts(_records(s, d))


@query
def q11_idf_weights(s, d):  # noqa: ANN001, ANN201
    r = _records(s, d).where(~F.col("is_s1"))
    return bl.idf_postings(r, bl.rare_terms(r, MAX_DF)).select("id", "term", _r("w"))


@query
def q12_token_top_k(s, d):  # noqa: ANN001, ANN201
    return _token_candidates(s, d).select("s1", "pool", _r("score"), "rank")


@query
def q13_nearest_vectors(s, d):  # noqa: ANN001, ANN201
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("country"), F.col("embedding").cast("array<double>").alias("v"))
    own = F.col("id") % 10 == 0
    return bl.exact_nearest(e.where(own), e.where(~own), 5).select("s1", "pool", _r("score"), "rank")


@query
def q14_union_passes(s, d):  # noqa: ANN001, ANN201
    p = pairs(s, d)
    a = bl.top_k(p.withColumnRenamed("prob", "score"), "s1", [F.desc("score"), F.asc("pool")], TOP_K)
    b = bl.top_k(p.withColumnRenamed("prob2", "score"), "s1", [F.desc("score"), F.asc("pool")], VECTOR_K)
    return bl.union_passes({"tok": a, "emb": b}, UNION_CAP)


def _keys(s: SparkSession, d: str) -> DataFrame:
    r = part_records(s, d)
    sets = r.select("id", "is_s1", F.col("country").alias("part"), F.lit(0).alias("family"), F.array_join(F.array_sort(F.array_distinct("toks")), " ").alias("key"))
    words = r.select("id", "is_s1", F.col("country").alias("part"), F.lit(1).alias("family"), F.explode(bl.word_pairs(F.col("toks"))).alias("key"))
    glue = r.select("id", "is_s1", F.col("country").alias("part"), F.lit(2).alias("family"), F.substring(tx.ocr_fold(F.array_join("toks", "")), 1, 6).alias("key"))
    return sets.unionByName(words).unionByName(glue)


@query
def q15_key_pairs(s, d):  # noqa: ANN001, ANN201
    return bl.key_pairs(_keys(s, d), KEY_CAP)


@query
def q16_digit_deletion_pairs(s, d):  # noqa: ANN001, ANN201
    """Customers and suppliers of a nation whose numbers are equal but for one digit."""
    num = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("bigint").cast("string")
    side = lambda t, i, n, c, own: table(s, d, t).select(F.col(i).alias("id"), F.lit(own).alias("is_s1"), F.col(c).cast("string").alias("part"), F.lit(0).alias("family"), F.explode(F.transform(tx.digit_deletions(num(F.col(n))), lambda x: x.cast("string"))).alias("key"))
    both = side("customer", "c_custkey", "c_name", "c_nationkey", True).unionByName(side("supplier", "s_suppkey", "s_name", "s_nationkey", False))
    return bl.key_pairs(both, 20).select("s1", "pool")


@query
def q17_pair_bits(s, d):  # noqa: ANN001, ANN201
    p = bl.key_pairs(_keys(s, d), KEY_CAP)
    flag = lambda i: (F.shiftright("bits", i).bitwiseAND(F.lit(1))).cast("int")
    return p.groupBy(flag(0).alias("f_set"), flag(1).alias("f_pair"), flag(2).alias("f_glue")).agg(F.count("*").alias("n"))


@query
def q18_fillers(s, d):  # noqa: ANN001, ANN201
    return pt.fillers(_records(s, d), 5, 0.00075, 1.2)


@query
def q19_partitions(s, d):  # noqa: ANN001, ANN201
    c = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit(True).alias("is_s1"), F.col("c_mktsegment").alias("country"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise("").alias("state"), (F.col("c_acctbal") > 0).alias("addr_ok"))
    n = table(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit(False).alias("is_s1"), F.lit("BUILDING").alias("country"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey").cast("string")).otherwise("").alias("state"), (F.col("s_acctbal") > 0).alias("addr_ok"))
    return pt.assign(c.unionByName(n), 0.5).select("id", "part")


@query
def q20_same_names(s, d):  # noqa: ANN001, ANN201
    return pt.same_names(part_records(s, d)).select("id", "n_s1_same", "n_pool_same")


def _candidate_texts(s: SparkSession, d: str) -> DataFrame:
    e = entities(s, d).select("id", "name", "addr", plain_tokens(F.col("text")).alias("toks"))
    c = _token_candidates(s, d)
    a, b = e.select(F.col("id").alias("s1"), F.col("name").alias("name_a"), F.col("toks").alias("ta")), e.select(F.col("id").alias("pool"), F.col("name").alias("name_b"), F.col("toks").alias("tb"))
    return c.join(a, "s1").join(b, "pool")


@query
def q21_set_similarity(s, d):  # noqa: ANN001, ANN201
    t = _candidate_texts(s, d)
    return t.select("s1", "pool", _r("jaccard", sim.jaccard(F.col("ta"), F.col("tb"))), F.size(F.array_intersect("ta", "tb")).alias("shared"), _r("inside", sim.containment(F.col("ta"), F.col("tb"))))


@query
def q22_edit_distance(s, d):  # noqa: ANN001, ANN201
    t = _candidate_texts(s, d)
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9 ]", "")
    return t.select("s1", "pool", F.levenshtein(plain(F.col("name_a")), plain(F.col("name_b"))).alias("distance"))


@query
def q23_jaro_winkler(s, d):  # noqa: ANN001, ANN201
    p = part_records(s, d).select("country", "name").distinct()
    b = p.select("country", F.col("name").alias("other"), F.substring("name", 1, 3).alias("head"))
    return p.withColumn("head", F.substring("name", 1, 3)).join(b, ["country", "head"]).select("country", "name", "other", _r("jw", sim.jaro_winkler_similarity(F.col("name"), F.col("other"))))


@query
def q23b_string_ratios(s, d):  # noqa: ANN001, ANN201
    """Indel ratios of candidates' names; no SQL form, held against plain Python in tests."""
    t = _candidate_texts(s, d)
    a, b = (tx.ascii_fold(F.col(c)) for c in ("name_a", "name_b"))
    return t.select("s1", "pool", sim.ratio(a, b).alias("ratio"), sim.token_sort_ratio(a, b).alias("token_sort"), sim.token_set_ratio(a, b).alias("token_set"))


@query
def q24_idf_overlap(s, d):  # noqa: ANN001, ANN201
    r = _records(s, d)
    terms = bl.rare_terms(r.where(~F.col("is_s1")), MAX_DF)
    return bl.idf_overlap(_token_candidates(s, d).select("s1", "pool"), r, terms).select("s1", "pool", _r("idf_jaccard"), _r("max_shared_idf"), _r("pool_only_idf"))


@query
def q25_rank_gap(s, d):  # noqa: ANN001, ANN201
    out = fe.rank_gap(fe.rank_gap(fe.counts(pairs(s, d)), "s1", "prob"), "pool", "prob")
    return out.select("s1", "pool", "n_pool", "n_s1", "s1_rank", _r("s1_gap"), "pool_rank", _r("pool_gap"))


@query
def q26_s1_context(s, d):  # noqa: ANN001, ANN201
    return fe.s1_context(pairs(s, d)).select("s1", "pool", "rn", "best", _r("gap"), _r("total"), "n_half", "second")


@query
def q27_pool_context(s, d):  # noqa: ANN001, ANN201
    return fe.pool_context(pairs(s, d)).select("s1", "pool", "n_rivals", "best_other", _r("margin"), "is_top")


@query
def q28_mutual_best(s, d):  # noqa: ANN001, ANN201
    return fe.mutual_best(pairs(s, d), "prob").select("s1", "pool", "place_s1", "place_pool", "mutual")


@query
def q29_siblings(s, d):  # noqa: ANN001, ANN201
    return fe.siblings(pairs(s, d), "prob", 0.5, 0.02).select("s1", "pool", "n_sure", "sure_best", "elsewhere")


@query
def q30_one_to_one(s, d):  # noqa: ANN001, ANN201
    return de.one_to_one(pairs(s, d)).select("s1", "pool", "prob")


@query
def q31_threshold_ratio(s, d):  # noqa: ANN001, ANN201
    return de.threshold_ratio(pairs(s, d), 0.5, 0.6).select("s1", "pool", "prob")


@query
def q32_expected_prefix(s, d):  # noqa: ANN001, ANN201
    return de.expected_prefix(pairs(s, d), 1.5).select("s1", "pool", "prob")


@query
def q32b_exact_prefix(s, d):  # noqa: ANN001, ANN201
    """Length of the exact expected-F0.5 prefix; no SQL form, held against enumeration in tests."""
    lists = pairs(s, d).groupBy("s1").agg(F.reverse(F.array_sort(F.collect_list("prob"))).alias("p"))
    return lists.select("s1", de.exact_prefix_length(F.col("p"), 1.0).alias("k"))


@query
def q33_expected_keep(s, d):  # noqa: ANN001, ANN201
    return de.expected_keep(pairs(s, d), 1.25, 0.05, 0.1)


@query
def q34_logit_blend(s, d):  # noqa: ANN001, ANN201
    p = pairs(s, d)
    filled = F.when(F.col("prob").between(0.2, 0.8), de.blend([F.col("prob"), F.col("prob2")])).otherwise(F.col("prob"))
    return p.select("s1", "pool", _r("blended", de.blend([F.col("prob"), F.col("prob2")])), _r("filled", filled))


@query
def q35_logit_shift(s, d):  # noqa: ANN001, ANN201
    p = pairs(s, d).join(s1_records(s, d), "s1")
    return p.select("s1", "pool", _r("prob", F.when(F.col("country") == "1-URGENT", de.shifted(F.col("prob"), F.lit(-1.0))).otherwise(F.col("prob"))))


def _two_matchers(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = pairs(s, d)
    base = de.one_to_one(p.where("prob >= 0.95"))
    return base, p.where("prob >= 0.4"), de.one_to_one(p.where("prob2 >= 0.8"), "prob2")


@query
def q36_union_merge(s, d):  # noqa: ANN001, ANN201
    return de.union_merge(*_two_matchers(s, d))


@query
def q37_rescue_merge(s, d):  # noqa: ANN001, ANN201
    return de.rescue_merge(*_two_matchers(s, d), least=0.45)


@query
def q38_pseudo_labels(s, d):  # noqa: ANN001, ANN201
    return de.pseudo_labels(pairs(s, d), ["prob", "prob2"], 0.8, 0.6, 0.55)


def _scored(s: SparkSession, d: str) -> DataFrame:
    return ev.per_s1(s1_records(s, d), _gold(s, d), de.expected_prefix(de.one_to_one(pairs(s, d)), 1.0))


@query
def q39_macro_f05(s, d):  # noqa: ANN001, ANN201
    return _scored(s, d).select("s1", "n_gold", "n_pred", "tp", _r("f05"))


@query
def q40_score_report(s, d):  # noqa: ANN001, ANN201
    return ev.report(_scored(s, d), "country")


@query
def q41_threshold_sweep(s, d):  # noqa: ANN001, ANN201
    return ev.sweep(s1_records(s, d), _gold(s, d), de.one_to_one(pairs(s, d)), TAUS)


@query
def q42_best_threshold(s, d):  # noqa: ANN001, ANN201
    w = W.partitionBy("country").orderBy(F.desc("macro_f05"), F.asc("tau"))
    return ev.sweep(s1_records(s, d), _gold(s, d), de.one_to_one(pairs(s, d)), TAUS, ["country"]).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


@query
def q43_error_breakdown(s, d):  # noqa: ANN001, ANN201
    p = pairs(s, d)
    missed = p.where("label = 1 and prob < 0.2").groupBy("s1").agg(F.count("*").alias("n_missed"))
    return ev.errors(ev.per_s1(s1_records(s, d), _gold(s, d), de.threshold_ratio(p, 0.5, 0.6)), missed)


@query
def q44_churn(s, d):  # noqa: ANN001, ANN201
    p = pairs(s, d)
    return ev.churn(de.threshold_ratio(p, 0.5, 0.6), de.threshold_ratio(p, 0.5, 0.6, "prob2"))


@query
def q45_blocking_recall(s, d):  # noqa: ANN001, ANN201
    return ev.recall(entity_gold(s, d), _token_candidates(s, d), [1, 2, 3, 5, TOP_K])


@query
def q46_oracle_f05(s, d):  # noqa: ANN001, ANN201
    g = _gold(s, d)
    found = g.join(pairs(s, d).where("prob >= 0.2").select("s1", "pool"), ["s1", "pool"], "left_semi")
    return ev.report(ev.per_s1(s1_records(s, d), g, found))


@query
def q47_id_lists(s, d):  # noqa: ANN001, ANN201
    return src.id_lists(s1_records(s, d), de.threshold_ratio(pairs(s, d), 0.5, 0.6))


@query
def q48_validator(s, d):  # noqa: ANN001, ANN201
    lists = src.id_lists(pairs(s, d).select("s1").distinct(), pairs(s, d).where("prob > 0.5"))
    part = table(s, d, "part").where("p_size <= 45").select(F.col("p_partkey").alias("pool"))
    return src.validate(lists, s1_records(s, d).select("s1"), part)


@query
def q49_expansion(s, d):  # noqa: ANN001, ANN201
    r = part_records(s, d)
    keys = r.select("id", "is_s1", F.lit("name").alias("kind"), "name", F.concat_ws("|", "country", F.array_join(F.array_sort("toks"), " ")).alias("key")).drop("name").unionByName(r.select("id", "is_s1", F.lit("addr").alias("kind"), F.concat_ws("|", "country", F.substring("name", 1, 4)).alias("key")))
    known = bl.key_pairs(_keys(s, d), KEY_CAP)
    a, b = r.select(F.col("id").alias("s1"), F.col("toks").alias("ta")), r.select(F.col("id").alias("pool"), F.col("toks").alias("tb"))
    sure = de.one_to_one(known.join(a, "s1").join(b, "pool").select("s1", "pool", sim.jaccard(F.col("ta"), F.col("tb")).alias("prob"))).where(F.col("prob") >= SURE)
    seeds = r.where("is_s1").select(F.col("id").alias("s1"), F.col("id").alias("seed"), F.lit(0).alias("via")).unionByName(sure.select("s1", F.col("pool").alias("seed"), F.lit(1).alias("via")))
    return bl.expand(seeds, keys, known, 20, NEW_PAIRS).select("s1", "pool", "by_addr", "rank")


@query
def q50_cooccurrence(s, d):  # noqa: ANN001, ANN201
    """Words of a first line and the word of the last line that most often goes with them."""
    return pt.cooccurring(entities(s, d).select(plain_tokens(F.col("name")).alias("a"), plain_tokens(F.col("addr")).alias("b")), 5, 0.5)


@query
def q51_field_quality(s, d):  # noqa: ANN001, ANN201
    share = lambda c, p: _r(c, F.avg(F.col("name").rlike(p).cast("double")))
    return entities(s, d).groupBy("source", "country").agg(share("digits", "[0-9]"), share("mark", "[|#%&!]"), share("upper", "^[A-Z ]+$"), _r("words", F.median(F.size(F.split("name", " ")).cast("double"))))


@query
def q52_contested(s, d):  # noqa: ANN001, ANN201
    return pairs(s, d).where(de.contested(F.col("prob"), F.col("prob2"), 0.3, 0.8)).select("s1", "pool")


@query
def q53_orphan_mask(s, d):  # noqa: ANN001, ANN201
    """Candidates whose pool record's true s1 is outside the selected countries go."""
    p, chosen = pairs(s, d), s1_records(s, d).where(F.col("country") < "3").select("s1")
    owner = _gold(s, d).groupBy("pool").agg(F.min("s1").alias("owner"))
    lost = owner.join(chosen.withColumnRenamed("s1", "owner"), "owner", "left_anti").select("pool")
    return p.join(chosen, "s1", "left_semi").join(lost, "pool", "left_anti").select("s1", "pool")


@query
def q54_ranking_quality(s, d):  # noqa: ANN001, ANN201
    return ev.auc(pairs(s, d), "prob", "label")


@query
def q55_override(s, d):  # noqa: ANN001, ANN201
    p = pairs(s, d)
    return de.override(p.where("prob < 0.9"), p.where("prob > 0.7").select("s1", "pool", F.col("prob2").alias("prob")))


@query
def q56_first_score(s, d):  # noqa: ANN001, ANN201
    p = pairs(s, d)
    return de.first_of([p.where("prob2 > 0.8").select("s1", "pool", F.col("prob2").alias("prob")), p.select("s1", "pool", "prob")])


@query
def q57_country_threshold(s, d):  # noqa: ANN001, ANN201
    return de.by_country(pairs(s, d).join(s1_records(s, d), "s1"), {"1-URGENT": 0.6, "2-HIGH": 0.4}).select("s1", "pool", "prob")


@query
def q58_rarest_terms(s, d):  # noqa: ANN001, ANN201
    r = _records(s, d)
    return bl.rarest(r, bl.term_counts(r), 4).select("id", F.array_join("rare", " ").alias("rare"))


@query
def q59_partition_choice(s, d):  # noqa: ANN001, ANN201
    sizes = entities(s, d).groupBy(F.concat_ws("|", "country", "source").alias("part")).agg(F.count("*").alias("n"))
    return pt.choose(sizes, 0.4, F.col("part"))


@query
def q60_bootstrap(s, d):  # noqa: ANN001, ANN201
    """Interval of the macro F0.5 by hashed resampling; no SQL form."""
    return ev.bootstrap(_scored(s, d))


@query
def linkage(s, d):  # noqa: ANN001, ANN201
    """From records to scores: token candidates, Jaccard, a fixed logistic, one-to-one, expected F0.5, report."""
    e = entities(s, d)
    t = _candidate_texts(s, d).withColumn("j", sim.jaccard(F.col("ta"), F.col("tb")))
    scored = t.select("s1", "pool", F.round(sim.sigmoid(10 * F.col("j") + 2 * F.col("score") - 7), 9).alias("prob"))
    kept = de.expected_prefix(de.one_to_one(scored), 1.0)
    s1 = e.where("is_s1").select(F.col("id").alias("s1"), "country")
    return ev.report(ev.per_s1(s1, entity_gold(s, d), kept), "country")

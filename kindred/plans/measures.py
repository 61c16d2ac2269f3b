"""More linkage operators over the driver's tables, as named queries: record preparation, pair features, vectors and
block jobs, grids, samples and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import lexicon as L
from kindred.functions import similarity as sim
from kindred.functions import text as tx
from kindred.operators import blocking as bl
from kindred.operators import decide as de
from kindred.operators import evaluate as ev
from kindred.operators import explore as ex
from kindred.operators import pairs as pr
from kindred.operators import partition as pt
from kindred.operators import prepare as pp
from kindred.operators import vectors as vc
from kindred.plans.adapter import entities, entity_gold, pairs, part_records, plain_tokens, prepared, prepared_pairs, raw_records, s1_records, table
from kindred.sources import tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
COLUMNS = ["name", "source", "country", "toks", "ftoks", "words", "nums", "units", "has_addr", "family", "legal"]
EDGES = [0.0, 0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 1.0001]
GRID = ([0.3, 0.4, 0.5, 0.6, 0.7, 0.8], [0.0, 0.5, 0.8])


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _six(df: DataFrame) -> DataFrame:
    """Doubles to six digits."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


def _beside(s: SparkSession, d: str) -> DataFrame:
    return pr.beside(prepared_pairs(s, d), prepared(s, d), COLUMNS)


def _true(s: SparkSession, d: str) -> DataFrame:
    """Pairs of one type stand for true ones."""
    return _beside(s, d).where(F.element_at("a_ftoks", -1) == F.element_at("b_ftoks", -1))


def _gold(s: SparkSession, d: str) -> DataFrame:
    return pairs(s, d).where("label = 1").select("s1", "pool")


@query
def q61_pair_equality(s, d):  # noqa: ANN001, ANN201
    return pr.equality(_beside(s, d))


@query
def q62_pair_overlap(s, d):  # noqa: ANN001, ANN201
    return _six(pr.overlap(_beside(s, d), ["economy", "standard"]))


@query
def q63_pair_numbers(s, d):  # noqa: ANN001, ANN201
    return _six(pr.numbers(_beside(s, d)))


@query
def q64_pair_designators(s, d):  # noqa: ANN001, ANN201
    return pr.designators(_beside(s, d))


@query
def q65_pair_decoys(s, d):  # noqa: ANN001, ANN201
    return _six(pr.decoys(_beside(s, d)))


@query
def q66_pair_name_counts(s, d):  # noqa: ANN001, ANN201
    n = pt.same_names(prepared(s, d)).select("id", "n_s1_same", "n_pool_same")
    return _six(pr.name_counts(pr.beside(prepared_pairs(s, d), n, ["n_s1_same", "n_pool_same"])))


@query
def q67_invented_names(s, d):  # noqa: ANN001, ANN201
    """Two syllables for every other part, its own words for the rest."""
    at = lambda by: F.element_at(F.array(*[F.lit(x) for x in L.SYLLABLES]), (F.col("p_partkey") * by % len(L.SYLLABLES) + 1).cast("int"))
    words = F.when(F.col("p_partkey") % 2 == 0, F.array(F.concat(at(1), at(7)), F.lit("bolt"))).otherwise(plain_tokens(F.col("p_name")))
    return _six(table(s, d, "part").select(F.col("p_partkey").alias("id"), pr.invented_share(words).alias("share")))


@query
def q68_token_documents(s, d):  # noqa: ANN001, ANN201
    """A record's terms by field: skeletons of its name's words, its glued name, its address's words."""
    glued = F.array_join("toks", "")
    terms = F.concat(F.transform("toks", lambda t: F.concat(F.lit("n:"), tx.skeleton(t))), F.when(F.length(glued) >= 6, F.array(F.concat(F.lit("s:"), glued))).otherwise(F.array().cast("array<string>")), F.transform("words", lambda t: F.concat(F.lit("a:"), t)))
    return prepared(s, d).select("id", F.array_join(terms, " ").alias("terms"))


@query
def q69_words_by_sound(s, d):  # noqa: ANN001, ANN201
    words = entities(s, d).where("is_s1").select(plain_tokens(F.col("text")).alias("toks"))
    voc = pp.vocabulary(words)
    return pp.by_sound(voc).withColumn("voiced", F.lit(False)).unionByName(pp.by_sound(voc, True).withColumn("voiced", F.lit(True)))


@query
def q70_prepared_records(s, d):  # noqa: ANN001, ANN201
    """Names and addresses taken apart; no SQL form, held against hand cases in tests."""
    return pp.prepare(raw_records(s, d))


@query
def q71_without_fillers(s, d):  # noqa: ANN001, ANN201
    r = part_records(s, d)
    few = pt.fillers(r, 5, 0.00075, 1.2)
    return pp.without_fillers(r, few).select("id", F.array_join("toks", " ").alias("toks"), F.array_join("ftoks", " ").alias("ftoks"))


def _made_up(s: SparkSession, d: str) -> DataFrame:
    """Distinct words of a known syllable and an ending, which s1 records have or not."""
    at = F.element_at(F.array(*[F.lit(x) for x in L.SYLLABLES]), (F.col("p_partkey") % len(L.SYLLABLES) + 1).cast("int"))
    return table(s, d, "part").select(F.concat(at, F.split("p_name", " ")[0]).alias("word")).groupBy("word").agg(F.lit(0).alias("n_s1"))


@query
def q72_learned_syllables(s, d):  # noqa: ANN001, ANN201
    """The syllables learned from made-up words; no SQL form, held against hand cases in tests."""
    return s.createDataFrame([(x,) for x in pp.learned_syllables(_made_up(s, d))], "syllable string")


@query
def q73_unglued_words(s, d):  # noqa: ANN001, ANN201
    """Glued names cut by the vocabulary; no SQL form, held against hand cases in tests."""
    r = part_records(s, d)
    voc = pp.vocabulary(r.select("toks"))
    glued = r.select(F.array_join("toks", "").alias("word"))
    return pp.unglued(glued, voc).select("word", F.array_join("parts", " ").alias("parts"))


def _letters(s: SparkSession, d: str) -> DataFrame:
    return vc.tfidf(prepared(s, d).select("id", F.col("country").alias("part"), vc.letter_grams(F.col("toks")).alias("terms")))


def _places(s: SparkSession, d: str) -> DataFrame:
    return vc.tfidf(prepared(s, d).select("id", F.col("country").alias("part"), F.concat("words", "nums").alias("terms")))


@query
def q74_tfidf_vectors(s, d):  # noqa: ANN001, ANN201
    return _six(_letters(s, d).select("id", F.explode("terms").alias("t")).select("id", "t.term", "t.w"))


@query
def q75_combined_neighbours(s, d):  # noqa: ANN001, ANN201
    asks = F.expr("id % 3 = 0").alias("asks")
    v = vc.both(_letters(s, d), _places(s, d)).select("id", "part", "terms", asks)
    found = vc.nearest_among(v, 20, sides=prepared(s, d).select(F.col("country").alias("part"), asks))
    return found.select("s1", "pool", F.round("score", 5).alias("score"), "rank")


@query
def q76_block_job(s, d):  # noqa: ANN001, ANN201
    r = prepared(s, d).withColumn("part", F.col("country"))
    return _six(vc.block_job(r, prepared_pairs(s, d), True, 20, 30).drop("prob"))


@query
def q77_block_all(s, d):  # noqa: ANN001, ANN201
    """Jobs of all parts and of records without an address; its two jobs are q76's, held against each other in tests."""
    r = prepared(s, d).withColumn("state", F.lit("")).withColumn("addr_ok", F.col("has_addr"))
    r = pt.assign(r, 0.5)
    where = r.select("id", "part")
    keys = prepared_pairs(s, d)
    lost = keys.join(where.where(F.col("part").endswith("|POOL")).select(F.col("id").alias("pool")).hint("merge"), "pool", "left_semi")
    return _six(vc.block_all(r, keys.join(lost.select("s1", "pool").hint("merge"), ["s1", "pool"], "left_anti"), lost).drop("prob"))


@query
def q78_pair_similarities(s, d):  # noqa: ANN001, ANN201
    return _six(vc.similarities(prepared_pairs(s, d).select("s1", "pool"), _letters(s, d), _places(s, d)))


@query
def q79_candidates_together(s, d):  # noqa: ANN001, ANN201
    p = prepared_pairs(s, d)
    old = p.where("bits < 3").select("s1", "pool", "bits")
    new = p.where("bits = 3").select("s1", "pool", F.lit(32).alias("bits"), F.lit(1).alias("exp_sib"), (F.col("s1") % 2).alias("exp_kaddr"))
    return pp.concat_candidates([old, new], ["exp_sib", "exp_kaddr"])


@query
def q80_restored_candidates(s, d):  # noqa: ANN001, ANN201
    """Pairs back from id lists; ids that no table has are left out and counted by the validator (q48)."""
    lists = src.id_lists(s1_records(s, d), de.threshold_ratio(pairs(s, d), 0.5, 0.6))
    back = src.explode_ids(lists, "s1", "ids").select("s1", F.col("pool").cast("long").alias("pool"))
    return back.join(table(s, d, "part").where("p_size <= 45").select(F.col("p_partkey").alias("pool")), "pool", "left_semi").select("s1", "pool")


@query
def q81_decision_grid(s, d):  # noqa: ANN001, ANN201
    return ex.decision_grid(s1_records(s, d), _gold(s, d), de.one_to_one(pairs(s, d)), *GRID)


@query
def q82_cross_fit(s, d):  # noqa: ANN001, ANN201
    halves = s1_records(s, d).withColumn("half", (F.col("s1") % 2).cast("int"))
    return ex.cross_fit(ex.decision_grid(halves, _gold(s, d), de.one_to_one(pairs(s, d)), *GRID, by=["half"]))


def _scored(s: SparkSession, d: str, prob: str) -> DataFrame:
    return ev.per_s1(s1_records(s, d), _gold(s, d), de.threshold_ratio(pairs(s, d), 0.5, 0.6, prob))


@query
def q83_paired_bootstrap(s, d):  # noqa: ANN001, ANN201
    """Interval of the difference of two scores by one resampling of both; no SQL form."""
    b = _scored(s, d, "prob2").select("s1", F.col("f05").alias("other"))
    return ev.bootstrap(_scored(s, d, "prob").join(b, "s1").select("s1", (F.col("f05") - F.col("other")).alias("f05")))


@query
def q84_error_histogram(s, d):  # noqa: ANN001, ANN201
    p = pairs(s, d)
    return ex.error_histogram(p, de.threshold_ratio(p, 0.5, 0.6), EDGES)


@query
def q85_rescue_ceiling(s, d):  # noqa: ANN001, ANN201
    p = pairs(s, d)
    return ex.ceilings(s1_records(s, d), _gold(s, d), de.threshold_ratio(p, 0.5, 0.6), {"all": p, "over 0.3": p.where("prob >= 0.3"), "other over 0.8": p.where("prob2 >= 0.8")})


@query
def q86_added_stats(s, d):  # noqa: ANN001, ANN201
    p = pairs(s, d)
    base = de.one_to_one(p.where("prob >= 0.95"))
    return ex.added_stats(s1_records(s, d), _gold(s, d), de.rescue_merge(base, p.where("prob >= 0.4"), de.one_to_one(p.where("prob2 >= 0.8"), "prob2"), least=0.45))


@query
def q87_token_changes(s, d):  # noqa: ANN001, ANN201
    return ex.token_changes(_true(s, d))


@query
def q88_word_quality(s, d):  # noqa: ANN001, ANN201
    r = entities(s, d).select("id", "country", plain_tokens(F.col("text")).alias("toks"))
    return ex.word_quality(bl.term_counts(r), [2, 10, 100])


@query
def q89_candidate_quantiles(s, d):  # noqa: ANN001, ANN201
    return _six(ex.candidate_quantiles(pairs(s, d).join(s1_records(s, d), "s1"), "country"))


@query
def q90_source_crosstab(s, d):  # noqa: ANN001, ANN201
    return ex.crosstab(entities(s, d), "country", "source", [1, 2, 3])


@query
def q91_same_code(s, d):  # noqa: ANN001, ANN201
    r = prepared(s, d).withColumn("code", F.concat_ws("-", "country", F.get("nums", F.lit(0)))).where("has_addr")
    return _six(ex.same_code(r.where("is_s1"), r.where(~F.col("is_s1")), 6))


@query
def q92_parser_quality(s, d):  # noqa: ANN001, ANN201
    return ex.parser_quality(_true(s, d))


@query
def q93_normalisers(s, d):  # noqa: ANN001, ANN201
    stems = lambda c: F.transform(c, tx.stem)
    full = ("a_ftoks", "b_ftoks")
    short = tuple(F.filter(c, lambda t: ~t.isin("economy", "standard")) for c in full)
    return ex.compared(_true(s, d), {"raw": tuple(F.col(c) for c in full), "no fillers": short, "stems": (stems(short[0]), stems(short[1])), "names": (F.col("a_toks"), F.col("b_toks"))})


@query
def q94_key_recovery(s, d):  # noqa: ANN001, ANN201
    return ex.key_recovery(_true(s, d))


@query
def q95_universe(s, d):  # noqa: ANN001, ANN201
    r = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("state"), F.concat_ws(" ", "c_custkey", "n_name").alias("address"), (F.col("c_custkey") % 6 != 0).alias("has_addr"))
    return ex.universe(r, "A", {"dev": ["FRANCE", "CANADA", "INDIA", "CHINA"], "check": ["JAPAN", "IRAN", "IRAQ", "KENYA"]}).select("id", "split")


@query
def q96_sampled_s1(s, d):  # noqa: ANN001, ANN201
    return ex.sampled(s1_records(s, d), "s1", 200)


@query
def q97_thinned_pairs(s, d):  # noqa: ANN001, ANN201
    kinds = de.pseudo_labels(pairs(s, d), ["prob", "prob2"], 0.8, 0.6, 0.55)
    return ex.thinned(kinds, "kind", {"easy": 0.1, "decoy": 0.5}, F.concat_ws("-", "s1", "pool"))


@query
def q98_training_set(s, d):  # noqa: ANN001, ANN201
    """Contested pairs whole, easy and hard ones up to a cap, with their split by s1."""
    p = pairs(s, d)
    kind = F.when(de.contested(F.col("prob"), F.col("prob2"), 0.3, 0.7), "contested").when((F.col("prob") >= 0.5) != (F.col("label") == 1), "hard").otherwise("easy")
    rows = ex.capped(p.withColumn("kind", kind), "kind", {"hard": 500, "easy": 300}, F.concat_ws("-", "s1", "pool"))
    return rows.select("s1", "pool", "label", "kind", F.when(ex.hashed(F.col("s1"), 5) < 0.2, "held out").otherwise("fit").alias("split"))


@query
def q99_common_decisions(s, d):  # noqa: ANN001, ANN201
    p = pairs(s, d)
    return de.threshold_ratio(p, 0.5, 0.6).select("s1", "pool").intersect(de.threshold_ratio(p, 0.5, 0.6, "prob2").select("s1", "pool"))


@query
def q100_composed(s, d):  # noqa: ANN001, ANN201
    p = pairs(s, d).join(s1_records(s, d), "s1")
    return ex.compose(de.threshold_ratio(p, 0.5, 0.6), de.threshold_ratio(p, 0.5, 0.6, "prob2"), ["1-URGENT", "5-LOW"]).select("s1", "pool", "country")


@query
def q101_looked_up(s, d):  # noqa: ANN001, ANN201
    p = pairs(s, d)
    return ex.looked_up(p, p.where("prob2 >= 0.5").select("s1", "pool", F.col("prob2").alias("prob")), s1_records(s, d).where("country < '4'"))


@query
def q102_logit_context(s, d):  # noqa: ANN001, ANN201
    p = pairs(s, d).select("s1", "pool", F.round(sim.logit(F.col("prob")), 9).alias("l1"), F.round(sim.logit(F.col("prob2")), 9).alias("l2"))
    return _six(pr.logit_context(p, ["l1", "l2"]))


@query
def q103_competition(s, d):  # noqa: ANN001, ANN201
    return _six(pr.competition(pairs(s, d).select("s1", "pool", F.round(F.col("prob") + F.col("prob2"), 6).alias("score")), "score"))


@query
def q104_sibling_features(s, d):  # noqa: ANN001, ANN201
    return _six(pr.siblings(prepared_pairs(s, d), prepared(s, d)))


@query
def q105_stage_gain(s, d):  # noqa: ANN001, ANN201
    return ex.accepted({"stage1": _scored(s, d, "prob"), "stage2": _scored(s, d, "prob2")})


@query
def q106_record_texts(s, d):  # noqa: ANN001, ANN201
    return prepared(s, d).select("id", F.concat_ws("", F.lit("query: "), "name", F.lit(" | "), F.concat_ws(" ", "words", "nums")).alias("text"))


@query
def q107_comparison(s, d):  # noqa: ANN001, ANN201
    return ex.comparison(s1_records(s, d), _gold(s, d), de.threshold_ratio(pairs(s, d), 0.5, 0.6))


@query
def q108_error_sample(s, d):  # noqa: ANN001, ANN201
    texts = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return ex.error_sample(_gold(s, d), de.threshold_ratio(pairs(s, d), 0.5, 0.6).select("s1", "pool"), texts, 20)


@query
def q109_string_evidence(s, d):  # noqa: ANN001, ANN201
    """Token-set ratios of raw texts; no SQL form, held against plain Python in tests."""
    r = prepared(s, d).withColumn("addr", F.concat_ws(" ", "nums", "words")).withColumn("alias", F.when(F.col("id") % 4 == 0, F.element_at("ftoks", -1)).otherwise(""))
    return _six(pr.evidence(pr.beside(prepared_pairs(s, d), r, ["name", "addr", "nums", "alias"])))


@query
def q110_frame_views(s, d):  # noqa: ANN001, ANN201
    """All views of a record at once, as the normaliser writes them."""
    return src.normalised(prepared(s, d).select("id", F.concat_ws(" ", "name", F.lit("mfg | bros of"), "country").alias("name"), F.concat_ws(" ", "nums", "words").alias("address"), F.concat(F.lit(" "), "country").alias("country")))


@query
def q111_house_numbers(s, d):  # noqa: ANN001, ANN201
    """Numbers and what they are with any one digit less, without leading zeros."""
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(tx.one_digit_less((F.col("p_partkey") * 101).cast("string"), 2)), " ").alias("less"))


@query
def q112_field_profile(s, d):  # noqa: ANN001, ANN201
    e = entities(s, d)
    paired = entity_gold(s, d)
    matched = paired.select(F.col("s1").alias("id")).unionByName(paired.select(F.col("pool").alias("id"))).distinct().withColumn("matched", F.lit(True))
    return ex.field_profile(e.join(matched, "id", "left").na.fill(False, ["matched"]), L.FIELD_CHECKS, ["source", "country", "matched"])


@query
def q113_matches_histogram(s, d):  # noqa: ANN001, ANN201
    return ex.matches_histogram(s1_records(s, d), _gold(s, d))


@query
def q114_gold_facts(s, d):  # noqa: ANN001, ANN201
    part = table(s, d, "part").select(F.col("p_partkey").alias("pool"), F.concat((F.col("p_partkey") % 5 + 1).cast("string"), F.lit("-URGENT")).alias("country"))
    return ex.gold_facts(_gold(s, d), s1_records(s, d), part)

"""Operators on rows small enough to work out by hand, and queries against DuckDB."""

import itertools
import math
import os
import random
import struct
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kindred.functions import similarity as sim
from kindred.functions import text as tx
from kindred.operators import blocking, decide, evaluate, partition
from kindred.sources import tables

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "clean", "core", "alt"),
    [
        ("Harbor Tools LLC", "harbor tools llc", "harbor tools", ""),
        ("HARBOR TOOLS L.L.C.", "harbor tools llc", "harbor tools", ""),
        ("H4rbor T0ols Inc (ID: 55)", "h4rbor tools inc", "h4rbor tools", ""),
        ("Zed Ltd dba Nova Group", "nova group", "nova group", "zed"),
        ("Café Brûlé & Co", "cafe brule and co", "cafe brule", ""),
        ("", "", "", ""),
        (None, "", "", ""),
    ],
)
def test_name_views(spark, raw, clean, core, alt):
    df = spark.createDataFrame([(raw,)], "n string")
    r = df.select(tx.name_views(F.col("n")).alias("v")).select("v.*").first()
    assert (r.clean, r.core, r.alt) == (clean, core, alt)


def test_address_views(spark):
    r = spark.createDataFrame([("70 North Main Street, near City Hall, 560 001",)], "x string").select(tx.address_views(F.col("x"))).select("a.*").first()
    assert r.clean == "70 n mn st nr hall 560 001"
    assert (r.postal, r.nums, r.landmarks) == ("560001", "001 560 70", "001 560 hall")


def test_token_forms(spark):
    assert one(spark, tx.skeleton(F.col("t")), t="bhawan") == "vn"
    assert one(spark, tx.skeleton(F.col("t")), t="llimmitedd") == "lmtd"
    assert sorted(one(spark, tx.digit_deletions(F.col("t")), t="707")) == [7, 70, 77, 707]
    assert one(spark, tx.us_state(F.col("t")), t="New York") == "ny"


words = st.text("abcd ", max_size=12)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_string_metrics(a, b):
    expect = 1.0 if not a and not b else 2 * lcs(a, b) / (len(a) + len(b))
    assert sim.indel(a, b) == pytest.approx(expect)
    for f in (sim.indel, sim.partial, sim.token_sort, sim.token_set, sim.jaro_winkler):
        assert 0 <= f(a, b) <= 1
        assert f(a, b) == pytest.approx(f(b, a))


def test_decisions(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.9), (2, 2, 0.2)], "s1 long, pool long, prob double")
    assert {tuple(r)[:2] for r in decide.one_to_one(df).collect()} == {(1, 1), (2, 2)}
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate([0.9, 0.8, 0.2])] + [(2, 9, 0.05)], "s1 long, pool long, prob double")
    assert {r.pool for r in decide.expected_prefix(rows, 1.5).where("s1 = 1").collect()} == {0, 1}
    assert decide.expected_prefix(rows, 1.0).where("s1 = 2").count() == 0
    ratio = spark.createDataFrame([(1, i, p) for i, p in enumerate([0.9, 0.6, 0.5])], "s1 long, pool long, prob double")
    assert {r.pool for r in decide.threshold_ratio(ratio, 0.5, 0.6).collect()} == {0, 1}


def test_exact_prefix(spark):
    def brute(p, alpha):
        scores = [alpha * math.prod(1 - x for x in p)]
        for k in range(1, len(p) + 1):
            total = 0.0
            for truth in itertools.product((0, 1), repeat=len(p)):
                chance = math.prod(x if t else 1 - x for x, t in zip(p, truth, strict=True))
                tp = sum(truth[:k])
                total += chance * (1.25 * tp / (0.25 * sum(truth) + k) if tp else 0.0)
            scores.append(total)
        return max(range(len(scores)), key=lambda i: (round(scores[i], 12), -i))

    cases = [[0.9, 0.8, 0.2], [0.05], [0.6, 0.55, 0.5, 0.1], [0.99], [0.4, 0.4]]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, p array<double>").select("i", decide.exact_prefix_length(F.col("p"), 1.0).alias("k")).collect()
    assert {r.i: r.k for r in got} == {i: brute(c, 1.0) for i, c in enumerate(cases)}


def test_scores(spark):
    s1 = spark.createDataFrame([(1,), (2,), (3,)], "s1 long")
    gold = spark.createDataFrame([(1, 10), (1, 11)], "s1 long, pool long")
    pred = spark.createDataFrame([(1, 10), (3, 12)], "s1 long, pool long")
    got = {r.s1: r.f05 for r in evaluate.per_s1(s1, gold, pred).collect()}
    assert got == pytest.approx({1: 1.25 / 1.5, 2: 1.0, 3: 0.0})


def test_key_cap(spark):
    rows = [(i, True, "p", 0, "k") for i in range(2)] + [(100 + i, False, "p", 0, "k") for i in range(5)] + [(1, True, "p", 1, "z"), (100, False, "p", 1, "z")]
    keys = spark.createDataFrame(rows, "id long, is_s1 boolean, part string, family int, key string")
    assert blocking.key_pairs(keys, 5).count() == 10
    assert [tuple(r) for r in blocking.key_pairs(keys, 4).collect()] == [(1, 100, 2)]


def test_tsv_and_validator(spark, tmp_path):
    p = tmp_path / "s.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tThe "Best\t\tUS\n', encoding="utf-8")
    r = tables.read_tsv(spark, str(p)).first()
    assert (r.business_name, r.business_address) == ('The "Best', "")
    lists = spark.createDataFrame([(1, "5,6,5"), (1, ""), (7, "8")], "s1 long, ids string")
    found = {r.rule: r.n for r in tables.validate(lists, spark.createDataFrame([(1,), (2,)], "s1 long"), spark.createDataFrame([(5,), (6,)], "pool long")).collect()}
    assert found == {"duplicate_s1": 1, "duplicate_id": 1, "unknown_id": 1, "missing_s1": 1, "extra_s1": 1}


def test_models(spark):
    from kindred.operators import model

    rows = [(i % 40, i, (i % 7) / 7.0, float(i % 7 > 3)) for i in range(400)]
    pairs = spark.createDataFrame(rows, "s1 long, pool long, x double, label double")
    out, models = model.out_of_fold(pairs, ["x"], "label", folds=2, rounds=2, depth=2)
    assert out.count() == 400 and len(models) == 2
    assert evaluate.auc(out, "prob", "label").first().auc > 0.99


def test_stream(spark, tmp_path):
    from kindred.streaming import incremental

    schema = "pool long, part string, family int, key string"
    spark.createDataFrame([(5, "p", 0, "k"), (5, "p", 2, "z"), (6, "p", 0, "none")], schema).write.parquet(str(tmp_path / "in"))
    keys = spark.createDataFrame([(1, "p", 0, "k"), (1, "p", 2, "z")], "s1 long, part string, family int, key string")
    got = []
    q = incremental.start(incremental.link_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), keys), str(tmp_path / "cp"), lambda df, _: got.extend(tuple(r) for r in df.collect()))
    q.awaitTermination(60)
    assert got == [(1, 5, 5)]


@pytest.mark.parametrize("name", ["q06_address_views", "q16_digit_deletion_pairs", "q33_expected_keep", "q49_expansion", "linkage"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    expect = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expect.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, expect.select(*columns).fetchall()))


def documents(spark, tmp_path, rows):
    """A table of documents (id, text, lang, whether of the first source), as the queries read it."""
    spark.createDataFrame([(i, t, lang, "src0" if own else "src9", len(t)) for i, t, lang, own in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_of_long_names(spark, tmp_path):
    same = "harbor tools and marine supply of the north shore " * 4
    names = {1: same + "austin", 2: same + "austin", 3: same + "boston, port 7", 4: "harbor " + same + "reno", 5: "Harbor Tools"}
    d = documents(spark, tmp_path, [(i, n, "en", i == 1) for i, n in names.items()])
    plain = {i: "".join(c for c in n.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789 ") for i, n in names.items()}
    got = {(r.s1, r.pool): r.distance for r in entry.queries()["q22_edit_distance"](spark, d).collect()}
    assert got == {(1, i): edits(plain[1], plain[i]) for i in (2, 3, 4, 5)}


def test_candidates_of_frequent_texts(spark, tmp_path):
    rng = random.Random(5)
    common, rows = "harbor tools", [(i, " ".join(rng.choice("abcdefghijk") + str(rng.randint(0, 9)) for _ in range(6)), "en", i % 4 == 0) for i in range(120)]
    rows += [(1000, common, "en", True), *[(1001 + i, common, "en", False) for i in range(320)]]
    d = documents(spark, tmp_path, rows)
    pool, own = ({i: set(t.split()) for i, t, _, o in rows if o == side} for side in (False, True))
    df = Counter(t for toks in pool.values() for t in toks)
    idf = {t: math.log1p(len(pool) / n) for t, n in df.items() if n <= 3000}
    norm = lambda toks: math.sqrt(sum(idf[t] ** 2 for t in toks if t in idf)) + 1e-6
    expect = {}
    for a, ta in own.items():
        scores = [(-round(sum(idf[t] ** 2 for t in ta & tb if t in idf) / norm(ta) / norm(tb), 9), b) for b, tb in pool.items() if any(t in idf for t in ta & tb)]
        expect |= {(a, b): (k, pytest.approx(-s, abs=2e-6)) for k, (s, b) in enumerate(sorted(scores)[:12], 1)}
    got = {(r.s1, r.pool): (r["rank"], r.score) for r in entry.queries()["q12_token_top_k"](spark, d).collect()}
    assert [b for a, b in sorted(got) if a == 1000] == list(range(1001, 1013))
    assert got == expect
    recall = {r.k: r.recall for r in entry.queries()["q45_blocking_recall"](spark, d).collect()}
    assert recall == {k: pytest.approx(k / 320, abs=1e-6) for k in (1, 2, 3, 5, 12)}


@pytest.mark.parametrize("name", ["q41_threshold_sweep", "q42_best_threshold"])
def test_sweep_against_brute_force(spark, name):
    from kindred.plans import adapter

    pairs = [tuple(r) for r in adapter.pairs(spark, SF).select("s1", "pool", "prob", "label").collect()]
    country = {r.s1: r.country for r in adapter.s1_records(spark, SF).collect()}
    first = {}
    for s1, pool, p, _ in sorted(pairs, key=lambda x: (-x[2], x[0])):
        first.setdefault(pool, (s1, p))
    gold = {s: {b for a, b, _, y in pairs if a == s and y} for s in {p[0] for p in pairs}}
    curves = {}
    for i in range(5, 96):
        found = {}
        for pool, (s1, p) in first.items():
            if p >= i / 100:
                found.setdefault(s1, set()).add(pool)
        for s1, c in country.items():
            g, f = gold.get(s1, set()), found.get(s1, set())
            score = 1.25 * len(g & f) / (0.25 * len(g) + len(f)) if g or f else 1.0
            for by in (c, None):
                curves.setdefault(by, {}).setdefault(i / 100, []).append(score)
    curves = {by: {t: round(sum(x) / len(x), 6) for t, x in c.items()} for by, c in curves.items()}
    rows = entry.queries()[name](spark, SF).collect()
    if name == "q41_threshold_sweep":
        assert {r.tau: r.macro_f05 for r in rows} == pytest.approx(curves[None], abs=1.1e-6) and len(rows) == 91
    else:
        got = {r.country: (r.tau, r.macro_f05) for r in rows}
        assert got == {c: (min(t for t in x if x[t] == max(x.values())), pytest.approx(max(x.values()), abs=1.1e-6)) for c, x in curves.items() if c}


def parts(spark, tmp_path, rows):
    """A table of parts (id, name) of one brand; ids that 3 divides are of the first source."""
    spark.createDataFrame([(i, n, "b") for i, n in rows], "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_keys_of_many_records(spark, tmp_path):
    # 120 pool records share the first name, 201 the second
    pool = [i for i in range(1, 1000) if i % 3]
    d = parts(spark, tmp_path, [(3, "amber bolt"), (6, "cedar dowel"), *[(i, "amber bolt") for i in pool[:120]], *[(i, "cedar dowel") for i in pool[120:321]]])
    assert {tuple(r) for r in entry.queries()["q15_key_pairs"](spark, d).collect()} == {(3, i, 7) for i in pool[:120]}
    assert [tuple(r) for r in entry.queries()["q17_pair_bits"](spark, d).collect()] == [(1, 1, 1, 120)]


def test_expansion_through_matches(spark, tmp_path):
    # 4 is the match of 3 (three of four words); 5 to 26 share only its first letters, 30 competes for no record
    new = [i for i in range(5, 60) if i % 3][:15]
    d = parts(spark, tmp_path, [(3, "amber bolt copper"), (4, "zinc amber bolt copper"), (30, "violet wax"), *[(i, f"zinc w{i}") for i in new]])
    got = [tuple(r) for r in entry.queries()["q49_expansion"](spark, d).orderBy("s1", "rank").collect()]
    assert got == [(3, i, 1, k) for k, i in enumerate(new, 1)]


def test_union_of_long_passes(spark, tmp_path):
    rows = [(1, i, float(50 - i), round(i / 300, 4), "N") for i in range(1, 41)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double, l_discount double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = entry.queries()["q14_union_passes"](spark, str(tmp_path)).collect()
    # both passes rank records by their number
    assert {r.pool: (r.tok_rank, r.emb_rank, r.best_rank) for r in got} == {i: (i if i <= 12 else 999, i, i) for i in range(1, 21)}


def test_country_without_pool_rows(spark, tmp_path):
    rows = [(1, "only one harbor", "fr", True), (2, "harbor tools", "en", True), (3, "harbor tools", "en", False), (4, "only one", "de", False), (5, "nova group", "de", False)]
    d = documents(spark, tmp_path, rows)
    got = [(r.s1, r.pool, r["rank"]) for r in entry.queries()["q12_token_top_k"](spark, d).orderBy("s1", "rank").collect()]
    assert got == [(1, 4, 1), (1, 3, 2), (2, 3, 1)]
    score = lambda n, df: math.log1p(n / df)
    norm = math.sqrt(sum(score(3, 1) ** 2 for _ in range(3))) + 1e-6  # only, one, harbor: each in one of three pool records
    first = entry.queries()["q12_token_top_k"](spark, d).where("s1 = 1 and pool = 4").first()
    assert first.score == pytest.approx(2 * score(3, 1) ** 2 / norm / (math.sqrt(2 * score(3, 1) ** 2) + 1e-6), abs=2e-6)

    vectors = [(10, "7", [1.0, 0.0]), (20, "1", [0.0, 1.0]), (1, "1", [0.6, 0.8]), (2, "2", [0.8, 0.6]), (3, None, [0.0, 1.0]), (30, None, [0.0, 1.0])]
    v = spark.createDataFrame(vectors, "id long, country string, v array<double>")
    own = F.col("id") % 10 == 0
    near = blocking.exact_nearest(v.where(own), v.where(~own), 5, block=2).orderBy("s1", "rank").collect()
    assert [(r.s1, r.pool, r["rank"]) for r in near] == [(10, 2, 1), (10, 1, 2), (10, 3, 3), (20, 1, 1), (30, 3, 1), (30, 1, 2), (30, 2, 3)]


def test_bootstrap_of_a_thousand_rounds(spark):
    scores = {i: (i * 37 % 11) / 11 for i in range(1, 41)}
    means = []
    for k in range(1, 1001):
        weights = []
        for i in scores:
            h = 42
            for raw in (struct.pack("<q", i), struct.pack("<i", k), struct.pack("<i", 7)):
                h = xxhash.xxh64_intdigest(raw, seed=h)
            u = (h - (h >> 63 << 64)) % 1_000_003 / 1_000_003
            weights.append(sum(u >= t for t in (0.367879, 0.735759, 0.919699, 0.981012, 0.99634, 0.999406)))
        means.append(np.dot(weights, list(scores.values())) / sum(weights))
    got = evaluate.bootstrap(spark.createDataFrame(list(scores.items()), "s1 long, f05 double")).first()
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=1e-9)


def test_shares_of_a_stratum_are_rounded_in_decimals(spark):
    sizes = {"a": 45, "b": 30, "c": 85, "d": 90, "e": 1}
    rows = spark.createDataFrame([(i, k) for k, n in sizes.items() for i in range(n)], "i long, k string")
    got = Counter((r.k, r.split) for r in partition.stratified(rows, ["k"], F.col("i")).collect())
    for k, n in sizes.items():
        fit, dev = (7 * n + 5) // 10, (85 * n + 50) // 100
        assert [got[k, x] for x in ("fit", "dev", "lockbox")] == [fit, dev - fit, n - dev]

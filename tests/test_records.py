"""Record preparation, vectors, samples and sources against hand cases and plain versions."""

import gzip
import json
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kindred.functions import lexicon as L
from kindred.functions import records as rc
from kindred.functions import similarity as sim
from kindred.functions import text as tx
from kindred.operators import blocking
from kindred.operators import evaluate as ev
from kindred.operators import explore as ex
from kindred.operators import model
from kindred.operators import pairs as pr
from kindred.operators import prepare as pp
from kindred.operators import vectors as vc
from kindred.plans import measures
from kindred.sources import tables as src


@pytest.mark.parametrize(
    ("name", "words"),
    [
        ("HARBOR TOOLS L.L.C.", ["harbor", "tools", "llc"]),
        ("T00ls 4 U Inc (ID: 55)", ["tools", "4", "u", "inc"]),
        ("M/s Café & Sons", ["cafe", "and", "sons"]),
        ("A B C Traders d/b/a x5y", ["abc", "traders", "xsy"]),
        ("www.harbor-tools.com", ["harbor", "tools"]),
        ("Nova formerly known as Zed", ["nova", "zed"]),
        ("", []),
        (None, []),
    ],
)
def test_raw_words(name, words):
    assert rc.raw_words(name) == words


def test_designators():
    assert rc.name_words("The Harbor Pvt. Ltd. of लिमिटेड") == ["harbor"]
    assert rc.legal_names("Harbor Pvt. Ltd. Public") == ["limited", "private", "public"]
    assert rc.legal_names("X प्राइवेट लिमिटेड") == ["limited", "private"]
    assert [rc.legal_family(x) for x in ("A Corp", "A Co Inc", "A GmbH", "A", None)] == ["corp", "inc", "other", "", ""]


@pytest.mark.parametrize(
    ("address", "country", "state", "words", "nums", "units"),
    [
        ("707 North Main Street, Austin, TX", "US", "tx", "n main st austin", "707", ""),
        ("70 N Main St, Austin, Texas", "US", "tx", "n main st austin", "70", ""),
        ("Twenty First Floor, 12 Lake Dr, Reno, NV", "US", "nv", "lake dr reno", "12", "21"),
        ("PO Box 12 34, 7 bis rue de la Paix", "FR", "", "r paix", "7", ""),
        ("H No 12-3, Unit 5B, 007 Oak, Maharashtra", "India", "mh", "oak", "123 7", "5b"),
        ("#12, 3rd floor, null", "US", "", "", "12", "3"),
        ("Eleventh Avenue 9, twenty", "US", "", "av", "11 9 20", ""),
        ("no house 4, suite", "US", "", "", "4", ""),
        ("5 Lake, ap", "India", "aptg", "lake", "5", ""),
        ("5 Lake, महाराष्ट्र", "India", "mh", "lake", "5", ""),
        ("", "US", "", "", "", ""),
        (None, "US", "", "", "", ""),
    ],
)
def test_addresses(address, country, state, words, nums, units):
    parts = [[rc.transliterated(t) for t in p] for p in rc.address_parts(address)]
    got = rc.address(parts, country)
    assert (got["state"], " ".join(got["words"]), " ".join(got["nums"]), " ".join(got["units"])) == (state, words, nums, units)


def test_scripts_and_sounds(spark):
    assert [rc.script(x) for x in ("abc", "नमस्ते", "தமிழ்", "తెలుగు")] == [None, "devanagari", "tamil", "telugu"]
    assert [rc.transliterated(x) for x in ("abc", "लिमिटेड", "नमस्ते", "ਪੰਜਾਬ", "राज")] == ["abc", "limited", "namaste", "panjab", "ras"]
    words = ["consultancy", "industries", "nature", "apple", "gems", "xylophone", "", "sociation", "dubbing"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.skeleton_2(F.col("w")).alias("a"), tx.skeleton_2(F.col("w"), True).alias("b"))
    assert {r.w: (r.a, r.b) for r in df.collect()} == {w: (rc.sound_2(w), rc.sound_2(w, True)) for w in words}
    assert rc.sound_2("consultancy") == "knsltns"[:-1] and rc.sound_2("apple") == "_pl" and rc.sound_2("dubbing", True) == "tpnk"


def test_prepared_records(spark):
    rows = [(i, True, "Smart Consultants", "1 Oak Rd, Reno, NV", "US") for i in range(25)]
    rows += [(100, False, "స్మార్ట్ कंसल्टेंट लिमिटेड ॐ", "5 Lake, महाराष्ट्र", "India"), (101, False, None, None, "US"), (102, False, "Dr Services MD (ID: 7)", "", None), (103, False, "Zed", " , null", "US")]
    got = {r.id: r for r in pp.prepare(spark.createDataFrame(rows, "id long, is_s1 boolean, name string, address string, country string")).collect()}
    assert len(got) == len(rows)
    assert (got[0].toks, got[0].state, got[0].words, got[0].nums, got[0].addr_ok) == (["smart", "consultant"], "nv", ["oak", "rd", "reno"], ["1"], True)
    assert got[100].toks == ["smart", "kansaltent", "om"] and (got[100].state, got[100].name_indic, got[100].legal) == ("mh", True, ["limited"])
    assert (got[101].toks, got[101].has_addr, got[101].nums, got[101].family) == ([], False, [], "")
    assert (got[102].toks, got[103].has_addr, got[103].addr_ok) == ([], True, False)
    listed = spark.createDataFrame([("కంచి", "kanchi"), ("स्मार्ट", "clever")], "word string, means string")
    voc = spark.createDataFrame([("smart", 50), ("rare", 3)], "word string, n long")
    words = spark.createDataFrame([("स्मार्ट",), ("రారె",), ("लिमिटेड",)], "word string")
    means = {r.word: r.means for r in pp.resolved(words, voc).collect()}
    assert means == {"स्मार्ट": "smart", "రారె": "rare"[:3] + "e", "लिमिटेड": None}
    assert {r.word: r.means for r in pp.resolved(words, voc, listed).collect()}["स्मार्ट"] == "clever"


def test_syllables_and_glue(spark):
    known = frozenset(["kelo", "belo", "quo"])
    assert [rc.pieces(w, known) for w in ("kelobelo", "zarkelo", "zarquobelo", "zark", "abcdefgkelo", "quo")] == [None, "zar", "zar", None, None, None]
    assert rc.unglued("smarthayesxcels", {"smart": 50, "hayes": 30, "xcel": 100}) == ["smart", "hayes", "xcel"]
    assert rc.unglued("smartest", {"smart": 50}) == ["smartest"]
    words = [(f"zar{s}", 0) for s in L.SYLLABLES[:12]] + [(f"mun{a}zar", 0) for a in L.SYLLABLES[:6]] + [(f"the{s}", 0) for s in L.SYLLABLES[:12]] + [("the", 90)]
    got = pp.learned_syllables(spark.createDataFrame(words, "word string, n_s1 long"), least=6)
    assert set(got) - set(L.SYLLABLES) == {"zar", "mun"}  # "the" is a common word; "mun" is found once "zar" is known
    cut = pp.unglued(spark.createDataFrame([("smarthayes",), ("smart",), ("unknownword",)], "word string"), spark.createDataFrame([("smart", 50), ("hayes", 30), ("know", 9)], "word string, n long"))
    assert [(r.word, r.parts) for r in cut.collect()] == [("smarthayes", ["smart", "hayes"])]
    share = spark.createDataFrame([(["pyralyra", "bolt"],), ([],), (["pyra"],)], "t array<string>").select(pr.invented_share(F.col("t")).alias("s"))
    assert [r.s for r in share.collect()] == [0.5, 0.0, 0.0]


@pytest.mark.parametrize("block", [32_768, 7])
def test_nearest_vectors_against_all_pairs(spark, block):
    rng = random.Random(2)
    docs = [(i, f"p{i % 3}", [rng.choice("abcdefghij") for _ in range(rng.randrange(0, 9))]) for i in range(90)] + [(200, "lone", ["a"]), (201, "lone", ["b"])]
    df = spark.createDataFrame(docs, "id long, part string, terms array<string>").repartition(4)
    weights, vectors = defaultdict(dict), {}
    for part in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == part]
        df_ = Counter(t for d in own for t in set(d[2]))
        least = 2 if max(df_.values()) >= 2 else 1
        for i, _, terms in own:
            w = {t: (1 + math.log(n)) * (math.log((1 + len(own)) / (1 + df_[t])) + 1) for t, n in Counter(terms).items() if df_[t] >= least}
            norm = math.sqrt(sum(x * x for x in w.values()))
            weights[part][i] = vectors[i] = {t: x / norm for t, x in w.items()}
    made = vc.tfidf(df)
    assert {r.id: {t.term: round(t.w, 9) for t in r.terms} for r in made.collect()} == {i: {t: round(x, 9) for t, x in w.items()} for i, w in vectors.items()}
    got = sorted((r.s1, r["rank"], r.pool, round(r.score, 7)) for r in vc.nearest(made.where("id % 2 = 0"), made.where("id % 2 = 1"), 5, 0.05, block).collect())
    expect = []
    for part in weights.values():
        for i in (i for i in part if i % 2 == 0):
            scores = sorted((-round(sum(x * part[j].get(t, 0) for t, x in part[i].items()), 9), j) for j in part if j % 2)
            expect += [(i, k + 1, j, round(-s, 7)) for k, (s, j) in enumerate([x for x in scores if -x[0] > 0.05][:5])]
    assert got == sorted(expect)


def test_block_all(spark):
    rows = [(i, i % 3 == 0, "US", "US|POOL" if i % 3 and i % 5 == 0 else "US|*", ["harbor", f"tools{i % 4}"], ["oak"] if i % 5 else [], [str(i % 6)] if i % 5 else []) for i in range(60)]
    r = spark.createDataFrame(rows, "id long, is_s1 boolean, country string, part string, toks array<string>, words array<string>, nums array<string>")
    none = spark.createDataFrame([], "s1 long, pool long, bits int")
    got = vc.block_all(r, none, none, near=(4, 3), keep=(3, 2)).collect()
    n = Counter((x.s1, x.no_addr) for x in got)
    assert set(n.values()) <= {2, 3} and all(n[s, lost] == (2 if lost else 3) for s, lost in n)
    assert all((x.pool % 5 == 0) == x.no_addr for x in got)


def test_string_evidence(spark):
    row = (1, 2, "harbor tools", "tools harbor inc", "70 main st", "7 main street", ["70"], ["7"], "harbor")
    p = spark.createDataFrame([row], "s1 long, pool long, a_name string, b_name string, a_addr string, b_addr string, a_nums array<string>, b_nums array<string>, b_alias string")
    r = pr.evidence(p).first()
    assert (r.r_name_tset, r.r_name_eq, r.r_num_eq, r.r_num_conflict, r.alias_tset) == (1.0, 0.0, 0.0, 1.0, 1.0)
    assert r.r_addr_tset == sim.token_set("70 main st", "7 main street") and r.r_street_tset == sim.token_set("main st", "main street")
    assert r.name_addr == pytest.approx(0.6 + 0.4 * r.r_addr_tset)
    assert pr.evidence(p.withColumn("b_alias", F.lit(""))).first().alias_tset == -1.0


def test_samples_repeat(spark):
    rows = spark.range(3000).withColumn("kind", F.when(F.col("id") % 3 == 0, "easy").otherwise("hard"))
    a, b = ({r.id for r in ex.sampled(rows.repartition(n), "id", 100).collect()} for n in (1, 7))
    assert a == b and len(a) == 100
    thin = Counter(r.kind for r in ex.thinned(rows, "kind", {"easy": 0.2}, F.col("id")).collect())
    assert thin["hard"] == 2000 and 140 < thin["easy"] < 260
    assert Counter(r.kind for r in ex.capped(rows, "kind", {"easy": 10}, F.col("id")).collect()) == {"easy": 10, "hard": 2000}


def test_grid_and_halves(spark):
    rng = random.Random(5)
    pairs = [(s, p, round(rng.random(), 2), rng.randrange(2)) for s in range(40) for p in range(s % 5)]
    df = spark.createDataFrame(pairs, "s1 long, pool long, prob double, label int")
    s1 = spark.createDataFrame([(s, s % 2) for s in range(40)], "s1 long, half int")
    grid = ex.decision_grid(s1, df.where("label = 1").select("s1", "pool"), df, [0.2, 0.6], [0.0, 0.9], by=["half"])
    got = {(r.half, r.tau, r["ratio"]): r.macro_f05 for r in grid.collect()}

    def one(half, tau, share):
        scores = []
        for s in range(half, 40, 2):
            own = [(p, y) for x, _, p, y in pairs if x == s]
            best = max([p for p, _ in own], default=0)
            kept = [y for p, y in own if p >= tau and p >= share * best]
            gold = sum(y for _, y in own)
            scores.append(1.0 if not gold and not kept else 1.25 * sum(kept) / (0.25 * gold + len(kept)))
        return round(sum(scores) / len(scores), 6)

    assert got == {(h, t, r): one(h, t, r) for h in (0, 1) for t in (0.2, 0.6) for r in (0.0, 0.9)}
    for r in ex.cross_fit(grid).collect():
        assert r.fitted == max(v for k, v in got.items() if k[0] == 1 - r.half) and r.held_out == got[r.half, r.tau, r["ratio"]]


def test_paired_bootstrap(spark):
    same = spark.range(200).select(F.col("id").alias("s1"), F.lit(0.25).alias("f05"))
    r = ev.bootstrap(same, rounds=50).first()
    assert (r.low, r.high) == (0.25, 0.25)


def test_sources(spark, tmp_path):
    raw = gzip.compress(("id\tlist\n" + "".join(f"S1-{i}\tS2-{i},S3-{i}\n" for i in range(5000))).encode())
    for name, data in (("a", raw), ("b", gzip.compress(b"id\tlist\nx\t"))):
        cut = max(1, len(data) // 3)
        for k in range(0, len(data), cut):
            (tmp_path / f"{name}.gz.part{k // cut:02d}").write_bytes(data[k : k + cut])
    got = src.read_gzip_parts(spark, str(tmp_path), ["id", "list"])
    rows = {r.id: r.list for r in got.collect()}
    assert len(rows) == 5001 and rows["S1-4999"] == "S2-4999,S3-4999" and rows["x"] == ""
    path = tmp_path / "map.json"
    path.write_text(json.dumps({"a": "b", "n": 3}))
    assert {r.key: r.value for r in src.read_json_map(spark, str(path)).collect()} == {"a": "b", "n": "3"}
    src.write_json_map(src.read_json_map(spark, str(path)), str(tmp_path / "out"))
    assert {r.key: r.value for r in src.read_json_map(spark, str(tmp_path / "out")).collect()} == {"a": "b", "n": "3"}
    (tmp_path / "s.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"q" x\tnan\t\n')
    first = src.read_cached(spark, str(tmp_path / "s.parquet"), str(tmp_path / "s.tsv"))
    assert [tuple(r) for r in first.collect()] == [("S1-1", '"q" x', "", "")]
    first.withColumn("country", F.lit("US")).write.parquet(str(tmp_path / "s.parquet"))
    assert src.read_cached(spark, str(tmp_path / "s.parquet"), str(tmp_path / "s.tsv")).first().country == "US"


def test_id_list_files(spark, tmp_path):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "s1 string")
    targets = spark.createDataFrame([("S2-1",), ("S3-1",)], "pool string")
    cands = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S3-1")], "s1 string, pool string")
    head = ("source1_entity_id", "matched_entity_ids")
    lists = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "")], "s1 string, ids string").toDF(*head)
    src.write_id_lists(lists, str(tmp_path / "good"))
    assert src.validate_file(spark, str(tmp_path / "good"), head, ids("S1-1", "S1-2"), targets, cands, "S2-|S3-").collect() == []
    bad = "\t".join(head) + "\nS1-1\tS2-1,S2-1,S1-1\nS1-1\tS2-9\nbroken\nS1-9\tS3-1\n"
    (tmp_path / "bad.tsv").write_text(bad)
    got = {r.rule: r.n for r in src.validate_file(spark, str(tmp_path / "bad.tsv"), head, ids("S1-1", "S1-2"), targets, cands, "S2-|S3-").collect()}
    assert got == {"duplicate_s1": 1, "duplicate_id": 1, "self_match": 1, "unknown_id": 2, "missing_s1": 1, "extra_s1": 1, "wrong_prefix": 1, "not_candidate": 3, "malformed_row": 1}
    for text, rule in (("a,b\nS1-1,S2-1\n", "comma_separated"), ("x\ty\n", "wrong_header"), ("", "empty_file")):
        (tmp_path / f"{rule}.tsv").write_text(text)
        assert [r.rule for r in src.validate_file(spark, str(tmp_path / f"{rule}.tsv"), head, ids("S1-1"), targets).collect()] == [rule]


def test_score_parts(spark, tmp_path):
    scores = spark.range(1000).select((F.col("id") % 100).alias("s1"), F.col("id").alias("pool"), (F.col("id") / 1000).alias("prob"))
    src.write_score_parts(scores, str(tmp_path / "parts"), 300, 2)
    back = src.read_scores(spark, str(tmp_path / "parts"), 0.5)
    assert back.count() == 500 and "GreaterThanOrEqual(prob,0.5)" in back._jdf.queryExecution().executedPlan().toString()
    files = [f.name for f in (tmp_path / "parts").glob("*.zstd.parquet")]
    assert len(files) >= 4
    quoted = tmp_path / "q.tsv"
    quoted.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\n1\t"a\tb"\tx\tUS\n')
    assert src.read_tsv(spark, str(quoted), quoted=True).first().business_name == "a\tb"


def test_models(spark):
    rng = random.Random(7)
    rows = [(s, p, x := rng.random(), rng.random(), int(x + 0.2 * rng.random() > 0.6)) for s in range(120) for p in range(4)]
    df = spark.createDataFrame(rows, "s1 long, pool long, a double, b double, label int").coalesce(1).cache()
    out = model.stacker(df, ["a", "b"], "label", quarters=2, seeds=(1,), rounds=6, depth=2).collect()
    assert len(out) == len(rows) and sum((r.prob > 0.5) == r.label for r in out) > 0.85 * len(rows)
    oof, models = model.out_of_fold(df, ["a", "b"], "label", folds=2, rounds=3, depth=2)
    assert model.mean_of(models, df, ["a", "b"]).where("prob between 0 and 1").count() == len(rows)
    steps = model.calibrated(oof, "prob", "label").select("prob", "calibrated").orderBy("prob").collect()
    assert all(x.calibrated <= y.calibrated + 1e-9 for x, y in zip(steps[:-1], steps[1:], strict=True))


def test_small_forms(spark):
    df = spark.createDataFrame([("harbor tool works", ["1", "2"], ["2"], ["9"], "harbor tools", "harbour")], "core string, a array<string>, b array<string>, c array<string>, x string, y string")
    none = F.array().cast("array<string>")
    r = df.select(tx.acronym(F.col("core")).alias("acronym"), tx.acronym(F.lit("one")).alias("none"), sim.conflict(F.col("a"), F.col("b")).alias("same"), sim.conflict(F.col("a"), F.col("c")).alias("other"), sim.conflict(F.col("a"), none).alias("open"), sim.partial_ratio(F.col("x"), F.col("y")).alias("partial"), tx.ascii_fold(F.lit("Łódź Žižkov Ấm")).alias("fold")).first()
    assert (r.acronym, r.none, r.same, r.other, r.open, r.fold) == ("htw", "", 0, 1, -1, "odz zizkov am")  # a crossed letter is no letter with a mark
    assert r.partial == sim.partial("harbor tools", "harbour")


def plan(df):
    """What Spark would run, by the sizes it takes its inputs for."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")


def test_terms_of_records_are_not_broadcast(spark, tmp_path):
    spark.range(300).select(F.col("id"), (F.col("id") % 3).cast("string").alias("part"), F.array(F.concat(F.lit("t"), F.col("id") % 7)).alias("terms")).write.parquet(f"{tmp_path}/docs")
    joins = Counter(re.findall(r"(\w+Join) \[part#\d+(, \w+)?", plan(vc.tfidf(spark.read.parquet(f"{tmp_path}/docs")))))
    assert joins == {("SortMergeJoin", ", term"): 1, ("BroadcastHashJoin", ""): 2}  # broadcast: a row for each part


def test_vectors_of_records_are_not_broadcast_to_find_the_nearest(spark, tmp_path):
    spark.range(300).select(F.col("id"), (F.col("id") % 3).cast("string").alias("part"), F.array(F.concat(F.lit("t"), F.col("id") % 7)).alias("terms")).write.parquet(f"{tmp_path}/docs")
    v = vc.tfidf(spark.read.parquet(f"{tmp_path}/docs"))
    v = vc.both(v, v)
    joins = re.findall(r"BroadcastHashJoin \[part#\d+(, \w+)?", plan(vc.nearest(v.where("id % 3 = 0"), v.where("id % 3 <> 0"), 5)))
    assert joins and set(joins) == {""}


def test_vectors_are_planned_once_to_find_the_nearest(spark):
    tree = plan(measures.q75_combined_neighbours(spark, "/root/testdata/sf0.001"))
    assert tree.count("Generate explode") <= 1 + 2 * 3  # of queries and pool; of names and addresses: terms, their records, the most of them
    assert set(re.findall(r"BroadcastHashJoin \[(\w+)#\d+(, \w+)?", tree)) == {("part", "")}


def test_nearest_among_vectors_is_nearest_of_two_sides(spark):
    rows = [(i, "ab"[i % 2], [(t, 0.1 * (1 + (i * t + i) % 7)) for t in range(i % 5)], None if i == 9 else i % 3 == 0) for i in range(60)] + [(100, "c", [(1, 0.5)], True), (101, None, [(1, 0.5)], False)]
    v = spark.createDataFrame([(i, p, [(f"t{t}", w) for t, w in ts], a) for i, p, ts, a in rows], f"id long, part string, terms {vc.TERMS}, asks boolean")
    for block in (4, 1000):
        got = vc.nearest_among(v, 3, block=block).collect()
        assert sorted(got) == sorted(vc.nearest(v.where("asks").drop("asks"), v.where("not asks").drop("asks"), 3).collect()) and len(got) > 20


def test_pairs_and_their_vectors_are_not_broadcast(spark, tmp_path):
    at = f"{tmp_path}/docs"
    spark.range(300).select(F.col("id"), (F.col("id") % 3).cast("string").alias("part"), (F.col("id") % 2 == 0).alias("is_s1"), F.lit(0).alias("family"), (F.col("id") % 90).cast("string").alias("key"), F.array(F.concat(F.lit("t"), F.col("id") % 7)).alias("terms")).write.parquet(at)
    docs = spark.read.parquet(at)
    pairs, v = blocking.key_pairs(docs.drop("terms"), 200), vc.tfidf(docs.select("id", "part", "terms"))
    assert "BroadcastHashJoin" not in plan(pairs)
    joins = re.findall(r"BroadcastHashJoin \[part#\d+(, \w+)?", plan(vc.similarities(pairs, v, v)))
    assert joins and set(joins) == {""}


def test_records_of_a_block_job_are_not_broadcast(spark, tmp_path):
    at, words = f"{tmp_path}/records", F.array(F.concat(F.lit("word"), F.col("id") % 7))
    spark.range(300).select(F.col("id"), (F.col("id") % 3).cast("string").alias("part"), (F.col("id") % 2 == 0).alias("is_s1"), words.alias("toks"), words.alias("words"), words.alias("nums")).write.parquet(at)
    none = spark.createDataFrame([], "s1 long, pool long, bits int")
    joins = re.findall(r"BroadcastHashJoin \[part#\d+(, \w+)?", plan(vc.block_job(spark.read.parquet(at), none, True, 4, 3)))
    assert joins and set(joins) == {""}


def test_records_of_all_block_jobs_are_not_broadcast(spark):
    joins = set(re.findall(r"BroadcastHashJoin \[(\w+)#\d+(, \w+)?", plan(measures.q77_block_all(spark, "/root/testdata/sf0.001"))))
    assert joins and joins <= {("part", ""), ("country", "")}


def test_a_repeated_record_has_one_vector(spark):
    docs = spark.createDataFrame([(1, "a", ["x", "y"]), (1, "a", ["x", "y"]), (2, "a", ["x"]), (3, "a", []), (4, None, ["x"])], "id long, part string, terms array<string>")
    got = {r.id: [t.term for t in r.terms] for r in vc.tfidf(docs).collect()}
    assert got == {1: ["x"], 2: ["x"], 3: [], 4: []} and vc.tfidf(docs).count() == 4

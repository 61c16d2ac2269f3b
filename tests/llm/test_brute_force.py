"""Operators whose results SQL cannot give, against plain versions, and the rows that are seldom there: nulls,
empties, very long texts, ties, repeats, empty tables, columns that clash."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import ann, decontaminate, lines, packing, pii, quality, resemblance, shards, simhash, substrings, urls
from kindred.llm import shared as S
from kindred.llm.queries import URL_RULES, tokenizer_path
from kindred.llm.tokens import PieceTokenizer

NO_ID = -(2**63)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- nearest neighbours


def all_nearest(rows, d, k=20, every=20):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == d and np.isfinite(np.array(v, float)).all() and np.any(v)]
    ids = np.array([i for i, _ in fine])
    out = []
    for i, v in fine:
        if i % every == 0:
            score = np.array([(x * v).sum() for _, x in fine])
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out += [(i, r + 1, int(ids[j]), round(float(score[j]), 9)) for r, j in enumerate(order)]
    return sorted(out)


def found(df, **more):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.nearest(df, **more).collect())


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.RandomState(3)
    v = rng.randn(600, 16)
    v[300:500] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(600, None), (620, [0.0] * 16), (640, [float("nan")] * 16), (660, [1.0] * 3), (None, [1.0] * 16)]
    rows += [(20, v[20].tolist())] * 3 + [(40, v[41].tolist()), (40, v[300].tolist())]  # an id's equal and other vectors
    return rows + [(60, v[7].tolist())] * 30 + [(61, v[61].tolist())] * 45  # more rows of an id than neighbours asked for


@pytest.mark.parametrize("more", [{}, {"part": 64, "asks": 7}])
def test_nearest_exact_setting(spark, vectors, more):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("ids", F.lit(1)).repartition(4)
    assert found(df, visits=1.0, shortlist=None, **more) == all_nearest(vectors, 16)


def test_nearest_of_few(spark, vectors):
    few = vectors[:100:10]
    assert found(spark.createDataFrame(few, "vec_id long, embedding array<double>")) == all_nearest(few, 16)
    assert found(spark.createDataFrame(vectors[:0], "vec_id long, embedding array<double>")) == []


@pytest.mark.parametrize(("n", "clusters"), [(300, 0), (2000, 0), (8000, 0), (4000, 25)])
def test_nearest_recall(spark, n, clusters):
    rng = np.random.RandomState(n)
    v = rng.randn(n, 24) + (8 * rng.randn(clusters, 24)[rng.randint(0, clusters, n)] if clusters else 0)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for q, _, i, _ in found(df):
        got[q].add(i)
    shares = []
    for q in range(0, n, 20):
        score = v @ v[q]
        score[q] = -np.inf
        assert len(got[q]) == 20
        shares.append(len(got[q] & set(np.argsort(-score)[:20].tolist())) / 20)
    assert np.mean(shares) >= 0.93


# --- quality


def plain_score(model, text):
    """The forward pass for one text, passage by passage."""
    data = text.encode()
    g = lambda x: np.round(np.asarray(x, float) * 2**18) / 2**18
    w = {k: g(v) for k, v in model.w.items()}
    codes, weights = [], []
    for at in range(0, max(1, len(data)), quality.PASSAGE):
        own = data[at : at + quality.PASSAGE]
        x = np.zeros(quality.WIDTH)
        for i, b in enumerate(own):
            x[quality._FINE[b]] += 1
            if at + i + 2 < len(data):
                a, b, c = (int(quality._COARSE[y]) for y in data[at + i : at + i + 3])
                x[quality.FINE + a * 64 + b * 8 + c] += 1
        h = g(np.tanh((g(np.sqrt(x / max(1, len(own))).astype(np.float32)) - w["mean"]) @ w["enc"] + w["enc0"]))
        codes.append(h)
        weights.append(g(np.tanh(h @ w["att_v"]) / (1 + np.exp(-(h @ w["att_u"])))) @ w["att"])
    a = np.exp(np.array(weights) - max(weights))
    return 1 / (1 + np.exp(-((a / a.sum()) @ np.array(codes) @ w["out"] + w["out0"])))


def test_scores_are_of_the_text_alone(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(["alpha", "be", "gam", "zz", "ö", "the", "of", "Qu"]) for _ in range(n))
    rows = [(i, prose(rng.randrange(1, 300)) if i % 3 else "!! ".join(prose(60).upper().split())) for i in range(150)]
    rows += [(None, None), (None, "x"), (999, ""), (7, rows[7][1]), (7, "another"), (1000, prose(300_000))]
    table = docs(spark, rows).withColumn("score", F.lit("clash")).withColumn("quality", F.lit(5))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)] + [(3, 1), (3, 0), (10**6, 1)], "doc_id long, quality int")
    model = quality.fit(table, labels)
    runs = []
    for df in (table.coalesce(1), table.orderBy(F.desc("doc_id")).repartition(7)):
        runs.append(Counter((r.doc_id, r.t, r.s) for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), quality.score(F.col("text"), model).alias("s")).collect()))
    assert runs[0] == runs[1]
    for (_, t, s), _n in runs[0].items():
        raw = np.frombuffer(t.encode(), np.uint8)
        assert s == model.scores(*quality.passages(raw, np.array([0, len(raw)])))[0]
        if len(t) < 5000:
            assert abs(s - plain_score(model, t)) < 1e-9
    assert len(quality.classify(table, labels).collect()) == len(rows)
    one_class = labels.where("quality = 1").where("doc_id > 3")
    assert {r.score for r in quality.classify(table, one_class).collect()} == {1.0}
    assert quality.classify(table.limit(0), labels).collect() == []


# --- packing, token files


def test_packing_against_one_stream(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(60), " ".join(rng.choice(["a", "bb", "ccc ", "né", "12"]) for _ in range(rng.randrange(60)))) for _ in range(90)]
    rows += [(None, "of no id"), (None, None), (5, ""), (5, ""), (1000, "long text, " * 100_000)]
    tok = PieceTokenizer(tokenizer_path(), 2).tokenizer
    stream = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        key = int(packing.curve_keys(np.array(ids), np.array([0, len(ids)]), packing.projection_table(65_536))[0])
        stream.append((key, NO_ID if i is None else i, np.array(ids, "<u2").tobytes(), ids))
    total = sum(len(x[3]) for x in stream)
    ends = list(range(256, total + 1, 256))
    for b in range(7, -1, -1):
        if total - (ends[-1] if ends else 0) >= 1 << b:
            ends.append((ends[-1] if ends else 0) + (1 << b))
    expect, here, seq = [], 0, 0
    for _, i, _, ids in sorted(stream):
        start = 0
        while start < len(ids):
            n = min(len(ids) - start, ends[seq] - here)
            expect.append((i, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), len(ids), seq, here - (ends[seq - 1] if seq else 0)))
            start, here = start + n, here + n
            seq += here == ends[seq]
    table = docs(spark, rows).withColumn("key", F.lit("x")).withColumn("part", F.lit("y")).repartition(5)
    got = packing.pack(table, tokenizer_path(), 2, 256).collect()
    assert sorted((NO_ID if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == sorted(expect)


def test_token_files_read_in_part(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(300)] + [(1000, "long text, " * 200_000), (None, None), (4, "again")]
    tok = PieceTokenizer(tokenizer_path(), 2).tokenizer
    files = shards.write(docs(spark, rows).withColumn("ids", F.lit(1)).repartition(6), str(tmp_path / "new"), tokenizer_path(), 2, frame_bytes=500, file_bytes=1 << 20)
    assert len(files) > 1
    got = shards.read(spark, files).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, (*tok.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in rows)
    reader = shards.Reader(files[0][0])
    opened, whole = [], reader.frame
    reader.frame = lambda k: opened.append(k) or whole(k)
    wanted = int(reader.doc_ids[len(reader.doc_ids) // 2])
    assert {d for _, d, _ in reader.documents({wanted})} == {wanted}
    assert len(opened) <= 2 < len(reader.table)  # only frames that hold it


# --- decontamination


def covered(doc, item, least):
    """Words of an item under greedy tiles: the longest common run of free words is marked, again and again."""
    free_doc, free_item, total, n_tiles = [True] * len(doc), [True] * len(item), 0, 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and doc[d + n] == item[i + n] and free_doc[d + n] and free_item[i + n]:
                    n += 1
                best = max(best, (n, -i, -d))
        n, i, d = best[0], -best[1], -best[2]
        if n < least:
            return total, n_tiles
        total, n_tiles = total + n, n_tiles + 1
        free_doc[d : d + n] = free_item[i : i + n] = [False] * n


@pytest.mark.parametrize("places", [1 << 20, 3])
def test_tiles_against_all_runs(spark, places, monkeypatch):
    monkeypatch.setattr(decontaminate, "PLACES", places)
    rng = random.Random(12)
    word = lambda: rng.choice("abcd")  # few words, so that runs repeat and cross
    for _ in range(120):
        item = [word() for _ in range(rng.randrange(2, 25))]
        doc = [word() for _ in range(rng.randrange(0, 20))] + item[rng.randrange(len(item)) :] + [word()] + item[: rng.randrange(len(item))] + ["e"]
        named = lambda x: np.array([ord(c) for c in x], np.uint64)
        block = decontaminate.Benchmark([named("dcba" * 4), named(item)], 3)
        words = named(doc)
        got = (0, 0)
        for _, place, number in block.candidates(words, np.array([0, len(words)])):
            if 1 in block.reachable(number, 0.0):
                numbered = np.array([np.flatnonzero(block.vocabulary == x)[0] if x in block.vocabulary else -1 for x in words])
                t = decontaminate.tiles(numbered, block.items[1], decontaminate.common_runs(place, number, block.item_seeds[1]), 3)
                got = (sum(x[2] for x in t), len(t))
        assert got == covered(doc, item, 3), (doc, item)


def test_decontamination_rows(spark):
    item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (2, item), (None, "one two three four five six"), (4, ""), (5, None)], "item_id long, text string").withColumn("words", F.lit(1))
    rows = [(1, "x " * 600_000 + item), (None, item.upper()), (3, item), (3, item), (4, "w1 w2 w3 w4 w5 " * 50_000), (5, None), (6, "")]
    table = docs(spark, rows).withColumn("item_id", F.lit("clash")).withColumn("covered", F.lit(2))
    for block in (2_000_000, 1):
        got = Counter((r.doc_id, r.item_id, r.covered, r.n_tiles) for r in decontaminate.contaminated(table, bench, block_words=block).collect())
        assert got == Counter((d, i, 30, 1) for d in (1, None, 3) for i in (1, 2))
    assert decontaminate.contaminated(table.limit(0), bench).collect() == []
    assert decontaminate.contaminated(table, bench.limit(0)).collect() == []


# --- urls


def test_ranks_over_many_hosts(spark):
    rng = random.Random(8)
    names = [f"h{i}.{rng.choice(['net', 'org', 'io', 'com', 'de'])}" for i in range(300)]
    links = {h: {rng.choice(names) for _ in range(rng.choice([0, 0, 1, 2, 5]))} - {h} for h in names}
    rows = []
    for h in names:
        for i in range(rng.randrange(1, 4)):
            html = "".join(f'<a class=x HREF="https://{x.upper()}/p">' for x in sorted(links[h])[i::2])
            rows.append((len(rows), f"http://{h}/{rng.choice(['fr/', 'de/', ''])}x?q", html))
    rows += [(len(rows), None, f'<a href="http://{names[0]}/">'), (len(rows), "nothing", None), (3, rows[3][1], rows[3][2])]
    host = [r[1].split("://")[1].split("/")[0] if r[1] and "://" in r[1] else "" for r in rows]
    path = [r[1].split("://")[1].partition("/")[2].split("?")[0] if h else "" for r, h in zip(rows, host, strict=True)]
    edges = {(h, x) for r, h in zip(rows, host, strict=True) if h for x in names if x != h and r[2] and f"https://{x.upper()}/p" in r[2]}
    edges |= {(h, names[0]) for r, h in zip(rows, host, strict=True) if h and h != names[0] and r[2] and f"http://{names[0]}/" in r[2]}
    rule = ["net" if h.endswith(".net") else "org" if h.endswith(".org") and p.startswith("fr/") else None for h, p in zip(host, path, strict=True)]
    by = {"net": "block", "org": "allow", None: None}
    pages = defaultdict(list)
    for h, r in zip(host, rule, strict=True):
        pages[h].append(by[r])
    seed = {"distrust": [h for h, v in pages.items() if h and 2 * v.count("block") > len(v)], "trust": [h for h, v in pages.items() if h and 2 * v.count("block") <= len(v) and "allow" in v]}
    rank = {}
    for kind, seeds in seed.items():
        out = defaultdict(list)
        for a, b in edges:
            out[a if kind == "trust" else b].append(b if kind == "trust" else a)
        start = {h: 0.15 / len(seeds) for h in seeds}
        now = dict(start)
        for _ in range(10):
            after = defaultdict(float, start)
            for h, r in now.items():
                for x in out[h]:
                    after[x] += 0.85 * r / len(out[h])
            now = dict(after)
        whole = sum(now.values())
        rank[kind] = {h: r / whole for h, r in now.items()}
    bad = {h for h in names if rank["distrust"].get(h, 0) > rank["trust"].get(h, 0) + 1e-12}
    expect = Counter((r[0], h, "/" + p if h else "", None if x is None else "net/" if x == "net" else "org/fr/", by[x] or ("block" if h in bad else "allow")) for r, h, p, x in zip(rows, host, path, rule, strict=True))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("kind", F.lit(2))
    got = urls.filter_urls(df, URL_RULES).collect()
    assert Counter(tuple(r) for r in got) == expect
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}
    assert urls.filter_urls(df.limit(0), URL_RULES).collect() == []


# --- rows that are seldom there


def test_pii_rows(spark):
    many = " mail a.b@c.de, iban DE89370400440532013000, tel 212 555 1234, +1 (212) 555-1234 " * 3000
    rows = [(1, many), (1, "x"), (None, "ssn 123-45-6789"), (2, None), (3, "")]
    table = docs(spark, rows).withColumn("spans", F.lit("clash")).withColumn("likely", F.lit(1)).withColumn("pieces", F.lit(2))
    got = pii.find_pii(table).collect()
    assert Counter(len(r.spans) for r in got) == Counter([12_000, 0, 1, 0, 0])
    found = {r.doc_id: r.spans for r in got if r.spans}
    assert {many[s.start : s.end] for s in found[1]} == {"a.b@c.de", "DE89370400440532013000", "212 555 1234", "+1 (212) 555-1234"}
    assert [(s.kind, s.start, s.end, s.base) for s in found[None]] == [("ssn", 4, 15, False)]
    assert pii.digest(pii.find_pii(table.limit(0))).collect() == []


def test_lines_dealt_rows(spark):
    long = "\n".join(f"own {i}" for i in range(60_000))
    rows = [(i, f"shared\nown {i}") for i in range(12)] + [(None, None), (5, ""), (6, long), (6, long + "\nSHARED \t")]
    table = docs(spark, rows).withColumn("_text_key", F.lit("clash")).withColumn("_lines", F.lit(1)).withColumn("shard", F.lit(2))
    for most in (64 << 20, 0):
        got = lines.drop_shared_lines(table, 10, most_shipped=most)
        assert set(got.columns) == set(table.columns)
        assert Counter((r.doc_id, r._lines.kept, r._text_key) for r in got.collect()) == Counter((i, (t or "").replace("shared\n", "").replace("\nSHARED \t", ""), "clash") for i, t in rows)
    assert lines.drop_shared_lines(table.limit(0), 10, most_shipped=0).collect() == []


def test_substrings_of_long_texts(spark):
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    fresh = lambda n: "".join(map(chr, np.random.RandomState(n).randint(0x4E00, 0x9F00, n // 3).tolist()))
    a = fresh(700_000) + passage + fresh(600_011)
    b = fresh(524_287) + passage + fresh(1000)  # across the borders of what is handled at a time
    rows = [(1, a), (2, b), (2, b), (None, passage[:120]), (None, passage[100:230])]
    table = docs(spark, rows).withColumn("at", F.lit(1)).withColumn("ats", F.lit(1)).withColumn("kind", F.lit(1))
    texts = sorted(((NO_ID if i is None else i), t.encode()) for i, t in rows)
    first = {}
    for d, t in texts:
        for p in range(len(t) - 99):
            w = t[p : p + 100]
            if w in first:
                first[w] = min(first[w], (d, p))
            elif len(w.decode("utf-8", "ignore")) > 90:  # only windows over the passage can repeat
                first[w] = (d, p)
    expect = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 99):
            w = t[p : p + 100]
            if w in first and first[w] < (d, p):
                gone[p : p + 100] = True
        expect.append((d, len(t), int(gone.sum())))
    got = substrings.remove_repeats(table, keep_bytes=False).collect()
    assert sorted((NO_ID if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed) for r in got) == sorted(expect)
    assert sum(x[2] for x in expect) > 800


def test_fingerprints_of_long_texts(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(1000)) for _ in range(60_000))
    rows = [(1, long), (2, long.upper()), (3, "other " + long), (None, long), (4, None), (5, ""), (5, "")]
    got = simhash.near_duplicates(docs(spark, rows).withColumn("fp", F.lit(1)).withColumn("root", F.lit("x")), words=4).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(1, 1), (2, 1), (3, 1), (None, 1), (4, 4), (5, 4), (5, 4)])
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).collect() == []
    kept = resemblance.near_copies(docs(spark, rows)).collect()
    assert {(r.doc_id, r.component_id) for r in kept} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}

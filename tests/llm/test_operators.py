"""Corpus operators against brute force, on rows with nulls, empties, ties, repeats and planted copies."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import ann, decontaminate, lines, packing, pii, quality, resemblance, shards, simhash, substrings, urls
from kindred.llm import shared as S
from kindred.llm.components import components
from kindred.llm.queries import URL_RULES, tokenizer_path
from kindred.llm.tokens import PieceTokenizer

SF = "/root/testdata/sf0.001"
NO_ID = -(2**63)
VOCABULARY = ["alpha", "be", "gam", "zz", "ö", "the", "of", "Qu"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, score string, kind string")


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base, passages = prose(rng, 300), [prose(rng, 60) for _ in range(4)]
    out = [(i, prose(rng, rng.randint(0, 60)) + rng.choice(passages)[rng.randint(0, 80) :] + (base[rng.randint(0, 400) :] if i % 3 == 0 else "")) for i in range(80)]
    return [*out, (None, base), (None, None), (7, out[7][1]), (7, out[9][1]), (500, "a" * 900), (501, "a" * 99), (502, "a" * 100), (503, ""), (504, "ab" * 300), (499, "a" * 300)]


def test_substrings(spark, rows):
    first = {}
    texts = [(NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    for d, t in texts:
        for p in range(len(t) - 99):
            w = t[p : p + 100]
            first[w] = min(first.get(w, (d, p)), (d, p))
    expect = []
    for d, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            if first[t[p : p + 100]] < (d, p):
                gone[p : p + 100] = b"\1" * 100
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        expect.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    got = substrings.remove_repeats(docs(spark, rows)).collect()
    assert sorted((NO_ID if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == sorted(expect)
    assert all(len(r.spans) == r.n_spans and sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert substrings.remove_repeats(docs(spark, rows).limit(0)).count() == 0


def test_buckets_of_substrings_are_even():
    data = np.random.default_rng(4).integers(97, 123, 1 << 20).astype(np.uint8)
    name = substrings.instances(data, np.array([0, len(data)]), 100)[0]
    shares = np.bincount(substrings._bucket(name, 256), minlength=256)
    assert shares.max() < 2 * shares.mean() and len(np.unique(name)) > 0.9 * len(name)


def test_substrings_are_read_in_small_batches(spark):
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, text = spark.conf.get(conf), "".join(chr(97 + i * i % 23) for i in range(4000))
    source = S.documents(spark.range(6000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")))
    lean = S.lean(spark)
    table = S.bucketed_table(source, ["doc_id"], "texts", lean)
    sizes = table.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long")
    assert 0 < sizes.agg(F.max("n")).first()[0] < 3 << 20
    assert spark.conf.get(conf) == before and lean.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert substrings.remove_repeats(source.limit(3)).sparkSession.conf.get(conf) != before


def test_simhash(spark, rows):
    rng = random.Random(2)
    base = prose(rng, 200).split()
    more = [(1000 + i, " ".join([*base[:k], f"z{i}", *base[k + 1 :]])) for i in range(60) for k in [rng.randrange(200)]]
    every = [*rows, *more, (99, "  "), (98, "one two")]

    def fp(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in every]
    root = list(range(len(every)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(every)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(every):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    expect = Counter((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(every, fps, strict=True)))
    got = simhash.near_duplicates(docs(spark, every), words=4).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == expect


@pytest.mark.parametrize("block", [4096, 16])
def test_links_in_blocks(spark, block):
    rng = np.random.RandomState(0)
    f = rng.randint(0, 2**62, 300).astype(np.uint64)
    f = np.unique(np.concatenate([f, f[:40] ^ np.uint64(0b1011), f[:40] ^ np.uint64(1 << 40)]))
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(int(x),) for x in f], "fp long"), 4, block)).collect()}
    for x in f:
        near = [int(y) for y in f if int(x ^ y).bit_count() <= 4]
        assert all(got.get(int(y), int(y)) == got.get(int(x), int(x)) for y in near)


def test_near_copies_against_all_pairs(spark):
    rng = np.random.default_rng(17)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (0, 1, 4, 5, 6, 9, 30, 80, 200, 500, 500)]
    for base in list(texts[5:]):
        for edits in (1, 2, 3, 4, 6, 9, 12, 20) * 3:
            parts = base.split()
            for at in rng.integers(0, len(parts), edits):
                parts[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(parts))
    texts += [*texts[3:12], texts[8].upper(), f"  {texts[9]}\n", None, "", " \t"]
    ids = rng.permutation(len(texts)).tolist()
    given = [(i, t) for i, t in zip(ids, texts, strict=True)] + [(None, texts[8]), (None, None), (ids[20], "another text under an id that is taken"), (ids[9], texts[9])]
    df = spark.createDataFrame(given, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("n", F.lit(1)).repartition(5)
    sets = [(i, {" ".join(p[k : k + 5]) for k in range(max(1, len(p) - 4))} if (p := (t or "").lower().split()) else set()) for i, t in given if i is not None]
    root = {i: i for i, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if i == j or (5 * len(x & y) >= 4 * len(x | y)):
                root[max(top(i), top(j))] = min(top(i), top(j))
    for more in ({}, {"block": 7}, {"exact": True}):
        got = {r.doc_id: r.component_id for r in resemblance.near_copies(df, **more).collect()}
        assert got == {i: top(i) for i in root}
    assert resemblance.near_copies(df.limit(0)).collect() == []


def test_lines(spark):
    rng = random.Random(5)
    common = ["Shared line.", "  shared LINE.\t", "", "other"]
    every = [(i, "\n".join(rng.choice([*common, f"own {i}", f"own {i % 20}"]) for _ in range(rng.randint(1, 6)))) for i in range(60)] + [(None, None), (3, ""), (3, "Shared line.")]
    key = lambda x: x.encode().strip(lines.BLANK).lower()
    count = Counter(k for _, t in every for k in {key(x) for x in (t or "").split("\n")} - {b""})
    expect = Counter((d, len((t or "").split("\n")), sum(count[key(x)] >= 10 for x in (t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if count[key(x)] < 10)) for d, t in every)
    for most in (64 << 20, 0):  # arrays sent with the tasks, and questions dealt to the shards
        got = lines.drop_shared_lines(docs(spark, every), 10, most_shipped=most).collect()
        assert Counter((r.doc_id, r._lines.n_lines, r._lines.n_dropped, r._lines.kept) for r in got) == expect


def test_perfect_hash():
    key = np.unique(np.random.RandomState(1).randint(1, 2**62, 20_000).astype(np.uint64))
    a = lines.Arrays.load(lines.Arrays.build(key, key + np.uint64(5), np.arange(len(key))).dump())
    assert sorted(a.slots(key)) == list(range(len(key)))
    assert (a.count(key, key + np.uint64(5)) == np.arange(len(key))).all()
    assert not a.count(key + np.uint64(1), key).any()


def test_tokens_equal_the_library():
    rng = random.Random(1)
    letters = list("aAbé'.,- \n\t1२<|>sStTlLdDmM!’—́ \x85\x1c")
    texts = ["", "don't we'll x'sail a'b'c <|endoftext|>x <|ENDOFTEXT|> é, ≠ 12a3½ A.B.C... ,'s 9'8 a<b>c|d 'İstanbul", "x" * 3000] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(500)]
    tok = PieceTokenizer(tokenizer_path(), 2)
    raw = [t.encode() for t in texts]
    ids, at = tok.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*tok.tokenizer.encode(t, add_special_tokens=False).ids, 2], t


def test_shards_and_packing(spark, rows):
    tok = PieceTokenizer(tokenizer_path(), 2).tokenizer
    expect = Counter((d, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 2])) for d, t in rows)
    files = shards.write(docs(spark, rows), S.new_folder(spark, "ids"), tokenizer_path(), 2, frame_bytes=2000)
    got = sorted(shards.read(spark, files).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == expect
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    ids = [NO_ID if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert {r.doc_id for r in shards.read(spark, files, {3, 5}).collect()} == {3, 5}
    out = sorted(packing.pack(docs(spark, rows), tokenizer_path(), 2, 256, with_ids=True).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert sum(r.length for r in out) == sum(len(k[1]) * n for k, n in expect.items())
    fill = Counter()
    for r in out:
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert all(n == 256 or n & (n - 1) == 0 for n in fill.values())
    unique = {d for d, n in Counter(d for d, _ in rows).items() if n == 1}
    pieces = {}
    for r in sorted(out, key=lambda r: r.start):
        if r.doc_id in unique:
            pieces.setdefault(r.doc_id, []).extend(r.ids)
    assert all(tuple(pieces[d]) == k for d, k in expect if d in unique)
    assert shards.read(spark, shards.write(docs(spark, rows).limit(0), S.new_folder(spark, "ids"), tokenizer_path(), 2)).count() == 0
    assert packing.pack(docs(spark, rows).limit(0), tokenizer_path()).count() == 0


def test_damaged_frame(spark, rows, tmp_path):
    files = shards.write(docs(spark, rows), str(tmp_path), tokenizer_path(), 2)
    path = files[0][0]
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 0xFF
    open(path, "wb").write(raw)
    reader = shards.Reader(path)
    reader.table = reader.table.copy()
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(reader.documents())


def test_hilbert_neighbours():
    cells = np.array([[a, b] for a in range(16) for b in range(16)])
    order = cells[np.argsort(packing.hilbert(cells, 4))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_decontamination(spark):
    rng = random.Random(4)
    item = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None)], "item_id long, text string")
    noise = lambda: " ".join(f"n{rng.randrange(10**6)}" for _ in range(30))
    cases = [(10, f"{noise()} {' '.join(item)} {noise()}"), (11, " ".join(item[20:] + ["gap"] + item[:20]).upper()), (12, " ".join(item[:16])), (13, noise()), (14, None), (15, ""), (16, " ".join(x for a in zip(item, item[::-1], strict=True) for x in a)), (10, " ".join(item))]
    for block in (2_000_000, 3):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs(spark, cases), bench, block_words=block).collect()}
        assert set(got) == {(10, 1), (11, 1)}
        assert (got[11, 1].n_tiles, got[11, 1].covered, got[11, 1].coverage) == (2, 40, 1.0)


def test_quality(spark):
    rng = random.Random(6)
    every = [(i, prose(rng, 80) if i % 3 else "!! ".join(prose(rng, 60).upper().split())) for i in range(240)] + [(None, None), (9999, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality.classify(docs(spark, every), labels).collect()
    assert len(got) == len(every) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.95
    assert {r.score for r in quality.classify(docs(spark, every), labels.limit(0)).collect()} == {0.5}


def test_urls(spark):
    link = lambda *h: "".join(f'<a href="http://{x}/p">' for x in h)
    cases = [(1, "http://A.Example.NET/en/x?y", ""), (2, "http://example.net/fr/", None), (3, "https://x.example.com/de/1", ""), (4, None, None), (5, "no scheme", ""), (6, "http://neutral.io/a", link("bad.net", "worse.net")), (7, "http://q.org/fr/", link("fine.io")), (8, "http://fine.io#x", ""), (9, "http://bad.net/", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(cases, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/fr/", "net/", "block")
    assert got[3][2:] == ("example.com/de/", "block")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == (None, "block")  # links to blocked hosts
    assert got[8] == ("fine.io", "", None, "allow")  # linked from a trusted host


def test_pii(spark):
    text = "é iban DE89370400440532013000 a@b.c_d@e.f .@x.y 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 tel (212) 555-1234 ssn 123-45-6789"
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(docs(spark, [(1, text), (2, None), (3, "4111 1111-1111 1111 +1 (212) 555-1234"), (4, "9" * 5000 + "@" * 50)]))).collect()}
    assert got[1].spans == "email:30:35,email:35:41,email:42:47,ip:48:55,ip:56:63,ip:74:86,phone:91:105,iban:7:29,ssn:110:121"
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (3, 3, 0, 0)
    assert (got[2].spans, got[4].spans) == ("", "")
    assert got[3].spans == "card:0:19,phone:20:37"


def test_account_numbers_before_other_text(spark):
    de, gb = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    lines = {
        f"{de} Please": [(0, 27)],
        f"{de} BIC COBADEFF": [(0, 27)],
        f"é {de} 12 A": [(2, 29)],
        f"{de} {gb} {de}": [(0, 27), (28, 55), (56, 83)],
        f"AB12 {de}, {gb.replace(' ', '')}.": [(5, 32), (34, 56)],
        "ZZ11 XYZ " + de + " IS": [(9, 36)],
        "NO9386011117947 AND MT84MALT011000012345MTLCAST001S THEN": [(0, 15), (20, 51)],
        de + "x": [],
        "x" + de: [],
        de.replace("89", "88") + " Please": [],
        "DE89 3704 0044 0532 0130": [],
    }
    got = pii.find_pii(docs(spark, list(enumerate(lines)))).collect()
    assert {r.doc_id: [(x.start, x.end) for x in r.spans if x.kind == "iban"] for r in got} == dict(enumerate(lines.values()))


def test_pipeline(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = S.stage_table(stage(spark, kept, SF), name)
        assert after.columns == corpus_pipeline.COLUMNS and after.count() <= kept.count()
        kept = after
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.select("doc_id").collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [r for r in kept.collect() if any(b in r.text for b in bench)]


def bag(text):
    """Features of a text's passages, byte by byte."""
    data = text.encode()
    fine, runs = (np.zeros((max(1, -(-len(data) // quality.PASSAGE)), n)) for n in (quality.FINE, 512))
    for i, b in enumerate(data):
        fine[i // quality.PASSAGE, quality._FINE[b]] += 1
        if i + 2 < len(data):
            a, b, c = (int(quality._COARSE[x]) for x in data[i : i + 3])
            runs[i // quality.PASSAGE, a * 64 + b * 8 + c] += 1
    return np.sqrt(np.concatenate([fine, runs], 1) / np.maximum(1, fine.sum(1, keepdims=True))).astype(np.float32)


def covered(doc, item, least=5):
    """Words of an item under greedy tiles: the longest common run of free words is marked, again and again."""
    free_doc, free_item, total = [True] * len(doc), [True] * len(item), 0
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
            return total
        total += n
        free_doc[d : d + n] = free_item[i : i + n] = [False] * n


def test_pipeline_against_plain_python(spark):
    docs_of = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    seen = sorted(i for i in y if i in docs_of and zlib.crc32(str(i).encode()) % 4 != 2)
    bags = {i: bag(t) for i, t in docs_of.items()}
    model = quality.fit_bags([bags[i] for i in seen], np.array([y[i] for i in seen], np.float32))
    kept = {i: t for i, t in docs_of.items() if model.scores(bags[i], np.array([0, len(bags[i])]))[0] >= 0.7}

    key = lambda x: x.encode().strip(lines.BLANK).lower()
    count = Counter(k for t in kept.values() for k in {key(x) for x in t.split("\n")} - {b""})
    kept = {i: "\n".join(x for x in t.split("\n") if count[key(x)] < 10) for i, t in kept.items()}

    sets = {i: {" ".join(p[k : k + 5]) for k in range(max(1, len(p) - 4))} if (p := t.lower().split()) else set() for i, t in kept.items()}
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and group[i] != group[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    kept = {i: t for i, t in kept.items() if group[i] == i}

    words = lambda t: re.findall("[0-9a-z\u0080-\U0010ffff]+", t.lower())
    seeds = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    bench = [words(r.text or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leak = lambda doc: any(seeds(doc) & seeds(b) and covered(doc, b) >= 0.8 * len(b) for b in bench)
    kept = {i: t for i, t in kept.items() if not leak(words(t))}

    tok = PieceTokenizer(tokenizer_path(), 2).tokenizer
    stream = []
    for i, t in kept.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        stream.append((int(packing.curve_keys(np.array(ids), np.array([0, len(ids)]), packing.projection_table(65_536))[0]), i, ids))
    total = sum(len(ids) for *_, ids in stream)
    ends = list(range(4096, total + 1, 4096))
    for b in range(11, -1, -1):
        if total - (ends[-1] if ends else 0) >= 1 << b:
            ends.append((ends[-1] if ends else 0) + (1 << b))
    expect, here, seq = [], 0, 0
    for _, i, ids in sorted(stream):
        start = 0
        while start < len(ids):
            n = min(len(ids) - start, ends[seq] - here)
            expect.append((i, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), len(ids), seq, here - (ends[seq - 1] if seq else 0)))
            start, here = start + n, here + n
            seq += here == ends[seq]
    got = corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    assert 0 < len(kept) < len(docs_of)
    assert sorted(map(tuple, got)) == sorted(expect)

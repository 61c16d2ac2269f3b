"""SimHash near-duplicates up to a given resemblance: for texts that share 0.8 of their shingles, not only for
fingerprints that are nearly equal.

At a resemblance (Jaccard, of sets of word shingles) of 0.8 two 64-bit fingerprints differ in some ten bits, in
over twenty at times; no cut of 64 bits into bands leaves small buckets at such a radius. So

* buckets are those of equal rows of the texts' least hashes (ROWS to a band, BANDS bands: two texts at 0.8 meet
  in none with a chance of 1e-5, at 0.9 of 4e-10),
* within a bucket fingerprints are compared bit-sliced with a radius of 25,
* and what is left is decided exactly, on the whole sets.

Buckets and radius may miss a link with the chances given. exact=True leaves nothing to chance: a text's buckets are
then its least n - ceil(0.8 n) + 1 shingle hashes (of two linked texts' sets, these parts have one in common at
least), and the radius is 64. It moves a fifth of all shingles instead of BANDS numbers a text.

Large groups of copies must not become all their pairs. Texts of equal sets are one node. Then every node is first
tested against leaders only: the members of its buckets that share most buckets with others (an original shares
more of them than its copies do). Verified links make components. Only pairs of nodes that then still lie in
different components are compared in whole buckets and tested, so that no link between components is lost. Of
these, pairs go untested that cannot link by one of two bounds, so copies that were edited too much to link do not
meet all of each other: two sets share at most what either shares with any other; and they differ at least by the
differences of their sketches, which count the hashes that begin with each of some two patterns a shingle (edits fall
on different patterns, so little of a difference cancels out).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm import shared as S
from kindred.llm.components import components
from kindred.llm.simhash import UNIT, by_unit, in_blocks, majority, meetings, shingle_hashes

BANDS, ROWS = 16, 3
#: Odd multipliers: each orders the hashes in its own way.
_ORDERS = np.random.default_rng(20240317).integers(0, 2**63, BANDS * ROWS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits by which fingerprints of two texts at a resemblance of 0.8 may differ (more with a chance of some 1e-6).
RADIUS = 25
#: Nodes that are tested against one copy of a leader's set.
FOLLOWERS = 1024
#: Bits of a sketch's patterns at most.
SKETCH_BITS = 14
#: For bounds on counts in floating point.
_SLACK = 1e-6
#: Leaders that a node is tested against before whole buckets are compared.
LEADERS = 2


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes in ascending order."""
    return [np.unique(shingle_hashes(data[a:e].tobytes(), words)) for a, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def signatures(docs: DataFrame, words: int, prefix_for: float | None = None) -> DataFrame:
    """(doc_id, d1, d2, n, fp, bands): the digest and size of the text's set, its SimHash, and its buckets' keys
    (none for an empty set): those of its bands, or the part of its least hashes that a similarity asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = S.byte_column(b, "text")
            ids = b.column("doc_id")
            for i, j in S.chunks(off, S.CHUNK):
                sets = shingle_sets(data, off[i : j + 1], words)
                sizes = np.array([len(x) for x in sets], np.int64)
                flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])
                keys, counts = _bands(flat, at, sizes) if prefix_for is None else _prefixes(sets, sizes, prefix_for)
                digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64)))
                yield pa.record_batch([ids.slice(i, j - i), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sizes), pa.array(majority(flat, at).view(np.int64)), bands], names=["doc_id", "d1", "d2", "n", "fp", "bands"])

    return docs.mapInArrow(S.trimmed(run), "doc_id long, d1 long, d2 long, n long, fp long, bands array<long>")


def _bands(flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all bands of each text that has shingles, and how many each text has."""
    full = sizes > 0
    if not full.any():
        return np.empty(0, np.uint64), full * BANDS
    least = np.stack([np.minimum.reduceat(flat * a, at[:-1][full]) for a in _ORDERS], 1)
    return _band_keys(least).ravel(), full * BANDS


def _prefixes(sets: list[np.ndarray], sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each ascending set the least hashes among which any set this similar has one, and how many they are."""
    counts = np.where(sizes > 0, sizes - np.ceil(similarity * sizes - _SLACK).astype(np.int64) + 1, 0)
    return np.concatenate([x[:n] for x, n in zip(sets, counts.tolist(), strict=True)]), counts


def _band_keys(least: np.ndarray) -> np.ndarray:
    """One key of each band's least hashes."""
    out = np.zeros((len(least), BANDS), np.uint64)
    for t in range(BANDS):
        for r in range(ROWS):
            out[:, t] = (out[:, t] ^ least[:, t * ROWS + r]) * np.uint64(0x9E3779B97F4A7C15)
            out[:, t] ^= out[:, t] >> np.uint64(29)
    return out


def verified(edges: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those edges (a, b) whose texts resemble each other enough: each edge ships a's set to b's, and a b with very
    many edges has several copies of its set, for FOLLOWERS edges each."""
    edges = S.stage_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "resemble")
    # the end with more edges leads
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    degree = S.stage_table(ends.groupBy("node").agg(F.count("*").alias("n")), "resemble")
    da, db = degree.select(F.col("node").alias("a"), F.col("n").alias("na")), degree.select(F.col("node").alias("b"), F.col("n").alias("nb"))
    led = edges.join(da, "a").join(db, "b")
    swap = F.col("na") > F.col("nb")
    led = led.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.greatest("na", "nb").alias("nb"))
    led = led.withColumn("copy", F.pmod(F.xxhash64("a"), F.ceil(F.col("nb") / FOLLOWERS)).cast("int"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = S.byte_column(b, "text")
            for i, j in S.chunks(off, S.CHUNK):
                each = [x.tobytes() for x in shingle_sets(data, off[i : j + 1], words)]
                yield pa.record_batch([b.column("doc_id").slice(i, j - i), pa.array(each, pa.binary())], names=["node", "shingles"])

    held = docs.join(degree, docs["doc_id"] == degree["node"], "left_semi").mapInArrow(S.trimmed(sets), "node long, shingles binary")
    held = S.stage_table(held, "resemble")
    leaders = held.join(led.select(F.col("b").alias("node"), "copy").distinct(), "node").select(F.col("node").alias("b"), "copy", F.lit(None).cast("long").alias("a"), "shingles")
    followers = led.join(held, led["a"] == held["node"]).select("b", "copy", "a", "shingles")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leading = None, []
        for batch in batches:
            found = []
            columns = (batch.column(c).to_pylist() for c in ("b", "copy", "a"))
            for b, copy, a, raw in zip(*columns, batch.column("shingles"), strict=True):
                mine = np.frombuffer(raw.as_buffer(), np.uint64)
                if at != (b, copy):
                    at, leading = (b, copy), []
                if a is None:
                    leading.append(mine.copy())
                elif any(resemblance(mine, x) >= similarity for x in leading):
                    found.append((a, b))
            yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    units = leaders.unionByName(followers).repartition(S.partitions(docs.sparkSession), "b", "copy")
    return units.sortWithinPartitions("b", "copy", F.col("a").asc_nulls_first()).mapInArrow(S.trimmed(test), "a long, b long")


def node_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, d1, shingles) of some nodes: their sets, in ascending order, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = S.byte_column(b, "text")
            for i, j in S.chunks(off, S.CHUNK):
                raw = [x.tobytes() for x in shingle_sets(data, off[i : j + 1], words)]
                d1 = [int.from_bytes(xxhash.xxh3_128_digest(x)[:8], "little", signed=True) for x in raw]
                yield pa.record_batch([b.column("doc_id").slice(i, j - i), pa.array(d1, pa.int64()), pa.array(raw, pa.binary())], names=["node", "d1", "shingles"])

    ids = nodes.select(F.col("node").alias("id")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["id"], "left_semi").mapInArrow(S.trimmed(run), "node long, d1 long, shingles binary")


def own_shingles(sets: DataFrame) -> DataFrame:
    """(node, d1, own_shingles) of those nodes that have shingles which no other of the nodes has: their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = S.byte_column(b, "shingles")
            n = np.diff(off) // 8
            yield pa.record_batch([pa.array(np.repeat(b.column("node").to_numpy(), n)), pa.array(np.repeat(b.column("d1").to_numpy(), n)), pa.array(data.view(np.int64))], names=["node", "d1", "h"])

    each = sets.mapInArrow(S.trimmed(run), "node long, d1 long, h long")
    alone = each.groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("d1").alias("d1")).where(F.col("n") == 1)
    return alone.groupBy("node", "d1").agg(F.count("*").alias("own_shingles"))


def sketches(sets: DataFrame) -> DataFrame:
    """(node, d1, sketch): how many of a set's hashes begin with each of 2**k patterns, a byte each, with some two
    patterns a shingle; empty where a byte is not enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = S.byte_column(b, "shingles")
            out = []
            for x, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                h = data[x:e].view(np.uint64)
                k = min(SKETCH_BITS, max(4, (2 * len(h)).bit_length()))
                n = np.bincount((h >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
                out.append(n.astype(np.uint8).tobytes() if n.max() < 256 else b"")
            yield pa.record_batch([b.column("node"), b.column("d1"), pa.array(out, pa.binary())], names=["node", "d1", "sketch"])

    return sets.mapInArrow(S.trimmed(run), "node long, d1 long, sketch binary")


def least_difference(sketch: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At least how many elements are in one of two sets and not in the other: the differences of their sketches'
    counts, the longer one's neighbours added up."""
    k = np.array([len(x).bit_length() - 1 for x in sketch])
    common = np.minimum(k[a], k[b])
    out = np.zeros(len(a), np.int64)
    for bits in np.unique(common[common >= 0]).tolist():
        here = np.flatnonzero(common == bits)
        used, at = np.unique(np.concatenate([a[here], b[here]]), return_inverse=True)
        counts = np.stack([np.frombuffer(sketch[r], np.uint8).reshape(1 << bits, -1).sum(1, dtype=np.int32) for r in used.tolist()])
        step = max(1, (1 << 22) >> bits)
        for i in range(0, len(here), step):
            x, y = at[: len(here)][i : i + step], at[len(here) :][i : i + step]
            out[here[i : i + step]] = np.abs(counts[x] - counts[y]).sum(1)
    return out


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two ascending arrays without repeats; of two empty ones 1."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0.0 if len(b) else 1.0
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = RADIUS, block: int = 4096, doc_id: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """(doc_id, component_id) of all documents that have an id, each id once: the smallest id that is reachable
    over links between texts whose sets of word shingles have a Jaccard of similarity or more. BANDS, ROWS and
    RADIUS are laid out for 0.8 or more; exact holds for any similarity.

    A text of fewer words is one shingle; null texts and those without words are equal. Rows without an id take no
    part; rows that repeat an id are in one component. An empty table gives no rows.
    """
    docs = S.documents(docs, doc_id, text).where(F.col("doc_id").isNotNull())
    radius = 64 if exact else radius
    prints = S.stage_table(signatures(docs, words, similarity if exact else None), "resemble")
    nodes = S.stage_table(prints.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.min("n").alias("shingles"), F.min("fp").alias("fp"), F.first("bands").alias("bands")).drop("d2"), "resemble")
    copies = prints.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"))
    equal = prints.join(copies, ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where(F.col("a") != F.col("b"))

    rows = nodes.select("node", "d1", "shingles", "fp", F.posexplode("bands").alias("t", "key"))
    rows = rows.withColumn("t", F.lit(0)) if exact else rows
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    live = S.stage_table(rows.join(sizes, ["t", "key"]).select("t", "key", "n", "node", "d1", "shingles", "fp"), "resemble")

    weight = live.groupBy("node").agg(F.sum("n").alias("w"), F.min("fp").alias("fp"))
    ranked = live.select("t", "key", "node").join(weight, "node")
    leader = ranked.groupBy("t", "key").agg(F.min_by(F.struct("node", "fp", "w"), F.struct(-F.col("w"), F.col("node"))).alias("l"))
    first = live.join(leader, ["t", "key"]).where(F.col("node") != F.col("l.node")).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("l.fp"))) <= radius)
    first = first.select(F.col("node").alias("a"), F.col("l.node").alias("b"), F.col("l.w").alias("w")).distinct()
    order = Window.partitionBy("a").orderBy(F.desc("w"), "b")
    first = first.withColumn("i", F.row_number().over(order)).where(F.col("i") <= LEADERS).select("a", "b")
    links = S.stage_table(verified(first, docs, words, similarity), "resemble")

    found = components(links)
    rooted = live.join(found, "node", "left").select("t", "key", "node", "d1", "shingles", "fp", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("t", "key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where(F.col("r0") != F.col("r1")).select("t", "key")
    rooted = S.stage_table(rooted.join(mixed, ["t", "key"]), "resemble")
    shared = F.col("shingles") - F.coalesce("own_shingles", F.lit(0))
    sets = S.stage_table(node_sets(docs, rooted.select("node").distinct(), words), "resemble")
    able = rooted.join(own_shingles(sets), ["node", "d1"], "left").withColumn("shared", shared).where(F.col("shared") >= similarity * F.col("shingles") - _SLACK)
    able = S.stage_table(able.join(sketches(sets), ["node", "d1"]).select("t", "key", "fp", "node", "root", "shingles", "shared", "sketch"), "resemble")
    apart = able.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where(F.col("r0") != F.col("r1")).select("t", "key", "n")
    work = in_blocks(able.join(apart, ["t", "key"]), "node", block).select(*UNIT, "side", "fp", "node", "root", "shingles", "shared", "sketch")

    def compare(part: np.ndarray, unit: np.ndarray, sketch: list[bytes]) -> pa.RecordBatch:
        node, root, size, shared = part[6:10]
        out = [np.empty((2, 0), np.int64)]
        for a, b in meetings(unit, part[4], part[5].view(np.uint64), radius):
            least = similarity / (1 + similarity) * (size[a] + size[b]) - _SLACK  # shingles that a linked pair shares
            go = (root[a] != root[b]) & (np.minimum(shared[a], shared[b]) >= least) & (np.minimum(size[a], size[b]) >= least)
            a, b, least = a[go], b[go], least[go]
            go = size[a] + size[b] - least_difference(sketch, a, b) >= 2 * least
            out.append(np.stack([np.maximum(node[a[go]], node[b[go]]), np.minimum(node[a[go]], node[b[go]])]))
        pairs = np.unique(np.concatenate(out, 1), axis=1)
        return pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    rest = by_unit(work, compare, "a long, b long", blobs=True).distinct().join(first, ["a", "b"], "left_anti")
    more = verified(rest, docs, words, similarity)
    whole = components(links.unionByName(more).unionByName(equal))
    ids = prints.select("doc_id").distinct()
    return ids.join(whole, ids["doc_id"] == whole["node"], "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))

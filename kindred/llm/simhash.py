"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: a text's shingles of words are hashed (XXH64, seed 42); a bit of the 64-bit fingerprint is 1 if it
is set in over half the hashes. The bits are counted in byte lanes of 64-bit words, eight counters at a time.

Links: fingerprints that differ in at most `radius` bits. The 64 bits are cut into bands; two such fingerprints
agree in all but `radius` of the bands at least, so for every choice of that many bands they meet in the bucket
of the choice's bits. The number of bands follows from the number of distinct fingerprints, so that a bucket
holds few by chance; any number gives the same links. Within a bucket, fingerprints stand in bit planes, up to
64 to a word. Each fingerprint is compared with a word's all 64 at once: plane by plane, differing lanes are
added to vertical carry-save counters, and words all of whose lanes exceed the radius are abandoned. A bucket
with more than `block` fingerprints is cut into blocks, and each pair of blocks is a task's work of its own.
A bucket gives a spanning forest of its links, not all pairs; components of the union are those of all links.

Equal fingerprints are one node, so groups of exact copies, however large, add nothing to the comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import shared as S
from kindred.llm.components import components

#: A byte's bits in eight lanes, lowest bit in the lowest lane.
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)
_ALL = np.uint64(2**64 - 1)
_ONE = np.uint64(1)
#: Comparisons (a fingerprint with a word of 64) at a time.
TILES = 1 << 17


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included; a shorter text is one shingle, an empty one none."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    n = max(1, len(parts) - words + 1)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n]
    lasts = ends[min(words, len(parts)) - 1 :] - 1
    shingles = map(line.__getitem__, map(slice, starts.tolist(), lasts.tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)


def majority(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row's hashes (at: offsets) the bits set in over half of them."""
    sizes = np.diff(at)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes > 0)
    if not len(full):
        return out
    # segments of at most 255 hashes, so that byte lanes cannot overflow
    pieces = -(-sizes[full] // 255)
    owner = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(pieces)[:-1]]), pieces)
    starts = at[full][owner] + 255 * nth
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    firsts = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    for k in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, k]], starts)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), firsts, axis=0)
        bits = (2 * counts > sizes[full][:, None]).astype(np.uint64)
        out[full] |= (bits << np.arange(8, dtype=np.uint64)).sum(1, dtype=np.uint64) << np.uint64(8 * k)
    return out


def fingerprints(docs: DataFrame, words: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; 0 for a null text or one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = S.byte_column(b, "text")
            fps = []
            for i, j in S.chunks(off, S.CHUNK):
                each = [shingle_hashes(data[a:e].tobytes(), words) for a, e in zip(off[i:j].tolist(), off[i + 1 : j + 1].tolist(), strict=True)]
                fps.append(majority(np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])))
            whole = np.concatenate(fps) if fps else np.empty(0, np.uint64)
            yield pa.record_batch([b.column("doc_id"), pa.array(whole.view(np.int64))], names=["doc_id", "fp"])

    return S.documents(docs, doc_id, text).mapInArrow(S.trimmed(run), "doc_id long, fp long")


def within(planes: np.ndarray, word: np.ndarray, fps: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit-sliced comparison of each fingerprint with one word of up to 64.

    planes[b, w] holds bit b of the fingerprints in word w, one a lane. Gives the comparisons that are left and
    for each the lanes at most radius away. The vertical counters have as many planes as the radius needs; a lane
    whose counter overflows is dead, and every eight bits so is one whose counter is over the radius.
    """
    left = np.arange(len(fps))
    counts = [np.zeros(len(fps), np.uint64) for _ in range(max(1, radius.bit_length()))]
    dead = ~lanes[word]
    for b in range(64):
        carry = planes[b, word] ^ (np.uint64(0) - ((fps >> np.uint64(b)) & _ONE))
        for k, plane in enumerate(counts):
            counts[k], carry = plane ^ carry, plane & carry
        dead |= carry
        if b % 8 == 7:
            dead |= _exceeds(counts, radius)
            go = dead != _ALL
            if not go.all():
                left, word, fps, dead, *counts = (x[go] for x in (left, word, fps, dead, *counts))
                if not len(left):
                    break
    return left, ~dead


def _exceeds(counts: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius: a comparison with a constant, from the high bit down."""
    over, equal = np.zeros_like(counts[0]), np.full_like(counts[0], _ALL)
    for k in reversed(range(len(counts))):
        if radius >> k & 1:
            equal = equal & counts[k]
        else:
            over = over | (equal & counts[k])
            equal = equal & ~counts[k]
    return over


def meetings(bucket: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a, b) of one bucket at most radius bits apart, some at a time, a row with itself included. Rows are
    sorted by bucket; a row of side 1 is compared with those of side 0 only, and one of side 2 with all."""
    n = len(fps)
    fresh = np.ones(n, bool)
    fresh[1:] = bucket[1:] != bucket[:-1]
    group = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    place = np.arange(n) - first[group]
    size = np.bincount(group)
    words = -(-size // 64)
    base = np.concatenate([[0], np.cumsum(words)])
    word = base[group] + place // 64
    lane = (place % 64).astype(np.uint64)
    begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    planes = np.stack([np.bitwise_or.reduceat(((fps >> np.uint64(b)) & _ONE) << lane, begins) for b in range(64)])
    lanes = np.bitwise_or.reduceat(np.where(side != 1, _ONE, np.uint64(0)) << lane, begins)
    reach = words[group]
    total = np.concatenate([[0], np.cumsum(reach)])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + TILES, "right")) - 1)
        rows = np.repeat(np.arange(i, j), reach[i:j])
        against = base[group[rows]] + np.arange(len(rows)) - np.repeat(total[i:j] - total[i], reach[i:j])
        for k in range(0, len(rows), TILES):
            part, to = rows[k : k + TILES], against[k : k + TILES]
            left, hits = within(planes, to, fps[part], lanes, radius)
            a = part[left]
            while len(a):
                low = hits & (np.uint64(0) - hits)
                yield a, begins[to[left]] + np.log2(low.astype(np.float64)).astype(np.int64)
                hits = hits & ~low
                go = hits != 0
                left, a, hits = left[go], a[go], hits[go]
        i = j


def forest(bucket: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) of a spanning forest of the links within each bucket; see meetings()."""
    root = np.arange(len(fps))
    for a, b in meetings(bucket, side, fps, radius):
        _union(root, a, b)
    child = np.flatnonzero(root != np.arange(len(fps)))
    return fps[child], fps[root[child]]


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[i] and b[i]; afterwards every row of root names its tree's smallest row."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def bands_for(count: int, radius: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Cuts of the 64 bits, and the choices of bands that make buckets: the fewest bands for which a bucket
    holds about four fingerprints or less if they were spread evenly."""
    for n in range(radius + 1, radius + 6):
        edges = [64 * i // n for i in range(n + 1)]
        bands = list(zip(edges[:-1], edges[1:], strict=True))
        chosen = n - radius
        if count <= 4 << (64 * chosen // n) or n == radius + 5:
            break
    return bands, list(combinations(range(n), chosen))


def links(distinct: DataFrame, radius: int, block: int = 4096) -> DataFrame:
    """Edges (a, b) between fingerprints at most radius bits apart: enough of them to connect all that are
    linked. distinct has each fingerprint once, in fp."""
    spark = distinct.sparkSession
    bands, choices = bands_for(distinct.count(), radius)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for t, choice in enumerate(choices):
                key = np.zeros(len(fp), np.uint64)
                for k in choice:
                    lo, hi = bands[k]
                    key = (key << np.uint64(hi - lo)) | ((fp >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1))
                yield pa.record_batch([pa.array(np.full(len(fp), t, np.int32)), pa.array(key.view(np.int64)), b.column("fp")], names=["t", "key", "fp"])

    rows = distinct.mapInArrow(S.trimmed(keyed), "t int, key long, fp long")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    work = in_blocks(rows.join(sizes, ["t", "key"]), "fp", block).select(*UNIT, "side", "fp")

    def compare(part: np.ndarray, unit: np.ndarray) -> pa.RecordBatch:
        a, b = forest(unit, part[4], part[5].view(np.uint64), radius)
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return by_unit(work, compare, "a long, b long")


#: What names a bucket's pair of blocks.
UNIT = ["t", "key", "lo", "hi"]


def in_blocks(rows: DataFrame, by: str, block: int) -> DataFrame:
    """Rows of buckets (t, key) of n rows, dealt by a column's hash to blocks of about `block`: a row goes to every
    pair of blocks that has its own, as side 0 or 1, or 2 if both are its own."""
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("lo"), F.greatest(F.col("own"), o).alias("hi"), F.when(F.col("own") == o, 2).when(F.col("own") < o, 0).otherwise(1).alias("side")))
    return rows.withColumn("p", F.explode(pairs)).select("*", "p.lo", "p.hi", "p.side").drop("p", "blocks", "own")


def by_unit(work: DataFrame, compare: Callable[..., pa.RecordBatch], schema: str, blobs: bool = False) -> DataFrame:
    """compare(columns, unit numbers) over whole units; all columns are integers, the first four are UNIT. With blobs
    the last column is of bytes, which compare gets as a third argument, a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bytes_ = np.empty((len(work_names), 0), np.int64), []

        def flush(part: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
            unit = np.concatenate([[0], np.cumsum((part[:4, 1:] != part[:4, :-1]).any(0))])
            return compare(part, unit, raw) if blobs else compare(part, unit)

        for b in batches:
            held = np.concatenate([held, np.stack([b.column(c).to_numpy().astype(np.int64) for c in work_names])], 1)
            if blobs:
                bytes_ += b.column(b.num_columns - 1).to_pylist()
            if held.shape[1] == 0:
                continue
            last = np.flatnonzero((held[:4] != held[:4, -1:]).any(0))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last unit may go on in the next batch
            if cut:
                yield flush(held[:, :cut], bytes_[:cut])
                held, bytes_ = held[:, cut:], bytes_[cut:]
        if held.shape[1]:
            yield flush(held, bytes_)

    work_names = work.columns[:-1] if blobs else work.columns
    dealt = work.repartition(S.partitions(work.sparkSession), *UNIT).sortWithinPartitions(*UNIT)
    return dealt.mapInArrow(S.trimmed(run), schema)


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable
    over links), n_same (documents with this very fingerprint).

    A null text is empty and has fingerprint zero, like any without words. A null id takes part, and its row's
    component is the smallest id among the others, or null if there are none. Rows that repeat an id are all
    returned. An empty table gives no rows.
    """
    prints = S.stage_table(fingerprints(docs, words, doc_id, text), "simhash")
    distinct = S.stage_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_same")), "simhash")
    found = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", "n_same", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = S.stage_table(rooted.join(smallest, "root").select(F.col("fp").alias("f"), "component_id", "n_same"), "simhash")
    out = prints.join(table, prints["fp"] == table["f"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")

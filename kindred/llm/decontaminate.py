"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters, digits and characters beyond ASCII. The benchmark's words and all its
runs of `tile` words (seeds) are sent to the tasks. A task names each document word, keeps those in the
benchmark's vocabulary, and finds seeds by a running Karp-Rabin hash over word numbers. A document and an item
that share seeds enough to reach the threshold are tiled: the longest run of equal words not yet covered on
either side is marked, again and again, down to `tile` words; seeds give the places where runs can start, and
the running hash is confirmed word by word. The share of the item's words under tiles is its coverage, whatever
the order in which the document has them, so reordered passages are found.

The benchmark is read in blocks of items whose words stay under `block_words` (one item may be longer), one pass
over the documents for each. A block is sent when its pass begins and destroyed after it, so one block, and the next
one on the driver, is all that is held, whatever the benchmark's size.

Rows: a null or empty text has no words and is clean; so is any against an item under `tile` words, which no
tile can cover. Null document or item ids are kept as they are. Rows that repeat an id are each judged, and give
one result a pair: that of largest coverage, then of most tiles. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import shared as S
from kindred.llm import textkernel as K

_RADIX = np.uint64(K.BASE)
#: Pairs of places that are formed at once.
PLACES = 1 << 20


def word_names(batch: pa.RecordBatch, name: str, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of the lower-cased words of rows i to j, and the offsets of the rows in them."""
    low = pa.record_batch([pc.utf8_lower(batch.column(name).slice(i, j - i).cast(pa.string()))], names=["t"])
    data, off = S.byte_column(low, "t")
    start, end = K.words(data, off)
    return K.mix(K.Prefixes(data).name(start, end) + (end - start).astype(np.uint64)), np.searchsorted(start, off)


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `size` words."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * _RADIX + words[k : k + len(out)]
    return K.mix(out)


class Benchmark:
    """A block of items: their words as numbers, and where each seed occurs."""

    def __init__(self, items: list[np.ndarray], tile: int):
        self.tile = tile
        self.vocabulary = np.unique(np.concatenate([*items, np.empty(0, np.uint64)]))
        self.items = [np.searchsorted(self.vocabulary, x) for x in items]
        self.sizes = np.array([len(x) for x in items], np.int64)
        seeds = [rolling(x, tile) for x in items]
        every = np.concatenate([*seeds, np.empty(0, np.uint64)])
        self.seeds, number = np.unique(every, return_inverse=True)
        self.item_seeds = np.split(number, np.cumsum([len(x) for x in seeds])[:-1])
        order = np.argsort(number, kind="stable")
        self.owner = np.repeat(np.arange(len(items)), [len(x) for x in seeds])[order]
        self.place = np.concatenate([np.arange(len(x)) for x in seeds])[order]
        self.begin = np.searchsorted(number[order], np.arange(len(self.seeds) + 1))

    def candidates(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each row with seeds: row, its places of seeds, and the seeds' numbers."""
        h = rolling(words, self.tile)
        number = np.searchsorted(self.seeds, h)
        hit = np.flatnonzero(self.seeds[np.minimum(number, len(self.seeds) - 1)] == h) if len(self.seeds) else np.empty(0, np.int64)
        row = np.searchsorted(at, hit, "right") - 1
        inside = hit + self.tile <= at[row + 1]
        hit, row = hit[inside], row[inside]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]]) if len(row) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(row[a]), hit[a:b] - at[row[a]], number[hit[a:b]]

    def reachable(self, numbers: np.ndarray, coverage: float) -> np.ndarray:
        """Items of which these seeds, all their places together, cover enough. Each seed counts once, so this takes
        no more than the block's own places, however often a document repeats them."""
        numbers = np.unique(numbers)
        n = self.begin[numbers + 1] - self.begin[numbers]
        pick = np.repeat(self.begin[numbers] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        owner, place = self.owner[pick], self.place[pick]
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        reach = np.full(len(owner), self.tile, np.int64)
        same = owner[1:] == owner[:-1]
        reach[:-1][same] = np.minimum(np.diff(place)[same], self.tile)
        covered = np.bincount(owner, reach, minlength=len(self.sizes))
        return np.flatnonzero((covered > 0) & (covered >= coverage * self.sizes))


def common_runs(doc_at: np.ndarray, doc_seed: np.ndarray, item_seed: np.ndarray) -> np.ndarray:
    """Maximal runs of equal seeds along diagonals: rows (seeds in the run, place in the document, in the item).

    Pairs of places are formed at once while they are few; a seed that both sides repeat very often is followed from
    item place to item place instead, which holds one document's places at a time."""
    order = np.argsort(doc_seed, kind="stable")
    at, seed = doc_at[order], doc_seed[order]
    lo, hi = np.searchsorted(seed, item_seed, "left"), np.searchsorted(seed, item_seed, "right")
    n = hi - lo
    if n.sum() <= PLACES:
        d = at[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
        i = np.repeat(np.arange(len(item_seed)), n)
        order = np.lexsort((d, d - i))
        d, i = d[order], i[order]
        new = np.ones(len(d), bool)
        new[1:] = (np.diff(d) != 1) | (np.diff(i) != 1)
        first = np.flatnonzero(new)
        return np.stack([np.diff(np.concatenate([first, [len(d)]])), d[first], i[first]], 1)
    done = []
    last, length = np.empty(0, np.int64), np.empty(0, np.int64)
    for i in range(len(item_seed) + 1):
        now = np.sort(at[lo[i] : hi[i]]) if i < len(item_seed) else np.empty(0, np.int64)
        k = np.minimum(np.searchsorted(last, now - 1), max(0, len(last) - 1))
        goes_on = last[k] == now - 1 if len(last) else np.zeros(len(now), bool)
        ended = np.ones(len(last), bool)
        ended[k[goes_on]] = False
        n = length[ended]
        done.append(np.stack([n, last[ended] - n + 1, i - n], 1))
        length = np.where(goes_on, length[k] + 1, 1) if len(last) else np.ones(len(now), np.int64)
        last = now
    return np.concatenate(done)


def tiles(doc: np.ndarray, item: np.ndarray, runs: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in the document, place in the item, words), longest first.

    runs are those of common seeds. The longest is marked, what is left of the others is cut, and so on."""
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    whole = ((-n - tile + 1, i, d) for n, d, i in runs.tolist())
    open_ = [r for r in whole if (doc[r[2] : r[2] - r[0]] == item[r[1] : r[1] - r[0]]).all()]  # the hash is confirmed
    heapq.heapify(open_)
    done = []
    while open_:
        n, i, d = heapq.heappop(open_)
        n = -n
        both = free_doc[d : d + n] & free_item[i : i + n]
        if both.all():
            free_doc[d : d + n] = free_item[i : i + n] = False
            done.append((d, i, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], both.astype(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= tile:
                heapq.heappush(open_, (a - b, i + a, d + a))
    return done


def _blocks(benchmark: DataFrame, item_id: str, text: str, tile: int, block_words: int) -> Iterator[tuple[list, Benchmark]]:
    """The benchmark in blocks: item ids and the block's seeds."""
    ids: list = []
    items: list[np.ndarray] = []
    size = 0
    for row in benchmark.select(benchmark[item_id].cast("long").alias("i"), benchmark[text].cast("string").alias("t")).orderBy("i", "t").toLocalIterator():
        names, _ = word_names(pa.record_batch([pa.array([row.t or ""])], names=["t"]), "t", 0, 1)
        if size and size + len(names) > block_words:
            yield ids, Benchmark(items, tile)
            ids, items, size = [], [], 0
        ids.append(row.i)
        items.append(names)
        size += len(names)
    if items:
        yield ids, Benchmark(items, tile)


def contaminated(docs: DataFrame, benchmark: DataFrame, tile: int = 5, coverage: float = 0.8, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", block_words: int = 2_000_000) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, item_words, covered (words under tiles),
    coverage, n_tiles, tiles (places and length, in words, in the document and the item)."""
    source = S.documents(docs, doc_id, text)
    names = ["doc_id", "item_id", "item_words", "covered", "coverage", "n_tiles", "tiles"]
    schema = "doc_id long, item_id long, item_words long, covered long, coverage double, n_tiles long, tiles array<struct<doc_at: long, item_at: long, words: long>>"
    tiled = pa.list_(pa.struct([("doc_at", pa.int64()), ("item_at", pa.int64()), ("words", pa.int64())]))
    kinds = [pa.int64()] * 4 + [pa.float64(), pa.int64(), tiled]

    def against(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, block = sent.value
            for b in batches:
                _, off = S.byte_column(b, "text")
                rows = []
                for i, j in S.chunks(off, S.CHUNK):
                    words, at = word_names(b, "text", i, j)
                    for row, place, number in block.candidates(words, at):
                        raw = words[at[row] : at[row + 1]]
                        doc = None
                        for k in block.reachable(number, coverage).tolist():
                            if doc is None:
                                known = np.minimum(np.searchsorted(block.vocabulary, raw), len(block.vocabulary) - 1)
                                doc = np.where(block.vocabulary[known] == raw, known, -1)
                            item = block.items[k]
                            found = tiles(doc, item, common_runs(place, number, block.item_seeds[k]), tile)
                            covered = sum(t[2] for t in found)
                            if covered >= coverage * len(item):
                                rows.append((b.column("doc_id")[i + row].as_py(), ids[k], len(item), covered, covered / len(item), len(found), [dict(zip(("doc_at", "item_at", "words"), t, strict=True)) for t in sorted(found)]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        return source.mapInArrow(S.trimmed(run), schema)

    out = None
    blocks = _blocks(benchmark, item_id, text="text", tile=tile, block_words=block_words)
    block = next(blocks, None)
    while block is not None:
        sent, block = docs.sparkSession.sparkContext.broadcast(block), next(blocks, None)
        part = against(sent)
        if block is not None:  # one block after another: what was found is kept, what was sent goes
            part = S.stage_table(part, "tiles")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max_by(F.struct(*names[2:]), F.struct("covered", "n_tiles", "tiles")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")

"""Removing long repeated substrings: prefix doubling over the positions of all texts.

A byte goes if it lies in a string of `length` bytes that also starts earlier (smaller document id, or the same
document and an earlier start). Positions are ranked by growing prefixes: the rank of 2L bytes is that of the pair of
ranks of L bytes at a position and L bytes further on. Ranks are names: 128 bits that equal prefixes share wherever
they stand, made by the same pairing in every task, so a rank L bytes further on need not be joined to a position,
which would move all positions of all texts in each round. Spark deals (name, position) pairs to buckets by the
name, where they are sorted, and a position leaves as soon as its name is unique or past the threshold is known:

1. Prefixes of 32 bytes, doubled from single bytes. Of the 69 prefixes that start in a window of 100 bytes, the one
   of least mixed name stands for it, so equal windows choose equal prefixes at equal distances. A run of windows
   with one such prefix is an instance: about one for every 35 positions. Unique names leave with all their windows.
   If all instances of a name are equal to their last byte, all but the first are repeats and the name is done.
2. Prefixes of 64 bytes: pairs of names at offset 32. Every window of an instance holds one of the 64-byte strings
   that start 0, 36, 72 ... bytes before the standing prefix, so an instance is cut into parts by the string its
   windows hold, and the parts are ranked by its name in the same way. Chance repeats of a few words and half of
   each border leave.
3. Prefixes of 100 bytes, the threshold: pairs of names of 64 bytes at offset 36, at every position of the parts
   left. All but the first of a name are repeats.

Hot names: equal instances of a batch become one row before the shuffle, and an instance whose name has two
unequal instances in its batch needs no count from elsewhere, so it skips the bucket, leaving a marker. A bucket
thus gets at most one row of a name from each batch (some ten thousand documents), however often it occurs.

Memory: positions are handled a megabyte at a time, whatever a document's length; a bucket holds half
a shuffle partition's share of the instances at most. The texts are dealt to buckets of document id and checksum once;
what a round finds goes back to them, so they move once, and rows without an id are not one group.

Rows: a null or empty text has no bytes and no spans; a null id counts as the smallest. Rows that share an id
share its positions: a string does not start earlier in one than at the same start in the other. They are told apart
by 16 bits of their checksum; of two such rows whose bits are equal, each loses what the other repeats as well. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import shared as S
from kindred.llm import textkernel as K

#: Length of the first ranked prefixes.
GRAM = 32
#: Positions handled at a time.
STRIDE = 1 << 19
#: Low bits of a packed (name, place) that hold the place.
_PLACE = np.uint64((1 << 24) - 1)
#: Instances or positions of which a batch speaks, give or take a stretch of text.
LOT = 1 << 20
FRESH, OPEN, REPEAT = 0, 1, 2

# A span packed in one number: start in the document, distance to the standing prefix and number of windows
# (8 bits each), row check (16 bits).
WINDOWS, CHECK = 8, 16


def _pack(start: np.ndarray, distance: np.ndarray, windows: np.ndarray, check: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << (2 * WINDOWS + CHECK)) | (distance.astype(np.int64) << (WINDOWS + CHECK)) | (windows.astype(np.int64) << CHECK) | check


def _start(at: np.ndarray) -> np.ndarray:
    return at >> (2 * WINDOWS + CHECK)


def _distance(at: np.ndarray) -> np.ndarray:
    return (at >> (WINDOWS + CHECK)) & ((1 << WINDOWS) - 1)


def _windows(at: np.ndarray) -> np.ndarray:
    return (at >> CHECK) & ((1 << WINDOWS) - 1)


def with_check(docs: DataFrame) -> DataFrame:
    """A column that tells apart rows of one id and different texts."""
    return docs.withColumn("check", F.crc32(F.coalesce("text", F.lit("")).cast("binary")) % (1 << CHECK))


def names(of: K.Prefixes, at: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the prefixes of this length at some positions: pairs of ranks half as long (and a little, where the
    length is no power of two), down to GRAM bytes."""
    if length == GRAM:
        return K.mix(of.name(at, at + GRAM))
    half = GRAM << ((length - 1) // GRAM).bit_length() - 1
    return K.paired(names(of, at, half), names(of, at + length - half, half))


def instances(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one standing prefix: the prefix's name, the name of all the run's bytes, its first
    window, the distance from there to the prefix, its number of windows. The places are in data. Standing names are
    the least of many, so they are mixed once more: else the first of 256 buckets would get a quarter of them."""
    firsts = np.maximum(off[:-1], 0)
    lasts = off[1:] - length + 1  # windows start in [firsts, lasts)
    has = lasts > firsts
    firsts, lasts = firsts[has], lasts[has]
    parts: list[tuple[np.ndarray, ...]] = []
    grams = length - GRAM + 1
    for base in range(0, len(data) - length + 1, STRIDE):
        seg = data[base : base + STRIDE + length - 1]
        count = len(seg) - length + 1
        edge = np.zeros(count + 1, np.int32)
        a, b = np.searchsorted(lasts, base, "right"), np.searchsorted(firsts, base + count, "left")
        if a >= b:
            continue
        np.add.at(edge, np.maximum(firsts[a:b] - base, 0), 1)
        np.add.at(edge, np.minimum(lasts[a:b] - base, count), -1)
        valid = np.cumsum(edge[:-1]) > 0
        h, have = K.BYTE_NAMES[0][seg], 1
        while have < GRAM:
            h = K.doubled(h, have)
            have *= 2
        name = K.mix(h)
        least = (name & ~_PLACE) | np.arange(len(name), dtype=np.uint64)
        reach = 1
        while reach * 2 <= grams:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < grams:
            least = np.minimum(least[: len(least) - (grams - reach)], least[grams - reach :])
        place = (least[:count] & _PLACE).astype(np.int64)
        new = np.ones(count + 1, bool)
        new[1:-1] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
        cuts = np.flatnonzero(new)
        s, e = cuts[:-1], cuts[1:]
        keep = valid[s]
        s, e = s[keep], e[keep]
        if not len(s):
            continue
        whole = K.mix(K.Prefixes(seg, 1).name(s, e + length - 1) + ((place[s] - s) << 8 | (e - s)).astype(np.uint64))
        parts.append((K.mix(name[place[s]]), whole, s + base, place[s] - s, e - s))
    if not parts:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _bucket(name: np.ndarray, buckets: int) -> np.ndarray:
    """Grows with the name, so sorted names are in order of their bucket."""
    return ((name >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _same(*columns: np.ndarray) -> np.ndarray:
    """Whether each row equals the one before it."""
    out = np.zeros(len(columns[0]), bool)
    out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def _blobs(kind: int, bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """One Arrow row for each bucket; bucket is sorted. Bytes of one place in the numbers stand together, so the
    shuffle's compression finds those that are alike (high bytes of ids and starts)."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    firsts = bucket[cuts[:-1]]
    octets = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), 32)
    planes = np.concatenate([octets[a:b].T.ravel() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    return pa.record_batch([pa.array(firsts.astype(np.int32)), pa.array(np.full(len(firsts), kind, np.int8)), S.binary_array(planes, cuts * 32)], names=["bucket", "kind", "blob"])


def _spread(kind: int, rows: np.ndarray, buckets: int, salt: int) -> Iterator[pa.RecordBatch]:
    """Rows that need no bucket of their own: pieces dealt to any."""
    for i in range(0, len(rows), 8192):
        yield _blobs(kind, np.full(min(8192, len(rows) - i), (salt + i // 8192 * 7919) % buckets), rows[i : i + 8192])


def _first_round(name: np.ndarray, whole: np.ndarray, doc: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """What one batch says about its instances; see the module's text on hot names."""
    order = np.argsort(name, kind="stable")
    n = name[order]
    shared = _same(n)
    shared[:-1] |= shared[1:]
    many = order[shared]
    fine = many[np.lexsort((_start(at[many]), doc[many], whole[many], name[many]))]
    repeat = _same(name[fine], whole[fine])
    tie = repeat & _same(doc[fine], _start(at[fine]))
    done = np.zeros(len(name), bool)
    done[fine[repeat & ~_chained(tie, repeat)]] = True
    left = fine[~repeat | _chained(tie, repeat)]
    unequal = np.zeros(len(left), bool)
    unequal[1:] = (name[left][1:] == name[left][:-1]) & (whole[left][1:] != whole[left][:-1])
    group = np.cumsum(~_same(name[left]))
    mixed = np.isin(group, group[unequal])
    as_rows = lambda k: np.stack([name[k], whole[k], doc[k].view(np.uint64), at[k].view(np.uint64)], 1)
    salt = int(n[0] % np.uint64(buckets)) if len(n) else 0
    yield from _spread(REPEAT, as_rows(np.flatnonzero(done)), buckets, salt)
    yield from _spread(OPEN, as_rows(left[mixed]), buckets, salt + 1)
    marks = np.unique(name[left[mixed]])
    marked = np.stack([marks, np.zeros_like(marks), np.zeros_like(marks), np.full(len(marks), 2**64 - 1, np.uint64)], 1)
    rows = np.concatenate([as_rows(np.concatenate([order[~shared], left[~mixed]])), marked])
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    if len(rows):
        yield _blobs(FRESH, _bucket(rows[:, 0], buckets), rows)


def _lots(parts: Iterator[tuple[np.ndarray, ...]], limit: int = LOT) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns put together to lots of some `limit` rows: Arrow's batches are small, and what a lot says is said once."""
    held: list[tuple[np.ndarray, ...]] = []
    for part in parts:
        held.append(part)
        if sum(len(x[0]) for x in held) >= limit:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _chained(tie: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    """Rows at the very place of their group's first row: rows of one id and text. They are no repeats of it."""
    if not tie.any():
        return tie
    run = np.cumsum(~repeat)
    broken = np.zeros(run[-1] + 1, np.int64)
    out = np.zeros(len(tie), bool)
    for i in np.flatnonzero(repeat):  # only reached when ids repeat
        out[i] = tie[i] and not broken[run[i]]
        broken[run[i]] |= not tie[i]
    return out


def _in_buckets(batches: Iterator[pa.RecordBatch], settle) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Gather each bucket's fresh rows (sorted by bucket), pass the others on."""
    held: list[np.ndarray] = []
    current = None

    def out(kind: np.ndarray | int, rows: np.ndarray) -> pa.RecordBatch:
        kinds = np.full(len(rows), kind, np.int8) if np.isscalar(kind) else kind.astype(np.int8)
        return pa.record_batch([pa.array(kinds), pa.array(rows[:, 2].copy().view(np.int64)), pa.array(rows[:, 3].copy().view(np.int64))], names=["kind", "doc", "at"])

    for b in batches:
        data, off = S.byte_column(b, "blob")
        for i, (bucket, kind) in enumerate(zip(b.column("bucket").to_pylist(), b.column("kind").to_pylist(), strict=True)):
            rows = np.ascontiguousarray(data[off[i] : off[i + 1]].reshape(32, -1).T).view(np.uint64)
            if kind != FRESH:
                yield out(kind, rows)
                continue
            if bucket != current and held:
                yield out(*settle(np.concatenate(held)))
                held = []
            current = bucket
            held.append(rows)
    if held:
        yield out(*settle(np.concatenate(held)))


def _settle_first(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each name: nothing if one instance has it; repeats of the first if all are equal; else all stay open."""
    marker = rows[:, 3] == np.uint64(2**64 - 1)
    place = rows[:, 3].copy().view(np.int64)
    rows = rows[np.lexsort((_start(place), rows[:, 2].copy().view(np.int64), rows[:, 1], rows[:, 0]))] if len(rows) else rows
    marker = rows[:, 3] == np.uint64(2**64 - 1)
    name, whole = rows[:, 0], rows[:, 1]
    group = np.cumsum(~_same(name)) - 1 if len(rows) else np.empty(0, np.int64)
    size = np.bincount(group)
    mixed = np.zeros(len(size), bool)
    mixed[group[marker]] = True
    mixed[group[_same(name) & ~_same(whole)]] = True
    doc, at = rows[:, 2].copy().view(np.int64), rows[:, 3].copy().view(np.int64)
    repeat = _same(name, whole)
    tied = _chained(repeat & _same(doc, _start(at)), repeat)
    opened = mixed[group] & ~marker
    done = ~mixed[group] & repeat & ~tied
    keep = opened | done
    return np.where(opened, OPEN, REPEAT)[keep], rows[keep]


def _settle_last(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each name of full length: all but the first are repeats."""
    place = rows[:, 3].copy().view(np.int64)
    rows = rows[np.lexsort((_start(place), rows[:, 2].copy().view(np.int64), rows[:, 1], rows[:, 0]))]
    doc, at = rows[:, 2].copy().view(np.int64), rows[:, 3].copy().view(np.int64)
    repeat = _same(rows[:, 0], rows[:, 1])
    done = repeat & ~_chained(repeat & _same(doc, _start(at)), repeat)
    return np.full(int(done.sum()), REPEAT), rows[done]


def _listed(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists of numbers: all numbers, and the row of each."""
    col = b.column(name)
    counts = np.array([0 if n is None else n for n in pc.list_value_length(col).to_pylist()], np.int64)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(b.num_rows), counts)


def in_rows(spans: DataFrame) -> DataFrame:
    """(doc_id, check, ats): the packed spans of each row, in order."""
    check = F.col("at").bitwiseAND(F.lit((1 << CHECK) - 1))
    return spans.groupBy(F.col("doc").alias("doc_id"), check.alias("check")).agg(F.sort_array(F.collect_list("at")).alias("ats"))


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc, at): packed runs of windows that start earlier elsewhere; docs: (doc_id, text, check)."""
    buckets = max(256, 2 * S.partitions(docs.sparkSession))

    step = length - 2 * GRAM

    def standing(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            data, off = S.byte_column(b, "text")
            name, whole, start, distance, count = instances(data, off, length)
            row = np.searchsorted(off, start, "right") - 1
            doc, check = b.column("doc_id").to_numpy()[row], b.column("check").to_numpy()[row]
            yield name, whole, doc, _pack(start - off[row], distance, count, check)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(standing(batches)):
            yield from _first_round(*lot, buckets)

    def opened(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """For stretches of the batch: bytes, where each row starts in them, and the open spans with their rows."""
        data, off = S.byte_column(b, "text")
        at, row = _listed(b, "ats")
        for i, j in S.chunks(off, 1 << 19):
            lo, hi = np.searchsorted(row, [i, j])
            if lo < hi:
                yield data[off[i] : off[j]], off - off[i], at[lo:hi], row[lo:hi]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """Parts of open instances, by the name of 2 * GRAM bytes that all their windows hold."""
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for seg, off, at, row in opened(b):
                start, distance, n = _start(at), _distance(at), _windows(at)
                low, high = (distance - n + 1) // step, distance // step  # which strings the windows hold
                parts = high - low + 1
                own = np.repeat(np.arange(len(at)), parts)
                j = high[own] - (np.arange(len(own)) - np.repeat(np.concatenate([[0], np.cumsum(parts)[:-1]]), parts))
                first = np.maximum(0, distance[own] - (j + 1) * step + 1)
                last = np.minimum(n[own] - 1, distance[own] - j * step)
                begin, base = start[own] + first, off[row[own]]
                held = base + start[own] + distance[own] - j * step
                name = names(K.Prefixes(seg, 0), held, 2 * GRAM)
                shape = (held - base - begin) << 8 | (last - first)
                whole = K.mix(K.Prefixes(seg, 1).name(base + begin, base + begin + last - first + length) + shape.astype(np.uint64))
                yield name, whole, ids[row[own]], _pack(begin, np.zeros_like(begin), last - first + 1, at[own] & ((1 << CHECK) - 1))

    def reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(cut_up(batches)):
            yield from _first_round(*lot, buckets)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """All windows of open parts, by their names of full length."""
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for seg, off, at, row in opened(b):
                n = _windows(at)
                first = np.repeat(_start(at) - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(int(n.sum()))
                owner = np.repeat(row, n)
                p = first + off[owner]
                k1, k2 = (names(K.Prefixes(seg, w), p, length) for w in (0, 1))
                yield k1, k2, ids[owner], _pack(first, np.zeros_like(first), np.ones_like(first), np.repeat(at & ((1 << CHECK) - 1), n))

    def every_position(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k1, k2, doc, at in _lots(positions(batches), LOT // 2):
            order = np.lexsort((_start(at), doc, k2, k1))
            k1, k2, doc, at = k1[order], k2[order], doc[order], at[order]
            repeat = _same(k1, k2)
            done = repeat & ~_chained(repeat & _same(doc, _start(at)), repeat)
            rows = np.stack([k1, k2, doc.view(np.uint64), at.view(np.uint64)], 1)
            yield from _spread(REPEAT, rows[done], buckets, int(k1[0] % np.uint64(buckets)))
            yield _blobs(FRESH, _bucket(k1[~done], buckets), rows[~done])

    def sort_in_buckets(df: DataFrame, settle) -> DataFrame:  # noqa: ANN001
        dealt = S.pool_partitions(df, "bucket").sortWithinPartitions("bucket")
        ranked = S.stage_table(dealt.mapInArrow(S.trimmed(lambda batches: _in_buckets(batches, settle)), "kind byte, doc long, at long"), "ranks")
        S.release(docs.sparkSession)  # what the round dealt out
        return ranked

    def with_open(spans: DataFrame) -> DataFrame:
        return docs.join(in_rows(spans.where(F.col("kind") == OPEN)).hint("shuffle_hash"), ["doc_id", "check"])

    packed = "bucket int, kind byte, blob binary"
    spans = sort_in_buckets(docs.mapInArrow(S.trimmed(ranked), packed), _settle_first)
    done = spans.where(F.col("kind") == REPEAT)
    if step > 0:
        spans = sort_in_buckets(with_open(spans).mapInArrow(S.trimmed(reranked), packed), _settle_first)
        done = done.unionByName(spans.where(F.col("kind") == REPEAT))
    last = sort_in_buckets(with_open(spans).mapInArrow(S.trimmed(every_position), packed), _settle_last)
    return done.unionByName(last).select("doc", "at")


def remove_repeats(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", keep_bytes: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, spans (start and
    end of each run, in bytes) and, if asked for, kept (the bytes that stay)."""
    if not GRAM < length < GRAM + (1 << WINDOWS):
        raise ValueError("length must be 33 to 287")
    source = S.documents(docs, doc_id, text)
    source = S.bucketed_table(with_check(source.withColumn("doc_id", F.coalesce("doc_id", F.lit(S.NULL_ID)))), ["doc_id", "check"], "texts", S.lean(docs.sparkSession))
    S.release(docs.sparkSession)
    spans = in_rows(repeated_spans(source, length))
    joined = source.join(spans.hint("shuffle_hash"), ["doc_id", "check"], "left").select("doc_id", "text", "ats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, sizes = S.byte_column(whole, "text")
            for i, j in S.chunks(sizes, 1 << 20):
                b = whole.slice(i, j - i)
                data, off = S.byte_column(b, "text")
                at, row = _listed(b, "ats")
                begin = off[row] + _start(at)
                change = np.bincount(begin, minlength=len(data) + 1) - np.bincount(begin + _windows(at) - 1 + length, minlength=len(data) + 1)
                gone = np.cumsum(change[:-1]) > 0
                before = np.concatenate([[False], gone[:-1]])
                before[off[:-1][off[:-1] < len(data)]] = False
                rises = np.flatnonzero(gone & ~before)
                after = np.concatenate([gone[1:], [False]]) if len(gone) else gone
                after[off[1:][off[1:] > 0] - 1] = False
                falls = np.flatnonzero(gone & ~after) + 1
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[off[1:]] - total[off[:-1]]
                owner = np.searchsorted(off, rises, "right") - 1
                kept = np.ascontiguousarray(data[~gone])
                kept_off = off - total[off]
                view = memoryview(kept)
                shas = [hashlib.sha256(view[x:y]).hexdigest() for x, y in zip(kept_off[:-1].tolist(), kept_off[1:].tolist(), strict=True)]
                n_spans = np.bincount(owner, minlength=b.num_rows)
                pairs = pa.StructArray.from_arrays([pa.array(rises - off[owner]), pa.array(falls - off[owner])], names=["start", "end"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32)), pairs)
                ids = b.column("doc_id").to_numpy()
                yield pa.record_batch([pa.array(ids, mask=ids == S.NULL_ID), pa.array(np.diff(off)), pa.array(removed), pa.array(n_spans), pa.array(shas, pa.string()), lists, *([S.binary_array(kept, kept_off)] if keep_bytes else [])], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>" + ", kept binary" * keep_bytes
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept"] * keep_bytes]
    return joined.mapInArrow(S.trimmed(cut), schema)

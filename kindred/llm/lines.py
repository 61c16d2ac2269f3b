"""Removing lines that many documents share, by a sharded minimal perfect hash.

Lines are counted by a 128-bit hash of their key: each document names each of its lines once, and the counts are
pre-aggregated before the shuffle. The distinct hashes that reach the threshold are dealt into shards. A shard
is one row: a minimal perfect hash over its hashes (levels of bit arrays; a hash is placed at the first level
where it stands alone, and its rank among the set bits is its slot), an array of 64-bit fingerprints and an
array of counts. A document asks the shard of a line for its slot and accepts the count if the fingerprint
agrees, so lines are never joined. A line outside the arrays would have to share a shard's slot and 64 more bits.

Where the arrays go: their size is added up first. Up to `most_shipped` bytes they are sent with the tasks that
rewrite the documents. Beyond it, shards stay where they are and documents' line hashes are dealt to them
instead, each shard's arrays in front of its questions; only the hashes found come back to the documents.

Rows: a null or empty text is one empty line. An empty key is never dropped. Each row counts as a document, also
rows that repeat an id. A null id is an id of its own. A column `_lines` that the table has already is replaced. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm import shared as S
from kindred.llm.textkernel import mix

#: White space as lines are stripped of it.
BLANK = b" \t\n\x0b\x0c\r"
#: Hashes that a shard is meant to hold.
SHARD = 1 << 17
#: Bits of a level for each hash that is left.
ROOM = 2
_U = np.uint64


def line_hashes(lines: list[bytes]) -> np.ndarray:
    """Two 64-bit values for each line's key; (0, 0) for an empty key."""
    digests = b"".join(xxhash.xxh3_128_digest(k) if (k := x.strip(BLANK).lower()) else b"\0" * 16 for x in lines)
    return np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)


class Arrays:
    """A minimal perfect hash with fingerprints and counts."""

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, counts: np.ndarray):
        self.levels, self.prints, self.counts = levels, prints, counts
        ones = [np.concatenate([[0], np.cumsum(np.bitwise_count(x), dtype=np.int64)]) for x in levels]
        before = np.concatenate([[0], np.cumsum([x[-1] for x in ones])])
        self.ranks = [x + b for x, b in zip(ones, before, strict=False)]

    @staticmethod
    def _place(key: np.ndarray, level: int, size: int) -> np.ndarray:
        return mix(key + _U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % _U(size)

    @classmethod
    def build(cls, key: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> Arrays:
        """key: distinct."""
        levels, left = [], key
        while len(left):
            size = -(-max(64, ROOM * len(left)) // 64) * 64
            place = cls._place(left, len(levels), size).astype(np.int64)
            hits = np.bincount(place, minlength=size)
            words = np.bitwise_or.reduce((hits == 1).astype(np.uint64).reshape(-1, 64) << np.arange(64, dtype=np.uint64), axis=1)
            levels.append(words)
            left = left[hits[place] > 1]
        out = cls(levels, np.zeros(len(key), np.uint64), np.zeros(len(key), np.int64))
        slot = out.slots(key)
        out.prints[slot], out.counts[slot] = prints, counts
        return out

    def slots(self, key: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1 where no level has one (then it is not in the set)."""
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        for i, words in enumerate(self.levels):
            place = self._place(key[left], i, 64 * len(words))
            word, bit = (place >> _U(6)).astype(np.int64), place & _U(63)
            there = (words[word] >> bit) & _U(1) == 1
            below = np.bitwise_count(words[word] & ((_U(1) << bit) - _U(1)))
            out[left[there]] = (self.ranks[i][word] + below)[there]
            left = left[~there]
            if not len(left):
                break
        return out

    def count(self, key: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The count of each hash, 0 if it is not in the set."""
        if not len(self.prints):
            return np.zeros(len(key), np.int64)
        slot = self.slots(key)
        return np.where((slot >= 0) & (self.prints[slot] == prints), self.counts[slot], 0)

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), len(self.prints), *(len(x) for x in self.levels)], np.int64)
        return b"".join([sizes.tobytes(), *(x.tobytes() for x in self.levels), self.prints.tobytes(), self.counts.tobytes()])

    @classmethod
    def load(cls, raw: bytes) -> Arrays:
        n, k = np.frombuffer(raw, np.int64, 2)
        sizes = np.frombuffer(raw, np.int64, n, 16)
        at, levels = 16 + 8 * int(n), []
        for size in sizes.tolist():
            levels.append(np.frombuffer(raw, np.uint64, size, at))
            at += 8 * size
        return cls(levels, np.frombuffer(raw, np.uint64, k, at), np.frombuffer(raw, np.int64, k, at + 8 * int(k)))


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return (key >> _U(33)).astype(np.int64) % shards


def shared_lines(docs: DataFrame, min_docs: int, text: str) -> DataFrame:
    """(k1, k2, n): hashes of the line keys that at least min_docs rows have, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = S.byte_column(b, "text")
            for i, j in S.chunks(off, 1 << 20):
                found = []
                for a, e in zip(off[i:j].tolist(), off[i + 1 : j + 1].tolist(), strict=True):
                    lines = {x.strip(BLANK).lower() for x in data[a:e].tobytes().split(b"\n")} - {b""}
                    found.extend(lines)
                if not found:
                    continue
                h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), ">u8").astype(np.uint64).reshape(-1, 2)
                h = h[np.lexsort((h[:, 1], h[:, 0]))]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]).any(1)]))
                n = np.diff(np.concatenate([new, [len(h)]]))
                yield pa.record_batch([pa.array(h[new, 0].view(np.int64)), pa.array(h[new, 1].view(np.int64)), pa.array(n)], names=["k1", "k2", "n"])

    lines = docs.select(docs[text].cast("string").alias("text")).mapInArrow(S.trimmed(run), "k1 long, k2 long, n long")
    return lines.groupBy("k1", "k2").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)


def line_arrays(frequent: DataFrame, shards: int) -> DataFrame:
    """(shard, arrays): the minimal perfect hash of each shard's hashes."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # ties in the first 64 bits go on under a changed key that question and answer both derive
        pdf = pdf.sort_values(["k1", "k2"])
        k1, k2 = (pdf[c].to_numpy().view(np.uint64) for c in ("k1", "k2"))
        arrays = Arrays.build(_key(k1, k2), k2, pdf["n"].to_numpy())
        return pd.DataFrame({"shard": [key[0]], "arrays": [arrays.dump()]})

    numbered = frequent.withColumn("shard", (F.shiftrightunsigned("k1", 33) % shards).cast("int"))
    return numbered.groupBy("shard").applyInPandas(build, "shard int, arrays binary")


def _key(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    return k1 ^ mix(k2)


class LineFilter:
    """Which lines go: built once over a table, then applied to any column of texts."""

    def __init__(self, docs: DataFrame, min_docs: int = 10, text: str = "text", most_shipped: int = 64 << 20):
        self.min_docs = min_docs
        frequent = S.stage_table(shared_lines(docs, min_docs, text), "lines")
        count = frequent.count()
        self.shards = max(1, -(-count // SHARD))
        self.table = S.stage_table(line_arrays(frequent, self.shards), "lines")
        self.bytes = self.table.agg(F.coalesce(F.sum(F.length("arrays")), F.lit(0))).first()[0]
        self.shipped = self.bytes <= most_shipped
        self.sent = docs.sparkSession.sparkContext.broadcast({r.shard: bytes(r.arrays) for r in self.table.collect()}) if self.shipped else None

    def cleaned(self, text: Column) -> Column:
        """struct(n_lines, n_dropped, kept); needs the arrays to be shipped."""
        sent, shards, least = self.sent, self.shards, self.min_docs

        @F.arrow_udf("n_lines long, n_dropped long, kept string")
        def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            arrays = {k: Arrays.load(v) for k, v in sent.value.items()}
            for col in texts:
                data, off = S.byte_column(pa.record_batch([col], names=["text"]), "text")
                n_lines, n_dropped, kept = [], [], []
                for i, j in S.chunks(off, 1 << 20):
                    texts_ = []
                    for a, e in zip(off[i:j].tolist(), off[i + 1 : j + 1].tolist(), strict=True):
                        raw = data[a:e].tobytes()
                        lines = raw.split(b"\n")
                        h = line_hashes(lines)
                        go = (h != 0).any(1)
                        which = _shard(h[:, 0], shards)
                        for k in np.unique(which):
                            here = which == k
                            if k in arrays:
                                go[here] &= arrays[k].count(_key(h[here, 0], h[here, 1]), h[here, 1]) >= least
                            else:
                                go[here] = False
                        gone = int(go.sum())
                        n_lines.append(len(lines))
                        n_dropped.append(gone)
                        texts_.append(b"\n".join([y for y, g in zip(lines, go.tolist(), strict=True) if not g]) if gone else raw)
                    kept.append(pa.array(texts_, pa.binary()).cast(pa.string()))
                whole = pa.concat_arrays(kept) if kept else pa.array([], pa.string())
                yield pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), whole], names=["n_lines", "n_dropped", "kept"])
            S.trim()

        return run(text)

    def dealt(self, docs: DataFrame, text: str) -> DataFrame:
        """docs with struct column `_lines`, without shipping the arrays: line hashes are dealt to the shards. A shard
        has as many copies as it takes to fill the shuffle's partitions, each asked by its share of the texts."""
        shards, least = self.shards, self.min_docs
        copies = -(-S.partitions(docs.sparkSession) // shards)
        own = next(n for n in (f"_text_key{i or ''}" for i in range(len(docs.columns) + 1)) if n.lower() not in {c.lower() for c in docs.columns})
        plain = F.coalesce(docs[text].cast("string"), F.lit(""))
        marked = docs.withColumn(own, F.unhex(F.md5(plain.cast("binary"))))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, off = S.byte_column(b, "text")
                for i, key in enumerate(b.column("key").to_pylist()):
                    h = np.unique(line_hashes(data[off[i] : off[i + 1]].tobytes().split(b"\n")), axis=0)
                    h = h[(h != 0).any(1)]
                    if not len(h):
                        continue
                    which = _shard(h[:, 0], shards)
                    order = np.argsort(which, kind="stable")
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(which[order])) + 1, [len(h)]])
                    where, copy = which[order][cuts[:-1]].astype(np.int32), int.from_bytes(key[:4], "little") % copies
                    yield pa.record_batch([pa.array(where), pa.array(np.full(len(where), copy, np.int32)), pa.array([key] * len(where), pa.binary()), S.binary_array(h[order].ravel().view(np.uint8), cuts * 16)], names=["shard", "copy", "key", "blob"])

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrays, at = None, None
            for b in batches:
                for shard, copy, key, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if key is None:
                        arrays, at = Arrays.load(blob), (shard, copy)
                    elif at == (shard, copy):
                        h = np.frombuffer(blob, np.uint64).reshape(-1, 2)
                        hit = h[arrays.count(_key(h[:, 0], h[:, 1]), h[:, 1]) >= least]
                        if len(hit):
                            yield pa.record_batch([pa.array([key], pa.binary()), pa.array([hit.tobytes()], pa.binary())], names=["key", "found"])

        texts = marked.select(plain.alias("text"), F.col(own).alias("key")).dropDuplicates(["key"])
        questions = texts.mapInArrow(ask, "shard int, copy int, key binary, blob binary")
        lent = self.table.select("shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(None).cast("binary").alias("key"), F.col("arrays").alias("blob"))
        stacked = lent.unionByName(questions).repartition(S.partitions(docs.sparkSession), "shard", "copy")
        hits = stacked.sortWithinPartitions("shard", "copy", F.col("key").asc_nulls_first()).mapInArrow(answer, "key binary, found binary")
        hits = hits.groupBy(F.col("key").alias(own)).agg(F.collect_list("found").alias("_lines"))  # a text's own lines

        @F.pandas_udf("n_lines long, n_dropped long, kept string")
        def rewrite(s: pd.Series, found: pd.Series) -> pd.DataFrame:
            rows = []
            for x, f in zip(s, found, strict=True):
                lines = (x.encode() if x else b"").split(b"\n")
                bad = set() if f is None else {h[i : i + 16] for h in f for i in range(0, len(h), 16)}
                keep = [y for y, h in zip(lines, line_hashes(lines), strict=True) if h.tobytes() not in bad]
                rows.append((len(lines), len(lines) - len(keep), b"\n".join(keep).decode()))
            return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])

        return marked.drop("_lines").join(hits, own, "left").withColumn("_lines", rewrite(F.col(text).cast("string"), F.col("_lines"))).drop(own)


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, text: str = "text", most_shipped: int = 64 << 20) -> DataFrame:
    """docs with a struct column _lines (n_lines before dropping, n_dropped, kept: the text without shared lines)."""
    lines = LineFilter(docs, min_docs, text, most_shipped)
    if lines.shipped:
        return docs.withColumn("_lines", lines.cleaned(F.col(text).cast("string")))
    return lines.dealt(docs, text)


def sha256_hex(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


__all__ = ["Arrays", "LineFilter", "drop_shared_lines", "line_hashes", "sha256_hex", "shared_lines"]

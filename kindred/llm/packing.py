"""Packing documents into training sequences along a space-filling curve.

Each document's ids are hashed to a vector of a few dimensions (the mean of a fixed random vector for each
token id), each dimension is mapped to a uniform scale, and the cell's place along a Hilbert curve is the
document's key. Documents are dealt by ranges of (key, id) and sorted, so neighbours in a sequence are alike.
The ids of all documents in that order form one stream that is cut every `length` ids: every sequence is full
and nothing is padded. The stream's tail is cut at powers of two, largest first, which need no padding either.

Rows: a null text is empty (the end id alone); a null id stays null and sorts first among equal keys; rows with
the same id are all packed, each for itself. An empty table gives no rows. A hot key (copies of one text) is
split by document id, so ranges stay even.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import shared as S
from kindred.llm import textkernel as K
from kindred.llm.shards import id_type, tokenized
from kindred.llm.tokens import crc32, tokenizer

DIMENSIONS, BITS = 4, 8
_NORMAL = np.array([0.5 * (1 + erf(x / 2**0.5)) for x in np.linspace(-4, 4, 4097)])


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer points (rows), by Gray-code rotations from the top bit down."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & (q - 1)
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, at: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The Hilbert key of each document, from its ids."""
    sums = np.add.reduceat(projection[ids], at[:-1], axis=0)
    scaled = sums / np.sqrt(np.diff(at))[:, None]
    uniform = np.interp(scaled, np.linspace(-4, 4, 4097), _NORMAL)
    return hilbert(np.minimum((uniform * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


@cache
def projection_table(size: int) -> np.ndarray:
    """A random vector of unit variance for each hashed token id."""
    out = [np.sqrt(12) * (K.mix(np.arange(size, dtype=np.uint64) * np.uint64(DIMENSIONS) + np.uint64(d + 1)) / 2.0**64 - 0.5) for d in range(DIMENSIONS)]
    return np.stack(out, 1).astype(np.float32)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 4096, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and the ids)."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    spark = docs.sparkSession
    parts, narrow = S.partitions(spark), id_type(tokenizer_path, end_id)
    vocabulary = max(65_536, tokenizer(tokenizer_path, end_id).tokenizer.get_vocab_size(), end_id + 1)

    source = S.documents(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(S.NULL_ID)))
    table = S.stage_table(tokenized(source, tokenizer_path, end_id, lambda doc, ids, at: curve_keys(ids, at, projection_table(vocabulary))), "pack")
    bounds = S.range_bounds(table.select("key", "doc_id"), ["key", "doc_id"], parts)
    cut_keys, cut_docs = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))

    @F.pandas_udf("int")
    def part_of(key, doc):  # noqa: ANN001, ANN202
        import pandas as pd

        k, d = key.to_numpy(), doc.to_numpy()
        low, high = np.searchsorted(cut_keys, k, "left"), np.searchsorted(cut_keys, k, "right")
        part = low.copy()
        for i in np.flatnonzero(high > low):  # cuts with this very key: the ids decide
            part[i] = low[i] + np.searchsorted(cut_docs[low[i] : high[i]], d[i], "right")
        return pd.Series(part.astype(np.int32))

    part_of = part_of.asNondeterministic()  # one evaluation a row
    totals = dict(table.select("n_tokens", part_of("key", "doc_id").alias("part")).groupBy("part").agg(F.sum("n_tokens")).collect())
    order = sorted(totals)
    before = dict(zip(order, np.concatenate([[0], np.cumsum([totals[p] for p in order])]).tolist(), strict=False))
    total = sum(totals.values())
    tail = total - total % length
    ends, at = [], tail
    for b in reversed(range(length.bit_length() - 1)):  # the tail's powers of two, largest first
        if total - at >= 1 << b:
            at += 1 << b
            ends.append(at)
    edges = np.array([tail, *ends], np.int64)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for b in batches:
            data, off = S.byte_column(b, "ids")
            ids, at = data.view(narrow), off // narrow.itemsize
            if here is None and b.num_rows:
                here = before[b.column("part")[0].as_py()]
            rows: list[tuple] = []
            for i, doc in enumerate(b.column("doc_id").to_pylist()):
                n, start = int(at[i + 1] - at[i]), 0
                while start < n:
                    if here < tail:
                        seq, first = divmod(here, length)
                        room = length - first
                    else:
                        k = int(np.searchsorted(edges, here, "right")) - 1
                        seq, first, room = tail // length + k, here - int(edges[k]), int(edges[k + 1]) - here
                    take = min(room, n - start)
                    piece = ids[at[i] + start : at[i] + start + take]
                    rows.append((None if doc == S.NULL_ID else doc, start, take, crc32(piece), n, seq, first, *([piece.tolist()] if with_ids else [])))
                    start += take
                    here += take
            if rows:
                kinds = [pa.int64()] * 7 + ([pa.list_(pa.int64())] if with_ids else [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    dealt = table.withColumn("part", part_of("key", "doc_id")).repartitionById(len(bounds) + 1, F.col("part"))
    schema = ", ".join(f"{n} {'array<long>' if n == 'ids' else 'long'}" for n in names)
    return dealt.sortWithinPartitions("key", "doc_id", "ids").mapInArrow(S.trimmed(cut), schema)

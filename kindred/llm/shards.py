"""Token-id files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file holds documents in ascending id order. Layout:

    frame*          zstandard frames, each the ids of whole documents as little-endian unsigned 32-bit integers,
                    with zstandard's content checksum
    skippable frame (magic 0x184D2A50): document index, three little-endian 64-bit arrays one after another:
                    document ids, token counts, frame numbers
    skippable frame (magic 0x184D2A5E): seek table in the public seekable layout: for each zstandard frame its
                    compressed size, size of content and checksum (low half of XXH64 of the content); footer:
                    number of frames, descriptor 0x80, magic 0x8F92EAB1. A last entry of no content covers the index.

A reader takes the footer, the table and the index, and then only the frames of the documents asked for.
Files go to any store that pyarrow.fs opens. A file is written under a name of its own and moved into place,
so a repeated or lost task leaves one whole file.

Rows: a null text is empty (the end id alone). A null document id is kept as null and sorts first. Rows with
the same id are all kept, ordered by their ids' bytes. An empty table gives no file and no row.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm import shared as S
from kindred.llm.tokens import crc32, tokenizer

INDEX_MAGIC, TABLE_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


def tokenized(docs: DataFrame, path: str, end_id: int, key: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], key_type: str = "long") -> DataFrame:
    """(key, doc_id, n_tokens, ids): each text's ids as little-endian integers of id_type(), 16 bits wide for
    vocabularies under 65,536 ids, so that they move in half the bytes. key gets the document ids, all rows' ids and their
    offsets: it is taken in the same worker, as a second one beside it would double the memory."""
    kind, narrow = pa.int64() if key_type == "long" else pa.int32(), id_type(path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, end_id)
        for batch in batches:
            data, off = S.byte_column(batch, "text")
            for i, j in S.chunks(off, S.CHUNK):
                ids, at = tok.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                doc, short = batch.column("doc_id").slice(i, j - i), ids.astype(narrow)
                yield pa.record_batch([pa.array(key(doc.to_numpy(), short, at), kind), doc, pa.array(np.diff(at)), S.binary_array(short.view(np.uint8), at * narrow.itemsize)], names=["key", "doc_id", "n_tokens", "ids"])

    return docs.mapInArrow(S.trimmed(run), f"key {key_type}, doc_id long, n_tokens long, ids binary")


def id_type(path: str, end_id: int) -> np.dtype:
    """The narrowest type that holds a vocabulary's ids and the end id."""
    return np.dtype("<u2" if max(tokenizer(path, end_id).tokenizer.get_vocab_size() - 1, end_id) < 65_536 else "<u4")


class Writer:
    """Writes one file frame by frame; holds one frame's documents in memory."""

    def __init__(self, folder: str, name: str, level: int, frame_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.final, self.temp = f"{self.root}/{name}", f"{self.root}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frame_bytes, self.held, self.size = frame_bytes, [], 0
        self.table: list[bytes] = []
        self.ids, self.counts, self.frames = array("q"), array("q"), array("q")

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        self.frames.append(len(self.table))
        self.held.append(np.ascontiguousarray(ids, "<u4").tobytes())
        self.size += len(self.held[-1])
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = self.zip.compress(raw)
            self.out.write(packed)
            self.table.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(np.frombuffer(x, np.int64).astype("<i8").tobytes() for x in (self.ids, self.counts, self.frames))
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join([*self.table, struct.pack("<III", len(index) + 8, 0, 0)])
        foot = struct.pack("<IBI", len(self.table) + 1, 0x80, FOOT_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table) + len(foot)) + table + foot)
        self.out.close()
        self.fs.move(self.temp, self.final)


class Reader:
    """Random access to one file; checks every frame that it opens."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOT_MAGIC or not flags & 0x80:
            raise ValueError(f"{uri}: no seek table")
        entries = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.table = entries[:-1]
        self.begin = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        index = np.frombuffer(self._at(int(self.begin[-1]) + 8, int(entries[-1, 0]) - 8), "<i8").reshape(3, -1)
        self.doc_ids, self.counts, self.frame_of = index

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def frame(self, k: int) -> np.ndarray:
        packed, size, check = (int(x) for x in self.table[k])
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.begin[k]), packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row in the file, document id, ids), decompressing only frames that hold a wanted document."""
        hit = np.ones(len(self.doc_ids), bool) if wanted is None else np.isin(self.doc_ids, np.array(sorted(wanted), np.int64))
        for k in np.unique(self.frame_of[hit]):
            ids, at = self.frame(int(k)), 0
            for row in range(*np.searchsorted(self.frame_of, [k, k + 1]).tolist()):  # frames ascend
                n = int(self.counts[row])
                if hit[row]:
                    yield int(row), int(self.doc_ids[row]), ids[at : at + n]
                at += n

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, folder: str, path: str, end_id: int, level: int = 3, frame_bytes: int = 1 << 20, file_bytes: int = 1 << 28) -> list[tuple[str, int, int, int]]:
    """Write the texts' ids below folder; the files in order of document id: (uri, documents, tokens, tokens before).

    Documents are dealt by ranges of their id, each range one file of about file_bytes of text, less where that
    would leave shuffle partitions idle (but a megabyte). Only the list of files reaches the driver.
    """
    spark = docs.sparkSession
    docs = S.documents(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(S.NULL_ID)))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // file_bytes), min(S.partitions(spark), -(-size // (1 << 20))))
    bounds = S.range_bounds(docs.select("doc_id"), ["doc_id"], parts)
    narrow = id_type(path, end_id)
    cuts = np.array([b[0] for b in bounds], np.int64)

    placed = tokenized(docs, path, end_id, lambda doc, ids, at: np.searchsorted(cuts, doc, "right"), "int").select("doc_id", "n_tokens", "ids", F.col("key").alias("part"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, tokens, part = None, 0, 0
        for b in batches:
            data, off = S.byte_column(b, "ids")
            values, at = data.view(narrow), off // narrow.itemsize
            for i, (doc, p) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if out is None:
                    out, part = Writer(folder, f"part-{p:06d}.ids.zst", level, frame_bytes), p
                out.add(doc, values[at[i] : at[i + 1]].astype("<u4"))
                tokens += int(at[i + 1] - at[i])
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([len(out.ids)]), pa.array([tokens])], names=["part", "n_docs", "n_tokens"])

    dealt = placed.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("doc_id", "ids")
    rows = sorted(dealt.mapInArrow(store, "part int, n_docs long, n_tokens long").collect())
    before = np.concatenate([[0], np.cumsum([r[2] for r in rows])]).tolist()
    return [(f"{folder}/part-{p:06d}.ids.zst", n, t, int(before[i])) for i, (p, n, t) in enumerate(rows)]


def read(spark, files: list[tuple[str, int, int, int]], wanted: set[int] | None = None, with_ids: bool = True) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                source = Reader(uri)
                starts = before + np.concatenate([[0], np.cumsum(source.counts)])
                rows: list[tuple] = []
                for row, doc, ids in source.documents(wanted):
                    rows.append((None if doc == S.NULL_ID else doc, int(starts[row]), len(ids), crc32(ids), *([ids.tolist()] if with_ids else [])))
                    if len(rows) >= (256 if with_ids else 65_536):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                source.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = [pa.int64()] * 4 + ([pa.list_(pa.int64())] if with_ids else [])
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names[:4]] + ([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []))
    listed = spark.createDataFrame([(f[0], f[3]) for f in files], "uri string, before long")
    return listed.repartition(max(1, min(len(files), 4 * S.partitions(spark)))).mapInArrow(load, schema)

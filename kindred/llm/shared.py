"""Plumbing that the corpus operators share: the shared folder, stage tables, Arrow text access."""

from __future__ import annotations

import atexit
import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator: it sorts before every other id.
NULL_ID = -(2**63)
#: Bytes of text that a worker takes up at a time; its temporaries are some fifty times as large.
CHUNK = 1 << 18

Batches = Iterator[pa.RecordBatch]


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is absent, a local master gets a folder of its own; a cluster is refused,
    as a machine-local folder would lose data there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return "/tmp/checkpoints/kindred"
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path not used before, under this application's folder in the shared one, which goes when the driver ends."""
    home = f"{shared_root(spark)}/kindred-{spark.sparkContext.applicationId}"
    if home not in _homes:
        _homes.add(home)
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration(), home)
    return f"{home}/{label}-{uuid.uuid4().hex}"


_homes: set[str] = set()


def _delete(jvm, conf, path: str) -> None:  # noqa: ANN001
    try:
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(conf).delete(hadoop, True)
    except (Py4JError, OSError):  # at exit the JVM may be gone already
        pass


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and any executor can reread it."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stage_path = path  # type: ignore[attr-defined]
    return back


def drop_table(df: DataFrame) -> None:
    """Delete a stage table that nothing reads any more."""
    spark = df.sparkSession
    _delete(spark._jvm, spark._jsc.hadoopConfiguration(), df.stage_path)  # type: ignore[attr-defined]


def lean(spark: SparkSession, size: int = 1 << 21) -> SparkSession:
    """A session like this one but with Arrow batches of some two megabytes: Java holds a batch outside its heap, in
    vectors of the next power of two, and a worker holds it beside what it makes of it."""
    out = spark.newSession()
    theirs = out.conf.getAll
    for key, value in spark.conf.getAll.items():
        if theirs.get(key) != value:
            out.conf.set(key, value)
    out.catalog.setCurrentDatabase(spark.catalog.currentDatabase())
    out.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return out


def bucketed_table(df: DataFrame, keys: list[str], label: str, reader: SparkSession | None = None) -> DataFrame:
    """df written once in buckets of its keys, so that any number of joins on them move the other side only. reader:
    the session that reads it, else that of df."""
    spark = df.sparkSession
    path, name, n = new_folder(spark, label), f"kindred_{label}_{uuid.uuid4().hex}", partitions(spark)
    dealt = df.repartition(n, *keys)
    dealt.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, *keys).saveAsTable(name)
    return (reader or spark).table(name)


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner drop the shuffle files of finished jobs now, not when the driver next collects garbage
    (half an hour, by default): for use after a shuffle of the size of the input, not after every job."""
    for _ in range(2):  # what the first round finds unreachable, the cleaner drops meanwhile
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.25)


def documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Exactly (doc_id long, text string): other columns, whatever they are called, play no part."""
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def byte_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as one byte buffer and row offsets into it (null: empty)."""
    col = batch.column(name)
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if off is not None else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow binary column."""
    whole = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(data))])
    return whole.cast(pa.binary())


def chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def trim() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def trimmed(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, trimming at its end: Spark uses Python workers again, and what one stage freed would stay with an idle one."""

    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        trim()

    return wrapped


def pool_partitions(df: DataFrame, column: str) -> DataFrame:
    """Deal rows by a column of evenly filled buckets, numbered from 0, with as many in each partition."""
    n = partitions(df.sparkSession)
    return df.repartitionById(n, F.pmod(F.col(column), F.lit(n)).cast("int"))


def range_bounds(keys: DataFrame, columns: list[str], parts: int, sample_per_part: int = 64, seed: int = 7) -> list[tuple]:
    """At most parts - 1 cut points over the columns, from a bounded sample (parts * sample_per_part rows).

    The sample only balances the ranges; every row is placed by comparison with the cuts.
    """
    total = keys.count()
    if parts < 2 or not total:
        return []
    want = parts * sample_per_part
    sampled = keys if total <= want else keys.sample(min(1.0, 1.2 * want / total), seed)
    rows = sorted(tuple(r) for r in sampled.select(*columns).limit(2 * want).collect())
    if not rows:
        return []
    cuts = [rows[len(rows) * i // parts] for i in range(1, parts)]
    return sorted(set(cuts))

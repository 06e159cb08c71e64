"""Shared helpers: scratch tables in the cluster's shared folder, Arrow access to text columns."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract of this package takes it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary one is set if all tasks run in
    this machine's one process (tests); on a cluster a machine's own folder would lose rows, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir isn't set; {master} needs a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage so that several consumers share one computation and lost executors lose nothing. The files go
    when the driver's JVM ends, or earlier by :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lectern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _place(spark, path)
    fs.deleteOnExit(p)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def _place(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`materialize` returned, once all that reads them is written."""
    for t in tables:
        fs, p = _place(t.sparkSession, t.scratch_path)
        fs.delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of what is written: it does so once the driver has collected its garbage, which on
    a large heap may be hours later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Have Arrow carry so many rows at once. Texts are long: at the default of 10,000 the buffers of two tasks fill an
    executor's memory outside its heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def freeing(run):
    """A task's function that gives the memory it has freed back to the machine at its end. Workers live on for other stages,
    and allocators keep what they had at their peak."""

    def f(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return f


def regroup(batches: Iterator[pa.RecordBatch], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive batches joined to about ``most`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def lower_ascii(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def text_of(col):
    """The text as bytes, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def byte_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and data of a null-free binary or string array, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off, raw


def slices(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of about ``most`` bytes; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def blobs(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary())


def too_many(keys: DataFrame, rows: int = 10_000) -> bool:
    """Whether a table of short keys is beyond what the planner would send to every task."""
    return keys.limit(rows + 1).count() > rows


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of texts without nulls, split at ASCII white space: each word's number, the distinct words, and where each text's
    words begin (the last entry: where they end). Leading or trailing space gives an empty word."""
    words = pc.ascii_split_whitespace(texts if pa.types.is_string(texts.type) else texts.cast(pa.string()))
    off = words.offsets.to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, off - off[0]


class WordTable:
    """Remembered values of words, a run of 32-bit numbers each, in flat arrays (some tens of bytes a word).

    ``make`` gets a list of distinct new words and returns their values as bytes. Beyond ``held`` words only those of the
    latest lookup stay.
    """

    def __init__(self, held: int, make, piece: int = 150_000):
        self.held, self.make, self.piece = held, make, piece
        self.words, self.pool, self.off = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def rows(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: start and size of each one's values in the pool, and the pool."""
        if len(self.words) > self.held:
            keep = np.flatnonzero(self.used)
            size = np.diff(self.off)[keep]
            end = np.cumsum(size)
            self.pool = self.pool[np.repeat(self.off[:-1][keep] - (end - size), size) + np.arange(int(size.sum()))]
            self.words, self.off = self.words.take(pa.array(keep)), np.r_[0, end]
        found = pc.index_in(words, value_set=self.words)
        new = words.filter(found.is_null())
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            sizes, pools = [np.zeros(0, np.int64)], [self.pool]
            for lo in range(0, len(new), self.piece):  # in pieces, as Python's strings take many times their bytes
                made = self.make(new.slice(lo, self.piece).to_pylist())
                sizes.append(np.fromiter(map(len, made), np.int64, len(made)) // 4)
                pools.append(np.frombuffer(b"".join(made), "<u4"))
            at[at < 0] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.off = np.r_[self.off, self.off[-1] + np.cumsum(np.concatenate(sizes))]
            self.pool = np.concatenate(pools)
        self.used = np.zeros(len(self.words), bool)
        self.used[at] = True
        return self.off[at], self.off[at + 1] - self.off[at], self.pool

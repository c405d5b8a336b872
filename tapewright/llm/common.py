"""What the operators share: the cluster's shared folder, tables in it, and batch views of text."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, one of our own, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tapewright-")
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tapewright/{name}-{uuid.uuid4().hex}"


_SCRATCH: list[list[DataFrame]] = []


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["saved_at"] = path
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


def scratch(make):
    """A function whose result is written, and whose other tables made by saved() are deleted when it returns or fails."""

    @functools.wraps(make)
    def made(*args, **named) -> DataFrame:
        _SCRATCH.append([])
        try:
            out = saved(make(*args, **named), make.__name__)
            _SCRATCH[-1] = [t for t in _SCRATCH[-1] if t is not out]
        finally:
            forget(*_SCRATCH.pop())
        if _SCRATCH:
            _SCRATCH[-1].append(out)
        return out

    return made


def forget(*tables: DataFrame) -> None:
    """Delete tables made by saved() that nothing reads any more."""
    for t in tables:
        path = t.__dict__.get("saved_at")
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def unused(docs: DataFrame, name: str) -> str:
    """A column name for our own use that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column, end to end, and the n + 1 offsets; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    _, offsets, data = col.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, count=n + 1, offset=col.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give freed memory back to the machine: a Python worker waits for its next task for up to a minute."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def collect_garbage(spark: SparkSession) -> None:
    """Have the executors collect garbage between stages of unlike needs, which lets their heaps shrink and frees the buffers
    of many small files: a stage that works in Python then finds the memory that one before it took in the JVM."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of a batch of texts, found and hashed without a Python loop.

    ``table`` maps each byte to itself as the words spell it (lower case, say), or to 0 where words end.
    ``start`` and ``end`` are byte places in the batch, ``doc`` the row, ``first`` the place of each row's
    first word among all words (n + 1 entries), ``hash`` 64 bits of the spelling.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray, hashed: bool = True):
        mapped = table[data]
        inside = mapped != 0
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True  # a word ends where its text ends
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.bytes = mapped
        self.hash = self._hashes(mapped, inside) if hashed else None

    def _hashes(self, mapped: np.ndarray, inside: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        within = np.arange(int(length.sum()), dtype=np.int64)
        begin = np.concatenate(([0], np.cumsum(length)[:-1]))
        within -= np.repeat(begin, length)
        powers = np.ones(int(length.max()), np.uint64)
        if len(powers) > 1:
            powers[1:] = self.BASE
            np.multiply.accumulate(powers, out=powers)
        letters = mapped[inside].astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            letters *= powers[within]
            total = np.add.reduceat(letters, begin)
            return mix64(total + mix64(length.astype(np.uint64)))


def lower_table(word_bytes) -> np.ndarray:
    """Byte table for Words: A-Z become a-z; bytes for which word_bytes(code) is false end words."""
    table = np.zeros(256, np.uint8)
    for c in range(256):
        low = c + 32 if 65 <= c <= 90 else c
        if word_bytes(low):
            table[c] = low
    return table


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 512 << 10):
    """Slices of whole rows of about ``limit`` bytes of text: work arrays are many times as large as the text."""
    col = batch.column(batch.schema.get_field_index(column))
    if not batch.num_rows:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0)).astype(np.int64)
    upto = np.cumsum(sizes)
    begin = 0
    while begin < batch.num_rows:
        before = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end

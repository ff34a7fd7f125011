"""What several operators share: scratch tables, byte slices of Arrow text, vectorised word and n-gram hashes."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, newline, vertical tab, form feed, carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: A run of white space, for Java's and DuckDB's engines.
GAP = r"[\x20\x09-\x0D]+"


def native_words(text: Column) -> Column:
    """Words of a text as an array, JVM only; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


# ---------------------------------------------------------------- scratch tables


class Scratch:
    """Tables in the folder that the cluster shares, named by spark.checkpoint.dir.

    A table read back from there has a short lineage that survives lost executors. Where the setting is absent a
    temporary folder is set in its place, on a single machine only: a cluster must name a folder that it shares.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="polyzona-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, sweep: bool = True) -> DataFrame:
        """df, computed once and read back; its shuffle files may go afterwards."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        if sweep:
            del df
            self.sweep()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Let the driver forget the shuffles of finished steps, so that their files are deleted."""
        gc.collect()
        self.spark._jvm.System.gc()


def quoted(name: str) -> str:
    """A column's name as an identifier, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def lean(run: Callable) -> Callable:
    """A function over Arrow batches that gives free memory back to the system when its task ends.

    Idle workers stay alive for a while beside those of later stages; what they keep counts against the executor.
    """

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return inner


# ---------------------------------------------------------------- bytes of Arrow text


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"").cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.fill_null("").cast(pa.large_string())
    raw = column.buffers()
    off = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1] if raw[1] else np.zeros(1, np.int64)
    return (np.frombuffer(raw[2], np.uint8) if raw[2] else np.zeros(0, np.uint8)), off


def slices(off: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about limit bytes each; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def find_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of the rows whose bytes are data[off[i]:off[i+1]], off[0] being 0."""
    n = len(data)
    solid = np.zeros(n + 2, bool)
    np.logical_not(_SPACE[data], out=solid[1:-1])
    begin, end = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    edge = off[:-1][off[:-1] < off[1:]]
    begin[edge] = solid[1:-1][edge]
    edge = off[1:][off[:-1] < off[1:]] - 1
    end[edge] = solid[1:-1][edge]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(off, starts, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any range of a sequence of 64-bit symbols, by differences of a polynomial's prefix sums (modulo 2**64)."""

    def __init__(self, seed: int):
        self.base = np.uint64(int(mixed(np.array([seed], np.uint64))[0]) | 5)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            m = max(n, 1 << 16)
            up, down = np.full(m, self.base), np.full(m, self.inverse)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        self.powers(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.up[: len(symbols)], dtype=np.uint64, out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.down[start])

    def windows(self, symbols: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all windows of that width."""
        if len(symbols) < width:
            return np.zeros(0, np.uint64)
        p = self.prefix(symbols)
        return mixed((p[width:] - p[:-width]) * self.down[: len(p) - width])


_BYTE = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1000))
_IN_WORD = Rolling(1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    p = _IN_WORD.prefix(_BYTE[data])
    return mixed(_IN_WORD.of(p, starts, ends) + (ends - starts).astype(np.uint64))


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit numbers as Arrow int64 with the same bits."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the ASCII controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_OWN_DIR: dict[str, str] = {}


#: Of a batch of rows that a task sends to Python: rows of long texts are many bytes.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    """A table of a folder, read with options. The session's batches are bounded by bytes, as its rows are of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.options(**options).parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session, whose tasks are this process, may lack it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN_DIR.setdefault("dir", tempfile.mkdtemp(prefix="spark-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/beatloom/{name}-{uuid.uuid4().hex}"


#: Parquet of rows of megabytes: each is a row group of its own, else a task holds up to 100 of them, writing as well as reading; statistics would keep every group's least and largest value to the file's end.
LARGE_ROWS = {"parquet.block.row.count.limit": "1", "parquet.column.statistics.enabled": "false"}


def stored(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**(LARGE_ROWS if large_rows else {})).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table written by stored(), once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_task(run: Callable) -> Callable:
    """A function of a task's batches that gives freed memory back at its end: workers outlive tasks, and would keep it."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another allocator
                pass

    return wrapped


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def hex_key(value: Column, digits: int, start: int = 1) -> Column:
    """An integer from hexadecimal digits of the MD5 of a value's text; null counts as the text '~'."""
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("~")).cast("binary"))
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of rows that no model learns from: CRC-32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_LETTER = np.zeros(0x110000, dtype=bool)


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER[ord("a")]:
        _LETTER[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _LETTER


class WordCache(dict):
    """What a function gives for words, remembered in two generations, so that frequent words stay when it is full.

    It holds 2 * size words at most between calls of trim().
    """

    def __init__(self, make: Callable[[str], object], size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, word: str) -> object:
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self[word] = value
        return value

    def trim(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


class SpanHashes:
    """64-bit hashes of spans of number sequences, by prefix sums of a polynomial modulo 2 ** 64."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        factor = 0x9E3779B97F4A7C15
        size = max(4096, 1 << n.bit_length())
        for name, f in (("up", factor), ("down", pow(factor, -1, 1 << 64))):
            steps = np.full(size, f, dtype=np.uint64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values)
        if n >= len(self.up):
            self._grow(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:n], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number scrambled."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators of words in the operators' contracts.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
UPPER = bytes(range(65, 91))
#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER_AZ = bytes.maketrans(UPPER, UPPER.lower())

_MADE: list[tuple[SparkSession, str]] = []


def ship(module: str) -> None:
    """Pickle the functions of `module` by value, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def worker_memo(name: str, limit: int) -> dict:
    """A dict that lives as long as the Python worker, emptied when it holds more than `limit` keys."""
    holder = sys.modules.setdefault("_tessera_memo", types.ModuleType("_tessera_memo"))
    memo = holder.__dict__.setdefault(name, {})
    if len(memo) > limit:
        memo.clear()
    return memo


def drop_memos() -> None:
    """Empty what another operator has kept in this Python worker: workers outlive the stages they serve."""
    for memo in vars(sys.modules.get("_tessera_memo", types.ModuleType("none"))).values():
        if isinstance(memo, dict):
            memo.clear()


def give_back() -> None:
    """Return to the system what this Python worker has freed: its allocators keep it, and an idle worker counts
    with its executor while later stages run."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their differences over all bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


LETTER = scrambled(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
STEP = np.uint64(0xD6E8FEB86659FD93)
POWERS = np.cumprod(np.full(64, STEP), dtype=np.uint64)
IN_WORD = np.ones(256, bool)
IN_WORD[[9, 10, 11, 12, 13, 32]] = False
#: Bytes whose words are hashed at once; a slab ends at the end of a word.
SLAB = 1 << 20


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a whole text, in order, without a Python object for each word."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLAB)
        while end < len(data) and IN_WORD[data[end]]:
            end += 1
        parts.append(_slab_hashes(np.frombuffer(data, np.uint8, end - at, at)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _slab_hashes(data: np.ndarray) -> np.ndarray:
    where = np.flatnonzero(IN_WORD[data])
    if not where.size:
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(where) > 1]))
    sizes = np.diff(np.append(first, where.size))
    longest = int(sizes.max())
    powers = POWERS if longest <= len(POWERS) else np.cumprod(np.full(longest, STEP), dtype=np.uint64)
    values = LETTER[data[where]] * powers[np.arange(where.size) - np.repeat(first, sizes)]
    return scrambled(np.add.reduceat(values, first) + sizes.astype(np.uint64))


def scratch(spark: SparkSession) -> str:
    """The shared folder for cut lineage: that of spark.checkpoint.dir. Where it is unset, a folder of our own
    if all runs on this machine; on a cluster that is an error, as executors could not read it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write `df` to the shared folder, in a folder for each value of `by` if given, and read it back: later plans
    start there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    swept(spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._tessera_path = path
    return out


def swept(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver ends."""
    if not _MADE:
        atexit.register(_sweep)
    _MADE.append((spark, path))


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more, and let Spark drop the shuffles behind it."""
    if path := getattr(df, "_tessera_path", None):
        _delete(df.sparkSession, path)
        release(df)


def release(df: DataFrame) -> None:
    """Let Spark drop the shuffles of plans that are done: it does so as the driver collects its garbage, and those
    of the last plan only as it does so once more."""
    gc.collect()
    for _ in range(2):
        df.sparkSession._jvm.System.gc()


def discarded(spark: SparkSession, path: str | None) -> None:
    """Delete a folder that nothing reads any more."""
    if path:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for spark, path in _MADE:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended  # noqa: BLE001
            return


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the input's size; for file scans the size of the files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def buckets(df: DataFrame, each: int = 4 << 20, least: int = 96) -> int:
    """How many hash buckets to deal work into, in proportion to the input."""
    return max(least, min(1 << 20, input_bytes(df) // each))


def small_batches(spark: SparkSession, rows: int = 500, size: int = 16 << 20) -> None:
    """Bound the rows and bytes of an Arrow batch: documents can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


#: Bytes that a broadcast side may have, as counted rows times their width in memory.
BROADCAST = 32 << 20
#: Bytes in memory that a row of it counts for.
WIDTH = 64


def few(side: DataFrame, width: int = WIDTH, rows: int | None = None, most: int = BROADCAST) -> DataFrame:
    """`side`, marked for broadcast only if its counted rows of `width` bytes each are within `most`; beyond
    that both sides are shuffled, however small the planner takes it to be by the bytes of compressed files."""
    return F.broadcast(side) if (side.count() if rows is None else rows) * width <= most else side.hint("merge")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the identifier as text; a null identifier counts as empty."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


ship(__name__)

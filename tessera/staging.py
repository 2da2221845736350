"""Tables written between stages: later plans start from files, not from all that made them."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own where that is unset and all runs on this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _MADE:
        atexit.register(_sweep)
    _MADE.append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    out._tessera_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._tessera_path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffles of plans that are done, which it does as the driver collects its garbage."""
    gc.collect()
    for _ in range(2):
        spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for spark, path in _MADE:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended  # noqa: BLE001
            return

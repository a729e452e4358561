"""The folder that all executors share, and tables written there once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
#: Rows of a narrow table that may be broadcast; they are counted first.
SMALL = 1 << 18


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves, but only in local mode, in
    which driver and executors are one process on one disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="sensespark-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of the file, never
    a re-run of what made it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> bool:
    """Whether ``df``, best a written table, has so few rows that they may be broadcast."""
    return df.limit(SMALL + 1).count() <= SMALL


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast if its rows are few; else a join shuffles it."""
    return F.broadcast(df) if few(df) else df

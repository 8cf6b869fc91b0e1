"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_live: dict[str, SparkSession] = {}


@cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="spindrift-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all tasks run on this machine (tests), a local folder."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return given or _own()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed by discard() or when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/spindrift/{label}-{uuid.uuid4().hex}"
    _live[path] = spark
    return path


def made() -> list[str]:
    """The paths that are not removed yet, the oldest first."""
    return list(_live)


def discard(paths: Iterable[str]) -> None:
    """Remove paths whose tables nothing reads any more."""
    for path in paths:
        spark = _live.pop(path, None)
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may have ended before  # noqa: BLE001
            pass


@atexit.register
def _discard_all() -> None:
    discard(made())


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read back, and its path."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, lost executors cost no recomputation."""
    return written(df, label)[0]


def spread(df: DataFrame) -> DataFrame:
    """A scan that gives fewer tasks than there are cores (one row group is one task), dealt out to all of them; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df

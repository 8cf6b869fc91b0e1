"""Attempt history: append-only, a folder for each month, kept for the current and the previous one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def month(started_at: Column) -> Column:
    return F.trunc(started_at.cast("date"), "MM")


def append(attempts: DataFrame, path: str) -> None:
    """Add attempts (started_at, ...) to the history; a reader of some months reads their folders alone."""
    attempts.withColumn("started_month", month(F.col("started_at"))).write.mode("append").partitionBy("started_month").parquet(path)


def kept(started_month: Column, now: Column) -> Column:
    """Whether retention keeps a month: the one before now's, and later ones."""
    return started_month >= F.add_months(F.trunc(now.cast("date"), "MM"), -1)


def drop_old(spark: SparkSession, path: str, now: str) -> list[str]:
    """Delete the folders of months before the kept ones; their names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()] if fs.exists(root) else []
    months = [(n, n.partition("=")[2]) for n in names if n.startswith("started_month=") and n[14:15].isdigit()]
    oldest = spark.sql(f"SELECT cast(add_months(trunc(timestamp'{now}', 'MM'), -1) AS string)").first()[0]
    old = sorted(n for n, m in months if m < oldest)
    for n in old:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}"), True)
    return old


def by_month(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy(month(F.col("started_at")).alias("started_month")).agg(F.count("*").alias("n_attempts"), F.count_if(F.col("error_class").isNotNull()).alias("n_errors"))


#: Upper bounds of the duration histogram, in milliseconds.
DURATION_BUCKETS = (50, 100, 250, 500, 1000, 2500, 5000, 10_000)


def metrics(attempts: DataFrame) -> DataFrame:
    """Attempts by outcome with a duration histogram of cumulative counts, as a scraper of metrics wants them."""
    bounds = [F.count_if(F.col("duration_ms") <= b).alias(f"le_{b}") for b in DURATION_BUCKETS]
    return attempts.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), *bounds)

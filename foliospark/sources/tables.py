"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; column pruning and filters reach the scan because nothing is read eagerly."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan with at least as many partitions as the cluster has cores.

    Files of few row groups leave cores idle, which costs more than moving their rows once when every
    row takes real work. Large inputs have more partitions than cores and pass through untouched.
    Only for scans: a plan with shuffles would have to run to tell its partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def text_rows(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose texts are to be worked on, over all cores."""
    return spread(table(spark, sf_dir, name).select(*columns))


def latest(df: DataFrame, key: str | list[str], version: str = "loaded_at") -> DataFrame:
    """One row per key: the last delivered one. Rows with a null key are kept as they are.

    Redelivered rows are equal but for ``version``, so callers that only need a function of the
    payload should rather apply it first and deduplicate its small result.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last())
    ranked = df.withColumn("__rn", F.row_number().over(order))
    return ranked.filter(F.col("__rn") == 1).drop("__rn")

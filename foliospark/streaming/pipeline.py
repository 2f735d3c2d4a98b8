"""The same columns over streams: files as they arrive, and windowed summaries of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from ..operators.routing import size_error
from ..operators.pii import BUILTIN_RULES, PiiRule, analyze_and_mask

FILES = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000, max_mb: float = 200) -> DataFrame:
    """New files of a folder, with what ``results_of`` needs; usable in ``foreachBatch``. Too large ones carry their error."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    problem = size_error(F.col("length"), max_mb)
    return stream.select(
        F.col("path").alias("file"), name.alias("file_name"), F.xxhash64("path").alias("ord"), "length", F.when(problem.isNull(), F.col("content")).alias("content"),
        problem["code"].alias("error_code"), problem["message"].alias("error"),
    )


def protected_stream(texts: DataFrame, column: str = "text", operator: str = "replace", rules: tuple[PiiRule, ...] = BUILTIN_RULES) -> DataFrame:
    """A stream of texts with their findings and report; stateless."""
    return analyze_and_mask(texts, column, operator, rules)


def deduplicated(stream: DataFrame, key: str, event_time: str, late: str) -> DataFrame:
    """Each key once, forgetting keys older than the watermark."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def status_windows(results: DataFrame, event_time: str = "processed_at", late: str | None = "1 day", window: str = "1 hour") -> DataFrame:
    """Results by window and status, for results no later than the watermark; without ``late`` the one that ``results`` has."""
    return (
        (results.withWatermark(event_time, late) if late else results)
        .groupBy(F.window(event_time, window), "status")
        .agg(F.count("*").alias("results"), F.avg("duration_sec").alias("avg_sec"))
        .select(F.col("window.start").alias("window_start"), "status", "results", "avg_sec")
    )


def run_files(spark: SparkSession, path: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Process the files there are and those that came since the last run, then stop."""
    from ..plans.pipeline import results_of

    def write(batch: DataFrame, batch_id: int) -> None:
        results_of(batch, **options).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    return file_stream(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

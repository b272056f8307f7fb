"""Parquet tables: views of the source tables, and the two append logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.columns import bucket_start, day_text
from flowlens.operators.lookups import lookup_join
from flowlens.session import path_exists

DELTA_BUCKET = 300


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def append_mint_log(events: DataFrame, path: str) -> None:
    """Append to the mint log, one partition per day, kept for good.

    The rebalance lets the adaptive plan merge small days and split a day that is too large.
    """
    dated = events.withColumn("day", day_text(F.col("block_time")))
    dated.hint("rebalance", F.col("day")).write.mode("append").partitionBy("day").parquet(path)


def read_mint_day(spark: SparkSession, path: str, day: str, mint: str | None = None) -> DataFrame:
    """One day of the mint log (a partition), optionally one mint."""
    rows = spark.read.option("basePath", path).parquet(path).filter(F.col("day").cast("string") == day)
    return rows.filter(F.array_contains("mints_touched", mint)) if mint else rows


def _period(bucket: int) -> int:
    """Seconds of one partition of the delta log: a day, or one bucket if that is longer."""
    return max(bucket, 86_400)


def append_delta_log(records: DataFrame, path: str, bucket: int = DELTA_BUCKET) -> None:
    """Append balance changes, one partition per day, sorted by time bucket within.

    Short buckets would make a directory each; within a day the sort lets readers skip row groups.
    """
    keyed = records.withColumns(
        {
            "bucket": bucket_start(F.col("block_time"), bucket),
            "period": bucket_start(F.col("block_time"), _period(bucket)),
        }
    )
    dealt = keyed.hint("rebalance", F.col("period")).sortWithinPartitions("period", "bucket")
    dealt.write.mode("append").partitionBy("period").parquet(path)


# Parts of the index, by hash of the mint.
INDEX_PARTS = 64


def _index_part(mint: Column) -> Column:
    return F.pmod(F.xxhash64(mint), F.lit(INDEX_PARTS)).cast("int")


def index_delta_log(spark: SparkSession, path: str, index: str) -> None:
    """Post every mint of the log files that ``index`` does not know yet: (mint, period, file, records).

    Files are immutable, so a file is posted once, whole; running it again posts nothing twice. Only new
    files are read, and of them one column.
    """
    rows = spark.read.parquet(path).select("mints_touched", "period", F.col("_metadata.file_path").alias("file"))
    if path_exists(spark, index):
        # File names are few beside records; the filter on them is not pushed down, so files are listed first.
        known = spark.read.parquet(index).select("file").distinct()
        files = rows.select("file").distinct().join(known, "file", "left_anti")
        rows = lookup_join(rows, files, ["file"], "left_semi")
    posted = rows.select(F.explode(F.array_distinct("mints_touched")).alias("mint"), "period", "file")
    counted = posted.groupBy("mint", "period", "file").agg(F.count("*").alias("records")).withColumn("part", _index_part(F.col("mint")))
    # The adaptive plan splits a part that is too large for a task, so what a task sorts does not grow with the log.
    dealt = counted.hint("rebalance", F.col("part")).sortWithinPartitions("part", "mint", "period")
    dealt.write.mode("append").partitionBy("part").parquet(index)


def read_indexed_deltas(
    spark: SparkSession, path: str, index: str, mint: str, now: int, max_age: int, bucket: int = DELTA_BUCKET
) -> DataFrame:
    """``read_recent_deltas`` of one mint that opens only the files which the index posts for it.

    The postings of one mint and period of time are at most one row per log file of that time.
    """
    period = _period(bucket)
    postings = spark.read.parquet(index).filter((F.col("part") == _index_part(F.lit(mint))) & (F.col("mint") == mint))
    oldest = (now - max_age) // period * period
    files = [r[0] for r in postings.filter((F.col("period") >= oldest) & (F.col("period") <= now)).select("file").distinct().collect()]
    schema = spark.read.parquet(path).schema
    if not files:
        return spark.createDataFrame([], schema)
    log = spark.read.schema(schema).option("basePath", path).parquet(*sorted(files))
    return _recent(log, now, max_age, bucket).filter(F.array_contains("mints_touched", mint))


def drop_expired(spark: SparkSession, path: str, now: int, max_age: int, bucket: int = DELTA_BUCKET) -> int:
    """Remove the partitions of the delta log that ended more than ``max_age`` seconds before ``now``."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dropped = 0
    for entry in system.listStatus(folder):
        name = entry.getPath().getName()
        if name.startswith("period=") and name[7:].lstrip("-").isdigit() and int(name[7:]) + _period(bucket) < now - max_age:
            system.delete(entry.getPath(), True)
            dropped += 1
    return dropped


def read_recent_deltas(
    spark: SparkSession,
    path: str,
    now: int,
    max_age: int,
    mint: str | None = None,
    bucket: int = DELTA_BUCKET,
) -> DataFrame:
    """Records of the last ``max_age`` seconds; older days are pruned, not read."""
    rows = _recent(spark.read.parquet(path), now, max_age, bucket)
    return rows.filter(F.array_contains("mints_touched", mint)) if mint else rows


def _recent(log: DataFrame, now: int, max_age: int, bucket: int) -> DataFrame:
    oldest = now - max_age
    return log.filter(
        (F.col("period") >= oldest // _period(bucket) * _period(bucket))
        & (F.col("bucket") >= oldest // bucket * bucket)
        & (F.col("block_time") >= oldest)
        & (F.col("block_time") <= now)
    )

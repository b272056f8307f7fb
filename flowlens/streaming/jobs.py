"""Streaming forms of the batch operators, and sinks that survive a replay."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlens.functions.columns import wide
from flowlens.operators.lookups import top_per_key
from flowlens.operators.merge import first_per_key
from flowlens.operators.rules import first_match
from flowlens.operators.trades import backfill_missing
from flowlens.session import path_exists, shared_dir
from flowlens.sources.rules import Rule
from flowlens.streaming.progress import ProgressLog


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    file_name: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Records from a growing folder of parquet files.

    ``max_files`` per micro-batch bounds the batch, the way a consumer's read count does.
    """
    reader = spark.readStream.schema(schema)
    if file_name:
        reader = reader.option("pathGlobFilter", file_name)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def event_time(rows: DataFrame, epoch: str = "block_time", late: str = "10 minutes") -> DataFrame:
    """Add ``ts`` from epoch seconds with a watermark; stateful operators drop rows later than that.

    ``run_available`` counts the dropped rows.
    """
    return rows.withColumn("ts", F.timestamp_seconds(epoch)).withWatermark("ts", late)


def deduplicated(rows: DataFrame, keys: Sequence[str] = ("signature",)) -> DataFrame:
    """First record per key within the watermark. Made for keys that never come back, such as
    signatures; for keys that recur use the ``first_sight`` gate."""
    return rows.dropDuplicatesWithinWatermark(list(keys))


def bucket_counters(swaps: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Counters per mint and window of a trade stream with event time ``ts``.

    Spark combines partial counts before the exchange, so a hot mint costs one row per task.
    """
    buy = F.col("side") == "buy"
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        swaps.groupBy(window.alias("w"), F.col("base_mint").alias("mint"))
        .agg(
            F.count_if(buy).alias("buy_count"),
            F.count_if(~buy).alias("sell_count"),
            F.sum(wide(F.col("quote_amount"))).alias("volume_lamports"),
            F.approx_count_distinct(F.when(buy, F.col("user_wallet"))).alias("unique_buyers"),
        )
        .select(
            "mint",
            F.unix_timestamp(F.col("w.start")).alias("win_start"),
            F.unix_timestamp(F.col("w.end")).alias("win_end"),
            "buy_count",
            "sell_count",
            "volume_lamports",
            "unique_buyers",
        )
    )


# --- sinks ---------------------------------------------------------------------------------


def write_versions(
    path: str, keys: Sequence[str] = (), every: int = 64
) -> Callable[[DataFrame, int], None]:
    """Sink for update mode: each micro-batch is a folder of its own, overwritten on replay.

    With ``keys`` the folders before every ``every``-th batch are put together to one, so that what a reader ranks is
    the table and a bounded number of batches, however long the stream has run.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if keys and batch_id and batch_id % every == 0:
            compact_versions(batch.sparkSession, path, keys, batch_id - 1)

    return write


def compact_versions(spark: SparkSession, path: str, keys: Sequence[str], upto: int) -> int:
    """Keep the newest version of each key among the batches up to ``upto`` in one folder; the number of folders left.

    Batches before the last one are never replayed, so they may go. The new folder is written whole before the
    old ones are dropped, and a run that was cut short in between is finished by the next one.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches() -> list[int]:
        names = [s.getPath().getName() for s in system.listStatus(root)]
        return sorted(int(n[6:]) for n in names if n.startswith("batch="))

    def target(name: str):
        return jvm.org.apache.hadoop.fs.Path(root, name)

    def settle(batch: int) -> None:
        if system.exists(target(f"_compacted-{batch}/_SUCCESS")):
            for old in [b for b in batches() if b <= batch]:
                system.delete(target(f"batch={old}"), True)
            system.rename(target(f"_compacted-{batch}"), target(f"batch={batch}"))
        else:
            system.delete(target(f"_compacted-{batch}"), True)

    for name in [s.getPath().getName() for s in system.listStatus(root)]:
        if name.startswith("_compacted-"):
            settle(int(name[11:]))
    old = [b for b in batches() if b <= upto]
    if len(old) > 1:
        rows = spark.read.option("basePath", path).parquet(*[f"{path}/batch={b}" for b in old])
        latest = top_per_key(rows, keys, [F.desc("batch")], 1).drop("rank", "batch")
        latest.write.mode("overwrite").parquet(f"{path}/_compacted-{old[-1]}")
        settle(old[-1])
    return len(batches())


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of each key among what ``write_versions`` wrote."""
    return top_per_key(spark.read.parquet(path), keys, [F.desc("batch")], 1).drop("rank", "batch")


def insert_once(
    path: str, keys: Sequence[str], order: Sequence[str], epoch: str | None = None, reach: int = 7, period: int = 86_400
) -> Callable[[DataFrame, int], None]:
    """Sink that keeps the first row per key for good.

    A replayed batch overwrites its own folder and is compared with earlier batches only, so a
    restart neither loses nor repeats rows. With ``epoch`` (a column of epoch seconds) rows are stored by
    ``period`` (a day), and a batch is compared with the periods it touches and ``reach`` periods around them only:
    what one batch reads then depends on the batch and not on the life of the stream. Keys must not come back later
    than that.
    """

    def stored_before(batch: DataFrame, batch_id: int) -> DataFrame:
        earlier = read_stored(batch.sparkSession, path, batch.schema, epoch).filter(F.col("batch") < batch_id)
        if epoch is None:
            return earlier
        low, high = batch.agg(F.min(epoch), F.max(epoch)).first()
        if low is None:
            return earlier.limit(0)
        return earlier.filter(F.col("day").between(low // period - reach, high // period + reach))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read twice below; the stateful steps before it must run once
        try:
            new = first_per_key(batch, keys, [F.asc(c) for c in order])
            if batch_id > 0 and path_exists(batch.sparkSession, path):
                new = new.join(stored_before(batch, batch_id).select(*keys), list(keys), "left_anti")
            if epoch is None:
                new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            else:
                days = new.withColumn("day", F.floor(F.col(epoch) / period))
                # Dealt by period, or each task would write a small file for each period.
                days.hint("rebalance", F.col("day")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def read_stored(spark: SparkSession, path: str, schema: T.StructType, epoch: str | None = None) -> DataFrame:
    """What ``insert_once`` has stored of rows with ``schema``, with ``batch`` and ``day``.

    The schema is not taken from the files: a batch without rows leaves a folder without any.
    """
    own = [T.StructField("batch", T.LongType()), *([T.StructField("day", T.LongType())] if epoch else [])]
    return spark.read.schema(T.StructType([*schema.fields, *own])).parquet(path)


def match_rules(
    path: str, rules: Callable[[], Sequence[Rule]]
) -> Callable[[DataFrame, int], None]:
    """Sink that evaluates rules on each batch of statistics; the rules are read anew every time."""

    def write(batch: DataFrame, batch_id: int) -> None:
        found = first_match(batch, rules()).withColumn("rules_batch", F.lit(batch_id))
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def backfill_hot(
    path: str, deltas: Callable[[], DataFrame], supply: DataFrame, period: int = 86_400
) -> Callable[[DataFrame, int], None]:
    """Sink for a stream of newly hot mints (``mint``): their trades in the stored balance changes
    that ``deltas`` reads, with market cap, stored once."""
    store = insert_once(path, ["signature", "base_mint"], ["slot"], epoch="block_time", period=period)

    def write(batch: DataFrame, batch_id: int) -> None:
        store(backfill_missing(deltas(), batch.select("mint").distinct(), supply), batch_id)

    return write


def state_partitions(spark: SparkSession) -> int:
    """Partitions for the state of a stream: one per core of the cluster, never more than the session's shuffles have.

    Each costs every micro-batch a task, a store on disk and its commit, however few keys it holds.
    """
    return min(int(spark.conf.get(SHUFFLES)), max(4, spark.sparkContext.defaultParallelism))


def run_available(
    stream: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str | None = None,
    mode: str = "update",
    counts: dict[str, int] | None = None,
    name: str | None = None,
    log: ProgressLog | None = None,
    partitions: int | None = None,
) -> str:
    """Process what is there, then stop; returns the checkpoint for a restart.

    ``partitions`` of the state of a stateful stream (see ``state_partitions``); a restart keeps those of its checkpoint.

    ``counts`` gets the number of micro-batches and of rows that came too late for the watermark. ``log``, a
    listener of the session, gets every report of the run, under ``name``, and is flushed.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or shared_dir(spark)
    # State beyond the executors' memory: kept on disk, snapshots in the checkpoint.
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if partitions:
        settings[SHUFFLES] = str(partitions)
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        writer = stream.writeStream.queryName(name) if name else stream.writeStream
        query = (
            writer.outputMode(mode)
            .foreachBatch(sink)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    if log is not None:
        log.wait(str(query.runId))
        log.flush()
    if counts is not None:
        progress = list({p["batchId"]: p for p in query.recentProgress}.values())
        counts["batches"] = counts.get("batches", 0) + len(progress)
        late = sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"])
        counts["late_rows"] = counts.get("late_rows", 0) + late
    return checkpoint


# --- token state ---------------------------------------------------------------------------

SHUFFLES = "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Rows of this mint only move the watermark.
CLOCK = "~clock"

STATE_OUT = T.StructType(
    [
        T.StructField("mint", T.StringType()),
        T.StructField("changed_at", T.LongType()),
        T.StructField("state", T.StringType()),
    ]
)
_STATE = T.StructType(
    [T.StructField("state", T.StringType()), T.StructField("hot_until", T.LongType())]
)


def token_state(evaluations: DataFrame, hot_ttl: int, late: str = "10 minutes") -> DataFrame:
    """State changes of a stream of evaluations (``mint``, ``win_end``, ``hit``).

    Cold turns warm on activity, anything but hot turns hot on a hit, hot turns cold ``hot_ttl``
    seconds later by an event-time timer. One row per token and window comes in, so a busy token
    is no larger than a quiet one.
    """

    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mint = key[0]
        if mint == CLOCK:
            return
        current, hot_until = state.get if state.exists else ("cold", 0)
        out = []
        if state.hasTimedOut:
            if current == "hot":
                out.append((mint, hot_until, "cold"))
                current = "cold"
        else:
            rows = pd.concat(list(chunks)).sort_values("win_end")
            for at, hit in zip(rows["win_end"], rows["hit"], strict=True):
                if current == "hot" and at >= hot_until:
                    out.append((mint, hot_until, "cold"))
                    current = "cold"
                if current == "cold":
                    out.append((mint, int(at), "warm"))
                    current = "warm"
                if hit and current != "hot":
                    out.append((mint, int(at), "hot"))
                    current, hot_until = "hot", int(at) + hot_ttl
        if current == "cold":
            state.remove()  # the same as no state
        else:
            state.update((current, hot_until))
        if current == "hot":
            due = max(hot_until * 1000, state.getCurrentWatermarkMs() + 1)
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame(out, columns=[f.name for f in STATE_OUT])

    timed = event_time(evaluations, "win_end", late)
    return timed.groupBy("mint").applyInPandasWithState(
        step, STATE_OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )

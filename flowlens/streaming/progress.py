"""Progress of running streams as a table: what a live page needs without asking the streams.

``ProgressLog`` is a listener that keeps one row per micro-batch of every query of the session and appends them to a
folder: query, batch, rows, seconds, the newest event time, and late rows. Rows are few (one per batch),
so each flush is one small file; a restarted query repeats a batch's row, and readers keep the last one.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from flowlens.operators.lookups import top_per_key
from flowlens.session import path_exists

SCHEMA = (
    "query string, run string, batch long, at string, input_rows long, seconds double, max_event_time string, late_rows long"
)


class ProgressLog(StreamingQueryListener):
    """Listener that gathers progress; ``flush`` appends what came since the last one to ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__()
        self.spark, self.path = spark, path
        self._rows: list[tuple] = []
        self._ended: set[str] = set()
        self._change = threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        told = json.loads(event.progress.json)
        late = sum(o.get("numRowsDroppedByWatermark", 0) for o in told.get("stateOperators", []))
        row = (
            told.get("name") or told["id"], told["runId"], int(told["batchId"]), told["timestamp"], int(told.get("numInputRows", 0)),
            told.get("durationMs", {}).get("triggerExecution", 0) / 1000.0, told.get("eventTime", {}).get("max"), int(late),
        )
        with self._change:
            self._rows.append(row)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._change:
            self._ended.add(str(event.runId))
            self._change.notify_all()

    def wait(self, run: str, seconds: float = 60.0) -> bool:
        """Wait until everything about a finished run has been told (events come after the query ends)."""
        with self._change:
            return self._change.wait_for(lambda: run in self._ended, seconds)

    def flush(self) -> None:
        with self._change:
            rows, self._rows = self._rows, []
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per query and batch, the last report of each; event times as epoch seconds."""
    if not path_exists(spark, path):
        rows = spark.createDataFrame([], SCHEMA)
    else:
        rows = top_per_key(spark.read.schema(SCHEMA).parquet(path), ["query", "batch"], [F.desc("input_rows"), F.desc("at")], 1)
    epoch = F.unix_timestamp(F.to_timestamp("max_event_time"))
    return rows.select("query", "batch", "at", "input_rows", "seconds", epoch.alias("event_seconds"), "late_rows")


def worker_state(progress: DataFrame) -> DataFrame:
    """One row over all batches: rows done, seconds spent, rows per second, newest event time, late rows."""
    return progress.agg(
        F.coalesce(F.sum("input_rows"), F.lit(0)).alias("worker_rows"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("worker_seconds"),
        F.max("event_seconds").alias("newest_event"),
        F.coalesce(F.sum("late_rows"), F.lit(0)).alias("late_rows"),
    ).withColumn(
        "rows_per_second", F.coalesce(F.try_divide(F.col("worker_rows").cast("double"), F.col("worker_seconds")), F.lit(0.0))
    )

"""Operational figures as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.columns import fixed

# Upper bounds of the latency histogram (seconds).
LATENCY_BOUNDS = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0)
# Lag (seconds) and backlog (records) above which a mode starts.
DEGRADED_LAG, CRITICAL_LAG = 5, 30
DEGRADED_BACKLOG, CRITICAL_BACKLOG = 50_000, 80_000


def labelled_counts(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Counts per combination of labels, with every subtotal; ``all`` marks a summed label.

    The rows are counted once per combination; only those counts are expanded into subtotals.
    """
    base = rows.groupBy(*labels).agg(F.count("*").alias("_n"))
    counted = base.cube(*labels).agg(F.sum("_n").alias("n"), F.grouping_id().alias("_g"))
    last = len(labels) - 1
    return counted.select(
        *[
            F.when(F.col("_g").bitwiseAND(1 << (last - i)) != 0, F.lit("all"))
            .otherwise(F.col(c))
            .alias(c)
            for i, c in enumerate(labels)
        ],
        "n",
    )


def histogram(rows: DataFrame, value: str, bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative counts at or below each bound and in total (``+Inf``), with sum and count.

    Each row is put into its bucket once; the running sum works on one row per bucket.
    """
    bounds = sorted(bounds)
    place = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        place = F.when(F.col(value) <= bounds[i], F.lit(i)).otherwise(place)
    exact = F.sum(F.round(F.col(value) * 1e9).cast("decimal(38,0)"))
    per_bucket = rows.groupBy(place.alias("_i")).agg(F.count("*").alias("n"), exact.alias("_s"))
    spark = rows.sparkSession
    frame = spark.range(len(bounds) + 1).select(F.col("id").cast("int").alias("_i"))
    w = Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(1))
    text = F.element_at(F.array(*[F.lit(str(b)) for b in bounds], F.lit("+Inf")), F.col("_i") + 1)
    filled = frame.join(per_bucket, "_i", "left")
    return filled.select(
        text.alias("le"),
        F.sum(F.coalesce("n", F.lit(0))).over(w).alias("cumulative"),
        (F.sum(F.coalesce("_s", F.lit(0))).over(whole).cast("double") / 1e9).alias("sum"),
        F.sum(F.coalesce("n", F.lit(0))).over(whole).alias("count"),
    )


def rate(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """``part / whole * scale``, 0 for an empty whole."""
    return F.coalesce(
        F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(scale), F.lit(0.0)
    )


def fire_rate(evaluated: DataFrame, fired: DataFrame) -> DataFrame:
    """One row: evaluations, those at which a rule fired, and their share in percent (0 without evaluations)."""
    counts = evaluated.agg(F.count("*").alias("evaluations")).crossJoin(fired.agg(F.count("*").alias("triggers_fired")))
    return counts.withColumn("fire_rate_pct", rate(F.col("triggers_fired"), F.col("evaluations"), 100.0))


def mode(
    lag: Column,
    backlog: Column,
    degraded: tuple[float, float] = (DEGRADED_LAG, DEGRADED_BACKLOG),
    critical: tuple[float, float] = (CRITICAL_LAG, CRITICAL_BACKLOG),
) -> Column:
    """Working mode from processing lag and backlog."""
    return (
        F.when((lag > critical[0]) | (backlog > critical[1]), F.lit("critical"))
        .when((lag > degraded[0]) | (backlog > degraded[1]), F.lit("degraded"))
        .otherwise(F.lit("normal"))
    )


def allowed(mode: Column) -> dict[str, Column]:
    """What each mode lets through."""
    return {
        "store_swaps": mode == "normal",
        "enrich": mode != "critical",
        "parse_full": mode == "normal",
    }


def with_transitions(progress: DataFrame, key: str, time: str, mode: str = "mode") -> DataFrame:
    """Mark rows whose mode differs from the one before. ``progress`` has one row per key and
    reporting interval, so a key's rows are bounded by the time range."""
    w = Window.partitionBy(key).orderBy(time)
    before = F.lag(mode).over(w)
    return progress.withColumn("changed", F.coalesce(before != F.col(mode), F.lit(False)))


def health_issues(lag: Column, backlog: Column, uptime: Column, tx_per_second: Column, limits=None) -> Column:
    """Array of problems, empty when healthy. ``limits``: lag, backlog, uptime, tx/s."""
    max_lag, max_backlog, grace, min_rate = limits or (60, 50_000, 60, 1)
    return F.array_compact(
        F.array(
            F.when(lag > max_lag, F.concat(F.lit("High processing lag: "), fixed(lag, 0), F.lit("s"))),
            F.when(
                backlog > max_backlog,
                F.concat(F.lit("Large stream backlog: "), backlog.cast("bigint").cast("string")),
            ),
            F.when(
                (uptime > grace) & (tx_per_second < min_rate),
                F.concat(F.lit("Low throughput: "), fixed(tx_per_second, 1), F.lit(" tx/s")),
            ),
        )
    )


def health_status(stores_ok: Column, last_tx_age: Column, active_within: float = 60) -> Column:
    """``healthy`` with a live stream, ``degraded`` with an idle one, ``unhealthy`` without stores."""
    return (
        F.when(~stores_ok, F.lit("unhealthy"))
        .when(last_tx_age < active_within, F.lit("healthy"))
        .otherwise(F.lit("degraded"))
    )

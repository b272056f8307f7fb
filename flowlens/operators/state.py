"""Token state over time and alert cool-down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.gate import first_sight
from flowlens.session import materialize


def cooled_down(hits: DataFrame, cooldown: int, key: str = "mint", time: str = "win_end") -> DataFrame:
    """Hits that raise an alert: none for the same key within ``cooldown`` seconds of the last.

    The hits are used twice, so they are worked out once and written.
    """
    hits, _ = materialize(hits)
    return hits.join(first_sight(hits.select(key, time), [key], time, cooldown), [key, time], "left_semi")


def state_changes(
    activity: DataFrame, hits: DataFrame, hot_ttl: int, key: str = "mint", time: str = "win_end"
) -> DataFrame:
    """State changes per key: cold to warm on activity, to hot on a hit, to cold ``hot_ttl`` later.

    ``activity`` holds the evaluation times at which the key traded, ``hits`` those at which a rule
    fired (a subset). A hit during a hot period changes nothing. Hot periods come from the gate;
    the rest is decided per (key, hot period) from its own rows.
    """
    hot = first_sight(hits.select(key, time), [key], time, hot_ttl).select(
        key, F.col(time).alias("changed_at"), F.lit("hot").alias("state")
    )
    cold = hot.select(key, (F.col("changed_at") + hot_ttl).alias("changed_at"), F.lit("cold").alias("state"))
    # Warm: first activity ever, and first activity at or after the end of each hot period. A
    # period's end is carried forward to later activity by running maxima over evaluation times,
    # whose number per key is bounded by the time range.
    from pyspark.sql import Window

    ends = cold.select(key, F.col("changed_at").alias("_t"), F.col("changed_at").alias("_end"), F.lit(0).alias("_k"))
    acts = activity.select(
        key, F.col(time).alias("_t"), F.lit(None).cast("bigint").alias("_end"), F.lit(1).alias("_k")
    ).distinct()
    w = (
        Window.partitionBy(key)
        .orderBy("_t", "_k")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = ends.unionByName(acts).withColumn("_last", F.coalesce(F.max("_end").over(w), F.lit(-1)))
    warm = (
        seen.filter("_k = 1")
        .groupBy(key, "_last")
        .agg(F.min("_t").alias("changed_at"))
        .select(key, "changed_at", F.lit("warm").alias("state"))
    )
    return hot.unionByName(cold).unionByName(warm)


def state_at(changes: DataFrame, now: int, key: str = "mint") -> DataFrame:
    """Last state of each key at ``now``. At equal times hot wins over warm over cold."""
    rank = F.when(F.col("state") == "hot", 2).when(F.col("state") == "warm", 1).otherwise(0)
    return (
        changes.filter(F.col("changed_at") <= now)
        .groupBy(key)
        .agg(F.max_by("state", F.struct("changed_at", rank)).alias("state"))
    )

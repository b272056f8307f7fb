"""Latest earlier value with an age limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.columns import bucket_start

# Buckets are this many times shorter than the age limit.
BUCKETS_PER_AGE = 64


def latest_before(
    facts: DataFrame,
    values: DataFrame,
    key: str,
    value: str,
    max_age: int,
    fact_order: Sequence[str] = ("block_time",),
    value_order: Sequence[str] = ("block_time",),
) -> DataFrame:
    """For each fact, the last ``value`` of its key at or before it and at most ``max_age`` old.

    Orders start with epoch seconds; at equal times the value comes first. Time is cut into buckets
    much shorter than ``max_age``. Each bucket is reduced to its last value, and these are carried forward
    over one row per bucket to the buckets that hold facts; the search itself runs per (key, bucket). So a
    hot key is spread over its buckets, however long values live, and nothing is paired with everything.
    """
    f_time, v_time = fact_order[0], value_order[0]
    width = max(1, max_age // BUCKETS_PER_AGE)
    tie = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in value_order[1:]] or [F.lit(0)]
    known = values.select(
        F.col(key),
        F.col(v_time).cast("bigint").alias("_t"),
        F.struct(*tie).alias("_tie"),
        F.col(value).alias("_v"),
    ).filter(F.col("_v").isNotNull())
    known = known.withColumn("_b", bucket_start(F.col("_t"), width))
    ends = known.groupBy(key, "_b").agg(
        F.max_by(F.struct("_t", "_tie", "_v"), F.struct("_t", "_tie")).alias("_l")
    )
    asked = facts.select(F.col(key), bucket_start(F.col(f_time).cast("bigint"), width).alias("_b")).distinct()
    steps = ends.select(key, "_b", "_l", F.lit(0).alias("_asked")).unionByName(
        asked.select(key, "_b", F.lit(None).cast(ends.schema["_l"].dataType).alias("_l"), F.lit(1).alias("_asked"))
    )
    before = Window.partitionBy(key).orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)
    last = (
        steps.withColumn("_c", F.last("_l", ignorenulls=True).over(before))
        .filter((F.col("_asked") == 1) & (F.col("_b") - F.col("_c._t") <= max_age))
        .select(key, "_b", "_c.*")
    )
    side = known.unionByName(last).select(
        key,
        "_b",
        "_t",
        "_tie",
        F.lit(0).alias("_kind"),
        F.struct("_t", "_v").alias("_seen"),
        F.lit(None).cast(facts.schema).alias("_fact"),
    )
    left = facts.select(
        F.col(key),
        bucket_start(F.col(f_time).cast("bigint"), width).alias("_b"),
        F.col(f_time).cast("bigint").alias("_t"),
        F.lit(None).cast(known.schema["_tie"].dataType).alias("_tie"),
        F.lit(1).alias("_kind"),
        F.lit(None).cast(side.schema["_seen"].dataType).alias("_seen"),
        F.struct(*facts.columns).alias("_fact"),
    )
    w = (
        Window.partitionBy(key, "_b")
        .orderBy("_t", "_kind", "_tie")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = side.unionByName(left).withColumn("_hit", F.last("_seen", ignorenulls=True).over(w))
    fresh = F.col("_t") - F.col("_hit._t") <= max_age
    return found.filter("_kind = 1").select(
        "_fact.*",
        F.when(fresh, F.col("_hit._v")).alias(value),
        F.when(fresh, F.col("_hit._t")).alias(f"{value}_time"),
    )


def latest_value(
    values: DataFrame, key: str, fields: Sequence[str], order: Sequence[str], now: int, max_age: int
) -> DataFrame:
    """Last values per key that are at most ``max_age`` seconds old at ``now``."""
    fresh = values.filter((F.col(order[0]) > now - max_age) & (F.col(order[0]) <= now))
    best = F.max_by(F.struct(order[0], *fields), F.struct(*order)).alias("_l")
    return fresh.groupBy(key).agg(best).select(key, "_l.*")

"""Reports over alerts and trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.columns import day_text, wide
from flowlens.functions.text import short_signature, short_wallet
from flowlens.operators.lookups import top_per_key
from flowlens.operators.metrics import mode


def alerts_by_date(alerts: DataFrame) -> DataFrame:
    """Alerts and distinct mints per day. Two-step distinct: a day's mints never meet in one task."""
    per_mint = alerts.groupBy(day_text(F.col("created_at")).alias("day"), "mint").agg(
        F.count("*").alias("n")
    )
    return per_mint.groupBy("day").agg(
        F.sum("n").alias("alert_count"), F.count("*").alias("unique_tokens")
    )


def heat_level(count):
    """Calendar colour step 0-4."""
    return (
        F.when(count > 50, 4).when(count > 20, 3).when(count > 10, 2).when(count > 0, 1).otherwise(0)
    )


def calendar_totals(by_date: DataFrame) -> DataFrame:
    """Sums over days: alerts, and daily distinct mints (a mint counts once per day)."""
    return by_date.agg(
        F.sum("alert_count").alias("total_alerts"),
        F.sum("unique_tokens").alias("total_tokens"),
        F.count("*").alias("active_days"),
    )


def alerts_daily_span(alerts: DataFrame) -> DataFrame:
    """Per day: alerts, distinct rules, first and last time, hours between."""
    return (
        alerts.groupBy(day_text(F.col("created_at")).alias("day"))
        .agg(
            F.count("*").alias("total"),
            F.count_distinct("trigger_name").alias("triggers"),
            F.min("created_at").alias("first_at"),
            F.max("created_at").alias("last_at"),
        )
        .withColumn("span_hours", (F.col("last_at") - F.col("first_at")) / F.lit(3600.0))
    )


def triggers_by_date(alerts: DataFrame) -> DataFrame:
    return (
        alerts.groupBy(day_text(F.col("created_at")).alias("day"), "trigger_name")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("day"), F.desc("n"), F.asc("trigger_name"))
    )


def alert_gaps(alerts: DataFrame, longer_than: int = 3600) -> DataFrame:
    """Pauses of more than ``longer_than`` seconds between consecutive alerts.

    Two alerts of one time bucket of that length are never so far apart, so a pause can only lie
    between the last alert of a bucket and the first of the next filled bucket. The global order is
    needed for one row per bucket only, and those are ordered within periods of buckets.
    """
    bucket = F.floor(F.col("created_at") / longer_than).cast("bigint")
    edges = alerts.groupBy(bucket.alias("bucket")).agg(
        F.min("created_at").alias("first"), F.max("created_at").alias("last")
    )
    period = F.floor(F.col("bucket") / 8760).cast("bigint")
    edges = edges.withColumn("period", period)
    starts = edges.groupBy("period").agg(F.min("first").alias("first"))
    following = starts.select(
        "period", F.lead("first").over(Window.orderBy("period")).alias("next_period_first")
    )
    inside = edges.withColumn(
        "next_first", F.lead("first").over(Window.partitionBy("period").orderBy("bucket"))
    )
    joined = inside.join(following, "period").withColumn(
        "next", F.coalesce("next_first", "next_period_first")
    )
    gap = F.col("next") - F.col("last")
    return joined.filter(gap > longer_than).select(
        F.col("last").alias("gap_start"),
        F.col("next").alias("gap_end"),
        (gap / F.lit(3600.0)).alias("gap_hours"),
    )


def alerts_top_per_date(alerts: DataFrame, n: int = 50) -> DataFrame:
    """Newest ``n`` alerts of each day."""
    dated = alerts.withColumn("day", day_text(F.col("created_at")))
    return top_per_key(dated, ["day"], [F.desc("created_at"), F.desc("alert_id")], n)


def alerts_page(alerts: DataFrame, mint: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the newest alerts with the total count, which is a scalar subquery."""
    rows = alerts if mint is None else alerts.filter(F.col("mint") == mint)
    total = rows.agg(F.count("*").alias("total")).scalar()
    page = rows.orderBy(F.desc("created_at"), F.desc("alert_id")).offset(offset).limit(limit)
    return page.withColumn("total", total).withColumn("has_image", F.col("token_image").isNotNull())


def live_swaps(swaps: DataFrame, now: int, window: int = 300, limit: int = 50) -> DataFrame:
    """Newest trades of the last ``window`` seconds with shortened ids."""
    recent = swaps.filter((F.col("block_time") >= now - window) & (F.col("block_time") <= now))
    newest = recent.orderBy(F.desc("block_time"), F.desc("slot")).limit(limit)
    return newest.select(
        "slot",
        short_signature(F.col("signature")).alias("signature"),
        F.col("base_mint").alias("mint"),
        short_wallet(F.col("user_wallet")).alias("wallet"),
        "side",
        (F.col("quote_amount").cast("double") / F.lit(1e9)).alias("amount_sol"),
        "venue",
        "block_time",
    )


def daily_report(alerts: DataFrame, start: int, end: int) -> DataFrame:
    """Alerts of a period by rule, with the period's totals beside them.

    Market caps are averaged over exact sums of hundredths.
    """
    rows = alerts.filter((F.col("created_at") >= start) & (F.col("created_at") < end))
    cents = wide(F.round(F.col("mcap_sol") * 100))
    per_rule = rows.groupBy(F.coalesce("trigger_name", F.lit("unknown")).alias("trigger_name")).agg(
        F.count("*").alias("n")
    )
    mean = F.try_divide(F.sum(cents).cast("double") / 100, F.count("mcap_sol").cast("double"))
    # One scalar subquery for all totals, so that they cost one scan.
    totals = rows.agg(
        F.struct(
            F.count("*").alias("total_alerts"),
            F.count_distinct("mint").alias("unique_tokens"),
            mean.alias("avg_alert_mcap"),
        )
    ).scalar()
    return per_rule.select(
        "trigger_name",
        "n",
        *[totals[c].alias(c) for c in ("total_alerts", "unique_tokens", "avg_alert_mcap")],
    )


def best_pair(pairs: DataFrame, chain: str = "solana") -> DataFrame:
    """Most liquid market per mint, those on ``chain`` before all others."""
    order = [F.desc(F.col("chain") == chain), F.desc("liquidity_usd"), F.asc("pair_id")]
    return top_per_key(pairs, ["mint"], order, 1).drop("rank")


def live_counts(swaps: DataFrame, alerts: DataFrame, swaps_now: int, alerts_since: int) -> DataFrame:
    """One row: trades of the last hour with their rate and newest time, alerts since a time."""
    recent = swaps.filter((F.col("block_time") > swaps_now - 3600) & (F.col("block_time") <= swaps_now))
    return recent.agg(
        F.count("*").alias("swaps_last_hour"),
        F.max("block_time").alias("last_block_time"),
    ).select(
        "swaps_last_hour",
        (F.col("swaps_last_hour") / F.lit(3600.0)).alias("tx_per_second"),
        (F.lit(swaps_now) - F.col("last_block_time")).alias("processing_lag"),
        alerts.filter(F.col("created_at") >= alerts_since)
        .agg(F.count("*").alias("n"))
        .scalar()
        .alias("alerts_today"),
    )


def live_snapshot(
    swaps: DataFrame, alerts: DataFrame, states: DataFrame, worker: DataFrame, waiting: DataFrame,
    swaps_now: int, alerts_since: int,
) -> DataFrame:
    """``live_counts`` with what the running streams report: backlog, lag, mode and hot tokens.

    ``worker``: the row of ``worker_state``. ``waiting``: source records (``block_time``) that no batch has read.
    ``states``: (mint, state) now. The number of trades is the larger of the last hour's in the table and the
    worker's own; the lag is the age of the newest record that a batch has read.
    """
    counts = live_counts(swaps, alerts, swaps_now, alerts_since).drop("processing_lag")
    backlog = waiting.agg(F.count("*").alias("backlog"))
    hot = states.agg(F.count_if(F.col("state") == "hot").alias("hot_tokens"))
    lag = F.coalesce(F.lit(swaps_now) - F.col("newest_event"), F.lit(0))
    # Four tables of one row each.
    joined = counts.crossJoin(worker).crossJoin(backlog).crossJoin(hot)
    return joined.withColumn("processing_lag", lag).select(
        F.greatest("swaps_last_hour", "worker_rows").alias("swaps_detected"), "swaps_last_hour", "tx_per_second", "hot_tokens",
        "alerts_today", "backlog", "processing_lag", mode(F.col("processing_lag"), F.col("backlog")).alias("mode"),
    )


def live_view(
    swaps: DataFrame, alerts: DataFrame, changes: DataFrame, now: int, alerts_now: int, newest: int = 20, span: int = 300
) -> DataFrame:
    """One list for a live page: trades of the last ``span`` seconds, alerts of the last hour, and hot tokens.

    Columns: kind (swap, alert, hot), place, id, mint, seen_at, mcap_sol (where known and not zero, infinite or
    not a number). ``changes`` are state changes (mint, changed_at, state). Every part is a top-k, cut before
    it is gathered.
    """

    def part(rows: DataFrame, kind: str, key: str, mint: str, at: str, mcap: str | None = None) -> DataFrame:
        cap = F.col(mcap).cast("double") if mcap in rows.columns else F.lit(None).cast("double")
        known = F.when((F.abs(cap) < float("inf")) & (cap != 0), cap).alias("mcap_sol")
        named = rows.select(F.col(key).cast("string").alias("id"), F.col(mint).alias("mint"), F.col(at).alias("seen_at"), known)
        top = named.orderBy(F.desc("seen_at"), F.desc("id")).limit(newest)
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("seen_at"), F.desc("id")))
        return top.select(F.lit(kind).alias("kind"), place.alias("place"), "id", "mint", "seen_at", "mcap_sol")

    fresh = swaps.filter((F.col("block_time") >= now - span) & (F.col("block_time") <= now))
    recent = alerts.filter((F.col("created_at") > alerts_now - 3600) & (F.col("created_at") <= alerts_now))
    last = (
        changes.filter(F.col("changed_at") <= now)
        .groupBy("mint")
        .agg(F.max(F.struct("changed_at", F.col("state") == "hot", "state")).alias("s"))
        .filter("s.state = 'hot'")
        .select("mint", F.col("s.changed_at").alias("at"))
    )
    return (
        part(fresh, "swap", "signature", "base_mint", "block_time", "mcap_at_swap")
        .unionByName(part(recent, "alert", "alert_id", "mint", "created_at", "mcap_sol"))
        .unionByName(part(last, "hot", "mint", "mint", "at"))
    )

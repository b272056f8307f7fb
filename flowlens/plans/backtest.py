"""Alerts against later prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.text import finite_or_null
from flowlens.operators.lookups import lookup_join


def results(
    alerts: DataFrame, prices: DataFrame, now: int, sol_usd: float = 200.0, since: int | None = None
) -> DataFrame:
    """Gain in percent, status and age of each alert.

    ``prices`` has one row per mint. Without a current price, or without a market cap at alert
    time, an alert is ``dead``; ``has_price`` tells the two apart.
    """
    chosen = alerts if since is None else alerts.filter(F.col("created_at") >= since)
    current = prices.select(
        "mint",
        F.col("market_cap_usd").alias("current_mcap_usd"),
        F.col("symbol").alias("price_symbol"),
    )
    joined = lookup_join(chosen, current, ["mint"])
    then = finite_or_null(F.col("mcap_sol")) * F.lit(float(sol_usd))
    now_usd = F.when(F.col("current_mcap_usd") != 0, F.col("current_mcap_usd"))
    gain = F.when(
        F.col("alert_mcap_usd") > 0,
        F.try_divide(now_usd - F.col("alert_mcap_usd"), F.col("alert_mcap_usd")) * 100,
    )
    return (
        joined.withColumn("alert_mcap_usd", then)
        .withColumn("gain_pct", gain)
        .withColumn(
            "status",
            F.when(F.col("gain_pct") > 0, F.lit("winner"))
            .when(F.col("gain_pct") <= 0, F.lit("loser"))
            .otherwise(F.lit("dead")),
        )
        .withColumn("has_price", now_usd.isNotNull())
        .withColumn("shown_symbol", F.coalesce("price_symbol", "token_symbol"))
        .withColumn("age_hours", F.round((F.lit(now) - F.col("created_at")) / F.lit(3600.0), 1))
    )


def report_order() -> list:
    """Dead alerts last, best gain first."""
    return [
        F.asc(F.col("status") == "dead"),
        F.desc_nulls_last("gain_pct"),
        F.asc("alert_id"),
    ]


def view(found: DataFrame, status: str | None = None, by: str = "gain", limit: int = 100) -> DataFrame:
    """The first rows of a result list: one status or all, by gain or by age."""
    rows = found if status is None else found.filter(F.col("status") == status)
    order = report_order() if by == "gain" else [F.asc("age_hours"), F.asc("alert_id")]
    return rows.orderBy(*order).limit(limit)


def _gain_figures() -> list:
    """Figures over exact sums of gains in billionths of a percent."""
    priced = F.count("gain_pct")
    total = F.sum(F.round(F.col("gain_pct") * 1e9).cast("decimal(38,0)")).cast("double") / 1e9
    return [
        F.count("*").alias("alerts"),
        priced.alias("with_price_data"),
        F.try_divide(F.count_if(F.col("gain_pct") > 0).cast("double"), priced.cast("double")).alias(
            "win_rate"
        ),
        F.try_divide(total, priced.cast("double")).alias("avg_gain_pct"),
        F.max("gain_pct").alias("best_gain_pct"),
        F.min("gain_pct").alias("worst_gain_pct"),
    ]


def by_trigger(found: DataFrame) -> DataFrame:
    """Performance per rule, best win rate first."""
    return found.groupBy("trigger_name").agg(*_gain_figures()).orderBy(
        F.desc(F.coalesce("win_rate", F.lit(0.0))), F.desc("alerts"), F.asc("trigger_name")
    )


def summary(found: DataFrame) -> DataFrame:
    """One row: totals, dead, win rate, mean gain, best and worst alert."""
    ranked = F.struct("gain_pct", -F.col("alert_id"))
    lowest = F.struct("gain_pct", "alert_id")
    priced = F.col("gain_pct").isNotNull()
    return found.agg(
        *_gain_figures(),
        F.count_if(F.col("status") == "dead").alias("dead"),
        F.max_by("shown_symbol", F.when(priced, ranked)).alias("best_symbol"),
        F.min_by("shown_symbol", F.when(priced, lowest)).alias("worst_symbol"),
    )


def by_trigger_fraction(
    alerts: DataFrame,
    prices: DataFrame,
    now: int,
    sol_usd: float,
    days: int | None = None,
    limit: int | None = None,
):
    """Command-line form: alerts with a market cap, gains as fractions.

    ``days`` keeps the alerts of that many days before ``now``, ``limit`` the newest ones; without
    them all alerts count.
    """
    newest = alerts.filter(F.col("mcap_sol") > 0)
    if days is not None:
        newest = newest.filter(F.col("created_at") >= now - days * 86_400)
    if limit is not None:
        newest = newest.orderBy(F.desc("created_at"), F.desc("alert_id")).limit(limit)
    found = results(newest, prices, now, sol_usd)
    total = F.sum(F.round(F.col("gain_pct") * 1e9).cast("decimal(38,0)")).cast("double") / 1e9
    priced = F.count("gain_pct").cast("double")
    return found.groupBy("trigger_name").agg(
        F.count("*").alias("alerts"),
        F.count_if(F.col("gain_pct") > 0).alias("wins"),
        F.count_if(F.col("gain_pct") <= 0).alias("losses"),
        (F.try_divide(total, priced) / 100).alias("avg_gain"),
    )

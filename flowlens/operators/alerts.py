"""Alert rows and their text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.constants import RISK_COLOUR, RISK_SIGN, RULE_TEXT, VENUE_SIGN, VENUE_TEXT
from flowlens.functions.columns import fixed, percent, ratio_or, sol
from flowlens.functions.scores import level
from flowlens.functions.text import mcap_text, ratio_text
from flowlens.operators.lookups import lookup_join, top_per_key


def _text_map(table: dict[str, str], key: Column) -> Column:
    pairs: list[Column] = []
    for k, v in table.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), key)


def rule_text(name: Column, reason: Column) -> Column:
    return F.coalesce(_text_map(RULE_TEXT, name), reason)


def venue_text(venue: Column) -> Column:
    return F.coalesce(_text_map(VENUE_TEXT, F.coalesce(venue, F.lit("unknown"))), F.lit("DEX"))


def venue_sign(venue: Column) -> Column:
    known = _text_map(VENUE_SIGN, F.coalesce(venue, F.lit("unknown")))
    return F.coalesce(known, F.lit(VENUE_SIGN["unknown"]))


def venue_or_suffix(venue: Column, mint: Column) -> Column:
    """The dominant venue; without one, ``pump`` for mints that end in it."""
    return F.coalesce(venue, F.when(mint.endswith("pump"), F.lit("pump")))


def buyer_lists(tops: DataFrame, limit: int = 5, keys: Sequence[str] = ("mint",)) -> DataFrame:
    """The top buyers per ``keys`` as one array of at most ``limit`` entries.

    ``tops`` is the result of ``top_buyers``, so a group is already bounded.
    """
    entry = F.struct(
        "rank", "user_wallet", "buy_count", "total_quote", "total_base", "avg_entry_mcap"
    )
    return (
        tops.filter(F.col("rank") <= limit)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(entry)).alias("top_buyers"))
    )


def alert_key(mint: Column, rule: Column, end: Column) -> Column:
    """A number from the first 60 bits of a digest of mint, rule and time."""
    digest = F.md5(F.concat_ws("|", mint, rule, end.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def build_alerts(
    hits: DataFrame,
    buyers: DataFrame,
    summaries: DataFrame,
    venues: DataFrame,
    prices: DataFrame,
) -> DataFrame:
    """Alert rows for rule hits (``mint``, ``win_end``, trigger and statistics).

    The others are keyed by mint and ``win_end`` (what was known then): ``top_buyers``,
    ``cluster_summary``, ``venue``, ``price_sol`` and ``mcap_sol``. The id is a hash of mint, rule and
    time, so a replay gives the same alert.
    """
    out = hits
    for table in (buyers, summaries, venues, prices):
        out = lookup_join(out, table, ["mint", "win_end"])
    return out.withColumn("venue", venue_or_suffix(F.col("venue"), F.col("mint"))).withColumn(
        "alert_id", alert_key(F.col("mint"), F.col("trigger_name"), F.col("win_end"))
    )


def delivery_flags(alerts: DataFrame, receipts: DataFrame) -> DataFrame:
    """Delivery flags by alert and channel: once true, always true.

    ``receipts``: (alert_id, discord boolean, telegram boolean), any number per alert.
    """
    seen = receipts.groupBy("alert_id").agg(
        F.bool_or("discord").alias("_discord"), F.bool_or("telegram").alias("_telegram")
    )
    return alerts.join(seen, "alert_id", "left").select(
        *[c for c in alerts.columns if c not in ("discord", "telegram")],
        *[
            (F.coalesce(F.col(c), F.lit(False)) | F.coalesce(F.col(f"_{c}"), F.lit(False))).alias(c)
            for c in ("discord", "telegram")
        ],
    )


def capped_per_minute(sends: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Sends allowed per channel and minute: the first ones up to the channel's cap."""
    table: list[Column] = []
    for channel, cap in caps.items():
        table += [F.lit(channel), F.lit(cap)]
    minute = F.floor(F.col("sent_at") / 60).cast("bigint")
    firsts = top_per_key(
        sends.withColumn("minute", minute),
        ["channel", "minute"],
        [F.asc("sent_at"), F.asc("alert_id")],
        max(caps.values()),
    )
    return firsts.filter(F.col("rank") <= F.try_element_at(F.create_map(*table), F.col("channel")))


def red_flags(alert: DataFrame) -> Column:
    """At most four reasons why the alert stands out."""
    ratio = F.col("buy_sell_ratio")
    per_wallet = ratio_or(F.col("buy_count"), F.greatest("unique_buyers", F.lit(1)), 0.0)
    endless = F.abs(ratio) == float("inf")
    own = F.array_compact(
        F.array(
            F.when(
                F.contains(F.lower("trigger_reason"), F.lit("unique_buyers")) & (per_wallet > 3),
                F.concat(fixed(per_wallet, 1), F.lit(" buys per wallet (coordinated?)")),
            ),
            F.when(endless, F.lit("All buys, zero sells")).when(
                ratio > 10,
                F.concat(fixed(F.when(~endless, ratio), 0), F.lit("x more buys than sells")),
            ),
            F.when(
                (F.col("unique_buyers") <= 5) & (F.col("volume_sol") > 5),
                F.concat(
                    F.lit("Only "),
                    F.col("unique_buyers").cast("string"),
                    F.lit(" wallets moved "),
                    fixed(F.col("volume_sol"), 1),
                    F.lit(" SOL"),
                ),
            ),
        )
    )
    more = F.slice(F.coalesce("evidence", F.array().cast("array<string>")), 1, 2)
    return F.slice(F.array_union(own, more), 1, 4)


def buyer_lines(buyers: Column, sol_usd: float = 200.0, shown: int = 5) -> Column:
    """One line per top buyer: short wallet, SOL spent and mean entry market cap."""
    wallet = lambda b: F.when(
        F.length(b["user_wallet"]) > 12,
        F.concat(
            F.substring(b["user_wallet"], 1, 6), F.lit("..."), F.right(b["user_wallet"], F.lit(4))
        ),
    ).otherwise(b["user_wallet"])
    return F.transform(
        F.slice(buyers, 1, shown),
        lambda b: F.concat(
            wallet(b),
            F.lit(" - "),
            fixed(amount_sol(b["total_quote"]), 2),
            F.lit(" SOL"),
            F.when(
                b["avg_entry_mcap"] > 0,
                F.concat(F.lit(" @ "), mcap_text(b["avg_entry_mcap"], sol_usd)),
            ).otherwise(F.lit("")),
        ),
    )


def amount_sol(amount: Column) -> Column:
    """Amounts above a million are lamports, smaller ones already SOL."""
    value = amount.cast("double")
    return F.when(value > 1e6, sol(amount)).otherwise(value)


def entry_mcap(buyers: Column) -> Column:
    """Plain mean of the positive entry market caps in a top-buyer array."""
    caps = F.filter(F.transform(buyers, lambda b: b["avg_entry_mcap"]), lambda m: m > 0)
    total = F.aggregate(caps, F.lit(0.0), lambda a, m: a + m)
    return F.when(F.size(caps) > 0, total / F.size(caps))


def buyers_share(buyers: Column, volume_sol: Column, shown: int = 5) -> Column:
    """Share of the window volume held by the listed buyers, in percent."""
    total = F.aggregate(
        F.slice(buyers, 1, shown), F.lit(0.0), lambda a, b: a + amount_sol(b["total_quote"])
    )
    return F.when(volume_sol > 0, total / volume_sol * 100)


# Fixed value: the note on alerts raised while enrichment was down.
DEGRADED_TEXT = "Enrichment degraded - some data may be missing"


def plain_line(alert: DataFrame) -> Column:
    """One log line per alert."""
    token = F.coalesce(F.nullif("token_symbol", F.lit("")), F.substring("mint", 1, 8))
    score = F.coalesce(percent(F.col("total_score")), F.lit("N/A"))
    return F.concat(
        F.lit("[ALERT] "),
        token,
        F.lit(" | "),
        F.col("trigger_name"),
        F.lit(" | Vol: "),
        fixed(F.col("volume_sol"), 1),
        F.lit(" SOL | Buyers: "),
        F.col("unique_buyers").cast("string"),
        F.lit(" | CTO: "),
        score,
    )


def rendered(alerts: DataFrame, sol_usd: float = 200.0) -> DataFrame:
    """Log line, structured payload and chat message of each alert."""
    ticker = F.coalesce(
        F.concat(F.lit("$"), F.nullif("token_symbol", F.lit(""))),
        F.concat(F.substring("mint", 1, 8), F.lit("...")),
    )
    lines = buyer_lines(F.col("top_buyers"), sol_usd)
    mean_entry = entry_mcap(F.slice("top_buyers", 1, 5))
    header = F.concat_ws(
        ", ",
        F.concat(
            fixed(buyers_share(F.col("top_buyers"), F.col("volume_sol")), 0), F.lit("% of volume")
        ),
        F.when(
            mean_entry.isNotNull(), F.concat(F.lit("avg entry @ "), mcap_text(mean_entry, sol_usd))
        ),
    )
    mint = F.col("mint")
    risk = level(F.col("total_score"), "alert")
    sign = F.coalesce(_text_map(RISK_SIGN, risk), F.lit(RISK_SIGN["MEDIUM"]))
    colours = F.create_map(*[F.lit(x) for pair in RISK_COLOUR.items() for x in pair])
    payload = F.struct(
        F.concat(F.lit("https://dexscreener.com/solana/"), mint).alias("url"),
        F.concat_ws(" ", sign, ticker).alias("title"),
        F.coalesce(F.element_at(colours, risk), F.lit(RISK_COLOUR["MEDIUM"])).alias("color"),
        F.when(F.col("token_name") != F.coalesce("token_symbol", F.lit("")), F.col("token_name")).alias("name"),
        F.col("token_image").alias("thumbnail"),
        risk.alias("risk"),
        F.concat_ws(" ", venue_sign(F.col("venue")), venue_text(F.col("venue"))).alias("venue"),
        F.when(F.col("mcap_sol").isNotNull(), mcap_text(F.col("mcap_sol"), sol_usd)).alias("mcap"),
        rule_text(F.col("trigger_name"), F.col("trigger_reason")).alias("pattern"),
        F.struct(
            fixed(F.col("volume_sol"), 1).alias("volume_sol"),
            F.col("buy_count").alias("buys"),
            F.col("unique_buyers").alias("wallets"),
            ratio_text(F.col("buy_sell_ratio")).alias("ratio"),
        ).alias("activity"),
        F.floor(F.col("total_score") * 100).cast("int").alias("score_pct"),
        F.col("top_factors").alias("factors"),
        red_flags(alerts).alias("why"),
        header.alias("buyers_header"),
        lines.alias("buyers"),
        F.when(
            F.contains(F.lower("cluster_summary"), F.lit("cluster")), F.col("cluster_summary")
        ).alias("clusters"),
        F.array(
            F.concat(F.lit("https://birdeye.so/token/"), mint, F.lit("?chain=solana")),
            F.concat(F.lit("https://dexscreener.com/solana/"), mint),
            F.concat(F.lit("https://solscan.io/token/"), mint),
        ).alias("links"),
        F.when(F.col("enrichment_degraded"), F.lit(DEGRADED_TEXT)).alias("warning"),
        F.col("win_end").alias("timestamp"),
        mint.alias("footer"),
    )
    chat = F.concat_ws(
        "\n",
        F.concat(sign, F.lit(" "), risk, F.lit(" RISK - "), ticker),
        F.initcap(F.replace("trigger_name", F.lit("_"), F.lit(" "))),
        rule_text(F.col("trigger_name"), F.col("trigger_reason")),
        F.concat(
            fixed(F.col("volume_sol"), 1),
            F.lit(" SOL from "),
            F.col("unique_buyers").cast("string"),
            F.lit(" wallets"),
        ),
        F.concat(
            F.col("buy_count").cast("string"),
            F.lit(" buys | "),
            ratio_text(F.col("buy_sell_ratio")),
            F.lit(" ratio"),
        ),
        F.concat(F.lit("CTO Score: "), percent(F.col("total_score"))),
        F.array_join(F.slice("evidence", 1, 2), "\n"),
        F.array_join(
            F.transform(F.slice(lines, 1, 3), lambda line, i: F.concat((i + 1).cast("string"), F.lit(". "), line)), "\n"
        ),
        mint,
    )
    return alerts.select(
        "alert_id",
        "mint",
        "win_end",
        plain_line(alerts).alias("plain"),
        F.to_json(payload).alias("payload"),
        chat.alias("chat"),
    )

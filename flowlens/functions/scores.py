"""Risk score bands as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.constants import SCORE_WEIGHTS
from flowlens.functions.columns import fixed, percent, ratio_or

# Fixed values: (lower bound, score), highest first.
CONCENTRATION_BANDS = ((0.8, 1.0), (0.6, 0.8), (0.4, 0.5), (0.2, 0.2))
TIMING_BANDS = ((10, 1.0), (5, 0.7), (3, 0.4), (2, 0.2))
NEW_WALLET_BANDS = ((0.7, 1.0), (0.5, 0.7), (0.3, 0.4))
RATIO_BANDS = ((20, 1.0), (10, 0.8), (5, 0.5), (3, 0.3))
# Fixed values: (upper bound, tenths taken off) for the score's own confidence.
FEW_BUYS = ((5, 3), (10, 2), (20, 1))
FEW_BUYERS = ((3, 2), (5, 1))
LOW_VOLUME = ((1.0, 2), (5.0, 1))
# Risk levels of the scorer and of alerts.
LEVELS = {
    "score": ((0.7, "HIGH"), (0.4, "MEDIUM"), (0.2, "LOW")),
    "alert": ((0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MEDIUM"), (0.2, "LOW")),
}


def _band(value: Column, bands, otherwise) -> Column:
    out = F
    for bound, result in bands:
        out = out.when(value >= bound, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def _below(value: Column, bands) -> Column:
    out = F
    for bound, result in bands:
        out = out.when(value < bound, F.lit(result))
    return out.otherwise(F.lit(0))


def concentration(top_share: Column) -> Column:
    return _band(top_share, CONCENTRATION_BANDS, 0.0)


def timing(buys: Column, buyers: Column) -> Column:
    return _band(ratio_or(buys, buyers, 0.0), TIMING_BANDS, 0.0)


def new_wallets(share: Column) -> Column:
    return _band(share, NEW_WALLET_BANDS, 0.0)


def ratio(value: Column) -> Column:
    return _band(value, RATIO_BANDS, 0.0)


def clustering(linked: Column, buyers: Column) -> Column:
    """Score of the share of top buyers in clusters of two or more."""
    share = ratio_or(linked, buyers, 0.0)
    return (
        F.when(share >= 0.5, F.least(F.lit(1.0), share + 0.2))
        .when(share >= 0.2, share + 0.1)
        .otherwise(F.lit(0.0))
    )


def total(concentration: Column, cluster: Column, timing: Column, new: Column, ratio: Column) -> Column:
    w = SCORE_WEIGHTS
    return (
        concentration * w["concentration"]
        + cluster * w["cluster"]
        + timing * w["timing"]
        + new * w["new_wallet"]
        + ratio * w["ratio"]
    ) / F.lit(100.0)


def confidence(buys: Column, buyers_listed: Column, volume: Column) -> Column:
    tenths = (
        F.lit(10)
        - _below(buys, FEW_BUYS)
        - _below(buyers_listed, FEW_BUYERS)
        - _below(volume, LOW_VOLUME)
    )
    return F.greatest(tenths, F.lit(1)) / F.lit(10.0)


def level(score: Column, scale: str = "score") -> Column:
    return _band(score, LEVELS[scale], "MINIMAL")


# Wording of the evidence, in the order of the score's parts.
EVIDENCE_TEXT = {
    "top_very_high": "Very high concentration: top 3 = ",
    "top_high": "High concentration: top 3 = ",
    "linked_high": "High clustering: ",
    "linked_largest": " in linked wallets, largest cluster = ",
    "linked_some": "Some clustering: ",
    "linked_end": " in linked wallets",
    "frequency_high": "High buy frequency: ",
    "frequency_some": "Elevated buy frequency: ",
    "frequency_end": " buys/wallet",
    "new_very_high": "Very high new wallet %: ",
    "new_high": "High new wallet %: ",
    "no_sells": "All buys, no sells",
    "ratio_extreme": "Extreme buy ratio: ",
    "ratio_very_high": "Very high buy ratio: ",
}


def evidence(
    top_share: Column,
    linked: Column,
    buyers_listed: Column,
    largest: Column,
    buys: Column,
    buyers: Column,
    new_share: Column,
    ratio: Column,
) -> Column:
    """Sentences behind the score, in the order of its parts."""
    cluster_share = ratio_or(linked, buyers_listed, 0.0)
    per_buyer = ratio_or(buys, buyers, 0.0)
    endless = F.abs(ratio) == float("inf")
    shown = F.when(~endless, ratio)
    return F.array_compact(
        F.array(
            F.when(
                top_share >= 0.8,
                F.concat(F.lit(EVIDENCE_TEXT["top_very_high"]), percent(top_share)),
            ).when(
                top_share >= 0.6, F.concat(F.lit(EVIDENCE_TEXT["top_high"]), percent(top_share))
            ),
            F.when(
                cluster_share >= 0.5,
                F.concat(
                    F.lit(EVIDENCE_TEXT["linked_high"]),
                    percent(cluster_share),
                    F.lit(EVIDENCE_TEXT["linked_largest"]),
                    largest.cast("string"),
                ),
            ).when(
                cluster_share >= 0.2,
                F.concat(
                    F.lit(EVIDENCE_TEXT["linked_some"]), percent(cluster_share), F.lit(EVIDENCE_TEXT["linked_end"])
                ),
            ),
            F.when(
                per_buyer >= 10,
                F.concat(F.lit(EVIDENCE_TEXT["frequency_high"]), fixed(per_buyer, 1), F.lit(EVIDENCE_TEXT["frequency_end"])),
            ).when(
                per_buyer >= 5,
                F.concat(
                    F.lit(EVIDENCE_TEXT["frequency_some"]), fixed(per_buyer, 1), F.lit(EVIDENCE_TEXT["frequency_end"])
                ),
            ),
            F.when(
                new_share >= 0.7, F.concat(F.lit(EVIDENCE_TEXT["new_very_high"]), percent(new_share))
            ).when(new_share >= 0.5, F.concat(F.lit(EVIDENCE_TEXT["new_high"]), percent(new_share))),
            F.when(endless, F.lit(EVIDENCE_TEXT["no_sells"]))
            .when(ratio >= 20, F.concat(F.lit(EVIDENCE_TEXT["ratio_extreme"]), fixed(shown, 1), F.lit("x")))
            .when(
                ratio >= 10, F.concat(F.lit(EVIDENCE_TEXT["ratio_very_high"]), fixed(shown, 1), F.lit("x"))
            ),
        )
    )


def summary(score: Column, evidence: Column, shown: int = 3) -> Column:
    """Risk level, score and the first evidence lines."""
    lines = F.transform(F.slice(evidence, 1, shown), lambda e: F.concat(F.lit("\n  "), e))
    return F.concat(
        F.lit("CTO Risk: "),
        level(score),
        F.lit(" ("),
        percent(score),
        F.lit(")"),
        F.array_join(lines, ""),
    )


def top_factors(parts: dict[str, Column], above: float = 0.1, shown: int = 3) -> Column:
    """The largest score parts above ``above``, as ``Name: nn%``; ties in the given order."""
    rows = F.array(
        *[
            F.struct((-value).alias("rank"), F.lit(i).alias("place"), F.lit(name).alias("name"))
            for i, (name, value) in enumerate(parts.items())
        ]
    )
    kept = F.filter(F.slice(F.array_sort(rows), 1, shown), lambda r: -r["rank"] > above)
    return F.transform(
        kept,
        lambda r: F.concat(
            F.initcap(F.replace(r["name"], F.lit("_"), F.lit(" "))), F.lit(": "), percent(-r["rank"])
        ),
    )

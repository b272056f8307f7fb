"""Rules, scores and alert text on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from flowlens.functions import scores as SC
from flowlens.functions import text as TX
from flowlens.operators import alerts as A
from flowlens.operators import metrics as ME
from flowlens.operators import rules as RU
from flowlens.operators.scoring import linked_buyers, scored
from flowlens.sources import rules as R


@pytest.mark.parametrize(
    "text, parts",
    [
        ("buy_count_5m >= 20", ("buy_count_5m", ">=", 20.0)),
        ("volume_sol_5m > 10", ("volume_sol_5m", ">", 10.0)),
        ("unique_buyers_5m <= 5", ("unique_buyers_5m", "<=", 5.0)),
        ("a == 1.5", ("a", "==", 1.5)),
        ("a = 1", None),
        ("a > b", None),
        ("a > 1 > 2", None),
    ],
)
def test_parse(spark, text, parts):
    found = R.parse_condition(text)
    assert (found and (found.field, found.op, found.value)) == parts
    columns = R.parsed_condition(F.col("t"))
    row = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in columns.items()]).first()
    assert (tuple(row) if row.op else None) == parts


def test_default_rules():
    names = [r.name for r in RU.in_order(R.load_rules())]
    assert names == [
        "concentrated_accumulation",
        "stealth_accumulation",
        "extreme_ratio",
        "whale_concentration",
        "slow_stealth_accumulation",
        "slow_concentration",
    ]


def test_match_and_reason(spark):
    rules = R.rules_from(
        [
            {"name": "slow", "conditions": ["buy_count_1h >= 1"]},
            {"name": "fast", "conditions": ["buy_count_5m >= 20", "buy_sell_ratio_5m > 5"]},
            {"name": "off", "enabled": False, "conditions": ["buy_count_5m >= 0"]},
        ]
    )
    rows = spark.createDataFrame(
        [(1, 25, float("inf"), 30), (2, 25, 3.0, 30), (3, 5, 9.0, 0)],
        "id int, buy_count_5m long, buy_sell_ratio_5m double, buy_count_1h long",
    )
    out = {r.id: r for r in RU.first_match(rows, rules).collect()}
    assert {k: v.trigger_name for k, v in out.items()} == {1: "fast", 2: "slow"}
    assert out[1].trigger_reason == (
        "Trigger: fast | buy_count_5m=25.00 (>= 20.0) | buy_sell_ratio_5m=inf (> 5.0)"
    )
    with pytest.raises(ValueError):
        RU.fires(R.Rule("bad", (R.Condition("nope", ">", 1.0),)))


def test_mcap_gate(spark):
    rows = spark.createDataFrame([(499.0,), (500.0,), (None,), (0.0,)], "mcap_sol double")
    assert sorted(str(r.mcap_sol) for r in RU.mcap_gate(rows).collect()) == ["0.0", "500.0", "None"]


def stats(spark, **over):
    row = dict(
        mint="m", buy_count=50, unique_buyers=5, volume_sol=10.0, top_3_volume_share=0.85,
        new_wallet_pct=0.3, buy_sell_ratio=5.0, buyers_listed=5, linked=0, largest=1, cluster_score=0.0,
    )
    row.update(over)
    return spark.createDataFrame([tuple(row.values())], ", ".join(
        f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}"
        for k, v in row.items()
    ))


def test_score_bands(spark):
    row = scored(stats(spark)).first()
    assert (row.concentration_score, row.timing_score, row.new_wallet_score, row.ratio_score) == (1.0, 1.0, 0.4, 0.5)
    assert row.total_score == (25 + 15 + 15 * 0.4 + 15 * 0.5) / 100
    assert row.score_confidence == 1.0
    assert row.evidence[0] == "Very high concentration: top 3 = 85%"
    row = scored(stats(spark, new_wallet_pct=0.75, buy_sell_ratio=float("inf"), buy_count=4)).first()
    assert (row.new_wallet_score, row.ratio_score, row.score_confidence) == (1.0, 1.0, 0.7)
    assert row.evidence[-1] == "All buys, no sells"


def test_levels(spark):
    rows = spark.createDataFrame([(v,) for v in (0.75, 0.45, 0.25, 0.1, 0.85, 0.65)], "s double")
    out = rows.select(SC.level(F.col("s")).alias("a"), SC.level(F.col("s"), "alert").alias("b")).collect()
    assert [r.a for r in out[:4]] == ["HIGH", "MEDIUM", "LOW", "MINIMAL"]
    assert [r.b for r in out[4:]] == ["CRITICAL", "HIGH"]


def test_cluster_links_count_whole_clusters(spark):
    buyers = spark.createDataFrame([("m", w) for w in "abcd"], "mint string, user_wallet string")
    members = spark.createDataFrame([("a", 1), ("b", 1), ("x", 1), ("c", 2), ("d", 3)], "node string, component long")
    sizes = spark.createDataFrame([(1, 3), (2, 1), (3, 1)], "component long, size long")
    history = spark.createDataFrame([("c", "h"), ("d", "h")], "user_wallet string, cluster_id string")
    row = linked_buyers(buyers, members, sizes).first()
    assert (row.linked, row.largest, row.cluster_score) == (3, 3, 0.95)
    row = linked_buyers(buyers, members, sizes, history).first()
    assert (row.linked, row.cluster_score) == (5, 1.0)


def test_unit_text(spark):
    rows = spark.createDataFrame(
        [(float("inf"), 10000.0), (500.0, 100.0), (5.5, 1.0), (50.0, 0.5)], "r double, m double"
    )
    out = rows.select(TX.ratio_text(F.col("r")).alias("r"), TX.mcap_text(F.col("m")).alias("m")).collect()
    assert [r.r for r in out] == ["ALL BUYS (no sells)", "500x (almost no sells)", "5.5x", "50x"]
    assert [r.m for r in out] == ["$2.0M", "$20K", "$200", "$100"]


def test_alert_text(spark):
    base = stats(spark).withColumns(
        {
            "alert_id": F.lit(1),
            "win_end": F.lit(300),
            "token_symbol": F.lit("TST"),
            "token_name": F.lit("Test token"),
            "token_image": F.lit("img"),
            "enrichment_degraded": F.lit(True),
            "trigger_name": F.lit("concentrated_accumulation"),
            "trigger_reason": F.lit("Trigger: x | unique_buyers_5m=5.00 (<= 5.0)"),
            "venue": F.lit("pump"),
            "mcap_sol": F.lit(5000.0),
            "cluster_summary": F.lit("3 wallets in 2 clusters: ..."),
            "top_factors": F.array(F.lit("Concentration: 100%")),
            "top_buyers": F.array(
                F.struct(
                    F.lit("wallet_that_is_long").alias("user_wallet"),
                    F.lit(2_500_000_000).cast("decimal(38,0)").alias("total_quote"),
                    F.lit(10.0).alias("avg_entry_mcap"),
                )
            ),
        }
    )
    row = A.rendered(scored(base)).first()
    assert row.plain == "[ALERT] TST | concentrated_accumulation | Vol: 10.0 SOL | Buyers: 5 | CTO: 54%"
    for part in ('"title":"\U0001f7e0 $TST","color":16755200', "pump.fun", "10.0 buys per wallet", "Only 5 wallets moved 10.0 SOL",
                 "wallet...long - 2.50 SOL @ $2K", "25% of volume", "$1.0M", "solscan.io/token/m",
                 '"name":"Test token"', '"thumbnail":"img"', '"warning":"Enrichment degraded'):
        assert part in row.payload, part
    assert "MEDIUM RISK - $TST" in row.chat and "Few wallets accumulating" in row.chat


def test_rate_cap(spark):
    sends = spark.createDataFrame([("c", 60 + i, i) for i in range(6)] + [("c", 120, 9)], "channel string, sent_at long, alert_id long")
    kept = A.capped_per_minute(sends, {"c": 5}).collect()
    assert sorted(r.alert_id for r in kept) == [0, 1, 2, 3, 4, 9]


def test_modes_and_histogram(spark):
    rows = spark.createDataFrame([(31.0, 0), (6.0, 0), (1.0, 60_000), (1.0, 90_000), (1.0, 5)], "lag double, backlog long")
    modes = [r[0] for r in rows.select(ME.mode(F.col("lag"), F.col("backlog"))).collect()]
    assert modes == ["critical", "degraded", "degraded", "critical", "normal"]
    out = {r.le: r.cumulative for r in ME.histogram(rows, "lag", (1.0, 10.0)).collect()}
    assert out == {"1.0": 3, "10.0": 4, "+Inf": 5}


def test_venue_by_suffix_and_signs(spark):
    from flowlens.operators import alerts as A

    rows = spark.createDataFrame([("raydium", "xpump"), (None, "xpump"), (None, "x"), ("odd", "x")], "venue string, mint string")
    venue = A.venue_or_suffix(F.col("venue"), F.col("mint"))
    got = rows.select(venue.alias("v"), F.concat_ws(" ", A.venue_sign(venue), A.venue_text(venue)).alias("t")).collect()
    assert [tuple(r) for r in got] == [("raydium", "\u2728 Raydium"), ("pump", "\U0001f4a7 pump.fun"), (None, "\u2753 DEX"), ("odd", "\u2753 DEX")]

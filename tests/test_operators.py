"""Distributed operators against brute force on small data."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import graph as G
from flowlens.operators import lookups as L
from flowlens.operators import merge as M
from flowlens.operators import stats as S
from flowlens.operators.asof import latest_before
from flowlens.operators.gate import first_sight, segment_seconds
from flowlens.operators.state import state_changes


def greedy(events, ttl):
    last, out = {}, set()
    for key, t in sorted(set(events), key=lambda e: e[1]):
        if key not in last or t - last[key] >= ttl:
            last[key] = t
            out.add((key, t))
    return out


@pytest.mark.parametrize("ttl, span, n", [(1, 50, 200), (7, 3000, 900), (60, 400_000, 900), (600, 9000, 5)])
def test_gate_equals_greedy(spark, ttl, span, n):
    rng = random.Random(ttl)
    # One key holds most rows.
    events = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", rng.randrange(span)) for _ in range(n)]
    frame = spark.createDataFrame(events, "key string, t long")
    found = {(r.key, r.t) for r in first_sight(frame, ["key"], "t", ttl).collect()}
    assert found == greedy(events, ttl)
    assert segment_seconds(ttl) % ttl == 0


def test_gate_carries_first_of_second(spark):
    frame = spark.createDataFrame([("a", 5, 9), ("a", 5, 3), ("a", 6, 1)], "key string, t long, id long")
    out = first_sight(frame, ["key"], "t", 10, order=["id"], carry=["id"]).collect()
    assert [(r.key, r.t, r.id) for r in out] == [("a", 5, 3)]


def brute_components(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def graphs():
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(40)]
    star = [(i, 500) for i in range(60)] + [(700, 701), (701, 702)]
    mesh = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    return {"path": path, "star": star, "mesh": mesh, "none": []}


@pytest.mark.parametrize("kind", ["path", "star", "mesh", "none"])
@pytest.mark.parametrize("hot", [False, True])
def test_components(spark, monkeypatch, kind, hot):
    if hot:  # every node with more than 3 edges takes the broadcast way
        monkeypatch.setattr(G, "HOT_MIN", 3)
        monkeypatch.setattr(G, "HOT_SHARE", 10**9)
    edges = graphs()[kind]
    nodes = sorted({n for e in edges for n in e} | {9999})
    vertices = spark.createDataFrame([(n,) for n in nodes], "node long")
    frame = spark.createDataFrame(edges, "wallet long, funder long")
    found = {r.node: r.component for r in G.components(vertices, frame).collect()}
    assert found == brute_components(nodes, edges)


@pytest.mark.parametrize("max_age", [3, 50])
def test_latest_before(spark, max_age):
    rng = random.Random(max_age)
    facts = [("hot" if rng.random() < 0.7 else "k", rng.randrange(200), i) for i in range(150)]
    values = [(rng.choice(["hot", "k"]), rng.randrange(200), i, float(i)) for i in range(60)]
    out = latest_before(
        spark.createDataFrame(facts, "key string, t long, id long"),
        spark.createDataFrame(values, "key string, t long, id long, v double"),
        "key",
        "v",
        max_age,
        ("t", "id"),
        ("t", "id"),
    ).collect()
    assert len(out) == len(facts)
    for r in out:
        seen = [(t, i, v) for k, t, i, v in values if k == r.key and t <= r.t]
        best = max(seen, default=None)
        assert r.v == (best[2] if best and r.t - best[0] <= max_age else None)


def test_salted_lookup_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(L, "planned_bytes", lambda df: 10**6 if "i" in df.columns else 10)
    facts = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, i long")
    table = spark.createDataFrame([("hot", 1), ("k3", 2), ("k9", 3)], "k string, x long")
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = sorted(map(tuple, facts.join(table, "k", how).collect()), key=str)
        salted = L.lookup_join(facts, table, ["k"], how, salts=5, broadcast_bytes=0)
        assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, salted.collect()), key=str) == plain


def swaps(spark, rows):
    return spark.createDataFrame(
        rows, "base_mint string, block_time long, user_wallet string, side string, quote_amount long"
    )


def test_window_statistics(spark):
    sol = 10**9
    frame = swaps(
        spark,
        [
            ("m", 10, "a", "buy", 6 * sol),
            ("m", 20, "b", "buy", 2 * sol),
            ("m", 30, "c", "buy", 1 * sol),
            ("m", 40, "d", "buy", 1 * sol),
            ("m", 350, "a", "sell", 5 * sol),
            ("n", 10, "z", "sell", 0),
        ],
    )
    rows = {(r.mint, r.win_end): r for r in S.token_stats(frame, 300, 600).collect()}
    first, both, later = rows["m", 300], rows["m", 600], rows["m", 900]
    assert (first.buy_count, first.unique_buyers, first.volume_sol) == (4, 4, 10.0)
    assert first.buy_sell_ratio == float("inf") and first.top_3_volume_share == 0.9
    assert (first.new_wallet_count, first.new_wallet_pct) == (4, 1.0)
    assert (both.buy_count, both.sell_count, both.avg_buy_size) == (4, 1, 15.0 / 4)
    assert both.top_3_volume_share == 14 / 15
    assert (later.buy_count, later.avg_buy_size, later.new_wallet_count) == (0, 0.0, 0)
    assert rows["n", 300].top_3_volume_share == 0.0
    only_buys = S.rolling_stats(frame, 300, 600, basis="buy").filter("mint = 'm' and win_end = 600").first()
    assert only_buys.volume_sol == 10.0


def test_state_changes(spark):
    activity = [("m", t) for t in (10, 20, 30, 45, 90)]
    hits = [("m", 20), ("m", 30), ("m", 90)]
    out = state_changes(
        spark.createDataFrame(activity, "mint string, win_end long"),
        spark.createDataFrame(hits, "mint string, win_end long"),
        20,
    )
    assert sorted((r.changed_at, r.state) for r in out.collect()) == [
        (10, "warm"),
        (20, "hot"),
        (40, "cold"),
        (45, "warm"),
        (90, "hot"),
        (110, "cold"),
    ]


def test_upsert_and_update(spark):
    old = spark.createDataFrame([("a", 1, "x", 5), ("b", 2, None, 6)], "k string, seen int, name string, first int")
    new = spark.createDataFrame([("b", 9, None, 7), ("c", 3, "z", 8)], "k string, seen int, name string, first int")
    out = {r.k: tuple(r)[1:] for r in M.upsert(old, new, "k", ["seen"], ["name"], ["first"]).collect()}
    assert out == {"a": (1, "x", 5), "b": (9, None, 6), "c": (3, "z", 8)}
    changed = M.update_by_key(old, new.select("k", "name"), "k", ["name"])
    assert {r.k: r.name for r in changed.collect()} == {"a": "x", "b": None}


def test_insert_ignore_and_retention(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, t long")
    held = spark.createDataFrame([("b", 0)], "k string, t long")
    assert [tuple(r) for r in M.insert_ignore(held, rows, ["k"], [F.asc("t")]).collect()] == [("a", 1)]
    assert M.retained(rows, "t", 1000, 999, 1).count() == 3
    assert M.retained(rows, "t", 310, 10, 300).count() == 3
    assert M.retained(rows, "t", 311, 10, 300).count() == 0


def test_cluster_summary_text(spark):
    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "node string, component string")
    wallets = spark.createDataFrame(
        [("a", 5 * 10**9, 1), ("b", 3 * 10**9, 1), ("c", 2 * 10**9, 1)],
        "node string, volume_lamports long, buy_count long",
    )
    stats = G.cluster_stats(members, wallets)
    lists = spark.createDataFrame([("m", "a"), ("m", "b"), ("m", "c")], "mint string, node string")
    found = G.clusters_of(lists, members, stats, "mint")
    text = G.cluster_summary(found, "mint").first().cluster_summary
    assert text == "3 wallets in 2 clusters: Cluster A (2 wallets, 8.00 SOL), Cluster B (1 wallet, 2.00 SOL)"


def test_plans_stay_on_the_jvm_and_avoid_cross_joins(spark):
    from flowlens.workload import load

    for name in ("swap_inference", "token_stats_two_windows", "trigger_first_match", "backtest_results"):
        frame = load().QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "Python" not in plan


def test_gate_null_keys_are_keys(spark):
    from flowlens.operators.gate import first_sight

    rows = [(None, 1), (None, 700), ("a", 1), ("a", 5), (None, 300)]
    events = spark.createDataFrame(rows, "k string, t long")
    got = sorted(map(tuple, first_sight(events, ["k"], "t", 600).collect()), key=str)
    assert got == sorted([(None, 1), (None, 700), ("a", 1)], key=str)
    carried = first_sight(events, ["k"], "t", 600, order=["t"], carry=["t"]).count()
    assert carried == 3


def test_large_plan_of_a_small_table_is_broadcast(spark):
    """Ten keys out of many rows: planned as large as the facts, broadcast after measuring."""
    from flowlens.operators.lookups import lookup_join, planned_bytes

    facts = spark.range(200_000).selectExpr("id % 10 as k", "id")
    table = facts.groupBy("k").count()
    limit = 10_000
    assert planned_bytes(table) > limit
    plan = lookup_join(facts, table, ["k"], broadcast_bytes=limit)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_new_wallets_beyond_the_hundredth(spark):
    from flowlens.operators.stats import token_stats

    rows = [("m", f"u{i}", "buy", 10, 1000 - i) for i in range(150)]
    trades = spark.createDataFrame(rows, "base_mint string, user_wallet string, side string, block_time long, quote_amount long")
    every = token_stats(trades, 60, 60).first()
    few = token_stats(trades, 60, 60, top_new=100).first()
    assert (every.new_wallet_count, every.new_wallet_pct) == (150, 1.0)
    assert few.new_wallet_count == 100


def test_late_rows_are_counted(spark):
    from flowlens.session import shared_dir
    from flowlens.streaming import jobs as J

    schema = "signature string, block_time long"
    path, out = shared_dir(spark), shared_dir(spark)
    counts, checkpoint = {}, None
    for batch in ([("a", 100_000), ("b", 100_010)], [("c", 200_000)], [("d", 5), ("e", 200_001)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        stream = J.file_stream(spark, path, spark.read.parquet(path).schema, max_files=1)
        unique = J.deduplicated(J.event_time(stream)).drop("ts")
        sink = J.insert_once(out, ["signature"], ["block_time"], epoch="block_time")
        checkpoint = J.run_available(unique, sink, checkpoint, "append", counts)
    assert sorted(r.signature for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "e"]
    assert counts["late_rows"] == 1 and counts["batches"] >= 3


def test_later_trades_do_not_change_an_alert(spark):
    import random

    from flowlens.operators.toplists import dominant_venue_as_of, top_buyers, top_buyers_as_of, vwap_as_of, vwap_recent
    from flowlens.plans.detection import gated_hits

    rng = random.Random(2)
    rows = [
        (f"m{rng.randrange(3)}", f"u{rng.randrange(9)}", rng.choice(["buy", "buy", "sell"]), rng.choice("abc"), "SOL",
         t * 7, t, rng.randrange(1, 99), rng.randrange(1, 99))
        for t in range(300)
    ]
    schema = (
        "base_mint string, user_wallet string, side string, venue string, quote_mint string, block_time long,"
        " slot long, quote_amount long, base_amount long"
    )
    trades = spark.createDataFrame(rows, schema)
    cases = spark.createDataFrame([("m0", 600), ("m0", 1200), ("m1", 60), ("m2", 1800)], "mint string, win_end long")

    def lists(swaps):
        found = (
            top_buyers_as_of(swaps, cases, 60, 3), dominant_venue_as_of(swaps, cases, 60), vwap_as_of(swaps, cases, 60, 5, "SOL")
        )
        return [sorted(map(str, f.collect())) for f in found]

    whole = lists(trades)
    for mint, end in ((r.mint, r.win_end) for r in cases.collect()):
        past = trades.filter((F.col("block_time") < end) & (F.col("base_mint") == mint))
        own = F.col("win_end") == end
        got = top_buyers_as_of(trades, cases, 60, 3).filter(own & (F.col("mint") == mint)).drop("win_end")
        want = top_buyers(past, 3)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
        price = vwap_as_of(trades, cases, 60, 5, "SOL").filter(own & (F.col("mint") == mint)).collect()
        assert [r.price_per_unit for r in price] == [r.price_per_unit for r in vwap_recent(past, 5, "SOL").collect()]
    late = [(f"m{i % 3}", "whale", "buy", "z", "SOL", 1800 + i, 1000 + i, 10**6, 1) for i in range(50)]
    assert lists(trades.unionByName(spark.createDataFrame(late, schema))) == whole

    hits = spark.createDataFrame([("m0", 600), ("m1", 600), ("m2", 600)], "mint string, win_end long")
    quotes = [("m0", 10, 1, 900.0), ("m0", 599, 2, 100.0), ("m0", 600, 3, 900.0), ("m1", 50, 4, 100.0)]
    quotes = spark.createDataFrame(quotes, "mint string, block_time long, slot long, mcap_sol double")
    passed = gated_hits(hits, quotes, 500.0, max_age=300)
    assert sorted((r.mint, r.mcap_sol) for r in passed.collect()) == [("m1", None), ("m2", None)]


def test_gate_many_keys_and_segments(spark, monkeypatch):
    """Keys of two columns with nulls, runs over many short segments, small batches; no call per key."""
    import random

    from flowlens.operators import gate

    monkeypatch.setattr(gate, "SEGMENT_TTLS", 2)
    rng, ttl = random.Random(4), 10
    rows = set()
    for a in (None, "x", "y"):
        for b in (None, 1, 2):
            t = rng.randrange(-50, 50)
            for _ in range(rng.choice([1, 40, 300])):
                rows.add((a, b, t))
                t += rng.choice([0, 1, 1, 2, 3, 5, 9, 10, 11, 40] if rng.random() < 0.2 else [1, 2, 3])
    want, last = set(), {}
    for a, b, t in sorted(rows, key=lambda r: r[2]):
        if (a, b) not in last or t - last[a, b] >= ttl:
            last[a, b] = t
            want.add((a, b, t))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frame = spark.createDataFrame(sorted(rows, key=str), "a string, b long, t long")
        out = gate.first_sight(frame, ["a", "b"], "t", ttl)
        assert {tuple(r) for r in out.collect()} == want
        assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

"""Sliding statistics against plain windows, and the size of what they shuffle."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import sliding, stats

PANES = "mint string, pane long, user_wallet string, buys long, sells long, lamports long"


def panes(seed, mints=2, wallets=12, span=40, n=150, pane=10):
    rng = random.Random(seed)
    rows = {}
    for _ in range(n):
        key = (f"m{rng.randrange(mints)}", rng.randrange(span) * pane, f"w{rng.randrange(wallets):02}")
        buys, sells = rng.choice([(0, 1), (1, 0), (2, 3)])
        rows[key] = (buys, sells, rng.choice([0, 1, 5, 5, 20, rng.randrange(10**12)]))
    return [(*k, *v) for k, v in rows.items()]


def windows(rows, pane, length):
    """{(mint, end): {wallet: [buys, sells, lamports]}}"""
    found = collections.defaultdict(lambda: collections.defaultdict(lambda: [0, 0, 0]))
    for mint, p, wallet, *values in rows:
        for end in range(p + pane, p + length + 1, pane):
            for i, v in enumerate(values):
                found[mint, end][wallet][i] += v
    return found


@pytest.mark.parametrize("seed,length", [(1, 10), (2, 20), (3, 70), (4, 390), (5, 1000)])
def test_totals(spark, seed, length):
    rows = panes(seed)
    rng = random.Random(seed)
    seen = {w: rng.randrange(-50, 450) for w in sorted({r[2] for r in rows})}
    want = {}
    for (mint, end), held in windows(rows, 10, length).items():
        want[mint, end] = (
            sum(v[0] for v in held.values()), sum(v[1] for v in held.values()), sum(v[0] > 0 for v in held.values()),
            sum(v[1] > 0 for v in held.values()), sum(v[2] for v in held.values()), sum(seen[w] >= end - length for w in held),
        )
    firsts = spark.createDataFrame(list(seen.items()), "user_wallet string, first_seen long")
    got = sliding.sliding_totals(spark.createDataFrame(rows, PANES), 10, length, F.col("lamports"), firsts).collect()
    assert {(r[0], r[1]): tuple(map(int, r[2:])) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("length", [10, 30, 500])
def test_peaks(spark, length):
    rows = panes(9)
    per_pane = collections.defaultdict(list)
    for mint, pane, _, buys, sells, lamports in rows:
        per_pane[mint, pane].append((buys, sells, lamports))
    want = {}
    for (mint, pane), held in per_pane.items():
        for end in range(pane + 10, pane + length + 1, 10):
            old = want.get((mint, end), (0, 0, 0, 0, 0))
            want[mint, end] = (
                old[0] + sum(h[0] for h in held), old[1] + sum(h[1] for h in held), max(old[2], sum(h[0] > 0 for h in held)),
                max(old[3], sum(h[1] > 0 for h in held)), old[4] + sum(h[2] for h in held),
            )
    frame = spark.createDataFrame(rows, PANES).select("*", F.col("lamports").alias("buy_lamports"), F.lit(0).alias("sell_lamports"), F.lit(0).alias("first_time"))
    got = sliding.sliding_peaks(stats.window_totals(frame, ["mint", "pane"], "buy"), 10, length).collect()
    assert {(r[0], r[1]): tuple(map(int, r[2:])) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("listed", [1, 2, 4, None])
@pytest.mark.parametrize("length", [10, 40, 300])
def test_top_wallets(spark, listed, length):
    """With short lists most windows can't be proven by candidates and are ranked in full."""
    rows = panes(listed or 7, n=260)
    want = set()
    for (mint, end), held in windows(rows, 10, length).items():
        ranked = sorted(((-v[2], w) for w, v in held.items()))[:3]
        want |= {(mint, end, w, -v, k + 1) for k, (v, w) in enumerate(ranked)}
    frame = spark.createDataFrame(rows, PANES)
    got = sliding.sliding_top_wallets(frame, 10, length, 3, F.col("lamports"), listed)
    found = [(r.mint, r.win_end, r.user_wallet, int(r.lamports), r["rank"]) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_windows_left_over_rank_few_wallets(spark, monkeypatch):
    """All wallets of like volume: no window can be proven, yet only those that reach the known third sum are ranked."""
    rows = [("m", 10 * p, f"w{w:03}", 1, 0, 1000 + (w * 7 + p * 3) % 50) for p in range(6) for w in range(300)]
    frame = spark.createDataFrame(rows, PANES)
    ranked, plain = [], sliding._largest
    monkeypatch.setattr(sliding, "_largest", lambda sums, n: ranked.append(sums.count()) or plain(sums, n))
    got = sliding.sliding_top_wallets(frame, 10, 40, 3, F.col("lamports"), 8).collect()
    want = {
        (mint, end, w, v)
        for (mint, end), held in windows(rows, 10, 40).items()
        for v, w in [(-a, b) for a, b in sorted((-x[2], w) for w, x in held.items())[:3]]
    }
    assert {(r.mint, r.win_end, r.user_wallet, int(r.lamports)) for r in got} == want
    assert len(ranked) == 2 and 0 < ranked[1] < 300


def shuffled_rows(df):
    """Records that the exchanges of a finished plan wrote."""
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_rows_shuffled_do_not_grow_with_the_window(spark):
    rows = panes(3, wallets=40, span=200, n=3000)
    frame = spark.createDataFrame(rows, PANES).repartition(3)
    written = []
    for length in (20, 1000):
        out = sliding.sliding_totals(frame, 10, length, F.col("lamports"))
        out.collect()
        written.append(shuffled_rows(out))
    assert 0 < written[1] <= written[0] * 1.1 and written[1] <= 2 * len(rows) + 3 * 2 * 2 * 220


def test_empty(spark):
    none = spark.createDataFrame([], PANES)
    assert sliding.sliding_totals(none, 10, 30, F.col("lamports")).count() == 0
    assert sliding.sliding_top_wallets(none, 10, 30, 3, F.col("lamports")).count() == 0
    with pytest.raises(ValueError):
        sliding.sliding_totals(none, 10, 35, F.col("lamports"))

"""Lists as of many times against plain lists, and what a thousand cases of one key cost."""

import collections
import random

import pytest
from pyspark.sql import functions as F
from test_sliding import shuffled_rows

from flowlens.operators import graph, running, toplists

SWAPS = """base_mint string, block_time long, slot long, user_wallet string, side string, venue string, quote_mint string,
quote_amount long, base_amount long, mcap_at_swap double"""


def swaps(seed, n=500, mints=3, wallets=9, span=1000):
    rng = random.Random(seed)
    return [
        (f"m{rng.randrange(mints)}", rng.randrange(span), k, f"w{rng.randrange(wallets)}", rng.choice(["buy", "sell"]),
         rng.choice([None, "unknown", "a", "b", "c"]), rng.choice(["SOL", "USD"]), rng.choice([0, 5, 5, 100, rng.randrange(10**12)]),
         rng.randrange(1, 1000), rng.choice([None, 1.5, 2.25, 1000.0]))
        for k in range(n)
    ]


def cases(seed, n=60, mints=4, span=1100, pane=10):
    rng = random.Random(seed)
    return sorted({(f"m{rng.randrange(mints)}", rng.randrange(-2, span // pane) * pane) for _ in range(n)})


@pytest.mark.parametrize("seed", [1, 2])
def test_lists(spark, seed):
    rows, asked = swaps(seed), cases(seed)
    frame, ends = spark.createDataFrame(rows, SWAPS), spark.createDataFrame(asked, "mint string, win_end long")
    buyers, venues, prices = set(), set(), {}
    for mint, end in asked:
        mine = [r for r in rows if r[0] == mint and r[1] // 10 * 10 + 10 <= end]
        held = collections.defaultdict(list)
        for r in mine:
            if r[4] == "buy":
                held[r[3]].append(r)
        ranked = sorted(held, key=lambda w: (-sum(r[7] for r in held[w]), w))[:3]
        for k, w in enumerate(ranked):
            caps = [r[9] for r in held[w] if r[9] is not None]
            mean = round(sum(caps) / len(caps), 6) if caps else None
            buyers.add((mint, end, w, len(held[w]), sum(r[7] for r in held[w]), sum(r[8] for r in held[w]), mean, k + 1))
        seen = collections.Counter(r[5] for r in mine if r[5] not in (None, "unknown"))
        if seen:
            best = min(seen, key=lambda v: (-seen[v], v))
            venues.add((mint, end, best, seen[best]))
        last = [r for r in sorted(mine, key=lambda r: (-r[1], -r[2]))[:4] if r[4] == "buy" and r[6] == "SOL"]
        if last:
            prices[mint, end] = (sum(r[7] for r in last), sum(r[8] for r in last))
    got = toplists.top_buyers_as_of(frame, ends, 10, 3).collect()
    columns = ("mint", "win_end", "user_wallet", "buy_count", "total_quote", "total_base", "avg_entry_mcap", "rank")
    assert {tuple(round(x, 6) if isinstance(x, float) else x for x in (r[c] for c in columns)) for r in got} == buyers
    assert len(got) == len(buyers)
    got = toplists.dominant_venue_as_of(frame, ends, 10).collect()
    assert {(r.mint, r.win_end, r.venue, r.swap_count) for r in got} == venues and len(got) == len(venues)
    got = toplists.vwap_as_of(frame, ends, 10, 4, "SOL").collect()
    assert {(r.mint, r.win_end): (r.total_quote, r.total_base) for r in got} == prices and len(got) == len(prices)


def test_clusters(spark):
    rng = random.Random(8)
    members = [(f"w{k}", f"w{k // 3 * 3}") for k in range(12)]
    activity = [(f"w{rng.randrange(12)}", t, rng.randrange(100)) for t in range(0, 300, 10) for _ in range(3)]
    summed = collections.Counter()
    for node, t, x in activity:
        summed[node, t] += x
    lists = sorted({(f"m{rng.randrange(2)}", rng.randrange(-1, 32) * 10, f"w{rng.randrange(12)}") for _ in range(40)})
    component = dict(members)
    want = {
        (m, end, component[w]): (3, sum(x for (node, t), x in summed.items() if component[node] == component[w] and t <= end))
        for m, end, w in lists
    }
    panes = spark.createDataFrame([(n, t, x) for (n, t), x in summed.items()], "node string, pane_end long, lamports long")
    got = graph.clusters_as_of(
        spark.createDataFrame(lists, "mint string, win_end long, node string"),
        spark.createDataFrame(members, "node string, component string"), panes, ["mint", "win_end"], "win_end",
    ).collect()
    assert {(r.mint, r.win_end, r.component): (r["size"], r.volume_lamports) for r in got} == want and len(got) == len(want)


def test_a_thousand_hits_of_one_mint(spark):
    """Rows written grow with panes and cases, not with their product."""
    rows = [("hot", t, t, f"w{t % 700}", "buy", "a", "SOL", 1 + t * 7919 % 1000, 1, None) for t in range(0, 10_000, 2)]
    ends = [("hot", t) for t in range(10, 10_010, 10)]
    frame = spark.createDataFrame(rows, SWAPS).repartition(3)
    out = toplists.top_buyers_as_of(frame, spark.createDataFrame(ends, "mint string, win_end long"), 10, 5)
    assert len(out.collect()) == 5 * len(ends)
    panes, listed = 5000, 5 * 1000
    assert shuffled_rows(out) < 6 * (panes + listed + 4 * len(ends))


def test_small_batches_and_empty(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        changed = spark.createDataFrame([("a", 1, "x", 5), ("a", 2, "y", 7), ("b", 2, "z", 1), ("a", 4, "x", 9)], "mint string, win_end long, e string, v long")
        ends = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 1), ("b", 2), ("c", 2)], "mint string, win_end long")
        got = running.lists_as_of(changed, ends, ["e"], [F.desc("v")], 2).collect()
        assert sorted((r.mint, r.win_end, r["rank"], r.e, r.v) for r in got) == [
            ("a", 1, 1, "x", 5), ("a", 2, 1, "y", 7), ("a", 2, 2, "x", 5), ("a", 3, 1, "y", 7), ("a", 3, 2, "x", 5),
            ("a", 4, 1, "x", 9), ("a", 4, 2, "y", 7), ("b", 2, 1, "z", 1),
        ]
        assert running.lists_as_of(changed.limit(0), ends, ["e"], [F.desc("v")], 2).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

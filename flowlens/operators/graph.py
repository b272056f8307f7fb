"""Wallet clusters from funding edges, and funding traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.columns import fixed, sol, wide
from flowlens.operators.lookups import lookup_join, top_per_key
from flowlens.session import drop_path, materialize

# A node is hot when it has more than this share of all edges (or HOT_MIN edges).
HOT_SHARE = 10_000
HOT_MIN = 100_000


def _relink(edges: DataFrame, on: str, minima: DataFrame, total: int) -> DataFrame:
    """Edges with the minimum of their ``on`` end as ``low``.

    Hot nodes are joined by broadcast: more than ``total / HOT_SHARE`` edges each makes them at
    most ``2 * HOT_SHARE`` in number. All others are joined by shuffle, with no hot key left; the hint keeps Spark
    from broadcasting them for the small files they come from, round after round through the driver.
    """
    limit = max(HOT_MIN, total // HOT_SHARE)
    if total <= limit:
        return edges.join(minima.select(F.col("node").alias(on), "low"), on)
    hot = minima.filter(F.col("degree") > limit).select(F.col("node").alias(on), "low")
    rest = minima.filter(F.col("degree") <= limit).select(F.col("node").alias(on), "low")
    by_broadcast = edges.join(F.broadcast(hot), on)
    by_shuffle = edges.join(F.broadcast(hot.select(on)), on, "left_anti").join(rest.hint("merge"), on)
    return by_broadcast.unionByName(by_shuffle)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")).unionByName(
        edges.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
    )
    minima = both.groupBy("node").agg(
        F.least(F.col("node"), F.min("other")).alias("low"), F.count("*").alias("degree")
    )
    return (
        _relink(edges, "lo", minima, total)
        .select(F.col("hi"), F.col("low").alias("lo"))
        .filter("hi <> lo")
        .distinct()
    )


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the least of them."""
    minima = edges.groupBy(F.col("hi").alias("node")).agg(
        F.min("lo").alias("low"), F.count("*").alias("degree")
    )
    moved = _relink(edges, "hi", minima, total).select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
    own = minima.select(F.col("node").alias("hi"), F.col("low").alias("lo"))
    return moved.unionByName(own).filter("hi <> lo").distinct()


def components(
    vertices: DataFrame, edges: DataFrame, a: str = "wallet", b: str = "funder", max_rounds: int = 60
) -> DataFrame:
    """Connected components (``node``, ``component`` = least node); lone vertices included.

    ``vertices`` has the column ``node``. Alternates the large-star and small-star steps of Kiveris
    et al. (2014) until nothing changes. Each round is written to the shared folder, which ends the
    lineage and outlives lost executors; the driver sees one count and one checksum per round.
    """
    spark = edges.sparkSession
    current = (
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .filter("hi <> lo")
        .distinct()
    )
    current, path = materialize(current)
    mark = _checksum(current)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        moved, moved_path = materialize(_small_star(_large_star(current, mark[0]), mark[0]))
        new_mark = _checksum(moved)
        drop_path(spark, path)
        current, path = moved, moved_path
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    ends = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node")))
    nodes = vertices.select("node").unionByName(ends).distinct()
    found = found.hint("merge") if mark[0] > HOT_MIN else found
    return nodes.join(found, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*"), F.coalesce(F.sum(wide(F.xxhash64("hi", "lo"))), F.lit(0).cast("decimal(38,0)"))
    ).first()
    return int(row[0]), int(row[1])


def same_cluster(pairs: DataFrame, members: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """Are the two wallets of each given pair in one component?"""
    left = members.select(F.col("node").alias(a), F.col("component").alias("_a"))
    right = members.select(F.col("node").alias(b), F.col("component").alias("_b"))
    joined = lookup_join(lookup_join(pairs, left, [a]), right, [b])
    return joined.withColumn("connected", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).drop(
        "_a", "_b"
    )


def cluster_stats(members: DataFrame, wallets: DataFrame) -> DataFrame:
    """Size, volume and buys per component. ``wallets``: node, volume_lamports, buy_count."""
    joined = members.join(wallets, "node", "left")
    return joined.groupBy("component").agg(
        F.count("*").alias("size"),
        F.coalesce(F.sum(wide(F.col("volume_lamports"))), F.lit(0)).alias("volume_lamports"),
        F.coalesce(F.sum("buy_count"), F.lit(0)).alias("buy_count"),
    )


def whole_amounts(df: DataFrame, column: str) -> DataFrame:
    """``column`` (whole numbers as decimals) as bigint where all of its values fit, else as it is.

    A sum over a component grows with the table, so whether it fits is only known from the data.
    """
    df, _ = materialize(df)
    fits = F.coalesce(F.bool_and(F.col(column).try_cast("bigint").isNotNull() | F.col(column).isNull()), F.lit(True))
    return df.withColumn(column, F.col(column).cast("bigint")) if df.agg(fits).first()[0] else df


def clusters_of(lists: DataFrame, members: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Distinct clusters of the wallets listed per ``key`` (columns ``key``, ``node``)."""
    found = lookup_join(lists.select(key, "node"), members, ["node"], "inner")
    return lookup_join(found.select(key, "component").distinct(), stats, ["component"], "inner")


def clusters_as_of(
    lists: DataFrame, members: DataFrame, activity: DataFrame, keys: Sequence[str], end: str
) -> DataFrame:
    """Clusters of the wallets listed per ``keys``, with the volume of their members until then.

    ``lists``: (keys, node). ``activity``: (node, pane_end, lamports), one row per wallet and pane; only panes
    that close by the column ``end`` (one of ``keys``) count. Activity is summed once per (component, pane) of
    the listed components; their running volume meets the cases in one ordered pass, so a component that
    every case lists costs its panes and its cases, not their product.
    """
    keys = list(keys)
    found, _ = materialize(
        lookup_join(lists.select(*keys, "node"), members, ["node"], "inner").select(*keys, "component").distinct()
    )
    inside = lookup_join(members, found.select("component").distinct(), ["component"], "left_semi")
    sizes = inside.groupBy("component").agg(F.count_distinct("node").alias("size"))
    volumes = (
        lookup_join(activity, inside.select("node", "component").distinct(), ["node"], "inner")
        .groupBy("component", F.col("pane_end").cast("bigint").alias("_at"))
        .agg(F.sum(wide(F.col("lamports"))).alias("lamports"))
    )
    asked = found.withColumn("_at", F.col(end).cast("bigint")).withColumn("_asked", F.lit(1))
    both = volumes.withColumn("_asked", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    until = Window.partitionBy("component").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = both.withColumn("volume_lamports", F.coalesce(F.sum("lamports").over(until), F.lit(0)))
    return lookup_join(summed.filter("_asked = 1").select(*keys, "component", "volume_lamports"), sizes, ["component"]).select(
        *keys, "component", "size", "volume_lamports"
    )


def cluster_overview(stats: DataFrame, minimum: int = 2) -> DataFrame:
    """One row: wallets, clusters, large clusters, mean and largest size."""
    return stats.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_wallets"),
        F.count("*").alias("total_clusters"),
        F.count_if(F.col("size") >= minimum).alias("large_clusters"),
        F.coalesce(
            F.try_divide(F.sum("size").cast("double"), F.count("*").cast("double")), F.lit(0.0)
        ).alias("avg_cluster_size"),
        F.coalesce(F.max("size"), F.lit(0)).alias("max_cluster_size"),
    )


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n > 1, F.lit("s")).otherwise(F.lit("")))


def cluster_summary(found: DataFrame, key: str | Sequence[str], shown: int = 5) -> DataFrame:
    """Text per key: wallets, clusters, and the largest clusters by volume as A, B, C, ...

    ``found`` is the result of ``clusters_of``. Only the ``shown`` largest clusters per key are
    gathered into a list.
    """
    keys = [key] if isinstance(key, str) else list(key)
    totals = found.groupBy(*keys).agg(
        F.sum("size").alias("wallets"), F.count("*").alias("clusters")
    )
    tops = (
        top_per_key(found, keys, [F.desc("volume_lamports"), F.asc("component")], shown)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "size", "volume_lamports"))).alias("top"))
    )
    lines = F.transform(
        "top",
        lambda c: F.concat(
            F.lit("Cluster "),
            F.char(F.lit(64) + c["rank"]),
            F.lit(" ("),
            _plural(c["size"], "wallet"),
            F.lit(", "),
            fixed(sol(c["volume_lamports"]), 2),
            F.lit(" SOL)"),
        ),
    )
    extra = F.when(
        F.col("clusters") > shown,
        F.concat(F.lit(" (+"), (F.col("clusters") - shown).cast("string"), F.lit(" more clusters)")),
    ).otherwise(F.lit(""))
    text = F.concat(
        F.col("wallets").cast("string"),
        F.lit(" wallets in "),
        _plural(F.col("clusters"), "cluster"),
        F.lit(": "),
        F.concat_ws(", ", lines),
        extra,
    )
    return totals.join(tops, keys).select(*keys, "wallets", "clusters", text.alias("cluster_summary"))


def funding_edges(tx: DataFrame) -> DataFrame:
    """Who funded whom in each transaction: for every account whose balance rose, the first
    account in key order whose balance fell."""
    both = F.arrays_zip(
        F.col("account_keys").alias("account"),
        F.col("pre_balances").alias("pre"),
        F.col("post_balances").alias("post"),
    )
    fell = F.filter(both, lambda z: z["pre"] > z["post"])
    rose = F.filter(both, lambda z: z["post"] > z["pre"])
    return (
        tx.select("signature", "slot", "block_time", rose.alias("rose"), fell.alias("fell"))
        .filter((F.size("rose") > 0) & (F.size("fell") > 0))
        .select(
            "signature",
            "slot",
            "block_time",
            F.element_at("fell", 1)["account"].alias("funder"),
            F.explode("rose").alias("r"),
        )
        .select(F.col("r.account").alias("wallet"), "funder", "signature", "slot", "block_time")
    )


def earliest_funder(
    transfers: DataFrame, order: Sequence[str], wallet: str = "wallet", funder: str = "funder"
) -> DataFrame:
    """First incoming transfer of each wallet, self-transfers left out."""
    real = transfers.filter(F.col(wallet) != F.col(funder))
    first = F.min(F.struct(*order, funder)).alias("_f")
    return real.groupBy(wallet).agg(first).select(
        F.col(wallet).alias("wallet"),
        F.col(f"_f.{funder}").alias("funder"),
        *[F.col(f"_f.{c}").alias(c) for c in order],
    )


def trace_funding(firsts: DataFrame, wallets: DataFrame, max_hops: int = 2) -> DataFrame:
    """Follow each wallet's first funder ``max_hops`` times.

    One row per traced wallet: ``funder_1`` .. ``funder_n``, the last one known, number of hops.
    One funder may stand behind a large share of wallets, hence the lookup. What it joins is written first: transfers
    are then reduced once and not for every hop, and the joins are chosen by real sizes.
    """
    step, _ = materialize(firsts.select("wallet", "funder"))
    wallets, _ = materialize(wallets.select("wallet"))
    out = lookup_join(
        wallets, step.withColumnRenamed("funder", "funder_1"), ["wallet"], "inner"
    )
    for hop in range(2, max_hops + 1):
        table = step.select(
            F.col("wallet").alias(f"funder_{hop - 1}"), F.col("funder").alias(f"funder_{hop}")
        )
        out, _ = materialize(out)
        out = lookup_join(out, table, [f"funder_{hop - 1}"], "left")
    names = [f"funder_{h}" for h in range(1, max_hops + 1)]
    hops = sum((F.col(n).isNotNull().cast("int") for n in names[1:]), F.lit(1))
    return out.select(
        "wallet", *names, F.coalesce(*reversed(names)).alias("ultimate_funder"), hops.alias("hops")
    )

"""What failed on larger tables: sums beyond bigint, batches without rows, micro-batches by setting instead of by rows."""

import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowlens.session import materialize, shared_dir
from flowlens.streaming import jobs as J
from flowlens.workload import q_stream


def test_cluster_volume_beyond_bigint(spark, tmp_path):
    names = ["a", "b", "c"]
    customers = pd.DataFrame({"c_custkey": [1, 7, 3], "c_name": names, "c_nationkey": [0, 0, 0]})
    orders = pd.DataFrame({"o_orderkey": range(3), "o_custkey": [1, 7, 3], "o_totalprice": [6e9, 7e9, 12.34]})
    spark.createDataFrame(customers).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders).write.parquet(f"{tmp_path}/orders.parquet")
    found = {r.component: int(r.volume_lamports) for r in entry.queries()["cluster_stats"](spark, str(tmp_path)).collect()}
    assert found == {1: 13 * 10**18, 3: 12_340_000_000}


def test_first_batch_without_rows(spark):
    schema = "signature string, block_time long"
    path, out = shared_dir(spark), shared_dir(spark)
    for batch in ([], [("a", 100)], [("a", 100), ("b", 200)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    rows = spark.createDataFrame([], schema).schema
    sink = J.insert_once(out, ["signature"], ["block_time"], epoch="block_time")
    J.run_available(J.file_stream(spark, path, rows, max_files=1), sink, mode="append")
    stored = J.read_stored(spark, out, rows, "block_time")
    assert sorted(r.signature for r in stored.collect()) == ["a", "b"]


def test_micro_batches_follow_the_rows(spark):
    def files(path):
        return spark.read.parquet(path).inputFiles()

    key, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, "200")
    try:
        rows = spark.range(2000)
        assert len(files(q_stream.staged(rows, "id"))) == 6
        assert len(files(q_stream.staged(rows, "id", rows=200))) == 10
        assert J.state_partitions(spark) < 200
    finally:
        spark.conf.set(key, before)


def test_table_beyond_the_limit_is_not_broadcast_by_its_files(spark):
    from flowlens.operators.lookups import lookup_join

    facts = spark.range(40_000).selectExpr("id % 20000 as k", "id")
    table = spark.range(20_000).selectExpr("id as k", "id * 2 as v")
    for salts in (1, 2):
        joined = lookup_join(facts, table, ["k"], salts=salts, broadcast_bytes=10_000)
        assert joined.count() == 40_000
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_changes_without_programs_join_no_parts(spark):
    plan = entry.queries()["swap_candidates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" not in plan and "l_partkey" in plan


def test_large_components_are_not_broadcast(spark, monkeypatch):
    """Links come from small files, but only hot nodes may go through the driver: two joins of a step."""
    from flowlens.operators import graph as G

    def broadcasts(df):
        return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")

    monkeypatch.setattr(G, "HOT_MIN", 50)
    links, _ = materialize(spark.range(1, 500).selectExpr("id as wallet", "id div 7 as funder").filter("wallet % 3 <> 0"))
    edges, _ = materialize(links.selectExpr("wallet as hi", "funder as lo"))
    minima, _ = materialize(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("low"), F.count("*").alias("degree")))
    assert broadcasts(G._relink(edges, "hi", minima, edges.count())) == 2
    found = G.components(links.selectExpr("wallet as node"), links)
    assert broadcasts(found) == 0 and found.filter("component = 0 and node = 7").isEmpty() is False

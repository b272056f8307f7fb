"""Stateful streams against plain Python, over unordered micro-batches and across a restart."""

import random

from pyspark.sql import functions as F

from flowlens.session import shared_dir
from flowlens.streaming import gates
from flowlens.streaming import jobs as J


def batches(spark, parts, schema):
    """A folder with one file per micro-batch, read one by one."""
    path = shared_dir(spark)
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, path, schema, make, out, checkpoint=None):
    stream = J.file_stream(spark, path, spark.createDataFrame([], schema).schema, max_files=1)
    return J.run_available(make(stream), J.write_versions(out), checkpoint, "append")


def greedy(rows, ttl):
    last, out = {}, set()
    for k, t in sorted(rows, key=lambda r: r[1]):
        if k not in last or t - last[k] >= ttl:
            last[k] = t
            out.add((k, t))
    return out


def test_gate_equals_greedy_and_survives_a_restart(spark):
    rng, schema = random.Random(6), "k string, t long, id long, is_clock boolean"
    rows = {(rng.choice([None, "a", "b", "c"]), rng.randrange(4000)) for _ in range(500)}
    # Batches overlap by up to 300 seconds; each row comes twice with different ids.
    ordered = sorted(rows, key=lambda r: r[1] + rng.randrange(300))
    every = [(k, t, i, False) for k, t in ordered for i in (7, 3)]
    cut = len(every) // 2
    first, second = every[:cut], every[cut:] + [("clock", 100_000, 0, True)]
    path, out = batches(spark, [first[: cut // 2], first[cut // 2 :]], schema), shared_dir(spark)

    def make(stream):
        return gates.first_sight(stream, ["k"], "t", 50, carry=["id"], late="400 seconds")

    checkpoint = run(spark, path, schema, make, out)
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("clock", 100_001, 0, True)], schema).coalesce(1).write.mode("append").parquet(path)
    run(spark, path, schema, make, out, checkpoint)
    got = [(r.k, r.t, r.id) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and {g[:2] for g in got} == greedy(rows, 50)
    assert {g[2] for g in got} == {3}


def test_latest_before(spark):
    rng, schema = random.Random(2), "kind string, key string, block_time long, slot long, v double, note string, is_clock boolean"
    rows = []
    for n in range(600):
        kind = rng.choice(["fact", "value"])
        value = rng.choice([None, float(n)]) if kind == "value" else None
        rows.append((kind, rng.choice("ab"), rng.randrange(5000), n, value, f"n{n}", False))
    want = {}
    for r in rows:
        if r[0] == "fact":
            old = [x for x in rows if x[0] == "value" and x[4] is not None and x[1] == r[1] and x[2] <= r[2]]
            best = max(old, key=lambda x: (x[2], x[3]), default=None)
            fresh = best is not None and r[2] - best[2] <= 100
            want[r[5]] = (best[4], best[2]) if fresh else (None, None)
    rows.sort(key=lambda r: r[2] + rng.randrange(200))
    clock = [("fact", "clock", 90_000 + k, 0, None, None, True) for k in range(2)]
    path, out = batches(spark, [rows[:200], rows[200:400], rows[400:], clock[:1], clock[1:]], schema), shared_dir(spark)

    def make(stream):
        facts = stream.filter("kind = 'fact'").select("key", "block_time", "note", "is_clock")
        return gates.latest_before(facts, stream.filter("kind = 'value'"), "key", "v", 100, late="300 seconds")

    run(spark, path, schema, make, out)
    got = spark.read.parquet(out).select("note", "v", "v_time").collect()
    assert len(got) == len(want) and {r[0]: (r[1], r[2]) for r in got} == want


def test_clock_row(spark):
    rows = spark.createDataFrame([("a", 5)], "k string, t long")
    both = gates.with_clock(rows, rows.agg((F.max("t") + 100).alias("t")), "t").collect()
    assert sorted((str(r.k), r.t, r.is_clock) for r in both) == [("None", 105, True), ("a", 5, False)]


def test_versions_are_put_together(spark):
    path, want = shared_dir(spark), {}
    sink = J.write_versions(path, ["k"], every=3)
    for batch in range(8):
        rows = [(k, batch * 10 + k) for k in range(batch, batch + 3)]
        want |= dict(rows)
        sink(spark.createDataFrame(rows, "k long, v long"), batch)
        got = J.read_latest(spark, path, ["k"]).collect()
        assert len(got) == len(want) and {r.k: r.v for r in got} == want
    names = {p.rsplit("/", 2)[1] for p in spark.read.parquet(path).inputFiles()}
    assert names == {"batch=5", "batch=6", "batch=7"}
    # A compaction that was cut short after its folder was written whole.
    whole = spark.read.parquet(path + "/batch=5").union(spark.read.parquet(path + "/batch=6"))
    whole.dropDuplicates(["k"]).limit(0).union(J.read_latest(spark, path, ["k"]).select("k", "v")).write.parquet(path + "/_compacted-6")
    assert J.compact_versions(spark, path, ["k"], 6) == 2
    assert {r.k: r.v for r in J.read_latest(spark, path, ["k"]).collect()} == want

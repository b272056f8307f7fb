"""Mixing sources to target weights along a time-varying curriculum.

**Targets.** Sources in order of code point (null last) have the weights ``WEIGHTS``, repeating. They
share ``TOTAL`` times all words; a source stops at ``MOST`` times its own size, and what it can't take is
shared among the rest by weight, until none is above. With sources in order of "cap / weight" those that
stop come first, so one pass of running sums finds the level: one row per source.

**Curriculum.** While training runs from time 0 to 1, a source's weight follows a schedule, here linear
from ``1 - tilt`` to ``1 + tilt`` times its mean: the tilt differs by source. The integral of the schedule
times the target is the source's cumulative demand of words. Its documents, in an order fixed by a digest
of their id and repeated if the target exceeds them, have cumulative positions; the inverse of the demand
turns each into a time, the document's training position. ``ordered`` range-sorts by it.

A document is taken once for every pass in which its middle lies below the target, so each source comes
within one document of its target and no document is taken more than ``MOST`` times.

Running sums over a source are made in two levels: per (source, slice of the digest), then within the
slice, so that a source with a third of all rows is not one task.

**Edge cases.** Null texts have size 0; documents of size 0 are never taken; a null source is a source of
its own; a null id counts as an empty one in the digest; rows that share an id are ordered by size, and
equal rows among themselves don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (3, 1, 2)
TOTAL = (3, 2)  # 150 %, as a fraction
MOST = 2
TILTS = (0.5, -0.5, 0.0)
SLICES = 3  # hexadecimal digits of the digest: 4,096 slices per source

WORD = "[^\\x20\\x09-\\x0D]+"


def size_of(text: str = "text") -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, tilt, target from (source, size) rows."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))  # one row per source
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1

    def pick(values: tuple) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(place, F.lit(len(values))) + 1)

    sources = sources.withColumns({"weight": pick(WEIGHTS), "tilt": pick(TILTS)})
    cap = F.col("source_size") * MOST
    total = F.sum("source_size").over(everything) * TOTAL[0] / TOTAL[1]
    before = everything.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    left = total - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    sources = sources.withColumns({"cap": cap, "left": left.cast("double"), "weights": weights})
    stops = F.col("left") * F.col("weight") >= F.col("cap") * F.col("weights")
    # The first source that doesn't stop sets the level; those after it would count it as stopped,
    # which leaves less than its share.
    level = F.max(F.col("left") / F.col("weights")).over(everything)
    open_sources = sources.filter(~stops).select("source", "weight", "tilt", "source_size", "left", "weights")
    shared = open_sources.withColumn("target", F.col("weight") * level)
    full = sources.filter(stops).withColumn("target", F.col("cap").cast("double"))
    columns = ["source", "source_size", "weight", "tilt", "target"]
    return full.select(columns).unionByName(shared.select(columns))


def time_of(words: Column, target: Column, tilt: Column) -> Column:
    """When the source's cumulative demand reaches ``words``.

    Demand grows as ``target * ((1 - tilt) t + tilt t ** 2)``: the integral of a linear schedule.
    """
    share = words / F.nullif(target, F.lit(0.0))
    b = F.lit(1.0) - tilt
    root = (F.sqrt(b * b + 4 * tilt * share) - b) / F.nullif(2 * tilt, F.lit(0.0))
    return F.when(tilt == 0, share).otherwise(root)


def curriculum(docs: DataFrame, size: Column) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target, mix_taken and mix_positions.

    ``docs`` has doc_id and source, and no columns named mix_...; ``size`` is a row's words.
    ``mix_positions`` has one time per pass that takes the row.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.withColumn("mix_size", size).withColumn("mix_key", key)
    rows = rows.withColumn("mix_slice", F.substring("mix_key", 1, SLICES))
    # A key without nulls, so that the window and the join below share one exchange of the rows.
    own = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = rows.withColumn("mix_own", own)
    sizes = rows.groupBy("source", "mix_slice").agg(F.sum("mix_size").alias("size"))
    upto = Window.partitionBy("source").orderBy("mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(sizes)
    slices = sizes.withColumn("base", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    places = slices.join(targets, slices.source.eqNullSafe(targets.source)).select(
        F.coalesce(F.concat(F.lit("="), slices.source), F.lit("")).alias("mix_own"), "mix_slice", F.col("base").alias("mix_base"),
        F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("tilt").alias("mix_tilt"),
    )
    within = (
        Window.partitionBy("mix_own", "mix_slice").orderBy("mix_key", "mix_size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inner = rows.withColumn("mix_before", F.coalesce(F.sum("mix_size").over(within), F.lit(0)))
    joined = inner.join(places, ["mix_own", "mix_slice"])
    start, target = F.col("mix_base") + F.col("mix_before"), F.col("mix_target")

    def middle(turn: int) -> Column:
        return (start + turn * F.col("mix_source_size")) + F.col("mix_size") / 2

    times = [
        F.when((F.col("mix_size") > 0) & (middle(k) < target), time_of(middle(k), target, F.col("mix_tilt")))
        for k in range(MOST)
    ]
    return joined.withColumn("mix_positions", F.array_compact(F.array(*times))).select(
        *docs.columns, "mix_size", "mix_source_size", "mix_target",
        (F.col("mix_size") * F.size("mix_positions")).alias("mix_taken"), "mix_positions",
    )


def ordered(mixed: DataFrame, parts: int) -> DataFrame:
    """Rows in training order, one for every time a document is taken: range-sorted by mix_position."""
    taken = mixed.withColumn("mix_position", F.explode("mix_positions")).drop("mix_positions")
    return taken.repartitionByRange(parts, "mix_position", "doc_id").sortWithinPartitions("mix_position", "doc_id")


TARGET_SQL = """
sizes as (select doc_id, source, md5(coalesce(doc_id::varchar, '')) as k,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size
  from {documents}),
sources as (select source, sum(size)::bigint as source_size,
    ([3, 1, 2])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight,
    ([0.5, -0.5, 0.0])[(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as tilt
  from sizes group by source),
ranked as (select *, 2 * source_size as cap, source_size / weight as ratio,
    (sum(source_size) over () * 1.5 - coalesce(sum(2 * source_size) over w, 0))::double as rest,
    sum(weight) over () - coalesce(sum(weight) over w, 0) as weights
  from sources window w as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
level as (select max(rest / weights) as value from ranked where rest * weight < cap * weights),
targets as (select source, source_size, tilt,
    case when rest * weight >= cap * weights then cap else weight * (select value from level) end::double as target
  from ranked),
places as (select doc_id, size, source_size, target, tilt,
    coalesce(sum(size) over (partition by s.source order by k, size rows between unbounded preceding and 1 preceding), 0) + size / 2 as middle
  from sizes s join targets t on s.source is not distinct from t.source)
"""

SQL = (
    "with "
    + TARGET_SQL.replace("{documents}", "documents")
    + """select doc_id, size, source_size, target,
  (size * ((size > 0 and middle < target)::int + (size > 0 and middle + source_size < target)::int))::bigint as taken
from places"""
)

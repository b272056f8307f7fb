"""Programs that are not in the known list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.lookups import lookup_join, top_per_key


def unknown_uses(tx: DataFrame, known: Sequence[str]) -> DataFrame:
    """One row per (transaction, unknown program), with the known programs next to it."""
    listed = F.array(*[F.lit(p) for p in known])
    return tx.select(
        "signature",
        "slot",
        F.explode(F.array_except("programs_invoked", listed)).alias("program_id"),
        F.array_intersect("programs_invoked", listed).alias("known_beside"),
    )


def unknown_programs(tx: DataFrame, known: Sequence[str]) -> DataFrame:
    """Occurrences, first slot and known companions of each unknown program.

    The known list is short and configured, so each companion is one boolean of the same hash
    aggregate: one scan, one exchange, no lists gathered.
    """
    companions = sorted(known)
    out = (
        unknown_uses(tx, known)
        .groupBy("program_id")
        .agg(
            F.count("*").alias("occurrences"),
            F.min("slot").alias("first_slot"),
            *[
                F.bool_or(F.array_contains("known_beside", p)).alias(f"_{i}")
                for i, p in enumerate(companions)
            ],
        )
    )
    beside = [F.when(F.col(f"_{i}"), F.lit(p)) for i, p in enumerate(companions)]
    return out.select(
        "program_id",
        "occurrences",
        "first_slot",
        F.array_compact(F.array(*beside)).alias("co_occurring"),
    )


def occurrence_notice(tx: DataFrame, known: Sequence[str], at: int = 100) -> DataFrame:
    """The transaction in which an unknown program appears for the ``at``-th time."""
    uses = unknown_uses(tx, known)
    firsts = top_per_key(uses, ["program_id"], [F.asc("slot"), F.asc("signature")], at)
    return firsts.filter(F.col("rank") == at)


def program_labels(uses: DataFrame, names: DataFrame) -> DataFrame:
    """Label of each program id: its configured name, else the first eight characters."""
    labelled = lookup_join(uses, names, ["program_id"], "left")
    return labelled.withColumn(
        "label", F.coalesce("name", F.substring("program_id", 1, 8))
    ).drop("name")

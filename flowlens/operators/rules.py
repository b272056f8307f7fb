"""Rules compiled to column expressions: no join with a rule table, all inside code generation."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.constants import MIN_MCAP_SOL
from flowlens.functions.columns import bind, fixed
from flowlens.sources.rules import FIELDS, Condition, Rule

_COMPARE = {
    ">=": operator.ge,
    "<=": operator.le,
    "==": operator.eq,
    ">": operator.gt,
    "<": operator.lt,
}


def holds(condition: Condition) -> Column:
    if condition.field not in FIELDS:
        raise ValueError(f"unknown field {condition.field}")
    value = F.coalesce(F.col(condition.field).cast("double"), F.lit(0.0))
    return _COMPARE[condition.op](value, F.lit(condition.value))


def fires(rule: Rule) -> Column:
    """All conditions of the rule hold."""
    return reduce(operator.and_, [holds(c) for c in rule.conditions])


def in_order(rules: Sequence[Rule]) -> list[Rule]:
    """Enabled rules: those on the short window first, each group in file order."""
    active = [r for r in rules if r.enabled]
    return [r for r in active if not r.long] + [r for r in active if r.long]


def evaluate(stats: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One boolean column per rule, named after it."""
    return stats.withColumns({r.name: fires(r) for r in in_order(rules)})


def _number_text(column: Column) -> Column:
    big = (F.isnan(column)) | (F.abs(column) == float("inf"))
    return F.when(big, F.lit("inf")).otherwise(fixed(F.when(~big, column), 2))


def reason(rule: Rule) -> Column:
    """The rule's name and each tested value beside its limit."""
    parts = [F.lit(f"Trigger: {rule.name}")]
    for c in rule.conditions:
        actual = F.coalesce(F.col(c.field).cast("double"), F.lit(0.0))
        parts.append(
            F.concat(F.lit(f"{c.field}="), _number_text(actual), F.lit(f" ({c.op} {c.value})"))
        )
    return F.concat_ws(" | ", *parts)


def first_match(stats: DataFrame, rules: Sequence[Rule], with_reason: bool = True) -> DataFrame:
    """The first rule that fires per row; rows where none fires are dropped."""
    ordered = in_order(rules)
    name = F.coalesce(*[F.when(fires(r), F.lit(r.name)) for r in ordered])
    # Computed once per row: the reason below names it for every rule.
    hit = bind(stats, {"trigger_name": name}).filter(F.col("trigger_name").isNotNull())
    if with_reason:
        text = F.coalesce(
            *[F.when(F.col("trigger_name") == r.name, reason(r)) for r in ordered]
        )
        hit = hit.withColumn("trigger_reason", text)
    return hit


def mcap_gate(hits: DataFrame, mcap: str = "mcap_sol", minimum: float = MIN_MCAP_SOL) -> DataFrame:
    """Drop hits on tokens known to be smaller than ``minimum``; unknown or zero caps pass."""
    cap = F.coalesce(F.col(mcap), F.lit(0.0))
    return hits.filter((cap == 0) | (cap >= minimum))

"""Rule files and their conditions."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.constants import RULE_STATS

# Operators in the order in which a condition is searched for them.
OPERATORS = (">=", "<=", "==", ">", "<")
FIELDS = tuple(f"{name}_{suffix}" for suffix in ("5m", "1h") for name in RULE_STATS)
DEFAULT_RULES = Path(__file__).resolve().parent.parent / "rules" / "default.yaml"


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: float


@dataclass(frozen=True)
class Rule:
    name: str
    conditions: tuple[Condition, ...]
    enabled: bool = True

    @property
    def long(self) -> bool:
        """Does any condition look at the long window?"""
        return any("_1h" in c.field for c in self.conditions)


def parse_condition(text: str) -> Condition | None:
    """``field op number``; None where it is not that."""
    op = next((o for o in OPERATORS if o in text), None)
    parts = text.split(op) if op else []
    if len(parts) != 2:
        return None
    try:
        return Condition(parts[0].strip(), op, float(parts[1].strip()))
    except ValueError:
        return None


def rules_from(entries: list[dict]) -> list[Rule]:
    """Rules from ``{name, conditions, enabled}`` entries; disabled and empty ones are left out."""
    out = []
    for entry in entries or []:
        found = [parse_condition(c) for c in entry.get("conditions") or []]
        kept = tuple(c for c in found if c)
        if kept and entry.get("enabled", True):
            out.append(Rule(entry.get("name", "unknown"), kept))
    return out


def write_rules(spark: SparkSession, rules: list[Rule], path: str) -> None:
    """Rules as one JSON record per rule in a folder of any file system that Spark writes."""
    rows = [
        (i, r.name, [f"{c.field} {c.op} {c.value!r}" for c in r.conditions]) for i, r in enumerate(rules)
    ]
    table = spark.createDataFrame(rows, "place int, name string, conditions array<string>")
    table.coalesce(1).write.mode("overwrite").json(path)


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules from such a folder (a few dozen rows of configuration)."""
    schema = "place int, name string, conditions array<string>, enabled boolean"
    rows = spark.read.schema(schema).json(path).orderBy("place").collect()
    return rules_from(
        [{"name": r.name, "conditions": r.conditions, "enabled": r.enabled is not False} for r in rows]
    )


def load_rules(path: str | Path = DEFAULT_RULES) -> list[Rule]:
    """Read a YAML or JSON rule file (a few dozen entries of configuration)."""
    text = Path(path).read_text()
    if str(path).endswith(".json"):
        config = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading YAML rules needs PyYAML; use a .json file") from error
        config = yaml.safe_load(text)
    return rules_from((config or {}).get("triggers", []))


def parsed_condition(text: Column) -> dict[str, Column]:
    """The parts of a condition in a text column: ``field``, ``op``, ``value``, null if malformed."""
    op = F.coalesce(*[F.when(F.contains(text, F.lit(o)), F.lit(o)) for o in OPERATORS])
    parts = F.split(text, F.concat(F.lit(r"\Q"), op, F.lit(r"\E")))
    value = F.trim(F.try_element_at(parts, F.lit(2))).try_cast("double")
    good = (F.size(parts) == 2) & value.isNotNull()
    return {
        "field": F.when(good, F.trim(F.try_element_at(parts, F.lit(1)))),
        "op": F.when(good, op),
        "value": F.when(good, value),
    }


def rule_errors(rules: DataFrame) -> DataFrame:
    """Problems in a table of rules (``rule_id``, ``name``, ``conditions array<string>``).

    One row per problem: repeated name, no conditions, bad operator, format, field or number.
    """
    repeated = (
        rules.groupBy("name")
        .agg(F.count("*").alias("n"), F.min("rule_id").alias("rule_id"))
        .filter("n > 1")
        .select("rule_id", "name", F.lit("duplicate name").alias("problem"))
    )
    empty = rules.filter(F.coalesce(F.size("conditions"), F.lit(0)) == 0).select(
        "rule_id", "name", F.lit("no conditions").alias("problem")
    )
    each = rules.select("rule_id", "name", F.explode("conditions").alias("text"))
    text = F.col("text")
    op = F.coalesce(*[F.when(F.contains(text, F.lit(o)), F.lit(o)) for o in OPERATORS])
    parts = F.split(text, F.concat(F.lit(r"\Q"), op, F.lit(r"\E")))
    field = F.trim(F.try_element_at(parts, F.lit(1)))
    number = F.trim(F.try_element_at(parts, F.lit(2))).try_cast("double")
    problem = (
        F.when(op.isNull(), F.lit("invalid operator"))
        .when(F.size(parts) != 2, F.lit("invalid format"))
        .when(~field.isin(*FIELDS), F.concat(F.lit("unknown field "), field))
        .when(number.isNull(), F.lit("invalid value"))
    )
    bad = each.select("rule_id", "name", problem.alias("problem")).filter("problem is not null")
    return repeated.unionByName(empty).unionByName(bad)

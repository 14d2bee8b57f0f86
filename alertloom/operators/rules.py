"""Severity rules over typed evidence, compiled to column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType, StructType

from alertloom import constants as K

Rule = tuple[str, str, str, str, object]
REFERENCE = "reference"


def _field(schema: StructType, path: str):
    """Type of a dotted path below a collector's columns, or None where nothing is there.

    A `[*]` step stands for the list itself, which no check accepts; such rules never match.
    """
    kind = schema
    for name in path.split("."):
        if not isinstance(kind, StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
    return kind


def rule_condition(rule: Rule, schema: StructType, block: str = "") -> Column | None:
    """The condition of one rule, or None if its path or value type can never match.

    Paths start at the columns, or at those of the struct `block`.
    """
    _, _, path, check, value = rule
    kind = _field(schema, path)
    if kind is None:
        return None
    field = F.col(f"{block}.{path}" if block else path)
    if check == "equals":
        same = (
            isinstance(kind, StringType) and isinstance(value, str)
            or isinstance(kind, BooleanType) and isinstance(value, bool)
            or isinstance(kind, NumericType) and isinstance(value, (int, float))
        )
        return field == value if same else None
    if check == "startswith" and isinstance(kind, StringType):
        return field.startswith(value)
    if check == "gte" and isinstance(kind, NumericType):
        return field >= value
    if check == "contains" and kind.typeName() == "array":
        return F.array_contains(field, value)
    return None


def severity_level(
    collector: str, schema: StructType, rules: Iterable[Rule] = K.SEVERITY_RULES
) -> Column:
    """The level of a collector whose evidence stands alone: the highest one with a rule that holds."""
    rules = list(rules)
    out = F.when(F.lit(False), REFERENCE)
    for level in K.SEVERITY_LEVELS:
        for rule in rules:
            if rule[0] == level and rule[1] == collector:
                condition = rule_condition(rule, schema)
                if condition is not None:
                    out = out.when(condition, level)
    return out.otherwise(REFERENCE)


def with_levels(sessions: DataFrame, collectors: Sequence[str],
                rules: Iterable[Rule] = K.SEVERITY_RULES) -> DataFrame:
    """Adds a `level` to the block of each collector, as all rules of a session decide it together.

    Levels are gone through from the highest, and the rules of a level in order. The first rule
    that holds for a collector without a level gives it that level and ends the level, so a level
    has one collector. Others go on to lower levels; what no rule takes is for reference.
    """
    rules = list(rules)
    taken: list[str] = []
    out = sessions
    for level in K.SEVERITY_LEVELS:
        pick = F.when(F.lit(False), F.lit(None).cast("string"))
        for rule in rules:
            if rule[0] != level or rule[1] not in collectors:
                continue
            condition = rule_condition(rule, sessions.schema[rule[1]].dataType, rule[1])
            if condition is None:
                continue
            for earlier in taken:
                condition = condition & ~F.col(earlier).eqNullSafe(rule[1])
            pick = pick.when(condition, rule[1])
        taken.append(f"_{level}_taken")
        out = out.withColumn(taken[-1], pick)
    for c in collectors:
        level = F.coalesce(*[F.when(F.col(t) == c, lv)
                             for t, lv in zip(taken, K.SEVERITY_LEVELS, strict=True)], F.lit(REFERENCE))
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c).withField("level", level)))
    return out.drop(*taken)

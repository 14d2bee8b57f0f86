"""Documents read back: evidence rows, values at a path, and rules on the JSON itself."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from alertloom import constants as K
from alertloom.operators.rules import REFERENCE, Rule

PUBLISHED, INTENDED = "published", "intended"


def _members(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def blocks(docs: DataFrame, document: str = "document", id_col: str = "alert_id") -> DataFrame:
    """id, level, collector, block (VARIANT): what a document says of each collector.

    Unreadable documents and ones without evidence have no block.
    """
    evidence = F.try_variant_get(F.try_parse_json(document), "$.evidence", "map<string,variant>")
    levels = docs.select(id_col, F.explode(evidence).alias("level", "found"))
    return levels.select(id_col, "level", F.explode(_members(F.col("found"), "map<string,variant>"))
                         .alias("collector", "block"))


def item_text(entry: Column) -> Column:
    """What an evidence entry names: a text, a hash, or the kind and reasons of a finding."""
    reasons = F.array_join(F.try_variant_get(entry, "$.reasons", "array<string>"), ",")
    finding = F.concat_ws("|", _text(entry, "$.type"), _text(entry, "$.direction"),
                          _text(entry, "$.source"), reasons)
    is_object = F.schema_of_variant(entry).startswith("OBJECT")
    return F.when(is_object, F.coalesce(_text(entry, "$.hash"), finding)).otherwise(_text(entry, "$"))


def evidence_rows(docs: DataFrame, document: str = "document", id_col: str = "alert_id") -> DataFrame:
    """id, level, collector, kind, place, value: one row for each entry of a document's evidence lists."""
    lists = F.try_variant_get("block", "$.evidence", "map<string,variant>")
    kinds = blocks(docs, document, id_col).select(
        id_col, "level", "collector", F.explode(lists).alias("kind", "held"))
    context = F.schema_of_variant("held").startswith("OBJECT")  # lists may stand one step deeper
    inner = F.map_entries(_members(F.col("held"), "map<string,variant>"))
    own = F.array(F.struct(F.col("kind").alias("key"), F.col("held").alias("value")))
    every = kinds.select(id_col, "level", "collector", F.inline(F.when(context, inner).otherwise(own)))
    entries = every.select(id_col, "level", "collector", F.col("key").alias("kind"),
                           F.posexplode(_members(F.col("value"), "array<variant>")).alias("place", "entry"))
    return entries.select(id_col, "level", "collector", "kind", "place", item_text(F.col("entry")).alias("value"))


def path_values(value: Column, path: str) -> Column:
    """The values at a path as an array of VARIANT; a step `name[*]` goes on with each element of a list."""
    found = F.array(value)

    def below(name: str):
        return lambda v: F.try_variant_get(v, f"$.{name}", "variant")

    for step in path.split("."):
        name, each, _ = step.partition("[*]")
        found = F.transform(found, below(name))
        if each:
            found = F.flatten(F.transform(
                found, lambda v: F.coalesce(_members(v, "array<variant>"), F.array().cast("array<variant>"))))
        found = F.filter(found, lambda v: v.isNotNull())
    return found


def rule_holds(block: Column, rule: Rule, mode: str = PUBLISHED) -> Column:
    """Whether a rule holds for a collector's block.

    As published, a path with `[*]` ends at the list itself, which no check accepts. As intended, the
    rule holds if it does for some element; `contains` then asks the element's own list.
    """
    _, _, path, check, value = rule
    if "[*]" in path and mode == PUBLISHED:
        return F.lit(False)

    def holds(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        if check == "contains":
            listed = F.try_variant_get(v, "$", "array<string>")
            return kind.startswith("ARRAY") & F.array_contains(listed, F.lit(value).cast("string"))
        if check == "startswith":
            return (kind == "STRING") & F.try_variant_get(v, "$", "string").startswith(value)
        if check == "gte":
            number = kind.rlike("^(BIGINT|DOUBLE|DECIMAL)")
            return number & (F.try_variant_get(v, "$", "double") >= value)
        if isinstance(value, bool):
            return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == value)
        if isinstance(value, str):
            return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == value)
        return kind.rlike("^(BIGINT|DOUBLE|DECIMAL)") & (F.try_variant_get(v, "$", "double") == value)

    return F.coalesce(F.exists(path_values(block, path), holds), F.lit(False))


def document_levels(docs: DataFrame, collectors: Sequence[str] = ("http", "dns", "ssl", "files"),
                    rules: Iterable[Rule] = K.SEVERITY_RULES, mode: str = PUBLISHED,
                    document: str = "document", id_col: str = "alert_id") -> DataFrame:
    """id and a level per collector, decided anew from the documents by the rules of all levels in order."""
    rules = list(rules)
    found = blocks(docs, document, id_col).where(F.col("collector").isin(*collectors))
    # Rules are asked where the block stands; only the numbers of those that hold are shuffled.
    held = F.array_compact(F.array(*[
        F.when((F.col("collector") == rule[1]) & rule_holds(F.col("block"), rule, mode), F.lit(n))
        for n, rule in enumerate(rules)]).cast("array<int>"))
    out = found.select(id_col, "collector", held.alias("rules")).groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("collector", "rules"))).alias("held"))
    taken = []
    for level in K.SEVERITY_LEVELS:
        pick = F.when(F.lit(False), F.lit(None).cast("string"))
        for n, rule in enumerate(rules):
            if rule[0] == level and rule[1] in collectors:
                condition = F.coalesce(F.array_contains(F.col("held")[rule[1]], n), F.lit(False))
                for earlier in taken:
                    condition = condition & ~F.col(earlier).eqNullSafe(rule[1])
                pick = pick.when(condition, rule[1])
        taken.append(f"_{level}")
        out = out.withColumn(taken[-1], pick)
    named = {c: F.coalesce(*[F.when(F.col(t) == c, lv) for t, lv in zip(taken, K.SEVERITY_LEVELS, strict=True)],
                           F.lit(REFERENCE)) for c in collectors}
    return out.select(id_col, *[F.when(F.col("held")[c].isNotNull(), lv).alias(f"{c}_level")
                                for c, lv in named.items()])

"""Host names split by a table of public suffix rules: the longest rule wins, found by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertloom.functions.network import STRICT_V4, bare_host, text_before


def suffix_table(rules: DataFrame) -> DataFrame:
    """tail, size, exception: rules as the labels they end with, and how many labels a suffix has.

    `rules` has the text of a rule a row (column `rule`): `com.pl`, `*.ck` for every label before
    a tail, `!www.ck` for an exception, whose suffix is a label shorter. Comments are left out.
    """
    rule = F.lower(F.trim("rule"))
    kept = rules.select(rule.alias("rule")).where((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    tail = F.regexp_replace("rule", r"^(!|\*\.)", "")
    labels = F.size(F.split(tail, r"\."))
    more = F.when(F.col("rule").startswith("*."), 1).when(F.col("rule").startswith("!"), -1).otherwise(0)
    return kept.select(tail.alias("tail"), labels.alias("labels"), (labels + more).alias("size"),
                       F.col("rule").startswith("!").alias("exception")).distinct()


def with_domain_parts(rows: DataFrame, host: str, rules: DataFrame, name: str = "parts") -> DataFrame:
    """Adds a struct (subdomain, domain, suffix) of the host name in column `host`.

    Each distinct host asks with its last 1, 2, ... labels, no more than the longest rule has, so
    a hot host is split once and the rows of a join are bounded by hosts. Rules are some ten
    thousand, fixed by their list; Spark broadcasts them if it finds them small. A name without
    a listed ending and an IPv4 address have no suffix.
    """
    table = suffix_table(rules)
    deepest = table.agg(F.coalesce(F.max("labels"), F.lit(1))).first()[0]
    hosts = rows.select(F.col(host).alias("_host")).where(F.col("_host").isNotNull()).distinct()
    bare = hosts.withColumn("_bare", bare_host(F.col("_host")))
    count = F.size(F.split("_bare", r"\."))
    depths = F.sequence(F.lit(1), F.least(count, F.lit(deepest)))
    named = bare.where(~F.col("_bare").rlike(STRICT_V4)).withColumn("_count", count)
    tails = named.select("_host", "_count", F.explode(depths).alias("_depth"),
                         F.lower("_bare").alias("_low")).select(
        "_host", "_count", F.expr("substring_index(_low, '.', -_depth)").alias("tail"))
    fits = F.col("size") <= F.col("_count")
    best = F.max(F.struct("exception", "size"))
    sizes = tails.join(table, "tail").where(fits).groupBy("_host").agg(best["size"].alias("_size"))
    split = bare.join(sizes, "_host", "left").withColumn("_size", F.coalesce("_size", F.lit(0)))
    parts = split.select("_host", _parts(F.col("_bare")).alias(name))
    return rows.join(parts, rows[host] == F.col("_host"), "left").drop("_host")


def _parts(bare: Column) -> Column:
    suffix = F.expr("if(_size = 0, '', substring_index(_bare, '.', -_size))")
    rest = F.when(suffix == "", bare).otherwise(text_before(bare, suffix))
    domain = F.when(bare.rlike(STRICT_V4), bare).otherwise(F.substring_index(rest, ".", -1))
    return F.struct(text_before(rest, domain).alias("subdomain"), domain.alias("domain"),
                    suffix.alias("suffix"))

"""Constraints as queries: what a healthy catalog has no rows for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: each rule (a condition that must hold) that a row breaks; an unknown result breaks it too."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def orphans(references: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(name, child, column, parent, parent key) each -> relation, missing, n: references without a parent."""
    parts = []
    for name, child, column, parent, key in references:
        lost = child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")
        parts.append(lost.groupBy(F.col(column).cast("string").alias("missing")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "missing", "n"))
    return reduce(DataFrame.unionByName, parts)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once where they must not."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def exclusive(columns: list[str]) -> Column:
    """Exactly one of the columns is set."""
    return sum([F.col(c).isNotNull().cast("int") for c in columns[1:]], F.col(columns[0]).isNotNull().cast("int")) == 1

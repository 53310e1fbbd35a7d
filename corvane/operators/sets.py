"""Set operations and order-keeping deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import earliest


def distinct_first(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The first row of each key by position, with how many there were."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
    return earliest(rows, keys, [position]).join(counts, keys)


def preferred(choices: DataFrame, keys: list[str], mode: str, ranking: list[str], position: str) -> DataFrame:
    """One choice a key: the mode that comes first in ``ranking``, then the first by position."""
    place = F.array_position(F.array(*[F.lit(m) for m in ranking]), F.col(mode))
    ranked = choices.withColumn("place", F.when(place == 0, len(ranking) + 1).otherwise(place))
    return earliest(ranked, keys, ["place", position]).drop("place")


def only_value(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The keys with exactly one different value, and that value."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value)).filter("n = 1").drop("n")


def missing_columns(df: DataFrame, required: set[str]) -> list[str]:
    return sorted(required - set(df.columns))

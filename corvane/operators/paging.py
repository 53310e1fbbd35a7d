"""Pages and bounded lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keyset_page(rows: DataFrame, key: str, after=None, limit: int = 100) -> DataFrame:
    """The next ``limit`` rows by ascending key, with has_more and continuation (the last key, if there is more).

    The cut is a top-k of limit + 1 rows; the window runs over those only.
    """
    rest = rows if after is None else rows.filter(F.col(key) > after)
    head = rest.orderBy(key).limit(limit + 1)
    whole = Window.partitionBy()
    page = head.withColumn("nth", F.row_number().over(Window.orderBy(key))).withColumn("has_more", F.count(F.lit(1)).over(whole) > limit)
    page = page.filter(F.col("nth") <= limit)
    return page.withColumn("continuation", F.when(F.col("has_more"), F.max(key).over(whole))).drop("nth")


def newest_first(rows: DataFrame, key: str, limit: int) -> DataFrame:
    return rows.orderBy(F.col(key).desc()).limit(limit)


def bounded_lists(rows: DataFrame, keys: list[str], order: list, item: list[str], cap: int = 100) -> DataFrame:
    """For each key its first ``cap`` items, a count that stops at cap + 1, and whether more were left out.

    Only the first cap + 1 rows of a key are gathered; the rank limit applies before the shuffle.
    """
    nth = Window.partitionBy(*keys).orderBy(*order)
    head = rows.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= cap + 1)
    listed = head.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("nth", *item))).alias("all"))
    items = F.transform(F.slice("all", 1, cap), lambda x: F.struct(*[x[c].alias(c) for c in item]))
    return listed.select(*keys, items.alias("items"), F.size("all").alias("count"), (F.size("all") > cap).alias("truncated"))


def ranked(rows: DataFrame, keys: list[str], order: list, name: str = "nth") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def at_most(rows: DataFrame, limit: int, what: str) -> DataFrame:
    """rows, unless there are more than ``limit``: then the query fails rather than drop any."""
    n = rows.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows

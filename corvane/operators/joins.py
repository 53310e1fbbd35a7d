"""Join shapes of the catalog."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import latest


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys])


def left_latest(left: DataFrame, log: DataFrame, keys: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """left, with columns of the newest log row of its key (null without one)."""
    return left.join(latest(log, keys, order).select(*keys, *carry), keys, "left")


def existing(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(others.select(*keys), keys, "left_semi")


def lacking(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(others.select(*keys), keys, "left_anti")


def unordered(a: str, b: str) -> list[Column]:
    """Key columns under which (a, b) and (b, a) are one pair; null if either is null."""
    known = F.col(a).isNotNull() & F.col(b).isNotNull()
    return [F.when(known, F.least(a, b)).alias("low"), F.when(known, F.greatest(a, b)).alias("high")]


def compared_claims(declared: DataFrame, found: DataFrame, key: str, claims: list[str]) -> DataFrame:
    """key, claim, declared, found, outcome: each declared fact against the inspected one.

    matched or mismatched where both are known, else not_comparable.
    """
    wide = declared.select(key, *[F.col(c).cast("string").alias(f"d_{c}") for c in claims]).join(
        found.select(key, *[F.col(c).cast("string").alias(f"f_{c}") for c in claims]), key, "left"
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("claim"), F.col(f"d_{c}").alias("declared"), F.col(f"f_{c}").alias("found")) for c in claims])
    long = wide.select(key, F.inline(pairs))
    outcome = F.when(F.col("declared").isNull() | F.col("found").isNull(), "not_comparable").when(F.lower("declared") == F.lower("found"), "matched").otherwise("mismatched")
    return long.withColumn("outcome", outcome)


def reconciled(listed: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """key, status: what the catalog lists (key, digest, size) against what is there (key, digest, size)."""
    a = listed.select(key, F.col("digest").alias("want"), F.col("size").alias("want_size"))
    b = files.select(key, F.col("digest").alias("got"), F.col("size").alias("got_size"))
    both = a.join(b, key, "full")
    status = (
        F.when(F.col("got").isNull(), "missing")
        .when(F.col("want").isNull(), "orphan")
        .when((F.lower("want") == F.lower("got")) & (F.col("want_size") == F.col("got_size")), "valid")
        .otherwise("corrupt")
    )
    return both.select(key, status.alias("status"))

"""Current state from append-only logs.

Every current row is a fold of its log.  The folds here are aggregates, which
combine on the map side, so a key with any number of observations costs one
partial row per task; arrival order plays no part except through ``order``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The whole newest row of each key; of equal ``order`` values any one, so end it with a tie-break."""
    rest = [c for c in log.columns if c not in keys]
    picked = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), _order(order)).alias("row"))
    return picked.select(*keys, *[F.col("row")[c].alias(c) for c in rest]).select(*log.columns)


def earliest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The whole oldest row of each key."""
    rest = [c for c in log.columns if c not in keys]
    picked = log.groupBy(*keys).agg(F.min_by(F.struct(*rest), _order(order)).alias("row"))
    return picked.select(*keys, *[F.col("row")[c].alias(c) for c in rest]).select(*log.columns)


def newest_known(column: str, order: list[str]) -> Column:
    """The newest value that isn't null."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), _order(order))).alias(column)


def first_known(column: str, order: list[str]) -> Column:
    """The oldest value that isn't null: set once, kept afterwards."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), _order(order))).alias(column)


def newest(column: str, order: list[str]) -> Column:
    """The value of the newest row, null or not."""
    return F.max_by(F.struct(F.col(column).alias("v")), _order(order))["v"].alias(column)


RULES = {"newest": newest, "newest_known": newest_known, "first_known": first_known}


def projection(log: DataFrame, keys: list[str], order: list[str], rules: dict[str, str], seen: str | None = None) -> DataFrame:
    """One row a key, each column by its rule; with ``seen``, first_seen and last_seen of that column too."""
    own = [RULES[rule](column, order) for column, rule in rules.items()]
    span = [F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen")] if seen else []
    return log.groupBy(*keys).agg(*own, *span)


def snapshots(log: DataFrame, keys: list[str], content: list[str], order: list[str]) -> DataFrame:
    """The distinct contents of each key, each as first observed, with its digest."""
    digested = log.withColumn("digest", F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256))
    return earliest(digested, [*keys, "digest"], order)


def merged_assets(log: DataFrame) -> DataFrame:
    """Assets by sha256 from assertions (sha256, seq, storage, mime, size, managed).

    Once an asset is managed, only managed assertions write its storage and size;
    among assertions that may write, the last wins, and a size once known is not
    lost to a null.  The detected type is the last known one, whoever asserts it.
    """
    log = log.withColumn("sha256", F.lower("sha256"))
    since = log.filter("managed").groupBy("sha256").agg(F.min("seq").alias("since"))
    log = log.join(since, "sha256", "left")
    writes = F.col("managed") | F.col("since").isNull() | (F.col("seq") < F.col("since"))
    rank = F.struct(F.col("managed").cast("int"), F.col("seq"))
    return log.groupBy("sha256").agg(
        F.max_by("storage", rank).alias("storage"),
        F.max("managed").alias("managed"),
        F.max_by("mime", F.when(F.col("mime").isNotNull(), F.col("seq"))).alias("mime"),
        F.max_by("size", F.when(F.col("size").isNotNull() & writes, F.col("seq"))).alias("size"),
        F.count(F.lit(1)).alias("assertions"),
    )


def key_conflicts(log: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """Keys that were claimed for more than one owner."""
    return log.groupBy(*keys).agg(F.count_distinct(owner).alias("owners")).filter("owners > 1")


def unseen(batch: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch that aren't held yet, each once; nulls in keys are equal to each other."""
    same = None
    for key in keys:
        term = batch[key].eqNullSafe(held[key])
        same = term if same is None else same & term
    return batch.join(held.select(*keys), same, "left_anti").dropDuplicates(keys)

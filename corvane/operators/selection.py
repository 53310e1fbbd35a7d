"""Choosing rows: filters over allow-lists, states of work, paths, digests."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(rows: DataFrame, allowed: tuple[str, ...], **wanted) -> DataFrame:
    """Equality filters over an allow-list of columns, all of which must hold; a wanted value of None is no filter."""
    if extra := set(wanted) - set(allowed):
        raise ValueError(f"unknown filters: {sorted(extra)}")
    held = [F.col(c) == v for c, v in wanted.items() if v is not None]
    return rows.filter(reduce(and_, held)) if held else rows


def retryable(rows: DataFrame, state: str, states: tuple[str, ...], attempts: str, limit: float) -> DataFrame:
    """Work in one of the states that has had fewer attempts than the limit."""
    return rows.filter(F.col(state).isin(*states) & (F.col(attempts) < limit))


def other_than(rows: DataFrame, state: str, states: tuple[str, ...]) -> DataFrame:
    """Rows in none of the states; a null state is none of them."""
    return rows.filter(~F.coalesce(F.col(state).isin(*states), F.lit(False)))


def candidates(kinds: dict[str, DataFrame], least: float) -> DataFrame:
    """kind, id, score of all kinds of candidates (id, score) above a score."""
    parts = [df.select(F.lit(kind).alias("kind"), "id", "score") for kind, df in kinds.items()]
    return reduce(DataFrame.unionByName, parts).filter(F.col("score") > least)


def aliased(rows: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """Rows whose key is among the names (one column), once however often it is listed."""
    return rows.join(names.toDF(key), key, "left_semi")


def pending(rows: DataFrame, state: str, states: tuple[str, ...], native_id: str, limit: int) -> DataFrame:
    """The first rows in one of the states, by their native id as a number; ids that are no numbers come last."""
    return rows.filter(F.col(state).isin(*states)).orderBy(F.expr(f"try_cast(`{native_id}` AS bigint)").asc_nulls_last(), native_id).limit(limit)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)


def below(path: Column, root: str) -> Column:
    """The path is the root or lies below it; /en is not above /english."""
    return (path == root) | path.startswith(root.rstrip("/") + "/")


def by_digest_or_id(rows: DataFrame, digest: str, digests: DataFrame, key: str, ids: tuple) -> DataFrame:
    """Rows with one of the digests (one column, in either case) or one of the ids, each once."""
    wanted = digests.select(F.lower(F.col(digests.columns[0])).alias("_wanted")).distinct()
    j = rows.join(wanted, F.lower(digest) == F.col("_wanted"), "left")
    return j.filter(F.col("_wanted").isNotNull() | F.col(key).isin(*ids)).drop("_wanted")


def nested(rows: DataFrame, key: str, children: DataFrame, child_key: str, order: str, columns: list[str], name: str) -> DataFrame:
    """rows with their children as an array of structs, in order; empty without children."""
    kids = children.groupBy(F.col(child_key).alias(key)).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias(name))
    return rows.join(kids, key, "left").withColumn(name, F.coalesce(name, F.expr(f"CAST(array() AS {kids.schema[name].dataType.simpleString()})")))


def public(rows: DataFrame, shown: dict[str, Column], secrets: tuple[str, ...] = ()) -> DataFrame:
    """Only the shown columns, none of which may bear a secret's name."""
    if held := set(shown) & set(secrets):
        raise ValueError(f"not to be shown: {sorted(held)}")
    return rows.select(*[c.alias(name) for name, c in shown.items()])

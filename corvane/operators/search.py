"""Searching texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def holds(text: Column, query: str) -> Column:
    """Substring match without regard to ASCII case; %, _ and \\ mean themselves."""
    return ascii_lower(text).contains(query.translate(str.maketrans(_UPPER, _LOWER)))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def phrase(text: Column, query: str) -> Column:
    """The query's tokens occur next to each other and in order.  Blanks between tokens make it a substring test."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.array_join(tokens(F.lit(query)), " "), F.lit(" ")))


def inverted_index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """token, key, places: where each token occurs, one row a token and text."""
    listed = rows.select(key, F.posexplode(tokens(F.col(text))).alias("place", "token"))
    return listed.groupBy("token", key).agg(F.sort_array(F.collect_list("place")).alias("places"))

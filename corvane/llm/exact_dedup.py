"""Exact deduplication on normalised text, safe against hot groups.

Three combining steps, each of which groups by digest *and* full content, so
two different texts never fall together:

1. each task combines its own copies (map-side aggregation),
2. partial groups meet by (digest, salt), so a group of any size is spread
   over ``salts`` reducers,
3. the at most ``salts`` winners of each content meet globally.

Only DataFrame functions are used.  Text is shuffled twice; the decision goes
back to the rows over a join on digest and a second hash, salted for groups
that hold a thousandth of all rows or more (there are a thousand at most, so
their list may be broadcast).  Should two contents share both hashes, the job
stops with an error instead of merging them.

Defined results: null text counts as empty; empty texts are equal to each
other; a null doc_id loses every tie and is reported as null; rows repeating a
doc_id are rows of their own and share the decision when they tie, though of
these ``drop_exact_duplicates`` returns a single one; an empty table gives an
empty result; further columns, whatever their names, are carried through
``drop_exact_duplicates`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_hash, staged

#: Deleted before texts are compared: [\x20\x09-\x0D].
DELETED = " \t\n\x0b\x0c\r"
#: Orders (code points descending, doc_id ascending, null doc_id last) as one number that hash aggregation can hold.
_STEP = 2**65
#: Groups with at least a HOT-th of all rows are spread over SPREAD salts when decisions go back to rows.
HOT, SPREAD = 1000, 64
_TOP = 2**63


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), DELETED, "")


def sha256(clean: Column) -> Column:
    return F.unhex(F.sha2(clean, 256))


def _decimal(value: int, digits: int = 20) -> Column:
    return F.lit(str(value)).cast(f"decimal({digits},0)")


def _standing(doc_id: Column, points: Column) -> Column:
    turned = F.coalesce(_decimal(_TOP) - doc_id.cast("decimal(20,0)"), _decimal(0))
    return (points.cast("decimal(10,0)") * _decimal(_STEP) + turned).cast("decimal(32,0)")


def _winner(standing: Column) -> Column:
    turned = standing % _decimal(_STEP)
    return F.when(turned > 0, (_decimal(_TOP) - turned).cast("long"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=sha256) -> DataFrame:
    """One row per different content: digest, check, standing of the row that stays, group_size."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select(normalised(F.col("text")).alias("clean"), _standing(F.col("id"), F.char_length(F.coalesce("text", F.lit("")))).alias("standing"))
    rows = rows.select(digest(F.col("clean")).alias("digest"), "clean", "standing", (F.spark_partition_id() % F.lit(salts)).alias("salt"))
    salted = rows.groupBy("digest", "salt", "clean").agg(F.max("standing").alias("standing"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "clean").agg(F.max("standing").alias("standing"), F.sum("n").alias("n"))
    small = merged.select("digest", F.xxhash64("clean").alias("check"), "standing", "n")
    one = small.groupBy("digest", "check").agg(F.max("standing").alias("standing"), F.max("n").alias("group_size"), F.count(F.lit(1)).alias("contents"))
    clash = F.raise_error(F.lit("two different texts share both digests")).cast("long")
    return one.select("digest", "check", "standing", F.when(F.col("contents") == 1, F.col("group_size")).otherwise(clash).alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=sha256, carry: bool = False) -> DataFrame:
    """Every row's decision: doc_id, keep_id, group_size, kept, digest; with ``carry`` the whole input row as ``row`` too, and check and salt, which tied rows share."""
    groups = staged(exact_groups(docs, id_col, text_col, salts, digest), "groups")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    # at most HOT groups can hold a HOT-th of all rows each; their rows and winners meet on SPREAD salts
    hot = groups.filter((F.col("group_size") * HOT >= total) & (F.col("group_size") > 1)).select("digest", "check", F.lit(SPREAD).alias("spread"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    rows = rows.withColumn("clean", normalised(F.col("text")))
    rows = rows.select(
        "doc_id",
        digest(F.col("clean")).alias("digest"),
        F.xxhash64("clean").alias("check"),
        _standing(F.col("doc_id"), F.char_length(F.coalesce("text", F.lit("")))).alias("own"),
        *(["row"] if carry else []),
    )
    rows = rows.join(F.broadcast(hot), ["digest", "check"], "left")
    rows = rows.withColumn("salt", F.when(F.col("spread").isNotNull(), F.pmod(F.xxhash64("doc_id", "own"), F.lit(SPREAD))).otherwise(F.lit(0)).cast("int")).drop("spread")
    groups = groups.join(F.broadcast(hot), ["digest", "check"], "left")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("spread", F.lit(1)) - 1))).drop("spread")
    out = rows.join(groups, ["digest", "check", "salt"])
    return out.select("doc_id", _winner(F.col("standing")).alias("keep_id"), "group_size", (F.col("own") == F.col("standing")).alias("kept"), "digest", *(["row", "check", "salt"] if carry else []))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows that stay, one of each content, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col, salts, carry=True).filter("kept")
    # rows that tie agree in doc_id and length, so they lie on one salt, where the join has left them
    tie = F.when(F.col("group_size") > 1, row_hash())
    return kept.groupBy("digest", "check", "salt").agg(F.min_by("row", F.coalesce(tie, F.lit(0))).alias("row")).select("row.*")


# -- registered query -----------------------------------------------------------


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS clean FROM documents
), r AS (
  SELECT doc_id,
         first_value(doc_id) OVER (PARTITION BY clean ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY clean) AS group_size,
         sha256(clean) AS text_sha256
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""

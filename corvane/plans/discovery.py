"""Match candidates from links, their evidence, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import digest
from ..functions.scores import strength_score
from ..operators.joins import unordered


def link_candidates(links: DataFrame) -> DataFrame:
    """links (subject_kind, subject_id, object_kind, identifier_kind, target_id, link_id) -> candidates.

    An account that links a stable account may be the same person; a post that links a
    post may be sourced from it.  Handles aren't stable, and nothing matches itself.
    """
    relation = F.when((F.col("subject_kind") == "account") & (F.col("object_kind") == "account"), "same_identity").when((F.col("subject_kind") == "post") & (F.col("object_kind") == "post"), "sourced_from")
    c = links.withColumn("relation", relation).filter("relation IS NOT NULL AND identifier_kind = 'stable_id'")
    c = c.filter(~F.col("subject_id").eqNullSafe(F.col("target_id")))
    g = c.groupBy("relation", "subject_id", "target_id").agg(F.count_distinct("link_id").alias("evidence"))
    return g.withColumn("candidate_key", digest(F.col("relation"), F.col("subject_id"), F.col("target_id")))


def scored(candidates: DataFrame, evidence: DataFrame, key: str, all_stances: bool = False) -> DataFrame:
    """candidates with score (supporting strength) and generation (supporting evidence, or all of it)."""
    supports = F.col("stance") == "supports"
    count = F.count(F.lit(1)) if all_stances else F.count_if(supports)
    sums = evidence.groupBy(key).agg(F.sum(F.when(supports, strength_score(F.col("strength"))).otherwise(0)).cast("long").alias("score"), count.alias("generation"))
    return candidates.join(sums, key, "left").withColumn("score", F.coalesce("score", F.lit(0))).withColumn("generation", F.coalesce("generation", F.lit(0)))


def merged_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, relation, evidence) -> one row an unordered pair, both sides of it known; sourced_from outranks same_work."""
    u = pairs.select("relation", "evidence", *unordered("a", "b")).filter("low IS NOT NULL")
    rank = F.when(F.col("relation") == "sourced_from", 1).otherwise(0)
    return u.groupBy("low", "high").agg(F.max_by("relation", rank).alias("relation"), F.sum("evidence").alias("evidence"))


def reviewed(candidates: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """candidates with state (of the last accepted decision) and revision (the number of accepted decisions).

    decisions: key, seq, revision (expected, or null), state.  Taken in order of seq, a decision is accepted
    if it expects nothing or the revision it finds; one with another expectation is stale and changes nothing.
    A candidate's decisions are few (people make them), so they are folded as one array.
    """
    sets = decisions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", F.col("revision").cast("long").alias("revision"), "state"))).alias("ds"))
    start = F.struct(F.lit(0).cast("long").alias("revision"), F.lit("pending").alias("state"))
    step = lambda a, x: F.when(F.coalesce(x["revision"], a["revision"]) == a["revision"], F.struct((a["revision"] + 1).alias("revision"), x["state"].alias("state"))).otherwise(a)
    folded = sets.select(key, F.aggregate("ds", start, step).alias("f"))
    j = candidates.join(folded, key, "left")
    return j.select(*candidates.columns, F.coalesce("f.state", F.lit("pending")).alias("state"), F.coalesce("f.revision", F.lit(0)).alias("revision"))


def confirmed_edges(candidates: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """a, b of candidates whose last decision is confirmed."""
    last = decisions.groupBy(key).agg(F.max_by("state", "seq").alias("state")).filter("state = 'confirmed'")
    return candidates.join(last, key, "left_semi").select("a", "b")

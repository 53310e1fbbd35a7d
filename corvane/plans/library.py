"""Library expansion: which artist or account to follow from a seed, and how much to expect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import latest
from ..operators.sets import preferred

#: How a choice came about, best first (fixed values).
MODES = ["confirmed", "explicit", "authored", "referenced"]


def choices(*offers: DataFrame) -> DataFrame:
    """offers (seed, kind, id, mode, position) -> one row a (seed, kind, id), by the best mode, then by position."""
    every = offers[0]
    for more in offers[1:]:
        every = every.unionByName(more)
    return preferred(every, ["seed", "kind", "id"], "mode", MODES, "position")


def selected(chosen: DataFrame) -> DataFrame:
    """seed, kind, id, outcome: the choice, if there is exactly one; else ambiguous, without ids."""
    g = chosen.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("kind", "id")).alias("x"))
    one = F.col("n") == 1
    return g.select("seed", F.when(one, F.col("x.kind")).alias("kind"), F.when(one, F.col("x.id")).alias("id"), F.when(one, "selected").otherwise("ambiguous").alias("outcome"))


def alias_state(aliases: DataFrame) -> DataFrame:
    """aliases (alias_id, antecedent, consequent, status, observed_at, id) -> name, aliased: is the name's tag now an active alias of another?

    The newest observation of each alias is taken before names are looked at.
    """
    now = latest(aliases, ["alias_id"], ["observed_at", "id"])
    names = now.select(F.explode(F.array(F.struct(F.col("antecedent").alias("name"), (F.col("status") == "active").alias("aliased")), F.struct(F.col("consequent").alias("name"), F.lit(False).alias("aliased")))).alias("x"))
    return names.groupBy("x.name").agg(F.bool_or("x.aliased").alias("aliased"))


def estimate(targets: DataFrame, tags: DataFrame, probes: DataFrame) -> DataFrame:
    """targets (target, name) -> target, count, provenance: the tag's retained count if it has no alias, else the last probe's, else unknown.

    tags: name, post_count, aliased; probes: target, outcome, count, seq.
    """
    probed = probes.filter("outcome = 'success'").groupBy("target").agg(F.max_by("count", "seq").alias("probed"))
    j = targets.join(tags, "name", "left").join(probed, "target", "left")
    kept = F.col("post_count").isNotNull() & ~F.coalesce("aliased", F.lit(False))
    return j.select("target", F.when(kept, F.col("post_count")).otherwise(F.col("probed")).alias("count"), F.when(kept, "retained_tag").when(F.col("probed").isNotNull(), "probe").otherwise("unknown").alias("provenance"))


def rendered_targets(targets: DataFrame, accounts: DataFrame, names: DataFrame, tags: DataFrame) -> DataFrame:
    """targets (target, kind, id) -> target, rendered: an account's native id, an artist's current tag name, else its latest primary name.

    accounts (id, native_id); names (id, name, observed_at, seq), primary ones; tags (id, name).
    """
    latest_name = names.groupBy("id").agg(F.max_by("name", F.struct("observed_at", "seq")).alias("primary"))
    j = targets.join(accounts.select("id", "native_id"), "id", "left").join(latest_name, "id", "left").join(tags.select("id", F.col("name").alias("tag")), "id", "left")
    return j.select("target", F.when(F.col("kind") == "account", F.col("native_id")).otherwise(F.coalesce("tag", "primary")).alias("rendered"))


def drifted(projections: DataFrame, observations: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """Keys whose current row isn't what their newest observation says."""
    now = latest(observations, [key], order).select(key, F.struct(*columns).alias("seen"))
    held = projections.select(key, F.struct(*columns).alias("held"))
    return held.join(now, key, "left").filter(~F.col("held").eqNullSafe(F.col("seen"))).select(key)

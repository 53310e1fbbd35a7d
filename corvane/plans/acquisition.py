"""Acquisition: eligibility, assets that already satisfy an item, stale plans, decisions, run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsons import digest, with_variants
from ..functions.stages import settled

#: Variants that a provider with explicit roles knows (fixed values).
E621_VARIANTS = ("original", "sample", "preview")


def planned(selections: DataFrame, occurrences: DataFrame, supported: list[str]) -> DataFrame:
    """selections (occurrence_id, variant) -> occurrence_id, variant, url, original, reason, material.

    occurrences: occurrence_id, platform, availability, remote_url, preview_url, variants_json, sha256, md5.
    The first reason that holds decides; a null reason means that the item may be fetched.
    Declared digests enter the material of originals only.
    """
    o = with_variants(occurrences).withColumn("there", F.lit(True))
    j = selections.join(o, "occurrence_id", "left")
    url = F.element_at(F.col("variants.urls"), F.col("variant"))
    j = j.withColumn("url", F.when(F.col("there"), url))
    reason = (
        F.when(F.col("there").isNull(), "missing_occurrence")
        .when(~F.col("platform").isin(*supported), "unsupported_provider")
        .when(~F.col("availability").eqNullSafe("available"), "unavailable_occurrence")
        .when(F.col("variants.error").isNotNull(), F.col("variants.error"))
        .when((F.col("platform") == "e621") & ~F.col("variant").isin(*E621_VARIANTS), "unsupported_variant")
        .when(F.col("url").isNull(), "missing_variant")
    )
    original = F.coalesce((F.col("url") == F.col("remote_url")) & F.col("variant").isin("primary", "original"), F.lit(False))
    j = j.withColumn("reason", reason).withColumn("original", original)
    claim = lambda c: F.when(F.col("original"), F.lower(c))
    j = settled(j, ["occurrence_id", "variant", "url", "original", "reason"], {"sha256": claim("sha256"), "md5": claim("md5")})
    return j.withColumn("material", digest(F.col("occurrence_id"), F.col("variant"), F.col("url"), F.col("sha256"), F.col("md5"), F.col("reason")))


def _by_digest(items: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """items with what assets know of their digest.  Most items have none: those don't go to the one task of a null key."""
    spread = F.coalesce(key, F.concat(F.lit("none:"), F.xxhash64("occurrence_id", "variant").cast("string")))
    known = assets.withColumnRenamed(key, "_digest")
    return items.join(known, spread == known["_digest"], "left").drop("_digest")


def satisfied(items: DataFrame, completed: DataFrame, assets: DataFrame) -> DataFrame:
    """items with asset_id: that of an earlier completed item, else by sha256, else by md5 (originals only), else null.

    completed: occurrence_id, variant, asset_id, seq; assets: asset_id, sha256, md5.
    """
    done = completed.groupBy("occurrence_id", "variant").agg(F.max_by("asset_id", "seq").alias("by_item"))
    sha = assets.filter("sha256 IS NOT NULL").groupBy(F.lower("sha256").alias("sha256")).agg(F.min("asset_id").alias("by_sha"))
    md5 = assets.filter("md5 IS NOT NULL").groupBy(F.lower("md5").alias("md5")).agg(F.min("asset_id").alias("by_md5"))
    j = _by_digest(_by_digest(items.join(done, ["occurrence_id", "variant"], "left"), sha, "sha256"), md5, "md5")
    return j.withColumn("asset_id", F.coalesce("by_item", F.when(F.col("original"), F.coalesce("by_sha", "by_md5")))).drop("by_item", "by_sha", "by_md5")


def eligibility() -> Column:
    """Of a planned item with its asset: already_satisfied, excluded or eligible."""
    return F.when(F.col("reason").isNotNull(), "excluded").when(F.col("asset_id").isNotNull(), "already_satisfied").otherwise("eligible")


def stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """occurrence_id, variant, stale: is the stored material another than now?  Items that are gone are stale."""
    now = current.select("occurrence_id", "variant", F.col("material").alias("now"))
    return stored.join(now, ["occurrence_id", "variant"], "left").select("occurrence_id", "variant", (~F.col("material").eqNullSafe(F.col("now"))).alias("stale"))


def decided(items: DataFrame, run: list[str], order: str, size: str, budget: int) -> DataFrame:
    """items with ``decision``, in the order of the loop: satisfied, excluded, stale, over budget, fetch.

    The byte budget counts what the run's earlier fetches would take.
    """
    first = F.when(F.col("asset_id").isNotNull(), "already_satisfied").when(F.col("reason").isNotNull(), "excluded").when(F.col("stale"), "stale")
    d = items.withColumn("first", first)
    before = Window.partitionBy(*run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.when(F.col("first").isNull(), F.col(size)).otherwise(0)).over(before), F.lit(0))
    return d.withColumn("spent", spent).withColumn("decision", F.coalesce("first", F.when(F.col("spent") + F.col(size) > budget, "deferred").otherwise("fetch"))).drop("first", "spent")


def run_status(items: DataFrame, run: list[str], state: str = "state", outcome: str = "outcome") -> DataFrame:
    """run keys, status, result from the states (completed, failed, deferred) and outcomes of a run's items."""
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = items.groupBy(*run).agg(
        has(F.col(state) == "completed").alias("done"),
        has(F.col(state) == "failed").alias("failed"),
        has(F.col(state) == "deferred").alias("deferred"),
        *[has(F.col(outcome) == o).alias(f"o_{o}") for o in ("stale", "quarantined", "budget_exhausted")],
    )
    whole = ~F.col("failed") & ~F.col("deferred")
    status = F.when(whole, "complete").when(F.col("done"), "partial").when(~F.col("failed"), "partial").otherwise("failed")
    worst = F.when(F.col("o_stale"), "stale").when(F.col("o_quarantined"), "quarantined").when(F.col("o_budget_exhausted"), "budget_exhausted").otherwise("failed")
    result = F.when(whole, "success").when(F.col("done"), "partial").when(~F.col("failed"), "interrupted").otherwise(worst)
    return g.select(*run, status.alias("status"), result.alias("result"))


# Fixed values.
TERMINAL_STATES = {"success": "completed", "already_satisfied": "completed", "not_modified": "completed", "rate_limited": "deferred", "budget_exhausted": "deferred", "interrupted": "interrupted"}


def terminal_state(outcome: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TERMINAL_STATES.items() for x in pair])
    return F.coalesce(F.element_at(known, outcome), F.lit("failed"))


def recipes(items: DataFrame, hosts: dict[str, tuple[str, ...]]) -> DataFrame:
    """items (platform, variant, url) with operation, allowed (its host is the provider's) and identity, a digest that shows no URL."""
    from ..functions.urls import allowed_destination

    allowed = F.lit(False)
    for platform, names in hosts.items():
        allowed = F.when(F.col("platform") == platform, allowed_destination(F.col("url"), names)).otherwise(allowed)
    operation = F.when(F.col("variant").isin("primary", "original"), "media_original").when(F.col("variant") == "preview", "media_preview").otherwise("media_variant")
    return items.withColumn("operation", operation).withColumn("allowed", allowed).withColumn("identity", digest(F.col("platform"), F.col("operation"), F.sha2("url", 256)))


#: States that may follow a state (fixed values); what has ended stays as it is.
FOLLOWS = {"planned": ("running", "excluded"), "running": ("completed", "failed", "interrupted", "deferred"), "interrupted": ("running",), "deferred": ("running",)}


def bad_steps(log: DataFrame, keys: list[str], order: str, state: str = "state") -> DataFrame:
    """Steps of a state log that its machine doesn't allow: keys, order, before, state."""
    w = Window.partitionBy(*keys).orderBy(order)
    steps = log.withColumn("before", F.lag(state).over(w)).filter("before IS NOT NULL")
    fine = F.lit(False)
    for a, after in FOLLOWS.items():
        fine = fine | ((F.col("before") == a) & F.col(state).isin(*after))
    return steps.filter(~fine).select(*keys, order, "before", state)

"""Execution records: item states and run results from attempt logs, retries, publication, replanning, count probes, request streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsons import digest
from ..operators.joins import compared_claims

# Fixed values.
DONE = ("complete", "satisfied")
DELAYED = ("interrupted", "deferred")


def item_states(items: DataFrame, attempts: DataFrame, publications: DataFrame, budget: int) -> DataFrame:
    """run, item, state, outcome, retryable, attempts, received, quarantined, recovered.

    items: run, item, position, asset_id, reason, current (boolean; null counts as false); attempts: run, item, attempt,
    state, outcome, retryable, received; publications: run, item, published, quarantined (one row an item).
    Items are judged in the order of the loop: satisfied, excluded, over the run's byte budget (what earlier items
    received), stale, then what their last attempt came to.  An attempt that still runs was cut short.  An item that
    no attempt has reached and nothing excludes is pending.  A run's items lie in one window: plans bound their number.
    """
    keys = ["run", "item"]
    last = attempts.groupBy(*keys).agg(
        F.max_by(F.struct("state", "outcome", "retryable"), "attempt").alias("last"),
        F.count(F.lit(1)).alias("attempts"),
        F.coalesce(F.sum("received"), F.lit(0)).alias("received"),
    )
    j = items.join(last, keys, "left").join(publications, keys, "left").fillna(0, ["attempts", "received", "quarantined"])
    before = Window.partitionBy("run").orderBy("position", "item").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("received").over(before), F.lit(0))
    untried = F.col("attempts") == 0
    cut = F.col("last.state") == "running"
    ended = F.col("last.outcome")
    steps = [
        (F.col("asset_id").isNotNull(), "satisfied", F.lit("already_satisfied")),
        (F.col("reason").isNotNull(), "failed", F.col("reason")),
        (untried & (spent >= budget), "deferred", F.lit("budget_exhausted")),
        (untried & ~F.coalesce("current", F.lit(False)), "stale", F.lit("stale_target")),
        (untried, "pending", F.lit(None).cast("string")),
        (cut, "interrupted", F.lit("interrupted")),
        (F.col("published") == "hash_mismatch", "quarantined", F.col("published")),
        (F.col("published").isNotNull(), "complete", F.col("published")),
        (ended == "hash_mismatch", "quarantined", ended),
        (ended == "stale_target", "stale", ended),
        (F.col("last.state") == "interrupted", "interrupted", ended),
    ]
    state, outcome = F.lit("failed"), ended
    for when, a, b in reversed(steps):
        state, outcome = F.when(when, a).otherwise(state), F.when(when, b).otherwise(outcome)
    j = j.select(*keys, state.alias("state"), outcome.alias("outcome"), F.coalesce("last.retryable", F.lit(False)).alias("again"), "attempts", "received", "quarantined", F.coalesce(cut, F.lit(False)).alias("cut"))
    open_ended = F.col("cut") & (F.col("state") == "interrupted")
    retryable = F.when(open_ended | (F.col("outcome") == "budget_exhausted"), True).when(F.col("state").isin("failed", *DELAYED), F.col("again")).otherwise(False)
    return j.select(*keys, "state", "outcome", retryable.alias("retryable"), "attempts", "received", "quarantined", open_ended.alias("recovered"))


def run_results(states: DataFrame) -> DataFrame:
    """run, status, outcome, completed, failed, deferred, received, quarantined of a run's item states.

    A run with pending items runs on; one with an attempt cut short ends as interrupted.
    """
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    pending = F.col("state") == "pending"
    g = states.groupBy("run").agg(
        n(F.col("state").isin(*DONE)).alias("completed"),
        n(~F.col("state").isin(*DONE, *DELAYED) & ~pending).alias("failed"),
        n(F.col("state").isin(*DELAYED)).alias("deferred"),
        n(pending).alias("pending"),
        n(F.col("recovered")).alias("recovered"),
        F.sum("received").alias("received"),
        F.sum("quarantined").alias("quarantined"),
        *[n(F.col("outcome") == o).alias(o) for o in ("stale_target", "hash_mismatch", "budget_exhausted")],
    )
    some = F.col("completed") > 0
    steps = [
        ((F.col("recovered") > 0) & (some | (F.col("deferred") > 0)), "partial", "interrupted"),
        (F.col("pending") > 0, "running", None),
        ((F.col("failed") == 0) & (F.col("deferred") == 0), "complete", "success"),
        (some, "partial", "partial"),
        ((F.col("deferred") > 0) & (F.col("failed") == 0), "partial", "interrupted"),
        (F.col("stale_target") > 0, "failed", "stale"),
        (F.col("hash_mismatch") > 0, "failed", "quarantined"),
        (F.col("budget_exhausted") > 0, "failed", "budget_exhausted"),
    ]
    status, outcome = F.lit("failed"), F.lit("failed")
    for when, a, b in reversed(steps):
        status, outcome = F.when(when, a).otherwise(status), F.when(when, F.lit(b)).otherwise(outcome)
    return g.select("run", status.alias("status"), outcome.alias("outcome"), "completed", "failed", "deferred", "received", "quarantined")


def retries(states: DataFrame, every: bool = False) -> DataFrame:
    """Items that a retry takes up: the retryable ones that failed or wait, or every one that isn't done."""
    if every:
        return states.filter(~F.col("state").isin(*DONE))
    return states.filter(F.col("retryable") & F.col("state").isin("failed", *DELAYED))


def publications(items: DataFrame, inspected: DataFrame, most_quarantined: int) -> dict[str, DataFrame]:
    """items (item, sha256, md5, size, mime: declared) and inspected (the same, found, with phash, exact_only) -> claims, results, fingerprints.

    Only a digest that differs keeps a file out: it is quarantined, and counts no bytes if it is larger than may be
    kept.  Other claims are recorded.  What is published has its digests as verified fingerprints.  One row an item.
    """
    claims = compared_claims(items, inspected, "item", ["sha256", "md5", "size", "mime"])
    bad = claims.filter(F.col("claim").isin("sha256", "md5") & (F.col("outcome") == "mismatched")).select("item").distinct().withColumn("bad", F.lit(True))
    j = inspected.join(items.select("item"), "item", "left_semi").join(bad, "item", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    published = F.when(F.col("bad"), "hash_mismatch").when(F.col("exact_only"), "downloaded_exact_only").otherwise("downloaded")
    kept = F.when(F.col("bad") & (F.col("size") <= most_quarantined), F.col("size")).otherwise(0).cast("long")
    prints = F.array(
        *[F.struct(F.lit(k).alias("algorithm"), F.lit("verified").alias("state"), F.col(k).alias("value")) for k in ("sha256", "md5")],
        F.struct(F.lit("phash").alias("algorithm"), F.lit("calculated").alias("state"), F.col("phash").alias("value")),
    )
    return {
        "claims": claims,
        "results": j.select("item", published.alias("published"), kept.alias("quarantined")),
        "fingerprints": j.filter(~F.col("bad")).select("item", F.inline(prints)).filter("value IS NOT NULL"),
    }


def plan_digest(target: Column, revision: Column, note: Column, limits: list[Column], estimate: Column) -> Column:
    return digest(target, revision, note, *limits, estimate)


def replanned(executions: DataFrame, plans: DataFrame, targets: DataFrame, limits: list[str]) -> DataFrame:
    """execution, outcome: is the plan behind an execution still what planning would give?

    executions (execution, plan); plans (plan, seed, target, note, estimate, digest and the limits); targets (seed,
    target, revision, automatic): what may be chosen now.  The digest is computed again with the stored limits and
    estimate: automatic if the seed's automatic choice gives it, explicit if a plan with a note gives it by its
    target, else stale; missing without a plan.
    """
    chosen = targets.filter("automatic").groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("target", "revision")).alias("auto"))
    named = targets.select("seed", "target", F.col("revision").alias("now"), F.lit(True).alias("there"))
    j = plans.join(chosen, "seed", "left").join(named, ["seed", "target"], "left")
    stored = [F.col(c) for c in limits]
    by_rule = plan_digest(F.col("auto.target"), F.col("auto.revision"), F.lit(None).cast("string"), stored, F.col("estimate"))
    by_name = plan_digest(F.col("target"), F.col("now"), F.col("note"), stored, F.col("estimate"))
    outcome = F.when((F.col("n") == 1) & (by_rule == F.col("digest")), "automatic").when(F.col("there") & F.col("note").isNotNull() & (by_name == F.col("digest")), "explicit").otherwise("stale")
    return executions.join(j.select("plan", outcome.alias("outcome")), "plan", "left").select("execution", F.coalesce("outcome", F.lit("missing")).alias("outcome"))


#: Outcomes of a probe's status (fixed values).
PROBE_STATUS = {401: "authentication_required", 403: "authorization_denied", 404: "unavailable", 410: "deleted", 429: "rate_limited"}


def probes(plans: DataFrame, responses: DataFrame) -> DataFrame:
    """plan, outcome, count, requests: one row for each plan's count probe.

    plans (plan, probe: the capability's key or null); responses (plan, status, body), one a plan.  Without a
    capability no request is made.  The count is the profile's total, an integer of zero or more, else the response is
    malformed.  A plan whose probe has no response yet has no row.
    """
    body = F.try_parse_json("body")
    value = F.try_variant_get(body, "$.profile.total_illusts", "variant")
    whole = F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))
    status = F.col("status")
    outcome = F.when(status.between(200, 299), F.when(whole >= 0, "success").otherwise("malformed_response"))
    for code, name in PROBE_STATUS.items():
        outcome = outcome.when(status == code, name)
    outcome = outcome.when(status >= 500, "transient_provider").otherwise("malformed_response")
    asked = plans.filter("probe IS NOT NULL").join(responses, "plan").select("plan", outcome.alias("outcome"), whole.alias("whole"))
    rows = asked.select("plan", "outcome", F.when(F.col("outcome") == "success", F.col("whole")).alias("count"), F.lit(1).alias("requests"))
    none = plans.filter("probe IS NULL").select("plan", F.lit("unsupported").alias("outcome"), F.lit(None).cast("long").alias("count"), F.lit(0).alias("requests"))
    return rows.unionByName(none)


def request_steps(requests: DataFrame, stop: int, cooldown: int, most: int, base_ms: int, cooldown_ms: int) -> DataFrame:
    """requests (run, page, attempt, error) -> with action (done, wait, abort), reason and wait_ms (before jitter).

    Rate limits in a row are counted over a run's pages until a request succeeds; errors in a page count as retries.
    """
    order = ["page", "attempt"]
    so_far = Window.partitionBy("run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limited = F.col("error") == "rate_limited"
    r = requests.withColumn("_part", F.count_if(F.col("error").isNull()).over(so_far))
    r = r.withColumn("_streak", F.count_if(limited).over(Window.partitionBy("run", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    r = r.withColumn("_tries", F.count("error").over(Window.partitionBy("run", "page").orderBy("attempt").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    reason = F.when(limited & (F.col("_streak") >= stop), "rate_limit_exceeded").when(F.col("error") == "auth_error", "auth_error").when(F.col("error").isNotNull() & (F.col("_tries") >= most), "max_retries")
    action = F.when(F.col("error").isNull(), "done").when(reason.isNotNull(), "abort").otherwise("wait")
    backoff = F.lit(base_ms).cast("long") * F.pow(F.lit(2), "_tries").cast("long")
    wait = F.when(action == "wait", F.when(limited & (F.col("_streak") >= cooldown), F.lit(cooldown_ms).cast("long")).otherwise(backoff))
    return r.withColumn("action", action).withColumn("reason", reason).withColumn("wait_ms", wait).drop("_part", "_streak", "_tries")

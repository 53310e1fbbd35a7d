"""Item states, run results, retries, publication, replanning, count probes, request streaks and downloads, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import execution
from ..sources import files
from . import query

_STATES = """WITH e AS (SELECT event_id AS k, user_id AS run, CAST(floor(value) AS BIGINT) AS v, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 + event_id % 3 END AS attempts FROM events),
s AS (SELECT *, attempts * v AS received, coalesce(sum(attempts * v) OVER (PARTITION BY run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM e),
o AS (SELECT run, k AS item, attempts, received,
  CASE WHEN k % 11 = 0 THEN 'satisfied' WHEN k % 13 = 0 THEN 'failed' WHEN attempts = 0 AND spent >= 500 THEN 'deferred' WHEN attempts = 0 AND k % 8 = 0 THEN 'stale' WHEN attempts = 0 THEN 'pending'
    WHEN k % 17 = 1 THEN 'interrupted' WHEN k % 5 < 2 THEN 'complete' WHEN k % 5 = 2 THEN 'quarantined' WHEN k % 5 = 3 THEN 'stale' WHEN k % 17 = 2 THEN 'interrupted' ELSE 'failed' END AS state,
  CASE WHEN k % 11 = 0 THEN 'already_satisfied' WHEN k % 13 = 0 THEN 'missing_variant' WHEN attempts = 0 AND spent >= 500 THEN 'budget_exhausted' WHEN attempts = 0 AND k % 8 = 0 THEN 'stale_target' WHEN attempts = 0 THEN NULL
    WHEN k % 17 = 1 THEN 'interrupted' WHEN k % 5 < 2 THEN 'downloaded' WHEN k % 5 = 2 THEN 'hash_mismatch' WHEN k % 5 = 3 THEN 'stale_target' ELSE 'transient_provider' END AS outcome,
  CASE WHEN attempts > 0 AND k % 5 = 2 AND k % 17 <> 1 THEN v ELSE 0 END AS quarantined,
  attempts > 0 AND k % 17 = 1 AND k % 11 > 0 AND k % 13 > 0 AS recovered, k FROM s),
r AS (SELECT *, CASE WHEN recovered OR outcome = 'budget_exhausted' THEN TRUE WHEN state IN ('failed', 'interrupted', 'deferred') THEN attempts > 0 AND k % 2 = 0 ELSE FALSE END AS retryable FROM o)
"""


def _states(t):
    k, v = F.col("event_id"), F.floor("value").cast("long")
    e = t.events.select(F.col("user_id").alias("run"), k.alias("item"), k.alias("position"), v.alias("v"), F.when(k % 4 == 0, 0).otherwise(1 + k % 3).alias("n"))
    i = F.col("item")
    items = e.select("run", "item", "position", F.when(i % 11 == 0, i).alias("asset_id"), F.when(i % 13 == 0, "missing_variant").alias("reason"), (i % 8 != 0).alias("current"))
    tried = e.filter("n > 0").select("run", "item", "v", F.explode(F.expr("sequence(1, n)")).alias("attempt"))
    ended = F.when(i % 17 == 1, "running").when(i % 17 == 2, "interrupted").otherwise("finished")
    outcome = F.when(i % 5 == 3, "stale_target").otherwise("transient_provider")
    attempts = tried.select("run", "item", "attempt", ended.alias("state"), outcome.alias("outcome"), (i % 2 == 0).alias("retryable"), F.col("v").alias("received"))
    bad = i % 5 == 2
    published = e.filter((F.col("n") > 0) & (i % 5 < 3) & (i % 17 != 1)).select("run", "item", F.when(bad, "hash_mismatch").otherwise("downloaded").alias("published"), F.when(bad, F.col("v")).otherwise(0).alias("quarantined"))
    return execution.item_states(items, attempts, published, 500)


@query("PLN16_item_states", _STATES + "SELECT run, item, state, outcome, retryable, attempts, received, quarantined, recovered FROM r")
def pln16(t):
    return _states(t)


@query(
    "PLN16_run_results",
    _STATES
    + """, g AS (SELECT run, count(*) FILTER (state IN ('complete', 'satisfied')) AS completed, count(*) FILTER (state IN ('failed', 'stale', 'quarantined')) AS failed, count(*) FILTER (state IN ('interrupted', 'deferred')) AS deferred,
      count(*) FILTER (state = 'pending') AS waiting, count(*) FILTER (recovered) AS cut, count(*) FILTER (outcome = 'stale_target') AS stale, count(*) FILTER (outcome = 'hash_mismatch') AS bad, count(*) FILTER (outcome = 'budget_exhausted') AS over, CAST(sum(received) AS BIGINT) AS received, CAST(sum(quarantined) AS BIGINT) AS quarantined FROM r GROUP BY 1)
    SELECT run, completed, failed, deferred, received, quarantined,
      CASE WHEN cut > 0 THEN 'partial' WHEN waiting > 0 THEN 'running' WHEN failed + deferred = 0 THEN 'complete' WHEN completed > 0 OR failed = 0 THEN 'partial' ELSE 'failed' END AS status,
      CASE WHEN cut > 0 THEN 'interrupted' WHEN waiting > 0 THEN NULL WHEN failed + deferred = 0 THEN 'success' WHEN completed > 0 THEN 'partial' WHEN failed = 0 THEN 'interrupted' WHEN stale > 0 THEN 'stale' WHEN bad > 0 THEN 'quarantined' WHEN over > 0 THEN 'budget_exhausted' ELSE 'failed' END AS outcome FROM g""",
)
def pln16_runs(t):
    return execution.run_results(_states(t))


@query("PLN16_retries", _STATES + "SELECT run, count(*) AS n FROM r WHERE retryable AND state IN ('failed', 'interrupted', 'deferred') GROUP BY 1")
def pln16_retries(t):
    return execution.retries(_states(t)).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def _publications(t):
    k, name = F.col("p_partkey"), F.col("p_name")
    items = t.part.select(k.alias("item"), F.sha2(name, 256).alias("sha256"), F.when(k % 2 == 0, F.upper(F.md5(name))).alias("md5"), (F.col("p_size") + k % 3).alias("size"), F.lit(None).cast("string").alias("mime"))
    found = t.part.select(k.alias("item"), F.sha2(F.when(k % 5 == 0, "other").otherwise(name), 256).alias("sha256"), F.md5(name).alias("md5"), F.col("p_size").alias("size"), F.lit("image/png").alias("mime"), F.when(k % 4 == 0, F.hex(k)).alias("phash"), (k % 3 == 0).alias("exact_only"))
    return execution.publications(items, found, 20)


@query("PLN17_published", "SELECT p_partkey AS item, CASE WHEN p_partkey % 5 = 0 THEN 'hash_mismatch' WHEN p_partkey % 3 = 0 THEN 'downloaded_exact_only' ELSE 'downloaded' END AS published, CAST(CASE WHEN p_partkey % 5 = 0 AND p_size <= 20 THEN p_size ELSE 0 END AS BIGINT) AS quarantined FROM part")
def pln17(t):
    return _publications(t)["results"]


@query("PLN17_claims", "SELECT claim, outcome, count(*) AS n FROM (SELECT p_partkey AS k, unnest(['sha256', 'md5', 'size', 'mime']) AS claim, unnest([CASE WHEN k % 5 = 0 THEN 'mismatched' ELSE 'matched' END, CASE WHEN k % 2 = 0 THEN 'matched' ELSE 'not_comparable' END, CASE WHEN k % 3 = 0 THEN 'matched' ELSE 'mismatched' END, 'not_comparable']) AS outcome FROM part) GROUP BY 1, 2")
def pln17_claims(t):
    return _publications(t)["claims"].groupBy("claim", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "PLN17_fingerprints",
    "SELECT p_partkey AS item, 'sha256' AS algorithm, 'verified' AS state, sha256(p_name) AS value FROM part WHERE p_partkey % 5 > 0 UNION ALL SELECT p_partkey, 'md5', 'verified', md5(p_name) FROM part WHERE p_partkey % 5 > 0 UNION ALL SELECT p_partkey, 'phash', 'calculated', hex(p_partkey) FROM part WHERE p_partkey % 5 > 0 AND p_partkey % 4 = 0",
)
def pln17_fingerprints(t):
    return _publications(t)["fingerprints"]


@query(
    "PLN10_replanned",
    "SELECT o_orderkey AS execution, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'stale' WHEN o_orderkey % 2 = 0 THEN 'explicit' WHEN o_custkey % 5 = o_orderkey % 5 THEN 'automatic' ELSE 'stale' END AS outcome FROM orders",
)
def pln10(t):
    k = F.col("o_orderkey")
    stored = t.orders.filter(k % 11 != 0).select(k.alias("plan"), F.col("o_custkey").alias("seed"), (k % 5).alias("target"), F.when(k % 2 == 0, "why").alias("note"), F.when(k % 3 == 0, k).alias("estimate"), (k % 9).alias("requests"), (k % 4).alias("pages"))
    then = F.col("seed") + F.col("target") + F.when(F.col("plan") % 7 == 0, 1).otherwise(0)
    plans = stored.withColumn("digest", execution.plan_digest(F.col("target"), then, F.col("note"), [F.col("requests"), F.col("pages")], F.col("estimate")))
    seed = F.col("c_custkey")
    targets = t.customer.select(seed.alias("seed"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("target"))
    targets = targets.select("seed", "target", (F.col("seed") + F.col("target")).alias("revision"), (F.col("seed") % 5 == F.col("target")).alias("automatic"))
    return execution.replanned(t.orders.select(k.alias("execution"), k.alias("plan")), plans, targets, ["requests", "pages"])


@query(
    "PLN11_count_probes",
    """SELECT k AS plan, outcome, CASE WHEN outcome = 'success' THEN k END AS count, CASE WHEN outcome = 'unsupported' THEN 0 ELSE 1 END AS requests FROM (SELECT c_custkey AS k, CASE WHEN k % 4 = 0 THEN 'unsupported' WHEN k % 7 < 2 THEN CASE WHEN k % 5 = 0 THEN 'success' ELSE 'malformed_response' END
      ELSE ['authentication_required', 'unavailable', 'deleted', 'rate_limited', 'transient_provider'][k % 7 - 1] END AS outcome FROM customer)""",
)
def pln11(t):
    k = F.col("c_custkey")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 204, 401, 404, 410, 429, 503)]), (k % 7 + 1).cast("int"))
    value = F.element_at(F.array(k.cast("string"), F.lit("-1"), F.lit('"5"'), F.lit("true"), F.lit("1.5")), (k % 5 + 1).cast("int"))
    body = F.concat(F.lit('{"profile":{"total_illusts":'), value, F.lit("}}"))
    plans = t.customer.select(k.alias("plan"), F.when(k % 4 != 0, "count").alias("probe"))
    return execution.probes(plans, t.customer.select(k.alias("plan"), status.alias("status"), body.alias("body")))


@query(
    "STM10_request_steps",
    """WITH r AS (SELECT user_id AS run, event_id // 60 AS page, event_id AS attempt, CASE WHEN event_id % 97 = 0 THEN 'auth_error' WHEN event_type = 'click' THEN NULL WHEN event_id % 4 = 0 THEN 'network' ELSE 'rate_limited' END AS error FROM events),
    p AS (SELECT *, count(*) FILTER (error IS NULL) OVER (PARTITION BY run ORDER BY page, attempt ROWS UNBOUNDED PRECEDING) AS part, count(error) OVER (PARTITION BY run, page ORDER BY attempt ROWS UNBOUNDED PRECEDING) AS tries FROM r),
    s AS (SELECT *, count(*) FILTER (error = 'rate_limited') OVER (PARTITION BY run, part ORDER BY page, attempt ROWS UNBOUNDED PRECEDING) AS streak FROM p),
    a AS (SELECT *, CASE WHEN error = 'rate_limited' AND streak >= 5 THEN 'rate_limit_exceeded' WHEN error = 'auth_error' THEN 'auth_error' WHEN error IS NOT NULL AND tries >= 5 THEN 'max_retries' END AS reason FROM s)
    SELECT run, page, attempt, error, CASE WHEN error IS NULL THEN 'done' WHEN reason IS NULL THEN 'wait' ELSE 'abort' END AS action, reason,
      CASE WHEN error IS NOT NULL AND reason IS NULL THEN CASE WHEN error = 'rate_limited' AND streak >= 3 THEN 300000 ELSE 2500 * CAST(pow(2, tries) AS BIGINT) END END AS wait_ms FROM a""",
)
def stm10(t):
    k = F.col("event_id")
    error = F.when(k % 97 == 0, "auth_error").when(F.col("event_type") == "click", None).when(k % 4 == 0, "network").otherwise("rate_limited")
    r = t.events.select(F.col("user_id").alias("run"), F.floor(k / 60).alias("page"), k.alias("attempt"), error.alias("error"))
    # stop, cooldown, retries, base and cooldown delays: fixed values
    return execution.request_steps(r, 5, 3, 5, 2500, 300000)


@query(
    "SRC33_downloads",
    """SELECT k AS post_id, i AS media_index, outcome, CASE WHEN outcome = 'downloaded' THEN regexp_replace(o_orderpriority, '[^A-Za-z0-9_-]+', '_', 'g') || '/' || k || '_' || lpad(CAST(i AS VARCHAR), 2, '0') || CASE WHEN k % 3 = 0 THEN '.jpg' ELSE '.webp' END END AS path FROM
      (SELECT o_orderkey AS k, o_custkey % 30 AS i, o_orderpriority, CASE WHEN k % 4 < 2 THEN 'refused_host' WHEN k % 3 = 1 THEN 'not_an_image' WHEN k % 5 = 0 THEN 'too_large' ELSE 'downloaded' END AS outcome FROM orders)""",
)
def src33(t):
    k = F.col("o_orderkey")
    url = F.when(k % 4 == 0, "http://pbs.twimg.com/media/a.jpg").when(k % 4 == 1, "https://a.pbs.twimg.com/media/a.jpg").otherwise("https://pbs.twimg.com/media/a.jpg")
    kind = F.when(k % 3 == 0, "image/JPEG; q=1").when(k % 3 == 1, "text/html").otherwise("image/webp")
    images = t.orders.select(k.alias("post_id"), (F.col("o_custkey") % 30).alias("media_index"), F.col("o_orderpriority").alias("author"), url.alias("url"), kind.alias("content_type"), F.when(k % 5 == 0, files.MOST_IMAGE_BYTES + 1).alias("size"))
    return files.downloads(images)

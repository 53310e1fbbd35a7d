"""Ledgers: what runs, items, attempts and payloads come to, as folds of append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome_counts(log: DataFrame, entity: str, outcome: str, outcomes: list[str]) -> DataFrame:
    """One row an entity, a count for each outcome, 0 where there is none."""
    return log.groupBy(entity).agg(*[F.count_if(F.col(outcome) == o).alias(o) for o in outcomes])


def payload_store(observations: DataFrame, payload: str, kind: str) -> DataFrame:
    """sha256, observations (kinds of source that saw it, null being one), size in characters: a payload is stored once."""
    d = observations.select(F.sha2(payload, 256).alias("sha256"), F.coalesce(kind, F.lit("")).alias("kind"), F.char_length(payload).cast("long").alias("size"))
    return d.groupBy("sha256").agg(F.count_distinct("kind").alias("observations"), F.min("size").alias("size"))


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a key has already are not added again."""
    return rows.dropDuplicates(keys)


def delivered_once(rows: DataFrame, content: list[str]) -> DataFrame:
    """Each content once, however often it is delivered."""
    return rows.withColumn("_digest", F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)).dropDuplicates(["_digest"]).drop("_digest")


def run_ledger(log: DataFrame, run: str, order: str, status: str) -> DataFrame:
    """run, requests, status (the last one), checkpoint (the last place)."""
    return log.groupBy(F.col(run).alias("run")).agg(F.count(F.lit(1)).alias("requests"), F.max_by(status, order).alias("status"), F.max(order).alias("checkpoint"))


def item_ledger(attempts: DataFrame, run: str, item: str, attempt: str, outcome: str, tie: str) -> DataFrame:
    """run, item, attempts (the last number), outcome (that of the last attempt)."""
    g = attempts.groupBy(F.col(run).alias("run"), F.col(item).alias("item"))
    return g.agg(F.max(attempt).alias("attempts"), F.max_by(outcome, F.struct(attempt, tie)).alias("outcome"))


def adoption_ledger(runs: DataFrame, items: DataFrame, attempts: DataFrame) -> DataFrame:
    """run, status, items, settled, attempts: a run is finished once all its items are settled.

    runs (run), items (run, item), attempts (run, item, attempt, outcome): an item is settled by its last attempt's
    outcome (adopted or existing); items without attempts are open.
    """
    last = item_ledger(attempts, "run", "item", "attempt", "outcome", "outcome")
    state = items.join(last, ["run", "item"], "left").withColumn("done", F.coalesce(F.col("outcome").isin("adopted", "existing"), F.lit(False)))
    per_run = state.groupBy("run").agg(F.count(F.lit(1)).alias("items"), F.count_if("done").alias("settled"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"))
    j = runs.join(per_run, "run", "left").na.fill(0, ["items", "settled", "attempts"])
    return j.withColumn("status", F.when(F.col("settled") == F.col("items"), "finished").when(F.col("settled") > 0, "partial").otherwise("running"))


def lookup_ledger(requests: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, requests, failed, checkpoint (continuation after the last success), results (different ones).

    requests: keys, seq, status, continuation; results: keys, native_id.
    """
    ok = F.col("status") == "success"
    asked = requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(~ok).alias("failed"), F.max_by(F.struct("continuation"), F.when(ok, F.col("seq")))["continuation"].alias("checkpoint")
    )
    found = results.groupBy(*keys).agg(F.count_distinct("native_id").alias("results"))
    return asked.join(found, keys, "left").na.fill(0, ["results"])


def with_stubs(children: DataFrame, held: DataFrame, parent: str) -> DataFrame:
    """children with ``stub``: their parent isn't held yet and has to be written first, as a stub."""
    there = held.select(parent).distinct().withColumn("stub", F.lit(False))
    return children.join(there, parent, "left").withColumn("stub", F.coalesce("stub", F.lit(True)))


def kept_state(log: DataFrame, key: str, value: str, order: str, cleared: Column) -> DataFrame:
    """key, value: the last value put for each key since the store was last cleared."""
    last = log.agg(F.max(F.when(cleared, F.col(order)))).first()[0]
    live = log.filter(~cleared) if last is None else log.filter(~cleared & (F.col(order) > F.lit(last)))
    return live.groupBy(key).agg(F.max_by(F.struct(value), order)[value].alias(value))


def likes_media(listed: DataFrame, downloads: DataFrame) -> DataFrame:
    """post, index, source_url, local_path, error: media of a likes store.

    listed (post, index, source_url, seq): media by metadata fetches; a later fetch of a post replaces the media
    that aren't downloaded, and doesn't change the source of those that are.  downloads (post, index, seq, local_path, error).
    """
    key = ["post", "index"]
    got = downloads.groupBy(*key).agg(
        F.max_by("local_path", F.when(F.col("local_path").isNotNull(), F.col("seq"))).alias("local_path"),
        F.min(F.when(F.col("local_path").isNotNull(), F.col("seq"))).alias("since"),
        F.max_by(F.struct("error"), "seq")["error"].alias("error"),
    )
    fetches = listed.groupBy("post").agg(F.max("seq").alias("last"))
    j = listed.join(got, key, "left").join(fetches, "post")
    # of a downloaded medium the source stays that of the last fetch before the download
    before = F.col("since").isNull() | (F.col("seq") < F.col("since"))
    g = j.groupBy(*key).agg(F.max_by("source_url", F.when(before, F.col("seq"))).alias("source_url"), F.max("local_path").alias("local_path"), F.max("error").alias("error"), F.max("seq").alias("seen"), F.max("last").alias("last"))
    return g.filter("local_path IS NOT NULL OR seen = last").select(*key, "source_url", "local_path", "error")


def adoption_outcomes(rows: DataFrame, key: str, size: str, content: str, limit: int, missing: Column) -> DataFrame:
    """rows with ``outcome``: limit_exceeded, missing, existing (another row before it has the content) or adopted."""
    first = rows.groupBy(content).agg(F.min(key).alias("_first"))
    j = rows.join(first, rows[content].eqNullSafe(first[content]), "left").drop(first[content])
    outcome = F.when(F.col(size) > limit, "limit_exceeded").when(missing, "missing").when(F.col(key) > F.col("_first"), "existing").otherwise("adopted")
    return j.withColumn("outcome", outcome).drop("_first")


def details_required(posts: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """posts with details_required: no full media record of the post is held."""
    held = media.select(key).distinct().withColumn("_held", F.lit(True))
    return posts.join(held, key, "left").withColumn("details_required", F.col("_held").isNull()).drop("_held")


def content_record(rows: DataFrame, content: str) -> DataFrame:
    """rows with sha256, md5 and size in bytes of their content."""
    return rows.withColumn("sha256", F.sha2(content, 256)).withColumn("md5", F.md5(content)).withColumn("size", F.octet_length(content))

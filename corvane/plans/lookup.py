"""Reverse lookup: what to ask a provider, and what an answer means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_term
from ..functions.urls import x_aliases


def materials(posts: DataFrame, media: DataFrame, assets: DataFrame) -> DataFrame:
    """post_id, strategy, value, term: canonical URL (under all its hosts), pixiv ids, declared and verified md5; each once.

    posts: post_id, platform, native_id, canonical_url; media: post_id, md5; assets: post_id, md5.
    """
    url = posts.filter("canonical_url IS NOT NULL").select("post_id", F.lit("source_url").alias("strategy"), F.explode(x_aliases(F.col("canonical_url"))).alias("value"))
    pixiv = posts.filter("platform = 'pixiv'").select("post_id", F.lit("pixiv_id").alias("strategy"), F.col("native_id").alias("value"))
    hashes = [d.filter("md5 IS NOT NULL").select("post_id", F.lit("md5").alias("strategy"), F.lower("md5").alias("value")) for d in (media, assets)]
    every = reduce(DataFrame.unionByName, [url, pixiv, *hashes]).distinct()
    return every.withColumn("term", query_term(F.col("strategy"), F.col("value"))).filter("term IS NOT NULL")


def bounds(items: DataFrame, requests: int, pages: int, results: int) -> DataFrame:
    """post_id and the most requests, pages and results that its strategies may take."""
    return items.groupBy("post_id").agg((F.count(F.lit(1)) * requests).alias("requests"), (F.count(F.lit(1)) * pages).alias("pages"), (F.count(F.lit(1)) * results).alias("results"))


def interpretation(kind: Column, strategy: Column, same_source: Column, same_hash: Column) -> Column:
    """interpretation and strength of a result: equal bytes are exact, an equal source is strong, the rest is a lead."""
    post = kind == "post"
    return F.struct(
        F.when(post & (same_hash | same_source), "post_match").when(kind == "account", "account_match").when(kind == "attribution", "attribution").when(post, "weak_lead").otherwise("inconclusive").alias("interpretation"),
        F.when(post & same_hash, "exact").when(post & same_source, "strong").when(kind.isin("account", "attribution") & (strategy == "artist_name"), "moderate").otherwise("weak").alias("strength"),
    )


def executed(pages: DataFrame, key: list[str], limits: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(pages taken, items) of lookups from the pages that their provider gives, taken in order.

    pages: key, page (from 1), status, results (number), continuation (of the next page, or null).  limits: requests,
    results.  A page is asked for while the one before it succeeded and went on and the limits aren't used up; of the
    page that crosses the limit of results all results are kept.  items: key, requests, results, checkpoint (continuation
    from which a later run resumes) and state: complete, failed, or deferred where a limit ended it.
    """
    before = Window.partitionBy(*key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    goes_on = (F.col("status") == "success") & F.col("continuation").isNotNull()
    p = pages.withColumn("_open", F.coalesce(F.bool_and(goes_on).over(before), F.lit(True))).withColumn("_had", F.coalesce(F.sum("results").over(before), F.lit(0)))
    taken = p.filter(F.col("_open") & (F.col("page") <= limits["requests"]) & (F.col("_had") < limits["results"])).drop("_open", "_had")
    ok = F.col("status") == "success"
    last = taken.groupBy(*key).agg(
        F.count(F.lit(1)).alias("requests"),
        F.coalesce(F.sum(F.when(ok, F.col("results"))), F.lit(0)).alias("results"),
        F.max_by(F.struct("status", "continuation"), "page").alias("l"),
        F.max_by(F.struct("continuation"), F.when(ok, F.col("page")))["continuation"].alias("checkpoint"),
    )
    state = F.when(F.col("l.status") != "success", "failed").when(F.col("l.continuation").isNull(), "complete").otherwise("deferred")
    return taken, last.select(*key, "requests", "results", "checkpoint", state.alias("state"))


def first_stable_account(attributions: DataFrame) -> DataFrame:
    """attributions (attribution_id, position, reference) -> attribution_id, platform, native_id: its first URL that is a stable account."""
    r = F.col("reference")
    stable = attributions.filter((r["object_kind"] == "account") & (r["identifier_kind"] == "stable_id"))
    return stable.groupBy("attribution_id").agg(F.min_by(F.struct(r["platform"].alias("platform"), r["native_id"].alias("native_id")), "position").alias("x")).select("attribution_id", "x.platform", "x.native_id")


def located(results: DataFrame, held: DataFrame, keys: list[str], local: str) -> DataFrame:
    """results with the local id of what they name; the query fails on a result that isn't held."""
    j = results.join(held.select(*keys, local), keys, "left")
    return j.withColumn(local, F.coalesce(F.col(local), F.raise_error(F.lit("a result isn't in the catalog")).cast(held.schema[local].dataType)))

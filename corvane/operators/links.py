"""The link sink: links, their observations, and platform references with resolved targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import digest
from .merge import earliest


def resolved(references: DataFrame, accounts: DataFrame, posts: DataFrame) -> DataFrame:
    """references (platform, instance_host, object_kind, native_id, ...) with account_id and post_id of what they name.

    Only references to a platform itself are resolved, not those to an instance.  accounts and posts: platform, native_id, id.
    """
    home = F.coalesce("instance_host", F.lit("")) == ""
    own = lambda held, kind: held.select("platform", "native_id", F.lit(kind).alias("object_kind"), F.col("id").alias(f"{kind}_id"))
    key = ["platform", "native_id", "object_kind"]
    j = references.join(own(accounts, "account"), key, "left").join(own(posts, "post"), key, "left")
    return j.withColumn("account_id", F.when(home, F.col("account_id"))).withColumn("post_id", F.when(home, F.col("post_id"))).select(*references.columns, "account_id", "post_id")


def stored(observations: DataFrame, accounts: DataFrame, posts: DataFrame) -> dict[str, DataFrame]:
    """links, observations, references of link observations.

    observations: subject_kind, subject_id, context, json_path, url (as written), canonical_url, state, reason,
    reference (see with_reference), seq.  A link has the state last seen; an occurrence (its subject, place and URL) is
    stored once, as first seen; a reference keeps the target it was first resolved to.
    """
    links = observations.groupBy("canonical_url").agg(F.max_by(F.struct("state", "reason"), "seq").alias("s")).select("canonical_url", "s.state", "s.reason")
    occurrence = digest(*[F.col(c) for c in ("subject_kind", "subject_id", "context", "json_path", "url")])
    once = earliest(observations.withColumn("occurrence", occurrence).drop("reference", "state", "reason"), ["occurrence"], ["seq"])
    r = observations.filter("reference IS NOT NULL").select("reference.*", "seq")
    key = ["platform", "instance_host", "object_kind", "identifier_kind", "native_id"]
    newest = r.groupBy(*key).agg(F.max_by("target", "seq").alias("target"))
    return {"links": links, "observations": once, "references": resolved(newest, accounts, posts)}


def post_references(posts: DataFrame, key: str, urls: str) -> DataFrame:
    """key, position, url: the references that a post lists itself, in order, each URL once at its first place."""
    listed = posts.select(key, F.posexplode(urls).alias("position", "url")).filter("url IS NOT NULL AND url <> ''")
    return listed.groupBy(key, "url").agg(F.min("position").alias("position")).select(key, "position", "url")


def post_occurrences(posts: DataFrame, payload_links: DataFrame) -> DataFrame:
    """post, url, context, json_path: URLs of a post's canonical address, of its text and of its retained JSON.

    posts: post, canonical_url, text; payload_links: post, url, context, json_path.
    """
    from ..functions.urls import extract_urls

    own = posts.filter("canonical_url IS NOT NULL").select("post", F.col("canonical_url").alias("url"), F.lit("post.canonical").alias("context"), F.lit("$.canonical_url").alias("json_path"))
    text = posts.select("post", F.posexplode(extract_urls(F.col("text"))).alias("i", "url"))
    text = text.select("post", "url", F.lit("post.text").alias("context"), F.concat(F.lit("$.text_content["), F.col("i").cast("string"), F.lit("]")).alias("json_path"))
    return own.unionByName(text).unionByName(payload_links.select("post", "url", "context", "json_path"))

"""Bookmark exports, fanned out to the catalog's logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import real_handle, real_name
from ..functions.times import lenient, utc_text

_AUTHOR = "struct<user_id: string, screen_name: string, name: string, description: string, location: string, url: string, profile_url: string, profile_image_url: string, profile_banner_url: string, verified: boolean, followers_count: bigint, following_count: bigint>"
_MEDIA = "array<struct<type: string, url: string, thumbnail_url: string, alt_text: string, width: bigint, height: bigint, duration_ms: bigint, variants: array<struct<bitrate: bigint, content_type: string, url: string>>>>"
BOOKMARK = f"struct<tweet_id: string, status: string, created_at: string, full_text: string, lang: string, in_reply_to_tweet_id: string, folders: array<string>, author: {_AUTHOR}, media: {_MEDIA}, quoted_tweet: struct<tweet_id: string>>"
EXPORT = f"struct<export_metadata: struct<exported_at: string>, bookmarks: array<{BOOKMARK}>>"


def parsed(documents: DataFrame) -> DataFrame:
    """documents (json) -> index, exported_at, raw and the fields of each bookmark."""
    e = documents.select(F.from_json("json", EXPORT, {"mode": "FAILFAST"}).alias("e"), F.from_json("json", "struct<bookmarks: array<string>>").alias("raw"))
    rows = e.select(F.col("e.export_metadata.exported_at").alias("exported_at"), F.posexplode("e.bookmarks").alias("index", "b"), F.col("raw.bookmarks").alias("raws"))
    return rows.select("index", "exported_at", F.element_at("raws", F.col("index") + 1).alias("raw"), "b.*")


def diagnostics(rows: DataFrame) -> DataFrame:
    """index, problem: why an import can't be taken."""
    blank = F.col("tweet_id").isNull() | (F.trim("tweet_id") == "") | (F.trim("tweet_id") != F.col("tweet_id"))
    when = F.col("created_at").isNotNull() & lenient(F.col("created_at")).isNull()
    problems = F.array_compact(F.array(F.when(blank, "tweet_id"), F.when(when, "created_at")))
    return rows.select("index", F.explode(problems).alias("problem"))


def fan_out(rows: DataFrame) -> dict[str, DataFrame]:
    """accounts, posts, participants, observations, media, relations, raw; targets of relations are posts too, stubs."""
    author = F.col("author.user_id")
    handle = real_handle(F.col("author.screen_name"), author)
    rows = rows.withColumn("handle", handle)
    x = F.lit("x")
    accounts = rows.filter(author.isNotNull()).select(
        x.alias("platform"), author.alias("native_id"), F.col("exported_at").alias("observed_at"), F.col("index").alias("seq"), "handle",
        real_name(F.col("author.name"), author).alias("display_name"), F.col("author.description").alias("bio"), F.col("author.location").alias("location"),
        F.col("author.url").alias("website_url"), F.col("author.profile_url").alias("profile_url"), F.col("author.followers_count").alias("followers"), F.col("author.verified").alias("verified"),
    )
    link = F.concat(F.lit("https://x.com/"), F.coalesce("handle", F.lit("i")), F.lit("/status/"), F.col("tweet_id"))
    posts = rows.select(
        x.alias("platform"), F.col("tweet_id").alias("native_id"), F.col("exported_at").alias("observed_at"), F.col("index").alias("seq"), link.alias("canonical_url"),
        F.col("full_text").alias("text"), F.col("lang").alias("language"), utc_text(lenient(F.col("created_at"))).alias("created_at"), F.coalesce("status", F.lit("available")).alias("availability"),
    )
    relation = lambda c, kind: rows.select(F.col("tweet_id").alias("post"), F.col(c).alias("target"), F.lit(kind).alias("kind"), F.col("exported_at").alias("observed_at")).filter("target IS NOT NULL")
    relations = relation("in_reply_to_tweet_id", "reply").unionByName(relation("quoted_tweet.tweet_id", "quote"))
    stubs = relations.select(x.alias("platform"), F.col("target").alias("native_id")).distinct()
    media = rows.select(F.col("tweet_id").alias("post"), F.col("exported_at").alias("observed_at"), F.posexplode("media").alias("position", "m")).select(
        "post", "observed_at", F.concat(F.lit("xarchive:"), F.col("position").cast("string")).alias("source_key"), "position", F.coalesce("m.type", F.lit("unknown")).alias("media_type"),
        F.col("m.url").alias("remote_url"), F.col("m.thumbnail_url").alias("preview_url"), "m.width", "m.height", "m.duration_ms", F.when(F.col("m.variants").isNotNull(), F.to_json("m.variants")).alias("variants_json"), "m.alt_text",
    )
    return {
        "accounts": accounts,
        "posts": posts.unionByName(stubs, allowMissingColumns=True),
        "participants": rows.filter(author.isNotNull()).select(F.col("tweet_id").alias("post"), author.alias("account"), F.lit("author").alias("role")),
        "observations": rows.select(F.lit("xarchive").alias("source_kind"), F.concat(F.lit("bookmark:"), "tweet_id").alias("event_key"), F.lit("bookmarked").alias("event_type"), F.col("tweet_id").alias("post"), "exported_at", F.when(F.size("folders") > 0, F.to_json("folders")).alias("collection_data")),
        "media": media,
        "relations": relations,
        "raw": rows.select(F.sha2("raw", 256).alias("sha256"), F.col("raw").alias("payload"), F.col("tweet_id").alias("native_id")).dropDuplicates(["sha256"]),
    }


def read_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The logs of an export file, or no rows at all: an export with problems fails as a whole."""
    rows = parsed(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))
    found = diagnostics(rows).orderBy("index").limit(20).collect()
    if found:
        raise ValueError("; ".join(f"bookmark[{r['index']}].{r['problem']} is invalid" for r in found))
    return fan_out(rows)


def assembled(bookmarks: DataFrame, mapping: DataFrame, folders: DataFrame) -> DataFrame:
    """bookmarks (tweet_id, ...) with the sorted names of their folders (the id where a folder has no name)."""
    names = mapping.join(folders, "folder_id", "left").groupBy("tweet_id").agg(F.sort_array(F.collect_set(F.coalesce("name", "folder_id"))).alias("folders"))
    return bookmarks.join(names, "tweet_id", "left").withColumn("folders", F.coalesce("folders", F.array().cast("array<string>")))

"""Pages of a bookmark timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a page keeps its instructions (fixed values).
PATHS = ("$.data.bookmark_timeline_v2.timeline.instructions", "$.data.bookmark_timeline.timeline.instructions", "$.data.bookmark_collection_timeline.timeline.instructions")


def entries(pages: DataFrame) -> DataFrame:
    """pages (page, body) -> page, entry_id, entry (JSON), from the first path that is there."""
    found = F.coalesce(*[F.get_json_object("body", p) for p in PATHS])
    steps = pages.select("page", F.explode(F.from_json(found, "array<struct<entries: array<string>>>")).alias("i"))
    rows = steps.select("page", F.posexplode("i.entries").alias("place", "entry"))
    return rows.select("page", "place", F.get_json_object("entry", "$.entryId").alias("entry_id"), "entry")


def posts(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("entry_id").startswith("tweet-")).select("page", "place", F.substr("entry_id", F.lit(7)).alias("post_id"), "entry")


def cursors(rows: DataFrame) -> DataFrame:
    """page, cursor: where the next page begins."""
    return rows.filter(F.col("entry_id").startswith("cursor-bottom-")).groupBy("page").agg(F.max_by(F.get_json_object("entry", "$.content.value"), "place").alias("cursor"))


def stops(pages: DataFrame, empties: int = 5) -> DataFrame:
    """pages (run, page, posts, cursor) -> run, page, reason of the page after which a run stops: its cursor is null or was there before, or it is the last of so many empty ones."""
    from pyspark.sql import Window

    w = Window.partitionBy("run").orderBy("page")
    p = pages.withColumn("seen", F.row_number().over(Window.partitionBy("run", "cursor").orderBy("page")) > 1)
    p = p.withColumn("full", F.sum((F.col("posts") > 0).cast("int")).over(w.rowsBetween(1 - empties, 0))).withColumn("n", F.row_number().over(w))
    reason = F.when(F.col("cursor").isNull(), "end").when(F.col("seen"), "repeated_cursor").when((F.col("n") >= empties) & (F.col("full") == 0), "empty_pages")
    return p.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy("run").agg(F.min(F.struct("page", "reason")).alias("s")).select("run", "s.page", "s.reason")


_TWEET = "rest_id string, legacy struct<full_text: string, created_at: string, favorite_count: bigint, extended_entities: struct<media: array<struct<type: string, media_url_https: string, video_info: struct<variants: array<struct<bitrate: bigint, content_type: string, url: string>>>>>>>, note_tweet struct<note_tweet_results: struct<result: struct<text: string>>>, card struct<legacy: struct<binding_values: array<struct<key: string, value: struct<string_value: string>>>>>, tweet string"


def tweets(rows: DataFrame) -> DataFrame:
    """rows (tweet: JSON of a result) -> post_id, text (the long form if there is one), likes, media (mp4 by falling bitrate), card (map).

    A result that wraps its post in ``tweet`` is unwrapped; one without an id is a tombstone: all else is null.
    """
    inner = F.coalesce(F.get_json_object("tweet", "$.tweet"), F.col("tweet"))
    t = rows.select(F.from_json(inner, _TWEET).alias("t")).select("t.*")
    down = lambda a, b: (F.coalesce(b["bitrate"], F.lit(0)) - F.coalesce(a["bitrate"], F.lit(0))).cast("int")
    media = F.transform("legacy.extended_entities.media", lambda m: F.struct(m["type"].alias("type"), m["media_url_https"].alias("preview"), F.array_sort(F.filter(m["video_info"]["variants"], lambda v: v["content_type"] == "video/mp4"), down).alias("variants")))
    card = F.map_from_entries(F.transform("card.legacy.binding_values", lambda b: F.struct(b["key"].alias("key"), b["value"]["string_value"].alias("value"))))
    return t.select(F.col("rest_id").alias("post_id"), F.coalesce("note_tweet.note_tweet_results.result.text", "legacy.full_text").alias("text"), F.col("legacy.favorite_count").alias("likes"), media.alias("media"), card.alias("card"))


def folders(pages: DataFrame) -> DataFrame:
    """pages (body: items and cursor) -> folder_id, name, cursor."""
    e = pages.select(F.from_json("body", "struct<items: array<struct<id: string, collection_id: string, name: string>>, cursor: string>").alias("e"))
    return e.select(F.explode("e.items").alias("i"), F.col("e.cursor").alias("cursor")).select(F.coalesce("i.id", "i.collection_id").alias("folder_id"), F.col("i.name").alias("name"), "cursor")

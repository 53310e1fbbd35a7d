"""Importers and normalisers (SRC, SNK) over documents made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import bookmarks, likes, providers, timeline
from . import query


@query(
    "SRC01_likes",
    """WITH r AS (SELECT o_custkey + 10 AS id, o_orderkey AS pos, o_orderkey % 3 > 0 AS texted FROM orders)
    SELECT CAST(id AS VARCHAR) AS post_id, 'https://x.com/a/status/' || id || '?n=' || max(pos) AS post_url, 't' || max(pos) FILTER (texted) AS archived_text FROM r GROUP BY id""",
)
def src01(t):
    k, c = F.col("o_orderkey").cast("string"), (F.col("o_custkey") + 10).cast("string")
    text = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit(',"fullText":"t'), k, F.lit('"'))).otherwise("")
    record = F.concat(F.lit('{"like":{"tweetId":"'), c, F.lit('","expandedUrl":"https://x.com/a/status/'), c, F.lit("?n="), k, F.lit('"'), text, F.lit("}}"))
    parts = t.orders.groupBy(F.lpad(F.floor(F.col("o_orderkey") / 1000).cast("string"), 9, "0").alias("member")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", record.alias("r")))).alias("rs"))
    scripts = parts.select("member", F.concat(F.lit("window.YTD.like.part0 = [ "), F.array_join(F.transform("rs", lambda x: x["r"]), ","), F.lit(" ];")).alias("text"))
    return likes.likes(scripts)


@query("SRC03_array_in_script", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '[1, [2]]' END AS body FROM nation")
def src03(t):
    script = F.when(F.col("n_nationkey") % 2 == 0, "x = [1, [2]];").otherwise("x = ]1[;")
    return t.nation.select("n_nationkey", likes.array_in_script(script).alias("body"))


def _export(t):
    d = t.documents.select(
        "doc_id",
        F.to_json(F.struct(
            F.col("doc_id").cast("string").alias("tweet_id"), F.col("text").alias("full_text"), F.col("lang"), F.lit("Wed Aug 05 00:00:00 +0000 2026").alias("created_at"),
            F.when(F.col("doc_id") % 4 == 0, (F.col("doc_id") + 1).cast("string")).alias("in_reply_to_tweet_id"), F.array("source").alias("folders"),
            F.struct(F.col("source").alias("user_id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("user_"), "source")).otherwise(F.lit("bob")).alias("screen_name")).alias("author"),
            F.array(F.struct(F.lit("photo").alias("type"), F.concat(F.lit("https://h/"), F.col("doc_id").cast("string")).alias("url"), F.col("n_chars").alias("width"))).alias("media"),
        )).alias("b"),
    )
    whole = d.groupBy(F.floor(F.col("doc_id") / 100).alias("g")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "b"))).alias("bs"))
    json = F.concat(F.lit('{"export_metadata":{"exported_at":"2026-08-06T00:00:00Z"},"bookmarks":['), F.array_join(F.transform("bs", lambda x: x["b"]), ","), F.lit("]}"))
    return bookmarks.fan_out(bookmarks.parsed(whole.select(json.alias("json"))))


@query("SRC05_bookmark_posts", "SELECT CAST(doc_id AS VARCHAR) AS native_id, 'https://x.com/' || CASE WHEN doc_id % 2 = 0 THEN 'i' ELSE 'bob' END || '/status/' || doc_id AS canonical_url, lang AS language, '2026-08-05T00:00:00Z' AS created_at FROM documents")
def src05(t):
    return _export(t)["posts"].filter("observed_at IS NOT NULL").select("native_id", "canonical_url", "language", "created_at")


@query("SRC05_bookmark_media", "SELECT CAST(doc_id AS VARCHAR) AS post, 'xarchive:0' AS source_key, 'https://h/' || doc_id AS remote_url, n_chars AS width FROM documents")
def src05_media(t):
    return _export(t)["media"].select("post", "source_key", "remote_url", "width")


@query("SRC05_bookmark_relations", "SELECT CAST(doc_id AS VARCHAR) AS post, CAST(doc_id + 1 AS VARCHAR) AS target, 'reply' AS kind FROM documents WHERE doc_id % 4 = 0")
def src05_relations(t):
    return _export(t)["relations"].select("post", "target", "kind")


@query("SRC07_legacy_payload", """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '{}' ELSE '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' END AS payload FROM nation""")
def src07(t):
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(t.nation.columns)]), {"ignoreNullFields": "false"})
    return t.nation.select("n_nationkey", F.coalesce(F.when(F.col("n_nationkey") % 2 == 0, "{}"), row).alias("payload"))


@query("SRC09_status_metadata", "SELECT CAST(doc_id AS VARCHAR) AS post_id, doc_id % 3 <> 2 AS available, CAST(doc_id % 2 + 1 AS INTEGER) AS images FROM documents WHERE doc_id % 3 <> 2 UNION ALL SELECT CAST(doc_id AS VARCHAR), FALSE, 0 FROM documents WHERE doc_id % 3 = 2")
def src09(t):
    k = F.col("doc_id").cast("string")
    photos = F.when(F.col("doc_id") % 2 == 0, '[{"url":"a"}]').otherwise('[{"url":"a"},{"url":"b"}]')
    good = F.concat(F.lit('":{"id":"'), k, F.lit('","text":"x","media":{"photos":'), photos, F.lit("}}}"))
    body = F.concat(F.lit('{"code":200,"'), F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit('tweet":{"type":"tombstone","id":"'), k, F.lit('"}}'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("tweet"), good)).otherwise(F.concat(F.lit("status"), good)))
    m = providers.status_metadata(t.documents.select(body.alias("body")))
    return m.select("post_id", "available", F.size("images").alias("images"))


def _danbooru(t):
    body = F.to_json(F.struct(
        F.col("p_partkey").alias("id"), F.lower("p_type").alias("tag_string_general"), F.lower("p_brand").alias("tag_string_artist"), F.upper(F.md5("p_name")).alias("md5"), F.col("p_size").alias("file_size"),
        F.when(F.col("p_partkey") % 2 == 0, "https://h/o.png").alias("file_url"), F.lit("https://h/p.png").alias("preview_file_url"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") + 1).alias("parent_id"),
        F.when(F.col("p_partkey") % 5 == 0, "https://x.com/a").otherwise("a book").alias("source"),
    ))
    return providers.danbooru(t.part.select(body.alias("body")))


@query(
    "SRC14_danbooru_tags",
    """SELECT CAST(p_partkey AS VARCHAR) AS post, category, CAST(i AS INTEGER) AS position, names[i + 1] AS name FROM (
      SELECT p_partkey, 'general' AS category, list_filter(string_split_regex(lower(p_type), ' +'), lambda x: x <> '') AS names FROM part UNION ALL SELECT p_partkey, 'artist', list_filter(string_split_regex(lower(p_brand), ' +'), lambda x: x <> '') FROM part), range(10) r(i) WHERE i < len(names)""",
)
def src14_tags(t):
    return _danbooru(t)["tags"].select("post", "category", "position", "name")


@query("SRC14_danbooru_media", "SELECT CAST(p_partkey AS VARCHAR) AS post, md5(p_name) AS md5, CAST(p_size AS BIGINT) AS size, '{\"variants\":[' || CASE WHEN p_partkey % 2 = 0 THEN '{\"role\":\"original\",\"url\":\"https://h/o.png\"},' ELSE '' END || '{\"role\":\"preview\",\"url\":\"https://h/p.png\"}]}' AS variants_json FROM part")
def src14_media(t):
    return _danbooru(t)["media"].select("post", "md5", "size", "variants_json")


@query("SRC14_danbooru_links", "SELECT CAST(p_partkey + 1 AS VARCHAR) AS post, CAST(p_partkey AS VARCHAR) AS target, 'parent_of' AS kind FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'https://x.com/a', 'source' FROM part WHERE p_partkey % 5 = 0")
def src14_links(t):
    d = _danbooru(t)
    return d["relations"].unionByName(d["references"].select("post", F.col("value").alias("target"), "kind"))


@query("SRC16_listing", "SELECT o_orderkey AS post, 'b' || max(o_orderkey) OVER (PARTITION BY o_orderkey // 100) AS continuation FROM orders")
def src16(t):
    g = t.orders.groupBy(F.floor(F.col("o_orderkey") / 100).alias("g")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    body = F.concat(F.lit("["), F.array_join(F.transform("ids", lambda i: F.concat(F.lit('{"id":'), i.cast("string"), F.lit("}"))), ","), F.lit("]"))
    return providers.listing(g.select(body.alias("body")))


@query(
    "SRC18_e621_tags",
    "SELECT CAST(p_partkey AS VARCHAR) AS post, category, CAST(place AS INTEGER) AS place, name FROM (SELECT p_partkey, 'artist' AS category, 1 AS place, lower(p_brand) AS name FROM part UNION ALL SELECT p_partkey, 'general', 6, lower(p_type) FROM part UNION ALL SELECT p_partkey, 'zzz', 10, 'q' FROM part)",
)
def src18(t):
    body = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.create_map(F.lit("artist"), F.array(F.lower("p_brand")), F.lit("general"), F.array(F.lower("p_type")), F.lit("zzz"), F.array(F.lit("q"))).alias("tags")))
    return providers.e621(t.part.select(body.alias("body")))["tags"].select("post", "category", "place", "name")


@query("SRC24_timeline", "SELECT o_custkey AS page, CAST(o_orderkey AS VARCHAR) AS post_id, 'c' || o_custkey AS cursor FROM orders")
def src24(t):
    entry = F.concat(F.lit('{"entryId":"tweet-'), F.col("o_orderkey").cast("string"), F.lit('","content":{}}'))
    g = t.orders.groupBy(F.col("o_custkey").alias("page")).agg(F.collect_list(entry).alias("es"))
    cursor = F.concat(F.lit('{"entryId":"cursor-bottom-1","content":{"value":"c'), F.col("page").cast("string"), F.lit('"}}'))
    path = F.when(F.col("page") % 2 == 0, "bookmark_timeline_v2").otherwise("bookmark_collection_timeline")
    body = F.concat(F.lit('{"data":{"'), path, F.lit('":{"timeline":{"instructions":[{"entries":['), F.array_join(F.concat("es", F.array(cursor)), ","), F.lit("]}]}}}}"))
    rows = timeline.entries(g.select("page", body.alias("body")))
    return timeline.posts(rows).join(timeline.cursors(rows), "page").select("page", "post_id", "cursor")


@query("SRC22_stop_rules", "SELECT user_id AS run, min(event_id) AS page FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, CAST(floor(value) AS BIGINT) ORDER BY event_id) AS nth FROM events) WHERE nth > 1 GROUP BY 1")
def src22(t):
    p = t.events.select(F.col("user_id").alias("run"), F.col("event_id").alias("page"), F.lit(1).alias("posts"), F.floor("value").cast("long").alias("cursor"))
    return timeline.stops(p).select("run", "page")


@query("SNK24_assembled_export", "SELECT o_orderkey AS tweet_id, coalesce(string_agg(DISTINCT coalesce(n, f), ',' ORDER BY coalesce(n, f)), '') AS folders FROM orders LEFT JOIN (SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) AS f, CASE WHEN s_acctbal > 0 THEN s_name END AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) ON l_orderkey = o_orderkey GROUP BY 1")
def snk24(t):
    mapping = t.lineitem.select(F.col("l_orderkey").alias("tweet_id"), F.col("l_suppkey").cast("string").alias("folder_id"))
    folders = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("folder_id"), F.col("s_name").alias("name"))
    b = bookmarks.assembled(t.orders.select(F.col("o_orderkey").alias("tweet_id")), mapping, folders)
    return b.select("tweet_id", F.array_join("folders", ",").alias("folders"))

"""Importers, further normalisers, the link sink and the ledgers, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsons, scores, urls
from ..operators import ledgers, links, merge, search
from ..plans import lookup
from ..sources import bookmarks, providers
from ..staging import shared_folder
from . import query
from .sources import _export


@query("SRC04_bookmark_diagnostics", "SELECT doc_id % 100 AS index, CASE WHEN doc_id % 3 = 0 THEN 'tweet_id' ELSE 'created_at' END AS problem, count(*) AS n FROM documents WHERE doc_id % 3 < 2 GROUP BY 1, 2")
def src04(t):
    k = F.col("doc_id")
    d = t.documents.select(k, F.to_json(F.struct(F.when(k % 3 == 0, F.lit(" ")).otherwise(k.cast("string")).alias("tweet_id"), F.col("text").alias("full_text"), F.when(k % 3 == 1, "yesterday").otherwise("2026-08-05T00:00:00Z").alias("created_at"))).alias("b"))
    whole = d.groupBy(F.floor(k / 100).alias("g")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "b"))).alias("bs"))
    json = F.concat(F.lit('{"export_metadata":{"exported_at":"2026-08-06T00:00:00Z"},"bookmarks":['), F.array_join(F.transform("bs", lambda x: x["b"]), ","), F.lit("]}"))
    return bookmarks.diagnostics(bookmarks.parsed(whole.select(json.alias("json")))).groupBy("index", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("SRC04_bookmark_import", "SELECT CAST(c_custkey AS VARCHAR) AS native_id, c_name AS text, lower(c_mktsegment) AS language FROM customer")
def src04_import(t):
    import uuid

    d = t.customer.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").cast("string").alias("tweet_id"), F.col("c_name").alias("full_text"), F.lower("c_mktsegment").alias("lang"))).alias("b"))
    # an export is one JSON document, so one file holds it; customers are few
    body = d.agg(F.array_sort(F.collect_list(F.struct("c_custkey", "b"))).alias("bs")).select(F.concat(F.lit('{"export_metadata":{"exported_at":"2026-08-06T00:00:00Z"},"bookmarks":['), F.array_join(F.transform("bs", lambda x: x["b"]), ","), F.lit("]}")).alias("value"))
    path = f"{shared_folder(t.spark)}/corvane/{t.spark.sparkContext.applicationId}/{uuid.uuid4().hex}-export"
    body.write.text(path)
    return bookmarks.read_export(t.spark, path)["posts"].select("native_id", "text", "language")


@query("SRC11_pixiv_media", "SELECT CAST(p_partkey AS VARCHAR) AS post, CAST(i AS INTEGER) AS position, 'https://i/' || p_partkey || '/' || i AS remote_url FROM part, range(3) r(i) WHERE i = 0 OR p_partkey % 2 = 0")
def src11(t):
    k = F.col("p_partkey")
    url = lambda i: F.concat(F.lit("https://i/"), k.cast("string"), F.lit(f"/{i}"))
    pages = F.when(k % 2 == 0, F.array(*[F.struct(F.struct(url(i).alias("original")).alias("image_urls")) for i in range(3)])).otherwise(F.expr("CAST(array() AS array<struct<image_urls:struct<original:string>>>)"))
    work = F.struct(k.alias("id"), F.col("p_name").alias("title"), F.lit(True).alias("visible"), F.struct(k.alias("id")).alias("user"), pages.alias("meta_pages"), F.struct(url(0).alias("original_image_url")).alias("meta_single_page"))
    return providers.pixiv(t.part.select(F.to_json(F.struct(work.alias("illust"))).alias("body")))["media"].select("post", "position", "remote_url")


def _profiles(t):
    k = F.col("s_suppkey")
    there = F.to_json(F.struct(F.struct(k.alias("id"), F.col("s_name").alias("account"), (k % 5 != 0).alias("is_valid")).alias("user"), F.struct(F.lit("https://a.example").alias("webpage"), F.when(k % 2 == 0, "https://a.example").otherwise("https://x.com/b").alias("twitter_url"), (k % 7 - 1).alias("total_following")).alias("profile")))
    return t.supplier.select(k.cast("string").alias("requested"), F.when(k % 4 == 0, 410).when(k % 4 == 1, 404).otherwise(200).alias("status"), F.when(k % 4 < 2, '{"error":{}}').otherwise(there).alias("body"))


@query("SRC12_pixiv_accounts", "SELECT CAST(s_suppkey AS VARCHAR) AS native_id, CASE s_suppkey % 4 WHEN 0 THEN 'deleted' WHEN 1 THEN 'unavailable' ELSE CASE WHEN s_suppkey % 5 = 0 THEN 'unavailable' ELSE 'available' END END AS availability, CASE WHEN s_suppkey % 4 > 1 THEN s_name END AS handle, CASE WHEN s_suppkey % 4 > 1 AND s_suppkey % 7 > 0 THEN CAST(s_suppkey % 7 - 1 AS BIGINT) END AS following FROM supplier")
def src12(t):
    return providers.pixiv_accounts(_profiles(t))["accounts"].select("native_id", "availability", "handle", "following")


@query("SRC12_pixiv_links", "SELECT CAST(s_suppkey AS VARCHAR) AS native_id, 'account.website' AS context, 'https://a.example' AS url FROM supplier WHERE s_suppkey % 4 > 1 UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'account.social', 'https://x.com/b' FROM supplier WHERE s_suppkey % 4 > 1 AND s_suppkey % 2 = 1")
def src12_links(t):
    return providers.pixiv_accounts(_profiles(t))["links"].select("native_id", "context", "url")


@query("SRC12_pixiv_listing", "SELECT CAST(o_orderkey AS VARCHAR) AS post, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS position, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS continuation FROM orders")
def src12_listing(t):
    next_url = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("https://app/v1?user_id=1&offset="), F.col("o_custkey").cast("string")))
    g = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.col("o_orderkey"))).alias("ks"))
    body = F.to_json(F.struct(F.transform("ks", lambda k: F.struct(k.alias("id"), F.lit("t").alias("title"), F.lit("illust").alias("type"))).alias("illusts"), next_url.alias("next_url")))
    return providers.pixiv_listing(g.select(body.alias("body"))).select("post", "position", "continuation")


def _moving(t):
    k = F.col("p_partkey")
    frames = F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), lambda i: F.struct(F.concat(F.lpad(i.cast("string"), 6, "0"), F.lit(".jpg")).alias("file"), (i * 10 + 30).alias("delay")))
    there = F.to_json(F.struct(F.struct(F.struct(F.when(k % 2 == 0, "https://z/o").alias("original"), F.lit("https://z/m").alias("medium")).alias("zip_urls"), frames.alias("frames")).alias("ugoira_metadata")))
    gone = F.when(k % 6 == 0, '{"error":{"message":"The work was Deleted"}}').otherwise('{"error":{"message":"no"}}')
    return t.part.select(k.cast("string").alias("post"), F.when(k % 3 == 0, 404).otherwise(200).alias("status"), F.when(k % 3 == 0, gone).otherwise(there).alias("body"))


@query("SRC12_pixiv_ugoira", "SELECT p_partkey || ':ugoira' AS source_key, CASE WHEN p_partkey % 2 = 0 THEN 'https://z/o' ELSE 'https://z/m' END AS remote_url, CAST(p_size % 4 + 1 AS BIGINT) AS frames, CAST(sum(i * 10 + 30) AS BIGINT) AS delay_ms FROM part, range(4) r(i) WHERE p_partkey % 3 > 0 AND i <= p_size % 4 GROUP BY p_partkey, p_size")
def src12_ugoira(t):
    parts = providers.pixiv_ugoira(_moving(t))
    total = parts["frames"].groupBy("post").agg(F.count(F.lit(1)).alias("frames"), F.sum("delay_ms").alias("delay_ms"))
    return parts["media"].join(total, "post").select("source_key", "remote_url", "frames", "delay_ms")


@query("SRC12_pixiv_unavailable", "SELECT CAST(p_partkey AS VARCHAR) AS post, CASE WHEN p_partkey % 3 > 0 THEN 'available' WHEN p_partkey % 6 = 0 THEN 'deleted' ELSE 'unavailable' END AS availability FROM part")
def src12_unavailable(t):
    return providers.pixiv_ugoira(_moving(t))["posts"].select("post", "availability")


@query("SNK07_media_occurrences", "SELECT post, source_key, arg_max(remote_url, seq) AS remote_url, arg_min(md5, seq) FILTER (md5 IS NOT NULL) AS md5 FROM (SELECT l_orderkey AS post, 'k' || l_linenumber AS source_key, l_partkey * 100000 + l_suppkey AS seq, CASE WHEN l_tax > 0.02 THEN 'https://m/' || l_suppkey END AS remote_url, CASE WHEN l_discount > 0.05 THEN md5(CAST(l_partkey AS VARCHAR)) END AS md5 FROM lineitem) GROUP BY 1, 2")
def snk07(t):
    log = t.lineitem.select(
        F.col("l_orderkey").alias("post"), F.concat(F.lit("k"), F.col("l_linenumber").cast("string")).alias("source_key"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("seq"),
        F.when(F.col("l_tax") > 0.02, F.concat(F.lit("https://m/"), F.col("l_suppkey").cast("string"))).alias("remote_url"), F.when(F.col("l_discount") > 0.05, F.md5(F.col("l_partkey").cast("string"))).alias("md5"),
    )
    return merge.projection(log, ["post", "source_key"], ["seq"], {"remote_url": "newest_known", "md5": "first_known"})


@query("SNK14_post_references", "SELECT page_id, CAST(0 AS INTEGER) AS position, url FROM pages UNION ALL SELECT page_id, 1, 'https://b.example' FROM pages WHERE page_id % 2 = 0")
def snk14(t):
    listed = F.array(F.col("url"), F.when(F.col("page_id") % 2 == 0, "https://b.example").otherwise(""), F.col("url"))
    return links.post_references(t.pages.select("page_id", listed.alias("urls")), "page_id", "urls")


def _observed(t):
    k = F.col("o_custkey").cast("string")
    kind = F.col("o_orderkey") % 3
    url = F.when(kind == 0, F.concat(F.lit("https://x.com/a/status/"), k)).when(kind == 1, F.concat(F.lit("https://www.pixiv.net/users/"), k)).otherwise(F.concat(F.lit("https://none.example/"), k))
    rows = t.orders.select(F.lit("post").alias("subject_kind"), F.col("o_custkey").cast("string").alias("subject_id"), F.lit("post.text").alias("context"), kind.cast("string").alias("json_path"), url.alias("url"), F.col("o_orderkey").alias("seq"))
    return urls.with_reference(rows, "url")


_OBSERVED = "SELECT o_custkey AS k, o_orderkey % 3 AS kind, min(o_orderkey) AS seq FROM orders GROUP BY 1, 2"


@query("SNK15_link_targets", f"SELECT CASE kind WHEN 0 THEN 'x' ELSE 'pixiv' END AS platform, CAST(k AS VARCHAR) AS native_id, CASE WHEN kind = 1 AND k % 2 = 0 THEN k + 500000 END AS account_id, CASE WHEN kind = 0 AND k % 5 = 0 THEN k + 900000 END AS post_id FROM ({_OBSERVED}) WHERE kind < 2")
def snk15(t):
    c = F.col("c_custkey")
    accounts = t.customer.filter(c % 2 == 0).select(F.lit("pixiv").alias("platform"), c.cast("string").alias("native_id"), (c + 500000).alias("id"))
    posts = t.customer.filter(c % 5 == 0).select(F.lit("x").alias("platform"), c.cast("string").alias("native_id"), (c + 900000).alias("id"))
    return links.stored(_observed(t), accounts, posts)["references"].select("platform", "native_id", "account_id", "post_id")


@query("SNK15_link_observations", f"SELECT CAST(k AS VARCHAR) AS subject_id, CAST(kind AS VARCHAR) AS json_path, seq FROM ({_OBSERVED})")
def snk15_observations(t):
    none = t.customer.limit(0).select(F.lit("x").alias("platform"), F.lit("").alias("native_id"), F.col("c_custkey").alias("id"))
    return links.stored(_observed(t), none, none)["observations"].select("subject_id", "json_path", "seq")


@query(
    "SNK18_adoption_ledger",
    """WITH l AS (SELECT l_orderkey AS run, l_partkey AS item, max(l_linenumber) AS attempts, arg_max(l_returnflag, l_linenumber * 10 + CASE l_returnflag WHEN 'R' THEN 2 WHEN 'N' THEN 1 ELSE 0 END) AS f FROM lineitem GROUP BY 1, 2),
    r AS (SELECT o_orderkey AS run, count(l.item) AS items, count(*) FILTER (f IN ('R', 'N')) AS settled, CAST(coalesce(sum(attempts), 0) AS BIGINT) AS attempts FROM orders LEFT JOIN l ON l.run = o_orderkey GROUP BY 1)
    SELECT *, CASE WHEN settled = items THEN 'finished' WHEN settled > 0 THEN 'partial' ELSE 'running' END AS status FROM r""",
)
def snk18(t):
    outcome = F.when(F.col("l_returnflag") == "R", "existing").when(F.col("l_returnflag") == "N", "adopted").otherwise("failed")
    # of equal attempt numbers the greater outcome counts: adopted, existing, failed
    rank = F.when(F.col("l_returnflag") == "R", "existing").when(F.col("l_returnflag") == "N", "adopted").otherwise("!failed")
    attempts = t.lineitem.select(F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("item"), F.col("l_linenumber").cast("long").alias("attempt"), F.when(rank == "!failed", "!failed").otherwise(outcome).alias("outcome"))
    return ledgers.adoption_ledger(t.orders.select(F.col("o_orderkey").alias("run")), attempts.select("run", "item").distinct(), attempts)


@query(
    "SNK20_lookup_ledger",
    """SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failed, arg_max(event_id, event_id) FILTER (event_type <> 'error') AS checkpoint,
    count(DISTINCT CAST(floor(value) AS BIGINT)) FILTER (event_type = 'view') AS results FROM events GROUP BY 1""",
)
def snk20(t):
    e = t.events
    requests = e.select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("event_id").alias("continuation"))
    return ledgers.lookup_ledger(requests, e.filter("event_type = 'view'").select("user_id", F.floor("value").cast("long").alias("native_id")), ["user_id"])


@query(
    "SNK23_likes_media",
    """WITH m AS (SELECT o_custkey AS post, o_orderkey % 4 AS i, o_orderkey AS seq, 'u' || o_orderkey AS url FROM orders), b AS (SELECT post, max(seq) AS last FROM m GROUP BY 1),
    d AS (SELECT post, i, 300 AS since FROM (SELECT DISTINCT post, i FROM m) WHERE (post + i) % 3 = 0)
    SELECT m.post, m.i AS index, coalesce(arg_max(url, seq) FILTER (since IS NULL OR seq < since), NULL) AS source_url, CASE WHEN max(since) IS NOT NULL THEN 'p' || m.post END AS local_path, CASE WHEN max(since) IS NULL THEN 'timeout' END AS error
    FROM m JOIN b ON b.post = m.post LEFT JOIN d ON d.post = m.post AND d.i = m.i GROUP BY m.post, m.i HAVING max(since) IS NOT NULL OR max(seq) = max(last)""",
)
def snk23(t):
    listed = t.orders.select(F.col("o_custkey").alias("post"), (F.col("o_orderkey") % 4).alias("index"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("source_url"), F.col("o_orderkey").alias("seq"))
    got = (F.col("post") + F.col("index")) % 3 == 0
    tries = listed.select("post", "index").distinct().select("post", "index", F.lit(300).cast("long").alias("seq"), F.when(got, F.concat(F.lit("p"), F.col("post").cast("string"))).alias("local_path"), F.when(~got, "timeout").alias("error"))
    return ledgers.likes_media(listed, tries)


@query("SNK25_browser_store", "SELECT user_id AS key, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'error' AND event_id > (SELECT max(event_id) FROM events WHERE event_type = 'error' AND event_id % 7 = 0) - 5000 GROUP BY 1 HAVING max(event_id) > 0")
def snk25(t):
    # the store was cleared 5000 events before the last error that counts
    last = t.events.filter("event_type = 'error' AND event_id % 7 = 0").agg((F.max("event_id") - 5000).alias("event_id"))
    log = t.events.filter("event_type <> 'error'").select(F.col("user_id").alias("key"), "value", "event_id", F.lit(False).alias("cleared"))
    clear = last.select(F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("value"), "event_id", F.lit(True).alias("cleared"))
    return ledgers.kept_state(log.unionByName(clear), "key", "value", "event_id", F.col("cleared"))


@query(
    "STR05_post_occurrences",
    """SELECT CAST(doc_id AS VARCHAR) AS post, 'https://x.com/i/status/' || doc_id AS url, 'post.canonical' AS context, '$.canonical_url' AS json_path FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'https://t.example/' || doc_id, 'post.text', '$.text_content[0]' FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'https://s.example/' || doc_id, 'post.source', '$.data[0].source' FROM documents WHERE doc_id % 2 = 0""",
)
def str05(t):
    k = F.col("doc_id").cast("string")
    posts = t.documents.select(k.alias("post"), F.concat(F.lit("https://x.com/i/status/"), k).alias("canonical_url"), F.concat(F.lit("see <https://t.example/"), k, F.lit(">.")).alias("text"))
    payloads = t.documents.select(k.alias("post"), F.concat(F.lit('{"data":[{"source":"'), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://s.example/"), k)).otherwise("none"), F.lit('"}]}')).alias("payload"))
    return links.post_occurrences(posts, payloads.lateralJoin(jsons.PayloadLinks(F.col("payload").outer())))


@query("STR08_public_urls", "SELECT event_id, 'https://h.example/a?page=' || event_id || '&token=%3Credacted%3E' AS shown FROM events")
def str08(t):
    url = F.concat(F.lit("https://user:secret@H.example/a?page="), F.col("event_id").cast("string"), F.lit("&token="), F.col("event_type"), F.lit("#part"))
    return t.events.select("event_id", urls.public_url(url).alias("shown"))


@query("STR12_escaped_search", r"SELECT p_partkey, p_name || '50%_\' AS name FROM part WHERE contains(lower(p_name || '50%_\'), '0%_\')")
def str12(t):
    name = F.concat("p_name", F.lit("50%_\\"))
    return t.part.select("p_partkey", name.alias("name")).filter(search.holds(F.col("name"), "0%_\\") & ~search.holds(F.col("name"), "5%0"))


@query(
    "STM05_lookup_loop",
    """WITH p AS (SELECT l_orderkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS page, CASE WHEN l_quantity > 45 THEN 'failed' ELSE 'success' END AS status, CAST(l_suppkey % 50 AS BIGINT) AS results,
      CASE WHEN l_tax < 0.07 THEN 'after:' || l_partkey END AS c FROM lineitem),
    q AS (SELECT *, coalesce(bool_and(status = 'success' AND c IS NOT NULL) OVER w, TRUE) AS open_, coalesce(sum(results) OVER w, 0) AS had FROM p WINDOW w AS (PARTITION BY item ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    u AS (SELECT * FROM q WHERE open_ AND page <= 3 AND had < 60)
    SELECT item, count(*) AS requests, CAST(coalesce(sum(results) FILTER (status = 'success'), 0) AS BIGINT) AS results, max(CASE WHEN status = 'success' AND page = ok THEN c END) AS checkpoint,
      CASE WHEN max(CASE WHEN page = n THEN status END) <> 'success' THEN 'failed' WHEN max(CASE WHEN page = n THEN c END) IS NULL THEN 'complete' ELSE 'deferred' END AS state
    FROM (SELECT *, max(page) OVER (PARTITION BY item) AS n, max(page) FILTER (status = 'success') OVER (PARTITION BY item) AS ok FROM u) GROUP BY 1""",
)
def stm05(t):
    from pyspark.sql import Window

    page = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    pages = t.lineitem.select(
        F.col("l_orderkey").alias("item"), page.alias("page"), F.when(F.col("l_quantity") > 45, "failed").otherwise("success").alias("status"), (F.col("l_suppkey") % 50).alias("results"),
        F.when(F.col("l_tax") < 0.07, F.concat(F.lit("after:"), F.col("l_partkey").cast("string"))).alias("continuation"),
    )
    return lookup.executed(pages, ["item"], {"requests": 3, "results": 60})[1]


@query("MTH06_limits", "SELECT 'requests' AS name, 3 AS value, TRUE AS allowed UNION ALL SELECT 'pages', 101, FALSE UNION ALL SELECT 'results', 0, FALSE UNION ALL SELECT 'seconds', 3600, TRUE")
def mth06(t):
    def allowed(value, low, high, name):
        try:
            return scores.bounded(value, low, high, name) == value
        except ValueError:
            return False

    asked = [("requests", 3, 1, 100), ("pages", 101, 1, 100), ("results", 0, 1, 10_000), ("seconds", 3600, 1, 3600)]
    return t.spark.createDataFrame([(n, v, allowed(v, low, high, n)) for n, v, low, high in asked], "name string, value int, allowed boolean")


@query("UDF03_instances", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'danbooru' WHEN 1 THEN 'mastodon' END AS platform FROM pages")
def udf03(t):
    k = F.col("page_id")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://own.example/posts/"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("https://m.example/@bob/"), k.cast("string"))).otherwise(F.concat(F.lit("https://other.example/posts/"), k.cast("string")))
    hosts = urls.Hosts(boorus={"own.example": "danbooru"}, mastodons=("m.example",))
    return urls.with_reference(t.pages.select("page_id", url.alias("url")), "url", hosts).select("page_id", F.col("reference.platform").alias("platform"))


@query("SRC05_export_texts", "SELECT CAST(doc_id AS VARCHAR) AS native_id, text FROM documents")
def export_texts(t):
    return _export(t)["posts"].filter("observed_at IS NOT NULL").select("native_id", "text")

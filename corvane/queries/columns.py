"""Column functions over the driver's tables (STR, DAT, HSH, JSN, MTH)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsons, scores, times, urls
from ..functions import text as X
from ..operators import ledgers
from . import query

_SITE = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(
    "STR01_canonical_urls",
    r"""SELECT page_id, regexp_extract(url, '^([a-zA-Z]+)://', 1) || '://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) || CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE '' END || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*(.*)$', 1) AS canonical_url, 'unresolved' AS state FROM pages""",
)
def str01(t):
    return urls.with_canonical(t.pages.select("page_id", "url"), "url").select("page_id", "canonical_url", "state")


def _shared(t):
    """Page URLs moved to understood hosts, with tracking keys."""
    path = F.element_at(F.array(F.lit("/Bob/status/12"), F.lit("/@Bob"), F.lit("/en/artworks/7"), F.lit("/posts/9/"), F.lit("/x")), (F.col("page_id") % 5 + 1).cast("int"))
    host = F.element_at(F.array(F.lit("twitter.com"), F.lit("WWW.X.com"), F.lit("pixiv.net"), F.lit("danbooru.donmai.us:443"), F.lit("linktr.ee")), (F.col("page_id") % 5 + 1).cast("int"))
    return t.pages.select("page_id", F.concat(F.lit("https://"), host, path, F.lit("?utm_source=a&p="), F.col("page_id").cast("string"), F.lit("#f")).alias("url"))


@query(
    "STR02_recognised_urls",
    """SELECT page_id, state, reason, platform, object_kind, native_id, identifier_kind, CASE page_id % 5 WHEN 4 THEN 'https://linktr.ee/x?utm_source=a&p=' || page_id || '#f' ELSE base || '?p=' || page_id END AS canonical_url FROM (
      SELECT page_id, CASE page_id % 5 WHEN 4 THEN 'unresolved' ELSE 'recognized' END AS state, CASE page_id % 5 WHEN 4 THEN 'link_hub' END AS reason,
      ['x', 'x', 'pixiv', 'danbooru', NULL][page_id % 5 + 1] AS platform, ['post', 'account', 'post', 'post', NULL][page_id % 5 + 1] AS object_kind, ['12', 'bob', '7', '9', NULL][page_id % 5 + 1] AS native_id,
      ['stable_id', 'handle', 'stable_id', 'stable_id', NULL][page_id % 5 + 1] AS identifier_kind, ['https://x.com/Bob/status/12', 'https://x.com/@Bob', 'https://www.pixiv.net/en/artworks/7', 'https://danbooru.donmai.us/posts/9', NULL][page_id % 5 + 1] AS base FROM pages)""",
)
def str02(t):
    r = urls.with_reference(_shared(t), "url")
    return r.select("page_id", "state", "reason", "reference.platform", "reference.object_kind", "reference.native_id", "reference.identifier_kind", "canonical_url")


@query("STR03_extracted_urls", r"SELECT page_id, place, rtrim(u, '.,;:!?') AS url FROM (SELECT page_id, unnest(l) AS u, unnest(range(len(l))) AS place FROM (SELECT page_id, regexp_extract_all('see ' || url || '. ' || html || ' (' || url || ')', '(https?://[^\s<>\]\[(){}""'']+)', 1) AS l FROM pages))")
def str03(t):
    text = F.concat(F.lit("see "), F.col("url"), F.lit(". "), F.col("html"), F.lit(" ("), F.col("url"), F.lit(")"))
    return t.pages.select("page_id", F.posexplode(urls.extract_urls(text)).alias("place", "url")).select("page_id", F.col("place").cast("long").alias("place"), "url")


@query("STR04_field_occurrences", "SELECT page_id, 'account.bio' AS context, '$.bio[' || i || ']' AS json_path, url FROM pages, range(2) r(i) UNION ALL SELECT page_id, 'account.website', '$.website_url', url FROM pages")
def str04(t):
    bio = t.pages.select("page_id", F.lit("account.bio").alias("context"), F.posexplode(urls.extract_urls(F.concat("url", F.lit(" "), "url"))).alias("i", "url"))
    bio = bio.select("page_id", "context", F.concat(F.lit("$.bio["), F.col("i").cast("string"), F.lit("]")).alias("json_path"), "url")
    site = t.pages.select("page_id", F.lit("account.website").alias("context"), F.lit("$.website_url").alias("json_path"), F.explode(urls.extract_urls(F.col("url"))).alias("url"))
    return bio.unionByName(site)


@query("STR06_references", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'post' WHEN 1 THEN 'account' END AS kind, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey END AS id FROM orders")
def str06(t):
    word = F.element_at(F.array(F.lit("post:"), F.lit("account:"), F.lit("pool:")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    r = X.match_reference(F.concat(word, F.col("o_orderkey").cast("string")))
    return t.orders.select("o_orderkey", r.alias("r")).select("o_orderkey", "r.kind", "r.id")


@query("STR09_aliases", "SELECT doc_id, unnest(['https://x.com/a/status/' || doc_id, 'https://twitter.com/a/status/' || doc_id]) AS url FROM documents")
def str09(t):
    return t.documents.select("doc_id", F.explode(urls.x_aliases(F.concat(F.lit("https://twitter.com/a/status/"), F.col("doc_id").cast("string")))).alias("url"))


@query("STR10_same_post", "SELECT page_id, page_id % 5 IN (0, 2, 3) AS same FROM pages")
def str10(t):
    a = urls.with_reference(_shared(t), "url").select("page_id", F.col("reference").alias("a"))
    b = urls.with_reference(_shared(t).withColumn("url", F.replace("url", F.lit("twitter.com"), F.lit("mobile.twitter.com"))), "url").select("page_id", F.col("reference").alias("b"))
    return a.join(b, "page_id").select("page_id", urls.same_post(F.col("a"), F.col("b")).alias("same"))


@query("STR11_reference_urls", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'https://www.pixiv.net/artworks/' || c_custkey ELSE 'urn:x:post:' || c_custkey END AS url FROM customer")
def str11(t):
    return t.customer.select("c_custkey", urls.reference_url(F.when(F.col("c_custkey") % 2 == 0, "pixiv").otherwise("x"), F.lit("post"), F.col("c_custkey").cast("string")).alias("url"))


@query("STR13_first_filled", "SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN '  ' END), ''), nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN ' a ' END), ''), c_name) AS value FROM customer")
def str13(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", X.first_filled(F.when(k % 2 == 0, "  "), F.when(k % 3 == 0, " a "), F.col("c_name")).alias("value"))


@query("STR14_real_names", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'bob' END AS handle FROM customer")
def str14(t):
    k = F.col("c_custkey").cast("string")
    return t.customer.select("c_custkey", X.real_handle(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("user_"), k)).otherwise("bob"), k).alias("handle"))


@query("STR15_media_types", "SELECT p_partkey, ['image/png', 'image/jpeg', 'video/webm', NULL][p_partkey % 4 + 1] AS mime FROM part")
def str15(t):
    return t.part.select("p_partkey", X.media_type(F.element_at(F.array(F.lit("PNG"), F.lit(".jpg"), F.lit("webm"), F.lit("xyz")), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("mime"))


@query("STR16_destinations", f"SELECT page_id, starts_with(url, 'https://') AND ends_with(lower({_SITE}), '.example.com') AS allowed FROM pages")
def str16(t):
    return t.pages.select("page_id", urls.allowed_destination(F.col("url"), ("example.com",)).alias("allowed"))


@query("STR17_request_identity", "SELECT o_orderkey, 'danbooru:post:' || o_orderkey || ':limit=20:page=' || o_custkey AS identity FROM orders")
def str17(t):
    params = F.create_map(F.lit("page"), F.col("o_custkey").cast("string"), F.lit("limit"), F.lit("20"))
    return t.orders.select("o_orderkey", X.semantic_identity([F.lit("danbooru"), F.lit("post"), F.col("o_orderkey").cast("string")], params).alias("identity"))


@query("STR18_safe_paths", r"SELECT page_id, path <> '' AND NOT regexp_matches(path, '(^/|//|/$|(^|/)\.\.?(/|$)|\\)') AS safe FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a/../b' WHEN 1 THEN 'a/b' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS path FROM pages)")
def str18(t):
    path = F.when(F.col("page_id") % 3 == 0, "a/../b").when(F.col("page_id") % 3 == 1, "a/b").otherwise(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1))
    return t.pages.select("page_id", X.safe_path(path).alias("safe"))


@query("STR19_file_names", "SELECT n_nationkey, regexp_replace(n_name, '[^A-Za-z0-9._-]', '_', 'g') || '_' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS name FROM nation")
def str19(t):
    return t.nation.select("n_nationkey", X.file_name(F.col("n_name"), F.col("n_nationkey")).alias("name"))


@query("STR20_query_terms", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'md5:' || md5(text) WHEN 1 THEN 'source:' || md5(text) END AS term FROM documents")
def str20(t):
    strategy = F.element_at(F.array(F.lit("md5"), F.lit("source_url"), F.lit("other")), (F.col("doc_id") % 3 + 1).cast("int"))
    return t.documents.select("doc_id", X.query_term(strategy, F.md5("text")).alias("term"))


@query("STR21_header_values", "SELECT o_orderkey, o_orderkey % 2 = 0 AS strong, o_orderkey AS first, o_orderkey + 9 AS last, o_custkey + o_orderkey AS total FROM orders")
def str21(t):
    k = F.col("o_orderkey")
    tag = F.when(k % 2 == 0, '"abc"').otherwise('W/"abc"')
    span = X.content_range(F.concat(F.lit("bytes "), k.cast("string"), F.lit("-"), (k + 9).cast("string"), F.lit("/"), (F.col("o_custkey") + k).cast("string")))
    return t.orders.select("o_orderkey", X.strong_etag(tag).alias("strong"), span.alias("r")).select("o_orderkey", "strong", "r.first", "r.last", "r.total")


@query("DAT01_utc_text", "SELECT event_id, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || 'Z' AS at FROM events")
def dat01(t):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    return t.events.select("event_id", times.utc_text(times.strict(text)).alias("at"))


@query("DAT02_lenient_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def dat02(t):
    ts = F.date_trunc("second", "ts")
    form = F.when(F.col("event_id") % 2 == 0, F.concat(F.date_format(ts, "E MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format(ts, "yyyy"))).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    return t.events.select("event_id", times.utc_text(times.lenient(form)).alias("at"))


@query("DAT03_retry_after", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 90.0::DOUBLE WHEN 1 THEN 30.0::DOUBLE END AS wait FROM events")
def dat03(t):
    ts = F.date_trunc("second", "ts").cast("timestamp")
    later = F.timestamp_seconds(F.unix_seconds(ts) + 30)
    header = F.when(F.col("event_id") % 3 == 0, "90").when(F.col("event_id") % 3 == 1, F.concat(F.date_format(later, "E, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("soon")
    return t.events.select("event_id", times.retry_after(header, ts).alias("wait"))


@query("DAT04_later_or_equal", "SELECT event_id, event_id % 2 = 0 AS later FROM events")
def dat04(t):
    second = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    a = F.concat(second, F.when(F.col("event_id") % 2 == 0, ".5Z").otherwise("Z"))
    b = F.concat(second, F.when(F.col("event_id") % 2 == 0, "Z").otherwise(".5Z"))
    return t.events.select("event_id", times.later_or_equal(a, b).alias("later"))


@query("HSH01_array_digest", """SELECT doc_id, sha256('{"c0":"' || lang || '","c1":"' || source || '"}') AS digest FROM documents""")
def hsh01(t):
    return t.documents.select("doc_id", jsons.digest(F.col("lang"), F.col("source")).alias("digest"))


@query("HSH02_object_digest", """SELECT o_orderkey, sha256('{"c0":' || o_orderkey || ',"c1":' || coalesce('"' || nullif(o_orderstatus, 'P') || '"', 'null') || '}') AS digest FROM orders""")
def hsh02(t):
    return t.orders.select("o_orderkey", jsons.digest(F.col("o_orderkey"), F.nullif(F.col("o_orderstatus"), F.lit("P"))).alias("digest"))


@query("HSH03_content_hashes", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, CAST(strlen(text) AS INTEGER) AS size FROM documents")
def hsh03(t):
    return ledgers.content_record(t.documents, "text").select("doc_id", "sha256", "md5", "size")


@query("HSH04_plan_digest", "SELECT l_orderkey, sha256(string_agg(sha256(CAST(l_partkey AS VARCHAR)), '|' ORDER BY l_linenumber, l_partkey)) AS digest FROM lineitem GROUP BY 1")
def hsh04(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    return g.select("l_orderkey", F.sha2(F.array_join(F.transform("items", lambda i: F.sha2(i["l_partkey"].cast("string"), 256)), "|"), 256).alias("digest"))


@query(
    "JSN01_variants",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'invalid_variants' WHEN 2 THEN 'ambiguous_variant' END AS error, CASE o_orderkey % 4 WHEN 0 THEN 'original,primary' WHEN 3 THEN 'archive,primary' ELSE 'primary' END AS roles FROM orders""",
)
def jsn01(t):
    k = F.col("o_orderkey")
    url = F.concat(F.lit("u"), k.cast("string"))
    doc = F.when(k % 4 == 0, '{"variants":[{"role":"original","url":"o"}]}').when(k % 4 == 1, "[1]").when(k % 4 == 2, '{"variants":[{"role":"primary","url":"z"}]}').otherwise('{"archive":{"url":"z"}}')
    v = jsons.with_variants(t.orders.select("o_orderkey", url.alias("remote_url"), F.lit(None).cast("string").alias("preview_url"), doc.alias("variants_json")))
    return v.select("o_orderkey", "variants.error", F.array_join(jsons.shown_roles(F.col("variants.urls"))["roles"], ",").alias("roles"))


@query("JSN03_payload_links", "SELECT event_id, 'https://h/' || event_id AS url, ['post.entity', 'post.quote', 'post.source'][i + 1] AS context, ['$.tweet.entities.urls[0].expanded_url', '$.quoted_tweet.card[1].url', '$.data[0].source'][i + 1] AS json_path FROM events, range(3) r(i)")
def jsn03(t):
    url = F.concat(F.lit("https://h/"), F.col("event_id").cast("string"))
    doc = F.concat(F.lit('{"tweet":{"entities":{"urls":[{"expanded_url":"see '), url, F.lit('."}]}},"quoted_tweet":{"card":[1,{"url":"'), url, F.lit('"}]},"data":[{"source":"'), url, F.lit('"}],"url":"https://no"}'))
    rows = t.events.select("event_id", doc.alias("payload"))
    return rows.lateralJoin(jsons.PayloadLinks(F.col("payload").outer())).select("event_id", "url", "context", "json_path")


@query("JSN04_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def jsn04(t):
    return t.events.select("event_id", jsons.typed(F.parse_json("props"), "$.k", "int").alias("k"))


@query("JSN06_positions", "SELECT vec_id, i AS pos, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(4) r(i) WHERE embedding[i + 1] > 0")
def jsn06(t):
    e = t.embeddings.select("vec_id", F.posexplode(F.slice("embedding", 1, 4)).alias("pos", "x"))
    return e.filter("x > 0").select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))


@query("JSN07_map_rows", "SELECT event_id, key, value FROM (SELECT event_id, unnest(['k', 'type']) AS key, unnest([json_extract_string(props, '$.k'), event_type]) AS value FROM events)")
def jsn07(t):
    m = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type"))
    return t.events.select("event_id", F.explode(m))


@query("JSN08_type_guards", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id END AS n, CASE event_id % 3 WHEN 1 THEN 'x' END AS s, CASE event_id % 3 WHEN 2 THEN TRUE END AS b FROM events")
def jsn08(t):
    k = F.col("event_id")
    value = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, '"x"').otherwise("true")
    v = t.events.select("event_id", F.parse_json(F.concat(F.lit('{"v":'), value, F.lit("}"))).alias("v"))
    return v.select("event_id", jsons.typed(F.col("v"), "$.v", "int").alias("n"), jsons.typed(F.col("v"), "$.v", "string").alias("s"), jsons.typed(F.col("v"), "$.v", "boolean").alias("b"))


@query("JSN09_numeric_ids", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey > 0 THEN CAST(o_orderkey AS VARCHAR) END AS id FROM orders")
def jsn09(t):
    k = F.col("o_orderkey").cast("string")
    return t.orders.select("o_orderkey", jsons.numeric_id(F.when(F.col("o_orderkey") % 2 == 0, k).otherwise(F.concat(F.lit("0"), k))).alias("id"))


@query("MTH01_strengths", "SELECT event_type, CASE event_type WHEN 'view' THEN 100 WHEN 'click' THEN 70 WHEN 'error' THEN 35 ELSE 10 END AS score, count(*) AS n FROM events GROUP BY 1")
def mth01(t):
    strength = F.when(F.col("event_type") == "view", "exact").when(F.col("event_type") == "click", "strong").when(F.col("event_type") == "error", "moderate").otherwise("weak")
    return t.events.groupBy("event_type", scores.strength_score(strength).alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("MTH02_least_of", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN least(o_orderkey, o_custkey) END AS low, CASE WHEN o_orderkey % 4 > 0 THEN greatest(o_orderkey, o_custkey) END AS high FROM orders")
def mth02(t):
    a = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey"))
    return t.orders.select("o_orderkey", scores.least_of(a, F.col("o_custkey")).alias("low"), scores.greatest_of(a, F.col("o_custkey")).alias("high"))


@query("MTH03_status_outcomes", "SELECT code, CASE WHEN code BETWEEN 200 AND 299 THEN 'success' WHEN code IN (404, 410) THEN 'unavailable' WHEN code IN (401, 403) THEN 'authentication_failed' WHEN code = 429 THEN 'rate_limited' WHEN code >= 500 THEN 'transient_failure' ELSE 'permanent_failure' END AS outcome, count(*) AS n FROM (SELECT CAST(200 + o_orderkey % 350 AS BIGINT) AS code FROM orders) GROUP BY 1")
def mth03(t):
    c = t.orders.select((F.col("o_orderkey") % 350 + 200).alias("code"))
    return c.groupBy("code", scores.status_outcome(F.col("code")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("MTH04_backoff", "SELECT l_linenumber, round(pow(2.0, l_linenumber) * (0.7 + 0.5 * 0.8), 6) AS seconds FROM lineitem GROUP BY 1")
def mth04(t):
    return t.lineitem.select("l_linenumber").distinct().select("l_linenumber", F.round(scores.backoff_seconds(F.col("l_linenumber"), F.lit(0.5)), 6).alias("seconds"))


@query("MTH05_flags", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'unknown') AS status, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS large FROM orders")
def mth05(t):
    return t.orders.select("o_orderkey", F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("O")), F.lit("unknown")).alias("status"), (F.col("o_totalprice") > 200000).cast("int").alias("large"))

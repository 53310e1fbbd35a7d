"""Ledgers, recipes, targets, pacing and further normalisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsons
from ..operators import ledgers, merge, search
from ..plans import acquisition, discovery, library
from ..sources import files, providers, timeline
from ..streaming import pages
from . import query


@query(
    "PLN13_manual_pairs",
    "SELECT least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high, min(CASE WHEN l_returnflag = 'N' THEN 'same_work' ELSE 'same_work' END) AS relation, count(*) AS evidence FROM lineitem WHERE l_discount = 0.05 GROUP BY 1, 2",
)
def pln13(t):
    return discovery.merged_pairs(t.lineitem.filter("l_discount = 0.05").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.lit("same_work").alias("relation"), F.lit(1).alias("evidence")))


@query("PLN18_request_recipes", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'media_original' WHEN 1 THEN 'media_preview' ELSE 'media_variant' END AS operation, page_id % 2 = 0 AND starts_with(url, 'https://') AND ends_with(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '.example.com') AS allowed FROM pages")
def pln18(t):
    variant = F.element_at(F.array(F.lit("primary"), F.lit("preview"), F.lit("sample")), (F.col("page_id") % 3 + 1).cast("int"))
    items = t.pages.select("page_id", F.when(F.col("page_id") % 2 == 0, "a").otherwise("b").alias("platform"), variant.alias("variant"), "url")
    return acquisition.recipes(items, {"a": ("example.com",)}).select("page_id", "operation", "allowed")


@query("PLN22_drifted", "SELECT user_id FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'view'")
def pln22(t):
    log = t.events.select("user_id", "event_id", F.col("event_type").alias("name"))
    held = t.events.select("user_id").distinct().withColumn("name", F.lit("view"))
    return library.drifted(held, log, "user_id", ["name"], ["event_id"])


@query(
    "PLN23_rendered_targets",
    "SELECT c_custkey AS target, CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_custkey ELSE coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'tag' END, (SELECT arg_max(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey = c_custkey)) END AS rendered FROM customer",
)
def pln23(t):
    k = F.col("c_custkey")
    targets = t.customer.select(k.alias("target"), F.when(k % 2 == 0, "account").otherwise("attribution").alias("kind"), k.alias("id"))
    accounts = t.customer.select(k.alias("id"), F.concat(F.lit("n"), k.cast("string")).alias("native_id"))
    names = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"), F.lit(0).alias("observed_at"), F.col("o_orderkey").alias("seq"))
    tags = t.customer.filter("c_custkey % 3 = 0").select(k.alias("id"), F.lit("tag").alias("name"))
    return library.rendered_targets(targets, accounts, names, tags)


@query(
    "STM03_pacing",
    """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 429 WHEN 'view' THEN 200 ELSE 404 END AS code, CASE WHEN event_id % 2 = 0 THEN 5.0 END AS retry_after FROM events),
    g AS (SELECT *, count(*) FILTER (code <> 429) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id AS since FROM e),
    n AS (SELECT *, count(*) FILTER (code = 429) OVER (PARTITION BY user_id, s ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS nth FROM g)
    SELECT user_id, event_id, CAST(CASE WHEN code = 429 AND nth <= 1 THEN coalesce(retry_after, 1.0) WHEN code = 200 THEN greatest(0.0, 100.0 - coalesce(since, 100.0)) END AS DOUBLE) AS wait FROM n""",
)
def stm03(t):
    code = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "view", 200).otherwise(404)
    r = t.events.select("user_id", "event_id", F.col("event_id").cast("double").alias("at"), code.alias("code"), F.when(F.col("event_id") % 2 == 0, F.lit(5.0)).alias("retry_after"))
    return pages.waits(r, ["user_id"], "event_id", interval=100.0, retries=1).select("user_id", "event_id", "wait")


@query("STM04_resumed_runs", "SELECT c_custkey, c_mktsegment, (SELECT arg_max('b' || o_orderkey, o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND c_mktsegment = 'BUILDING') AS continuation FROM customer")
def stm04(t):
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("continuation"))
    return pages.resumable(done, t.customer.select("c_custkey", "c_mktsegment"), ["c_custkey", "c_mktsegment"])


@query("STM09_continuations", "SELECT o_custkey AS page, CASE WHEN count(*) >= 8 THEN 'b' || min(o_orderkey) END AS continuation, max(o_orderkey) < 14000 AS valid FROM orders GROUP BY 1")
def stm09(t):
    g = t.orders.groupBy(F.col("o_custkey").alias("page")).agg(F.sort_array(F.collect_list("o_orderkey"), asc=False).alias("ids")).withColumn("boundary", F.lit(14000))
    return pages.continuations(g, 8)


@query(
    "STM12_state_machine",
    """WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'planned' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END AS state FROM events),
    l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM s)
    SELECT user_id, event_id, before, state FROM l WHERE before IS NOT NULL AND NOT (before = 'planned' AND state = 'running' OR before = 'running' AND state IN ('completed', 'failed'))""",
)
def stm12(t):
    state = F.when(F.col("event_type") == "view", "planned").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed").otherwise("completed")
    return acquisition.bad_steps(t.events.select("user_id", "event_id", state.alias("state")), ["user_id"], "event_id")


@query("SNK11_tag_observations", "SELECT o_custkey, o_orderpriority AS name, min(o_orderkey) AS first_id, count(*) AS n FROM orders GROUP BY 1, 2")
def snk11(t):
    log = t.orders.select("o_custkey", F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("first_id"))
    once = merge.earliest(log, ["o_custkey", "name"], ["first_id"])
    return once.join(log.groupBy("o_custkey", "name").agg(F.count(F.lit(1)).alias("n")), ["o_custkey", "name"])


@query("SNK17_run_ledger", "SELECT user_id AS run, count(*) AS requests, arg_max(event_type, event_id) AS status, max(event_id) AS checkpoint FROM events GROUP BY 1")
def snk17(t):
    return ledgers.run_ledger(t.events, "user_id", "event_id", "event_type")


@query("SNK21_conflicting_plans", "SELECT o_custkey AS plan, count(DISTINCT o_orderpriority) AS owners FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def snk21(t):
    return merge.key_conflicts(t.orders.select(F.col("o_custkey").alias("plan"), "o_orderpriority"), ["plan"], "o_orderpriority")


@query("SNK28_rendered_rows", """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS shown FROM nation""")
def snk28(t):
    return t.nation.select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("shown"))


@query("UDF06_inverted_index", r"SELECT token, item_id, string_agg(place, ',' ORDER BY place) AS places FROM (SELECT item_id, unnest(l) AS token, unnest(range(len(l))) AS place FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS l FROM benchmark)) GROUP BY 1, 2")
def udf06(t):
    i = search.inverted_index(t.benchmark, "item_id", "text")
    return i.select("token", "item_id", F.array_join(F.transform("places", lambda p: p.cast("string")), ",").alias("places"))


@query("HSH05_material_digests", """SELECT doc_id, sha256('{"c0":"md5","c1":"' || md5(text) || '"}') AS digest FROM documents""")
def hsh05(t):
    return t.documents.select("doc_id", jsons.digest(F.lit("md5"), F.md5("text")).alias("digest"))


@query("JSN02_shown_roles", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN 'primary' ELSE 'a,b' END AS roles, o_orderkey % 3 = 2 AS truncated FROM orders")
def jsn02(t):
    k = F.col("o_orderkey") % 3
    one = lambda *rs: F.map_from_entries(F.array(*[F.struct(F.lit(r).alias("k"), F.lit("u").alias("v")) for r in rs]))
    m = F.when(k == 0, one("b", "a")).when(k == 1, F.map_filter(one("a"), lambda x, y: F.lit(False))).otherwise(one("c", "b", "a"))
    s = jsons.shown_roles(m, most=2)
    return t.orders.select("o_orderkey", s.alias("s")).select("o_orderkey", F.array_join("s.roles", ",").alias("roles"), "s.truncated")


@query("SRC02_like_members", r"SELECT n_nationkey, n_nationkey % 4 < 2 AS taken FROM nation")
def src02(t):
    from ..sources.likes import MEMBER

    name = F.element_at(F.array(F.lit("x/data/like.js"), F.lit("data/likes-part2.js"), F.lit("data/like.json"), F.lit("other/like.js")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return t.nation.select("n_nationkey", name.rlike(MEMBER).alias("taken"))


@query("SRC21_fixture_cases", "SELECT 'danbooru' AS provider, 'case' || r_regionkey AS name, CAST(200 + r_regionkey AS INTEGER) AS status FROM region")
def src21(t):
    case = F.concat(F.lit('{"name":"case'), F.col("r_regionkey").cast("string"), F.lit('","operation":"post","response":{"status_code":'), (F.col("r_regionkey") + 200).cast("string"), F.lit(',"body":{"id":1}},"expected":{}}'))
    suite = t.region.agg(F.array_join(F.collect_list(case), ",").alias("c")).select(F.concat(F.lit('{"manifest":{"provider":"danbooru"},"cases":['), "c", F.lit("]}")).alias("json"))
    return providers.fixture_cases(suite).select("provider", "name", "status")


@query("SRC25_tweets", "SELECT CAST(o_orderkey AS VARCHAR) AS post_id, CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS text, o_custkey AS likes, '9,5,0' AS bitrates, 'v' AS card FROM orders")
def src25(t):
    note = F.when(F.col("o_orderkey") % 2 == 0, '"note_tweet":{"note_tweet_results":{"result":{"text":"long"}}},').otherwise("")
    inner = F.concat(
        F.lit('{"rest_id":"'), F.col("o_orderkey").cast("string"), F.lit('",'), note, F.lit('"card":{"legacy":{"binding_values":[{"key":"k","value":{"string_value":"v"}}]}},"legacy":{"full_text":"short","favorite_count":'), F.col("o_custkey").cast("string"),
        F.lit(',"extended_entities":{"media":[{"type":"video","video_info":{"variants":[{"bitrate":5,"content_type":"video/mp4"},{"content_type":"x"},{"content_type":"video/mp4"},{"bitrate":9,"content_type":"video/mp4"}]}}]}}}'),
    )
    whole = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"tweet":'), inner, F.lit("}"))).otherwise(inner)
    d = timeline.tweets(t.orders.select(whole.alias("tweet")))
    rates = F.array_join(F.transform(F.element_at("media", 1)["variants"], lambda v: F.coalesce(v["bitrate"], F.lit(0)).cast("string")), ",")
    return d.select("post_id", "text", "likes", rates.alias("bitrates"), F.element_at("card", "k").alias("card"))


@query("SRC26_folders", "SELECT CAST(n_nationkey AS VARCHAR) AS folder_id, n_name AS name, 'c' AS cursor FROM nation")
def src26(t):
    item = F.concat(F.when(F.col("n_nationkey") % 2 == 0, '{"id":"').otherwise('{"collection_id":"'), F.col("n_nationkey").cast("string"), F.lit('","name":"'), "n_name", F.lit('"}'))
    body = t.nation.groupBy("n_regionkey").agg(F.array_join(F.collect_list(item), ",").alias("i")).select(F.concat(F.lit('{"items":['), "i", F.lit('],"cursor":"c"}')).alias("body"))
    return timeline.folders(body)


@query("SRC29_adoption_candidates", "SELECT doc_id AS occurrence_id, CASE WHEN doc_id % 4 = 0 THEN 'unsafe_path' WHEN doc_id % 4 = 1 THEN 'missing' WHEN n_chars > 1500 THEN 'limit_exceeded' ELSE 'eligible' END AS status FROM documents")
def src29(t):
    k = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("../"), k)).otherwise(F.concat(F.lit("a/"), k))
    listed = t.documents.select(F.col("doc_id").alias("occurrence_id"), path.alias("path"))
    there = t.documents.filter("doc_id % 4 <> 1").select(path.alias("path"), F.col("n_chars").alias("size"))
    return files.adoption_candidates(listed, there, 1500).select("occurrence_id", "status")

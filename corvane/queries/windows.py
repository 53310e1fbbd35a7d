"""Latest rows, positions, pages and sorted lists (WIN, TOP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge, paging
from . import query

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query(
    "WIN01_latest_snapshot",
    "SELECT user_id, event_id, event_type, value, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1",
)
def win01(t):
    e = merge.latest(t.events, ["user_id"], ["ts", "event_id"])
    return e.select("user_id", "event_id", "event_type", "value", F.date_format("ts", STAMP).alias("ts"))


@query("WIN02_filter_after_ranking", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1 AND event_type IN ('error', 'view')")
def win02(t):
    return merge.latest(t.events, ["user_id"], ["ts", "event_id"]).filter(F.col("event_type").isin("error", "view")).select("user_id", "event_id")


@query("WIN03_latest_per_tag", "SELECT l_partkey, arg_max(l_orderkey * 10 + l_linenumber, l_orderkey * 10 + l_linenumber) AS observation, arg_max(l_suppkey, l_orderkey * 10 + l_linenumber) AS l_suppkey FROM lineitem GROUP BY 1")
def win03(t):
    log = t.lineitem.select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("observation"), "l_suppkey")
    return merge.latest(log, ["l_partkey"], ["observation"])


@query("WIN04_latest_successful", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND c_acctbal > 0 GROUP BY 1")
def win04(t):
    o = t.orders.filter("o_orderstatus = 'F'").join(t.customer.filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return merge.latest(o.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("WIN05_first_and_last", "SELECT user_id, min(event_id) AS first_event, max(event_id) AS last_event, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1")
def win05(t):
    return t.events.groupBy("user_id").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.min_by("event_type", "event_id").alias("first_type"), F.max_by("event_type", "event_id").alias("last_type"))


@query("WIN06_positions", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS attempt FROM orders")
def win06(t):
    return paging.ranked(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "attempt").select("o_orderkey", "attempt")


@query("WIN07_arrival_fold", "SELECT o_custkey, arg_max(o_orderstatus, (epoch_us(o_orderdate) // 86400000000) * 100000000 + o_orderkey) AS status FROM orders GROUP BY 1")
def win07(t):
    return t.orders.groupBy("o_custkey").agg(merge.newest("o_orderstatus", ["o_orderdate", "o_orderkey"]).alias("status"))


@query(
    "TOP01_keyset_page",
    """WITH h AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 500 ORDER BY 1 LIMIT 26), n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS nth, count(*) OVER () > 25 AS has_more FROM h)
    SELECT o_orderkey, o_orderstatus, has_more, CASE WHEN has_more THEN (SELECT max(o_orderkey) FROM n WHERE nth <= 25) END AS continuation FROM n WHERE nth <= 25""",
)
def top01(t):
    return paging.keyset_page(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", after=500, limit=25)


@query("TOP02_newest_first", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 40")
def top02(t):
    return paging.newest_first(t.events, "event_id", 40).select("event_id", "event_type")


@query("TOP03_by_score", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 60")
def top03(t):
    return t.customer.orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(60).select("c_custkey", "c_acctbal")


@query(
    "TOP04_bounded_lists",
    """WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events)
    SELECT user_id, string_agg(event_id, ',' ORDER BY event_id) FILTER (nth <= 20) AS items, CAST(least(count(*), 21) AS INTEGER) AS count, count(*) > 20 AS truncated FROM n GROUP BY 1""",
)
def top04(t):
    b = paging.bounded_lists(t.events.select("user_id", "event_id"), ["user_id"], ["event_id"], ["event_id"], cap=20)
    return b.withColumn("items", F.array_join(F.transform("items", lambda i: i["event_id"].cast("string")), ","))


@query("TOP05_text_ids", "SELECT CAST(o_orderkey AS VARCHAR) AS post_id FROM orders ORDER BY o_orderkey LIMIT 15")
def top05(t):
    return t.orders.select(F.col("o_orderkey").cast("string").alias("post_id")).orderBy(F.col("post_id").cast("long")).limit(15)


@query("TOP06_several_keys", "SELECT p_brand, p_name, p_partkey FROM part ORDER BY p_brand, p_name, p_partkey LIMIT 80")
def top06(t):
    return t.part.orderBy("p_brand", "p_name", "p_partkey").limit(80).select("p_brand", "p_name", "p_partkey")


@query("TOP07_precedence", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END, event_id) AS nth FROM events) WHERE nth = 1")
def top07(t):
    e = t.events.withColumn("place", F.when(F.col("event_type") == "purchase", 0).otherwise(1))
    return merge.earliest(e, ["user_id"], ["place", "event_id"]).select("user_id", "event_id")


@query("TOP08_sorted_array", "SELECT l_orderkey, string_agg(l_linenumber, ',' ORDER BY l_quantity DESC, l_linenumber) AS lines FROM lineitem GROUP BY 1")
def top08(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_linenumber")).alias("ls"))
    down = lambda a, b: F.when(a["l_quantity"] != b["l_quantity"], F.signum(b["l_quantity"] - a["l_quantity"]).cast("int")).otherwise(a["l_linenumber"] - b["l_linenumber"])
    return g.select("l_orderkey", F.array_join(F.transform(F.array_sort("ls", down), lambda x: x["l_linenumber"].cast("string")), ",").alias("lines"))


@query("TOP09_stop_at_limit", "SELECT n_nationkey, n_name FROM nation")
def top09(t):
    return paging.at_most(t.nation, 25, "nations").select("n_nationkey", "n_name")


@query(
    "M0_flagship",
    """WITH l AS (SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1),
    m AS (SELECT user_id, event_type, arg_max(value, event_id) AS value, count(*) AS n FROM events GROUP BY ALL),
    j AS (SELECT l.user_id, l.event_id, l.event_type, m.value, m.n FROM l JOIN m USING (user_id, event_type) WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = l.user_id AND e.event_type = 'purchase') AND l.user_id > 5 ORDER BY l.user_id LIMIT 51),
    p AS (SELECT *, row_number() OVER (ORDER BY user_id) AS nth, count(*) OVER () > 50 AS has_more FROM j)
    SELECT user_id, event_id, event_type, value, n, has_more, CASE WHEN has_more THEN (SELECT max(user_id) FROM p WHERE nth <= 50) END AS continuation FROM p WHERE nth <= 50""",
)
def flagship(t):
    from ..operators.joins import existing

    now = merge.latest(t.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")
    state = t.events.groupBy("user_id", "event_type").agg(merge.newest("value", ["ts", "event_id"]), F.count(F.lit(1)).alias("n"))
    buyers = existing(now.join(state, ["user_id", "event_type"]), t.events.filter("event_type = 'purchase'"), ["user_id"])
    return paging.keyset_page(buyers.select("user_id", "event_id", "event_type", "value", "n"), "user_id", after=5, limit=50)

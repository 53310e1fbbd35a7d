"""Filters, predicates and projections (FLT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.urls import public_url
from ..operators import checks, joins, paging, search, selection
from ..operators.selection import matching
from . import query


@query("FLT01_dynamic_filter", "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src1' AND (doc_id = 7 OR n_chars > 1000)")
def flt01(t):
    return matching(t.documents, ("lang", "source"), lang="en", source="src1").filter((F.col("doc_id") == 7) | (F.col("n_chars") > 1000)).select("doc_id", "lang", "source", "n_chars")


@query(
    "FLT02_media_listing",
    """WITH h AS (
      SELECT o_orderkey, o_custkey, o_totalprice FROM orders o
      WHERE o_orderkey > 40 AND o_orderstatus <> 'P'
        AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'MACHINERY')
        AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')
        AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_discount > 0.09)
      ORDER BY o_orderkey LIMIT 101
    ), n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS nth, count(*) OVER () > 100 AS has_more FROM h)
    SELECT o_orderkey, o_custkey, o_totalprice, has_more, CASE WHEN has_more THEN (SELECT max(o_orderkey) FROM n WHERE nth <= 100) END AS continuation FROM n WHERE nth <= 100""",
)
def flt02(t):
    o = t.orders.filter(F.col("o_orderstatus") != "P")
    o = joins.existing(o, t.customer.filter("c_mktsegment = 'MACHINERY'").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"])
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    o = joins.lacking(joins.existing(o, lines.filter("l_returnflag = 'R'"), ["o_orderkey"]), lines.filter("l_discount > 0.09"), ["o_orderkey"])
    return paging.keyset_page(o.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", after=40, limit=100)


@query("FLT03_substring_search", r"SELECT doc_id FROM documents WHERE contains(lower(text), 'and the') OR contains(text, '100%_')")
def flt03(t):
    return t.documents.filter(search.holds(F.col("text"), "And The") | search.holds(F.col("text"), "100%_")).select("doc_id")


@query("FLT04_phrase_search", r"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ', ' of the ')")
def flt04(t):
    return t.documents.filter(search.phrase(F.col("text"), "of the")).select("doc_id")


@query("FLT05_event_exists", "SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def flt05(t):
    return joins.existing(t.documents, t.labels.filter("toxic = 1"), ["doc_id"]).select("doc_id", "source")


@query("FLT06_status_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 50")
def flt06(t):
    return paging.newest_first(matching(t.orders, ("o_orderstatus",), o_orderstatus="F"), "o_orderkey", 50).select("o_orderkey", "o_orderstatus")


@query("FLT07_retryable", "SELECT event_id, event_type FROM events WHERE value < 10 AND event_type IN ('error', 'click')")
def flt07(t):
    return selection.retryable(t.events, "event_type", ("error", "click"), "value", 10).select("event_id", "event_type")


@query("FLT08_not_in", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def flt08(t):
    return selection.other_than(t.events, "event_type", ("view", "click", "purchase")).select("event_id", "event_type")


@query(
    "FLT09_candidates_by_kind",
    "SELECT 'account' AS kind, c_custkey AS id, c_acctbal AS score FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'post', s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 9000",
)
def flt09(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    return selection.candidates({"account": a, "post": b}, 9000)


@query("FLT10_alias_filter", "SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def flt10(t):
    brand = t.part.agg(F.min("p_brand").alias("p_brand"))
    return selection.aliased(t.part, "p_brand", brand).select("p_partkey", "p_brand", "p_type")


@query("FLT11_by_platform", "SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def flt11(t):
    return selection.aliased(t.supplier, "s_nationkey", t.nation.filter("n_regionkey = 1").select("n_nationkey")).select("s_suppkey", "s_name")


@query("FLT12_pending_work", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('P', 'O') ORDER BY CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) LIMIT 30")
def flt12(t):
    return selection.pending(t.orders.select(F.col("o_orderkey").cast("string").alias("native_id"), "o_orderstatus"), "o_orderstatus", ("P", "O"), "native_id", 30).select(F.col("native_id").cast("long").alias("o_orderkey"))


@query(
    "FLT13_path_prefix",
    r"""SELECT page_id, path FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages) WHERE path = '/en' OR starts_with(path, '/en/') OR page_id IN (1, 2, 3)""",
)
def flt13(t):
    p = t.pages.select("page_id", selection.url_path(F.col("url")).alias("path"))
    return p.filter(selection.below(F.col("path"), "/en") | F.col("page_id").isin(1, 2, 3))


@query("FLT14_by_hash_or_id", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 3) OR doc_id = 5")
def flt14(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    return selection.by_digest_or_id(d, "digest", d.filter("doc_id = 3").select(F.upper("digest")), "doc_id", (5,))


@query(
    "FLT15_nested_document",
    """SELECT c_custkey, c_name, coalesce(o.n, 0) AS n_orders, o.listed FROM customer LEFT JOIN (
      SELECT o_custkey, count(*) AS n, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS listed FROM orders GROUP BY 1) o ON o_custkey = c_custkey""",
)
def flt15(t):
    c = selection.nested(t.customer, "c_custkey", t.orders, "o_custkey", "o_orderkey", ["o_orderstatus"], "orders")
    listed = F.array_join(F.transform("orders", lambda o: F.concat(o["o_orderkey"].cast("string"), F.lit(":"), o["o_orderstatus"])), ",")
    return c.select("c_custkey", "c_name", F.size("orders").cast("long").alias("n_orders"), F.when(F.size("orders") > 0, listed).alias("listed"))


@query("FLT16_post_listing", "SELECT l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 33 ORDER BY l_linenumber")
def flt16(t):
    return matching(t.lineitem, ("l_orderkey",), l_orderkey=33).orderBy("l_linenumber").select("l_linenumber", "l_partkey", "l_quantity")


@query(
    "FLT17_record_validation",
    """SELECT CAST(l_orderkey AS VARCHAR) AS key, rule, count(*) AS n FROM (
      SELECT l_orderkey, unnest(list_filter([CASE WHEN NOT l_quantity BETWEEN 2 AND 49 THEN 'quantity' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag' END, CASE WHEN NOT l_discount < 0.1 THEN 'discount' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem
    ) GROUP BY ALL""",
)
def flt17(t):
    rules = {"quantity": F.col("l_quantity").between(2, 49), "flag": F.col("l_returnflag").isin("A", "N"), "discount": F.col("l_discount") < 0.1}
    return checks.violations(t.lineitem, "l_orderkey", rules).groupBy("key", "rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "FLT18_redacted_urls",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(split_part(url, '#', 1), '([?&])([^=&]*)=[^&]*', '\1\2=%3Credacted%3E', 'g'), '([?&])page=%3Credacted%3E', '\1page=' || coalesce(regexp_extract(url, '[?&]page=([^&#]*)', 1), '')), '^([^:]*://)([^/?]*)', lower(regexp_extract(url, '^([^:]*://[^/?#]*)', 1))) AS shown FROM pages""",
)
def flt18(t):
    return t.pages.select("page_id", public_url(F.col("url")).alias("shown"))


@query("FLT19_public_projection", "SELECT c_custkey AS id, c_name AS label, c_acctbal AS \"limit\", c_acctbal < 0 AS overdrawn, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer")
def flt19(t):
    shown = {"id": F.col("c_custkey"), "label": F.col("c_name"), "limit": F.col("c_acctbal"), "overdrawn": F.col("c_acctbal") < 0, "segment": F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))}
    return selection.public(t.customer, shown, secrets=("c_phone", "c_comment"))


@query("STR07_casefolded_names", "SELECT r_regionkey, lower(r_name) AS name, lower(md5(r_name)) AS digest FROM region")
def str07(t):
    return t.region.select("r_regionkey", X.casefold("r_name").alias("name"), X.hash_of(F.upper(F.md5("r_name")), 32).alias("digest"))

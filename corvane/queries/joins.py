"""Joins, set operations, deduplication and graphs (JOI, SET, GRF)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, joins, merge, sets
from . import query


@query("JOI01_inner", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000")
def joi01(t):
    o = t.orders.filter("o_totalprice > 300000")
    return o.join(t.customer, o["o_custkey"] == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("JOI02_left_chain", "SELECT c_custkey, o_orderkey, l_linenumber FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def joi02(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("c_custkey", "o_orderkey", "l_linenumber")


@query("JOI03_left_with_condition", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'F' GROUP BY 1")
def joi03(t):
    live = t.orders.filter("o_orderstatus <> 'F'")
    return t.customer.join(live, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query(
    "JOI04_left_latest",
    """SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders) o ON o_custkey = c_custkey AND nth = 1""",
)
def joi04(t):
    log = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return joins.left_latest(t.customer, log, ["c_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"]).select("c_custkey", "o_orderkey", "o_orderstatus")


@query("JOI05_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R')")
def joi05(t):
    returned = t.orders.join(t.lineitem.filter("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return joins.existing(t.customer, returned.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey")


@query("JOI06_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def joi06(t):
    return joins.lacking(t.customer, t.orders.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey")


@query("JOI07_self_join", "SELECT DISTINCT a.s_suppkey AS seed, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey WHERE a.s_acctbal > 8000 AND b.s_acctbal > 0")
def joi07(t):
    a = t.supplier.filter("s_acctbal > 8000").select("s_nationkey", F.col("s_suppkey").alias("seed"))
    b = t.supplier.filter("s_acctbal > 0").select("s_nationkey", F.col("s_suppkey").alias("other"))
    return a.join(b, "s_nationkey").filter("seed <> other").select("seed", "other").distinct()


@query("JOI08_composite_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_tax FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_suppkey = b.l_suppkey WHERE a.l_quantity > 48")
def joi08(t):
    key = ["l_orderkey", "l_linenumber", "l_suppkey"]
    return t.lineitem.filter("l_quantity > 48").select(*key).join(t.lineitem.select(*key, "l_tax"), key).select("l_orderkey", "l_linenumber", "l_tax")


@query("JOI09_null_safe", "WITH d AS (SELECT doc_id, nullif(lang, 'en') AS k FROM documents) SELECT doc_id, least_id, n FROM d JOIN (SELECT k, min(doc_id) AS least_id, count(*) AS n FROM d GROUP BY 1) g ON g.k IS NOT DISTINCT FROM d.k")
def joi09(t):
    d = t.documents.select("doc_id", F.nullif(F.col("lang"), F.lit("en")).alias("k"))
    of = d.groupBy("k").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n"))
    return d.join(of, joins.null_safe(d, of, ["k"])).select("doc_id", "least_id", "n")


@query("JOI10_unordered_pair", "SELECT least(c_nationkey, s) AS low, greatest(c_nationkey, s) AS high, count(*) AS n FROM (SELECT c_nationkey, CAST(c_custkey % 25 AS INTEGER) AS s FROM customer) GROUP BY 1, 2")
def joi10(t):
    return t.customer.select("c_nationkey", (F.col("c_custkey") % 25).cast("int").alias("s")).groupBy(*joins.unordered("c_nationkey", "s")).agg(F.count(F.lit(1)).alias("n"))


@query("JOI11_no_case", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON lower(n_name) > lower(r_name) AND upper(left(n_name, 1)) = upper(left(lower(r_name), 1))")
def joi11(t):
    n = t.nation.withColumn("k", F.lower(F.substring("n_name", 1, 1)))
    r = t.region.withColumn("k", F.lower(F.substring("r_name", 1, 1)))
    return n.join(r, "k").filter(F.lower("n_name") > F.lower("r_name")).select("n_nationkey", "r_regionkey")


@query(
    "JOI12_chained_latest",
    """WITH a AS (SELECT user_id, max(event_id) FILTER (event_type = 'error') AS err FROM events GROUP BY 1)
    SELECT a.user_id, a.err, (SELECT max(e.event_id) FROM events e WHERE e.user_id = a.user_id AND e.event_id < a.err AND e.event_type <> 'error') AS before FROM a""",
)
def joi12(t):
    err = t.events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("err"))
    before = t.events.filter("event_type <> 'error'").join(err, "user_id").filter("event_id < err").groupBy("user_id").agg(F.max("event_id").alias("before"))
    return err.join(before, "user_id", "left").select("user_id", "err", "before")


@query(
    "JOI13_claims",
    """SELECT doc_id, claim, CASE WHEN declared IS NULL OR found IS NULL THEN 'not_comparable' WHEN lower(declared) = lower(found) THEN 'matched' ELSE 'mismatched' END AS outcome FROM (
      SELECT doc_id, 'size' AS claim, CAST(n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS declared, CAST(length(text) AS VARCHAR) AS found FROM documents
      UNION ALL SELECT doc_id, 'md5', CASE WHEN doc_id % 5 > 0 THEN upper(md5(text)) END, md5(text) FROM documents)""",
)
def joi13(t):
    declared = t.documents.select("doc_id", (F.col("n_chars") + (F.col("doc_id") % 7 == 0).cast("int")).alias("size"), F.when(F.col("doc_id") % 5 > 0, F.upper(F.md5("text"))).alias("md5"))
    found = t.documents.select("doc_id", F.length("text").cast("long").alias("size"), F.md5("text").alias("md5"))
    return joins.compared_claims(declared, found, "doc_id", ["size", "md5"]).select("doc_id", "claim", "outcome")


@query(
    "JOI14_locations_and_files",
    """WITH l AS (SELECT doc_id, md5(text) AS want, n_chars AS want_size FROM documents WHERE doc_id % 10 <> 3),
    f AS (SELECT doc_id, md5(text) AS got, n_chars + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS got_size FROM documents WHERE doc_id % 10 <> 4)
    SELECT coalesce(l.doc_id, f.doc_id) AS doc_id, CASE WHEN got IS NULL THEN 'missing' WHEN want IS NULL THEN 'orphan' WHEN want = got AND want_size = got_size THEN 'valid' ELSE 'corrupt' END AS status
    FROM l FULL JOIN f ON l.doc_id = f.doc_id""",
)
def joi14(t):
    listed = t.documents.filter("doc_id % 10 <> 3").select("doc_id", F.md5("text").alias("digest"), F.col("n_chars").alias("size"))
    files = t.documents.filter("doc_id % 10 <> 4").select("doc_id", F.md5("text").alias("digest"), (F.col("n_chars") + (F.col("doc_id") % 11 == 0).cast("int")).alias("size"))
    return joins.reconciled(listed, files, "doc_id")


@query(
    "JOI15_folder_names",
    """SELECT o_orderkey, string_agg(coalesce(p_brand, CAST(l_partkey AS VARCHAR)), ',' ORDER BY coalesce(p_brand, CAST(l_partkey AS VARCHAR))) AS folders
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON p_partkey = l_partkey  GROUP BY 1""",
)
def joi15(t):
    lines = t.lineitem.join(t.part.filter("p_size > 25"), F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("l_orderkey").alias("o_orderkey"), F.coalesce("p_brand", F.col("l_partkey").cast("string")).alias("folder"))
    return t.orders.join(lines, "o_orderkey").groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_list("folder")), ",").alias("folders"))


@query("SET01_union", "SELECT 'account' AS subject, c_custkey AS id, c_mktsegment AS extra FROM customer UNION ALL SELECT 'post', s_suppkey, NULL FROM supplier")
def set01(t):
    a = t.customer.select(F.lit("account").alias("subject"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("extra"))
    b = t.supplier.select(F.lit("post").alias("subject"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SET02_first_wins", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, count(*) AS occurrences FROM orders GROUP BY 1")
def set02(t):
    return sets.distinct_first(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "occurrences")


@query("SET03_distinct", "SELECT DISTINCT lower(p_brand) AS brand, p_size FROM part")
def set03(t):
    return t.part.select(F.lower("p_brand").alias("brand"), "p_size").distinct()


@query(
    "SET04_preferred_choice",
    """SELECT l_orderkey, l_linenumber, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, l_linenumber) AS nth FROM lineitem) WHERE nth = 1""",
)
def set04(t):
    return sets.preferred(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey"], "l_returnflag", ["R", "A"], "l_linenumber").select("l_orderkey", "l_linenumber", "l_returnflag")


@query("SET05_idempotent_insert", "SELECT sha256(text) AS digest, min(doc_id) AS doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1")
def set05(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    fresh = merge.earliest(d, ["digest"], ["doc_id"])
    return merge.unseen(fresh, d.filter("doc_id % 3 = 0"), ["digest"]).select("digest", "doc_id")


@query("SET06_missing_columns", "SELECT unnest(['n_orders', 'o_shippriority']) AS missing")
def set06(t):
    lost = sets.missing_columns(t.orders, {"o_orderkey", "o_shippriority", "n_orders"})
    return t.spark.createDataFrame([(c,) for c in lost], "missing string")


@query("SET07_only_value", "SELECT o_custkey, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1")
def set07(t):
    return sets.only_value(t.orders, ["o_custkey"], "o_orderstatus").select("o_custkey", "o_orderstatus")


@query(
    "GRF01_identity_components",
    """WITH RECURSIVE e AS (
      SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 20 <> 0
    ), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT a AS node, a AS seen FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.seen)
    SELECT node, min(seen) AS label FROM r GROUP BY 1""",
)
def grf01(t):
    e = t.customer.filter("c_custkey % 20 <> 0").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return graph.components(e)

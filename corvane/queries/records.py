"""Attribution, tag and alias records, ledgers' current rows, scans and clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsons, urls
from ..operators import checks, joins, ledgers, merge, search
from ..plans import library, lookup
from ..sources import providers
from . import query


def _artists(t):
    k = F.col("s_suppkey")
    body = F.to_json(F.struct(k.alias("id"), F.col("s_name").alias("name"), F.when(k % 2 == 0, F.array(F.lit("o1"), F.lit("o2"))).alias("other_names"), F.array(F.struct(F.concat(F.lit("https://www.pixiv.net/users/"), k.cast("string")).alias("url"), (k % 3 == 0).alias("is_active"))).alias("urls")))
    return providers.attributions(t.supplier.select(body.alias("body")))


@query("SRC15_attribution_names", "SELECT CAST(s_suppkey AS VARCHAR) AS artist, 'primary' AS kind, s_name AS name FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'other', unnest(['o1', 'o2']) FROM supplier WHERE s_suppkey % 2 = 0")
def src15(t):
    return _artists(t)["names"].select("artist", "kind", "name")


@query("SNK13_attribution_urls", "SELECT CAST(s_suppkey AS VARCHAR) AS artist, 'https://www.pixiv.net/users/' || s_suppkey AS url, s_suppkey % 3 = 0 AS active FROM supplier")
def snk13(t):
    return _artists(t)["urls"].select("artist", "url", "active")


@query("PLN07_artist_accounts", "SELECT s_suppkey AS attribution_id, 'pixiv' AS platform, CAST(s_suppkey AS VARCHAR) AS native_id FROM supplier")
def pln07(t):
    k = F.col("s_suppkey")
    found = t.supplier.select(k.alias("attribution_id"), F.posexplode(F.array(F.lit("https://x.com/bob"), F.concat(F.lit("https://www.pixiv.net/users/"), k.cast("string")), F.lit("https://www.pixiv.net/users/1"))).alias("position", "url"))
    return lookup.first_stable_account(urls.with_reference(found, "url"))


@query("PLN24_located_results", "SELECT o_orderkey, c_name AS local FROM orders JOIN customer ON c_custkey = o_custkey")
def pln24(t):
    results = t.orders.select("o_orderkey", "o_custkey")
    held = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("local"))
    return lookup.located(results, held, ["o_custkey"], "local").select("o_orderkey", "local")


@query("SRC19_tag_records", "SELECT 'tag:' || p_partkey AS tag, lower(p_name) AS name, ['general', 'artist', 'contributor', 'copyright', 'character', 'species', 'invalid', 'meta', 'lore', NULL][p_partkey % 10 + 1] AS category, CAST(p_size AS BIGINT) AS post_count FROM part")
def src19(t):
    body = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"), (F.col("p_partkey") % 10).alias("category"), F.col("p_size").alias("post_count")))
    return providers.tag_records(t.part.select(body.alias("body"))).select("tag", "name", "category", "post_count")


@query("WIN02_alias_state", "SELECT name, bool_or(aliased) AS aliased FROM (SELECT 'a' || k AS name, s = 'active' AS aliased FROM (SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN 'active' ELSE 'deleted' END AS s FROM part) UNION ALL SELECT 'a' || (p_partkey + 1), FALSE FROM part) GROUP BY 1")
def win02_alias(t):
    k = F.col("p_partkey")
    body = F.to_json(F.struct(k.alias("id"), F.concat(F.lit("a"), k.cast("string")).alias("antecedent_name"), F.concat(F.lit("a"), (k + 1).cast("string")).alias("consequent_name"), F.when(F.col("p_size") > 25, "active").otherwise("deleted").alias("status")))
    new = providers.alias_records(t.part.select(body.alias("body"))).withColumn("observed_at", F.lit("2")).withColumn("id", F.lit(2))
    old = new.withColumn("status", F.lit("active")).withColumn("observed_at", F.lit("1")).withColumn("id", F.lit(9))
    return library.alias_state(old.unionByName(new))


@query("JSN10_valid_shapes", "SELECT o_orderkey, o_orderkey % 4 = 0 AS valid FROM orders")
def jsn10(t):
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"fav_count":'), F.when(k % 4 == 1, "-1").otherwise("3"), F.lit(',"score":{"up":2,"down":-1,"total":'), F.when(k % 4 == 2, "5").otherwise("1"), F.lit('},"flags":{"deleted":'), F.when(k % 4 == 3, '"no"').otherwise("false"), F.lit('},"pools":[1]}'))
    return providers.valid_shapes(t.orders.select("o_orderkey", body.alias("body"))).select("o_orderkey", "valid")


@query("JSN05_serialised", """SELECT o_orderkey, '{"folders":["' || o_orderpriority || '"],"status":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}' AS document FROM orders""")
def jsn05(t):
    return t.orders.select("o_orderkey", F.to_json(F.struct(F.array("o_orderpriority").alias("folders"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status")), {"ignoreNullFields": "false"}).alias("document"))


@query("SRC28_link_scan", "SELECT 'account' AS subject_kind, page_id AS subject_id, url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 'post', page_id, unnest([url, url]) FROM pages WHERE page_id % 2 = 1")
def src28(t):
    a = t.pages.filter("page_id % 2 = 0").select(F.lit("account").alias("subject_kind"), F.col("page_id").alias("subject_id"), F.explode(urls.extract_urls(F.col("url"))).alias("url"))
    p = t.pages.filter("page_id % 2 = 1").select(F.lit("post").alias("subject_kind"), F.col("page_id").alias("subject_id"), F.explode(urls.extract_urls(F.concat(F.lit("<"), "url", F.lit("> ("), "url", F.lit(")")))).alias("url"))
    return a.unionByName(p)


@query("SRC30_tree_orphans", "SELECT 'sha256/' || left(h, 2) || '/' || substr(h, 3, 2) || '/' || h AS path FROM (SELECT DISTINCT sha256(text) AS h FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0))")
def src30(t):
    from ..functions.text import content_path

    tree = t.documents.select(content_path(F.sha2("text", 256)).alias("path")).distinct()
    held = t.documents.filter("doc_id % 3 = 0").select(content_path(F.sha2("text", 256)).alias("path"))
    return joins.lacking(tree, held, ["path"])


@query("SNK02_repeated_import", "SELECT o_orderpriority AS source, o_orderstatus AS digest FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2")
def snk02(t):
    new = t.orders.select(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("digest"))
    done = new.filter("digest = 'F'")
    return merge.unseen(new, done, ["source", "digest"])


@query("SNK06_post_projection", "SELECT o_custkey AS post, arg_max(p, k) FILTER (p IS NOT NULL) AS text, arg_min(p, k) FILTER (p IS NOT NULL) AS created, min(k) AS first_seen, max(k) AS last_seen FROM (SELECT o_custkey, o_orderkey AS k, nullif(o_orderpriority, '5-LOW') AS p FROM orders) GROUP BY 1")
def snk06(t):
    p = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    log = t.orders.select(F.col("o_custkey").alias("post"), F.col("o_orderkey").alias("k"), p.alias("text"), p.alias("created"))
    return merge.projection(log, ["post"], ["k"], {"text": "newest_known", "created": "first_known"}, seen="k")


@query("SNK10_once_each", "SELECT DISTINCT l_orderkey AS post, l_suppkey AS account, 'author' AS role FROM lineitem")
def snk10(t):
    return t.lineitem.select(F.col("l_orderkey").alias("post"), F.col("l_suppkey").alias("account"), F.lit("author").alias("role")).transform(ledgers.once, ["post", "account", "role"])


@query("SNK12_metadata_observations", "SELECT user_id, v, min(event_id) AS first_id FROM (SELECT user_id, event_id, CAST(floor(value / 10) AS BIGINT) AS v FROM events) GROUP BY 1, 2")
def snk12(t):
    log = t.events.select("user_id", F.col("event_id").alias("first_id"), F.floor(F.col("value") / 10).cast("long").alias("v"))
    return merge.snapshots(log, ["user_id"], ["v"], ["first_id"]).select("user_id", "v", "first_id")


@query("SNK16_orphaned_links", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def snk16(t):
    return joins.lacking(t.part, t.lineitem.filter("l_quantity > 40").withColumnRenamed("l_partkey", "p_partkey"), ["p_partkey"]).select("p_partkey")


@query("SNK19_item_ledger", "SELECT l_orderkey AS run, l_partkey AS item, max(l_linenumber) AS attempts, arg_max(l_returnflag, l_linenumber * 100000 + l_suppkey) AS outcome FROM lineitem GROUP BY 1, 2")
def snk19(t):
    return ledgers.item_ledger(t.lineitem, "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_suppkey")


@query("SNK22_parents_first", "SELECT n_nationkey AS child, n_regionkey AS parent, FALSE AS stub FROM nation WHERE n_regionkey < 3 UNION ALL SELECT n_nationkey, n_regionkey, TRUE FROM nation WHERE n_regionkey >= 3")
def snk22(t):
    held = t.region.filter("r_regionkey < 3").select(F.col("r_regionkey").alias("parent"))
    return ledgers.with_stubs(t.nation.select(F.col("n_nationkey").alias("child"), F.col("n_regionkey").alias("parent")), held, "parent").select("child", "parent", "stub")


@query("SNK29_search_table", "SELECT o_custkey, string_agg(DISTINCT lower(o_orderpriority), ' ' ORDER BY lower(o_orderpriority)) AS words FROM orders GROUP BY 1")
def snk29(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(search.ascii_lower(F.col("o_orderpriority")))), " ").alias("words"))


@query("STM06_details_required", "SELECT o_orderkey, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS details_required FROM orders")
def stm06(t):
    media = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return ledgers.details_required(t.orders, media, "o_orderkey").select("o_orderkey", "details_required")


@query("PLN15_adoption_outcomes", "SELECT CASE WHEN n_chars > 4000 THEN 'limit_exceeded' WHEN doc_id % 5 = 0 THEN 'missing' WHEN c > 1 THEN 'existing' ELSE 'adopted' END AS outcome, count(*) AS n FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS c FROM documents) GROUP BY 1")
def pln15(t):
    d = t.documents.select("doc_id", "n_chars", F.md5("text").alias("h"))
    return ledgers.adoption_outcomes(d, "doc_id", "n_chars", "h", 4000, F.col("doc_id") % 5 == 0).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("JOI_exclusive_targets", "SELECT CAST(o_orderkey AS VARCHAR) AS key, 'one target' AS rule FROM orders WHERE (o_orderkey % 3 = 0) = (o_orderkey % 2 = 0)")
def exclusive(t):
    k = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", F.when(k % 3 == 0, k).alias("a"), F.when(k % 2 == 0, k).alias("b"))
    return checks.violations(rows, "o_orderkey", {"one target": checks.exclusive(["a", "b"])})


@query("HSH04_ordered_children", """SELECT o_custkey, sha256(string_agg(sha256('{"c0":' || o_orderkey || '}'), '' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1""")
def hsh04(t):
    g = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", jsons.digest(F.col("o_orderkey")).alias("d")))).alias("ds"))
    return g.select("o_custkey", F.sha2(F.array_join(F.transform("ds", lambda x: x["d"]), ""), 256).alias("digest"))

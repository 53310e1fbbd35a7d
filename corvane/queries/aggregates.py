"""Aggregations (AGG)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import ledgers, merge
from . import query


@query(
    "AGG01_table_counts",
    " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("customer", "orders", "lineitem", "part", "supplier", "events", "documents", "pages")),
)
def agg01(t):
    parts = [getattr(t, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in ("customer", "orders", "lineitem", "part", "supplier", "events", "documents", "pages")]
    return reduce(DataFrame.unionByName, parts)


@query("AGG02_distinct_by_event", "SELECT event_type, count(DISTINCT user_id) AS subjects FROM events GROUP BY 1")
def agg02(t):
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("subjects"))


@query(
    "AGG03_conditional_counts",
    """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'F') AS fetched, count(*) FILTER (o_orderstatus = 'O') AS failed,
    count(*) FILTER (o_totalprice > 100000) AS large, count(*) FILTER (o_totalprice <= 100000) AS small, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders""",
)
def agg03(t):
    c = lambda cond, name: F.count_if(cond).alias(name)
    s = F.col("o_orderstatus")
    return t.orders.agg(
        F.count(F.lit(1)).alias("total"), c(s == "P", "pending"), c(s == "F", "fetched"), c(s == "O", "failed"),
        c(F.col("o_totalprice") > 100000, "large"), c(F.col("o_totalprice") <= 100000, "small"), c(F.col("o_orderpriority") == "1-URGENT", "urgent"),
    )


@query("AGG04_left_join_count", "SELECT p_partkey, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_size < 5 GROUP BY 1")
def agg04(t):
    counts = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.part.filter("p_size < 5").join(counts, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "AGG05_two_children",
    """SELECT s_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT c_custkey) AS neighbours FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey
    LEFT JOIN customer ON c_nationkey = s_nationkey AND c_acctbal > 9500 GROUP BY 1""",
)
def agg05(t):
    parts = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_distinct("l_partkey").alias("parts"))
    near = t.customer.filter("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count_distinct("c_custkey").alias("neighbours"))
    s = t.supplier.join(parts, "s_suppkey", "left").join(near, "s_nationkey", "left")
    return s.select("s_suppkey", F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


@query("AGG06_exact_duplicates", "SELECT sha256(text) AS digest, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def agg06(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    g = d.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("doc_id")).alias("ids")).filter(F.size("ids") > 1)
    return g.select("digest", "n", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("AGG07_missing_counts", "SELECT lang, count(*) AS assertions, count(*) FILTER (k IS NULL) AS without_hash FROM (SELECT lang, nullif(source, 'src0') AS k FROM documents) GROUP BY 1")
def agg07(t):
    return t.documents.select("lang", F.nullif(F.col("source"), F.lit("src0")).alias("k")).groupBy("lang").agg(F.count(F.lit(1)).alias("assertions"), F.count_if(F.col("k").isNull()).alias("without_hash"))


@query("AGG08_min_flag", "SELECT l_orderkey, min(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS details_required, count(DISTINCT l_suppkey) AS executions FROM lineitem GROUP BY 1")
def agg08(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.min((F.col("l_returnflag") == "R").cast("int")).alias("details_required"), F.count_distinct("l_suppkey").alias("executions"))
    return g


@query(
    "AGG09_correlated_counts",
    """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS posts, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS incomplete,
    (SELECT min(o_orderpriority) FROM orders WHERE o_custkey = c_custkey) AS kind FROM customer""",
)
def agg09(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("posts"), F.count_if(F.col("o_orderstatus") == "P").alias("incomplete"), F.min("o_orderpriority").alias("kind"))
    return t.customer.join(o, "c_custkey", "left").select("c_custkey", F.coalesce("posts", F.lit(0)).alias("posts"), F.coalesce("incomplete", F.lit(0)).alias("incomplete"), "kind")


def _evidence(t):
    strength = F.when(F.col("l_quantity") > 45, "exact").when(F.col("l_quantity") > 30, "strong").when(F.col("l_quantity") > 15, "moderate").otherwise("weak")
    return t.lineitem.select(F.col("l_orderkey").alias("candidate"), strength.alias("strength"), F.when(F.col("l_returnflag") == "R", "contradicts").otherwise("supports").alias("stance"))


_SCORE = "sum(CASE WHEN l_quantity > 45 THEN 100 WHEN l_quantity > 30 THEN 70 WHEN l_quantity > 15 THEN 35 ELSE 10 END) FILTER (l_returnflag <> 'R')"


@query("AGG10_evidence_score", f"SELECT l_orderkey AS candidate, CAST(coalesce({_SCORE}, 0) AS BIGINT) AS score, count(*) FILTER (l_returnflag <> 'R') AS generation FROM lineitem GROUP BY 1")
def agg10(t):
    return _evidence(t).groupBy("candidate").agg(scores.evidence_score().cast("long").alias("score"), F.count_if(F.col("stance") == "supports").alias("generation"))


@query("AGG11_manual_score", f"SELECT l_orderkey AS candidate, CAST(coalesce({_SCORE}, 0) AS BIGINT) AS score, count(*) AS generation FROM lineitem GROUP BY 1")
def agg11(t):
    return _evidence(t).groupBy("candidate").agg(scores.evidence_score().cast("long").alias("score"), F.count(F.lit(1)).alias("generation"))


@query(
    "AGG12_plan_counts",
    "SELECT count(*) AS requested, count(*) FILTER (o_orderstatus = 'O') AS eligible, count(*) FILTER (o_orderstatus = 'F') AS satisfied, count(*) FILTER (o_orderstatus = 'P') AS excluded FROM orders",
)
def agg12(t):
    state = F.when(F.col("o_orderstatus") == "O", "eligible").when(F.col("o_orderstatus") == "F", "satisfied").otherwise("excluded")
    wide = t.orders.select(state.alias("state")).groupBy().pivot("state", ["eligible", "satisfied", "excluded"]).count()
    return wide.select((F.col("eligible") + F.col("satisfied") + F.col("excluded")).alias("requested"), "eligible", "satisfied", "excluded")


@query("AGG13_status_report", "SELECT lang AS status, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) FILTER (n_chars > 2000) AS issues FROM documents GROUP BY 1")
def agg13(t):
    return t.documents.groupBy(F.col("lang").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("bytes"), F.count_if(F.col("n_chars") > 2000).alias("issues"))


@query(
    "AGG14_first_outcomes",
    "SELECT outcome, count(*) AS n FROM (SELECT user_id, event_type AS outcome, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events) WHERE nth = 1 GROUP BY 1",
)
def agg14(t):
    return t.events.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "AGG15_latest_wins_merge",
    """WITH e AS (SELECT user_id, event_type, event_id, ts, CASE WHEN value >= 20 THEN value END AS known, value FROM events)
    SELECT user_id, event_type, arg_max(known, event_id) FILTER (known IS NOT NULL) AS known, arg_min(known, event_id) FILTER (known IS NOT NULL) AS first_known_value, arg_max(value, event_id) AS value,
    strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen FROM e GROUP BY ALL""",
)
def agg15(t):
    e = t.events.withColumn("known", F.when(F.col("value") >= 20, F.col("value"))).withColumn("first_known_value", F.col("known"))
    p = merge.projection(e, ["user_id", "event_type"], ["ts", "event_id"], {"known": "newest_known", "first_known_value": "first_known", "value": "newest"}, seen="ts")
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return p.withColumn("first_seen", F.date_format("first_seen", stamp)).withColumn("last_seen", F.date_format("last_seen", stamp))


@query(
    "AGG16_recovery_rollup",
    """SELECT user_id AS run, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS deferred,
    round(sum(value), 4) AS bytes, max(value) FILTER (event_type = 'error') AS partial FROM events GROUP BY 1""",
)
def agg16(t):
    e = F.col("event_type")
    return t.events.groupBy(F.col("user_id").alias("run")).agg(
        F.count_if(e == "purchase").alias("completed"), F.count_if(e == "error").alias("failed"), F.count_if(~e.isin("purchase", "error")).alias("deferred"),
        F.round(F.sum("value"), 4).alias("bytes"), F.max(F.when(e == "error", F.col("value"))).alias("partial"),
    )


@query("AGG17_export_statistics", "SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS available, count(*) FILTER (lang <> 'en') AS unavailable, count(DISTINCT source) AS folders FROM documents")
def agg17(t):
    return t.documents.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("lang") == "en").alias("available"), F.count_if(F.col("lang") != "en").alias("unavailable"), F.count_distinct("source").alias("folders"))


@query("AGG18_discovery_counters", "SELECT flag, count(*) AS n FROM (SELECT CASE WHEN contains(url, 'utm_') THEN 'tracked' WHEN contains(url, '#') THEN 'fragment' ELSE 'plain' END AS flag FROM pages) GROUP BY 1")
def agg18(t):
    flag = F.when(F.col("url").contains("utm_"), "tracked").when(F.col("url").contains("#"), "fragment").otherwise("plain")
    return t.pages.groupBy(flag.alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SNK08_asset_merge",
    """WITH a AS (SELECT md5(CAST(l_partkey AS VARCHAR)) AS sha256, l_orderkey * 10 + l_linenumber AS seq, l_returnflag AS storage, CASE WHEN l_linestatus = 'O' THEN l_linestatus END AS mime,
      CASE WHEN l_quantity > 10 THEN l_quantity END AS size, l_discount > 0.08 AS managed FROM lineitem)
    SELECT sha256, arg_max(storage, seq + CASE WHEN managed THEN 1000000000000 ELSE 0 END) AS storage, bool_or(managed) AS managed, arg_max(mime, seq) FILTER (mime IS NOT NULL) AS mime, arg_max(size, seq) FILTER (size IS NOT NULL AND (managed OR since IS NULL OR seq < since)) AS size, count(*) AS assertions
    FROM (SELECT *, min(seq) FILTER (managed) OVER (PARTITION BY sha256) AS since FROM a) GROUP BY 1""",
)
def snk08(t):
    log = t.lineitem.select(
        F.upper(F.md5(F.col("l_partkey").cast("string"))).alias("sha256"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_returnflag").alias("storage"),
        F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")).alias("mime"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("size"), (F.col("l_discount") > 0.08).alias("managed"),
    )
    return merge.merged_assets(log)


@query("SNK03_outcome_counts", "SELECT o_orderpriority AS entity, count(*) FILTER (o_orderstatus = 'F') AS inserted, count(*) FILTER (o_orderstatus = 'O') AS updated, count(*) FILTER (o_orderstatus = 'P') AS existing FROM orders GROUP BY 1")
def snk03(t):
    outcome = F.when(F.col("o_orderstatus") == "F", "inserted").when(F.col("o_orderstatus") == "O", "updated").otherwise("existing")
    return ledgers.outcome_counts(t.orders.select(F.col("o_orderpriority").alias("entity"), outcome.alias("outcome")), "entity", "outcome", ["inserted", "updated", "existing"])


@query("SNK04_payload_store", "SELECT sha256(text) AS sha256, count(DISTINCT coalesce(source, '')) AS observations, CAST(min(length(text)) AS BIGINT) AS size FROM documents GROUP BY 1")
def snk04(t):
    return ledgers.payload_store(t.documents, "text", "source")


@query("SNK09_key_conflicts", "SELECT n_chars, count(DISTINCT lang) AS owners FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def snk09(t):
    return merge.key_conflicts(t.documents.select("n_chars", "lang"), ["n_chars"], "lang").select("n_chars", "owners")


@query(
    "SNK05_snapshots",
    "SELECT user_id, event_type, kind, min(event_id) AS event_id FROM (SELECT user_id, event_type, event_id, CASE WHEN value > 20 THEN 'high' END AS kind FROM events) GROUP BY ALL",
)
def snk05(t):
    log = t.events.select("user_id", "event_id", "event_type", F.when(F.col("value") > 20, "high").alias("kind"))
    return merge.snapshots(log, ["user_id"], ["event_type", "kind"], ["event_id"]).select("user_id", "event_type", "kind", "event_id")


@query("SNK26_content_paths", "SELECT doc_id, 'sha256/' || left(h, 2) || '/' || substr(h, 3, 2) || '/' || h AS path FROM (SELECT doc_id, sha256(text) AS h FROM documents)")
def snk26(t):
    from ..functions.text import content_path

    return t.documents.select("doc_id", content_path(F.upper(F.sha2("text", 256))).alias("path"))

"""Planners over the driver's tables (PLN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks
from ..plans import acquisition, discovery, library, lookup
from . import query


def _occurrences(t):
    k = F.col("o_orderkey")
    url = F.concat(F.lit("https://h/"), k.cast("string"))
    return t.orders.select(
        k.alias("occurrence_id"), F.when(k % 7 == 0, "x").when(k % 7 == 1, "e621").otherwise("danbooru").alias("platform"),
        F.when(F.col("o_orderstatus") == "P", "unavailable").otherwise("available").alias("availability"),
        F.when(k % 5 > 0, url).alias("remote_url"), F.lit(None).cast("string").alias("preview_url"),
        F.when(k % 11 == 0, "{").when(k % 3 == 0, F.concat(F.lit('{"variants":[{"role":"original","url":"'), url, F.lit('"}]}'))).alias("variants_json"),
        F.upper(F.sha2(k.cast("string"), 256)).alias("sha256"), F.md5(k.cast("string")).alias("md5"),
    )


def _selections(t):
    s = t.lineitem.select((F.col("l_orderkey") + F.when(F.col("l_linenumber") == 1, 10_000_000).otherwise(0)).alias("occurrence_id"), F.when(F.col("l_linenumber") % 2 == 0, "primary").otherwise("original").alias("variant"))
    return s.distinct()


_PLN = """WITH o AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'x' WHEN o_orderkey % 7 = 1 THEN 'e621' ELSE 'danbooru' END AS platform, o_orderstatus = 'P' AS gone,
         CASE WHEN o_orderkey % 5 > 0 THEN 'https://h/' || o_orderkey END AS url, o_orderkey % 11 = 0 AS broken, o_orderkey % 3 = 0 AS listed FROM orders
), s AS (SELECT DISTINCT l_orderkey + CASE WHEN l_linenumber = 1 THEN 10000000 ELSE 0 END AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'primary' ELSE 'original' END AS variant FROM lineitem),
j AS (SELECT s.id, s.variant, CASE WHEN variant = 'primary' THEN url WHEN listed AND NOT broken THEN 'https://h/' || k END AS u, o.* FROM s LEFT JOIN o ON k = id),
p AS (SELECT id AS occurrence_id, variant, CASE WHEN k IS NULL THEN 'missing_occurrence' WHEN platform = 'x' THEN 'unsupported_provider' WHEN gone THEN 'unavailable_occurrence' WHEN broken THEN 'invalid_variants'
  WHEN platform = 'e621' AND variant = 'primary' THEN 'unsupported_variant' WHEN u IS NULL THEN 'missing_variant' END AS reason, coalesce(u = url, FALSE) AS original, k FROM j)
"""


@query("PLN01_acquisition_plan", _PLN + "SELECT occurrence_id, variant, reason, original FROM p")
def pln01(t):
    return acquisition.planned(_selections(t), _occurrences(t), ["danbooru", "e621"]).select("occurrence_id", "variant", "reason", "original")


def _satisfied(t):
    items = acquisition.planned(_selections(t), _occurrences(t), ["danbooru", "e621"])
    done = t.orders.filter("o_orderkey % 13 = 0").select(F.col("o_orderkey").alias("occurrence_id"), F.lit("original").alias("variant"), (F.col("o_orderkey") + 1).alias("asset_id"), F.col("o_orderkey").alias("seq"))
    assets = t.orders.filter("o_orderkey % 4 = 0").select((F.col("o_orderkey") + 2).alias("asset_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"), F.lit(None).cast("string").alias("md5"))
    return acquisition.satisfied(items, done, assets)


_SAT = _PLN + ", q AS (SELECT *, coalesce(CASE WHEN occurrence_id % 13 = 0 AND variant = 'original' AND k IS NOT NULL THEN occurrence_id + 1 END, CASE WHEN original AND occurrence_id % 4 = 0 THEN occurrence_id + 2 END) AS asset_id FROM p)"


@query("PLN02_satisfied", _SAT + " SELECT occurrence_id, variant, asset_id, CASE WHEN reason IS NOT NULL THEN 'excluded' WHEN asset_id IS NOT NULL THEN 'already_satisfied' ELSE 'eligible' END AS eligibility FROM q")
def pln02(t):
    return _satisfied(t).select("occurrence_id", "variant", "asset_id", acquisition.eligibility().alias("eligibility"))


@query("PLN03_stale_items", "SELECT DISTINCT l_orderkey AS occurrence_id, 'primary' AS variant, l_orderkey % 9 = 0 AND l_orderkey % 2 = 1 AS stale FROM lineitem")
def pln03(t):
    wanted = t.lineitem.select(F.col("l_orderkey").alias("occurrence_id"), F.lit("primary").alias("variant")).distinct()
    was = _occurrences(t).withColumn("remote_url", F.lit("https://h/1"))
    now = was.withColumn("remote_url", F.when((F.col("occurrence_id") % 9 == 0) & (F.col("occurrence_id") % 2 == 1), F.lit("https://h/2")).otherwise(F.col("remote_url")))
    stored = acquisition.planned(wanted, was, ["danbooru", "e621"])
    return acquisition.stale(stored, acquisition.planned(wanted, now, ["danbooru", "e621"]))


@query(
    "PLN04_lookup_materials",
    """SELECT post_id, strategy, value FROM (
      SELECT doc_id AS post_id, 'md5' AS strategy, md5(text) AS value FROM documents UNION SELECT doc_id, 'md5', md5(text || 'x') FROM documents WHERE doc_id % 2 = 0
      UNION SELECT doc_id, 'pixiv_id', source FROM documents WHERE lang = 'fr' UNION SELECT doc_id, 'source_url', 'https://x.com/a/status/' || doc_id FROM documents UNION SELECT doc_id, 'source_url', 'https://twitter.com/a/status/' || doc_id FROM documents)""",
)
def pln04(t):
    posts = t.documents.select(F.col("doc_id").alias("post_id"), F.when(F.col("lang") == "fr", "pixiv").otherwise("x").alias("platform"), F.col("source").alias("native_id"), F.concat(F.lit("https://x.com/a/status/"), F.col("doc_id").cast("string")).alias("canonical_url"))
    media = t.documents.select(F.col("doc_id").alias("post_id"), F.upper(F.md5("text")).alias("md5"))
    assets = t.documents.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("post_id"), F.md5(F.concat("text", F.lit("x"))).alias("md5"))
    return lookup.materials(posts, media, assets).select("post_id", "strategy", "value")


@query(
    "PLN05_interpretation",
    """SELECT event_id, CASE WHEN k = 'post' AND (h OR s) THEN 'post_match' WHEN k = 'account' THEN 'account_match' WHEN k = 'post' THEN 'weak_lead' ELSE 'inconclusive' END AS interpretation,
    CASE WHEN k = 'post' AND h THEN 'exact' WHEN k = 'post' AND s THEN 'strong' ELSE 'weak' END AS strength
    FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'post' WHEN 'click' THEN 'account' ELSE event_type END AS k, value > 30 AS h, event_id % 3 = 0 AS s FROM events)""",
)
def pln05(t):
    kind = F.when(F.col("event_type") == "view", "post").when(F.col("event_type") == "click", "account").otherwise(F.col("event_type"))
    i = lookup.interpretation(kind, F.lit("source_url"), F.col("event_id") % 3 == 0, F.col("value") > 30)
    return t.events.select("event_id", i.alias("i")).select("event_id", "i.interpretation", "i.strength")


@query(
    "PLN06_merged_pairs",
    "SELECT least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high, max(CASE WHEN l_returnflag = 'R' THEN 'sourced_from' ELSE 'same_work' END) AS relation, CAST(sum(l_linenumber) AS BIGINT) AS evidence FROM lineitem WHERE l_linenumber < 7 GROUP BY 1, 2",
)
def pln06(t):
    p = t.lineitem.select(F.when(F.col("l_linenumber") < 7, F.col("l_partkey")).alias("a"), F.col("l_suppkey").alias("b"), F.when(F.col("l_returnflag") == "R", "sourced_from").otherwise("same_work").alias("relation"), F.col("l_linenumber").alias("evidence"))
    return discovery.merged_pairs(p)


@query(
    "PLN_reviews",
    """WITH RECURSIVE d AS (
      SELECT l_orderkey AS candidate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth, CASE WHEN l_quantity < 40 THEN CAST(l_suppkey % 3 AS BIGINT) END AS expected, CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'confirmed' END AS state FROM lineitem
    ), f AS (
      SELECT o_orderkey AS candidate, CAST(0 AS BIGINT) AS nth, 'pending' AS state, CAST(0 AS BIGINT) AS revision FROM orders
      UNION ALL
      SELECT f.candidate, d.nth, CASE WHEN coalesce(expected, revision) = revision THEN d.state ELSE f.state END, revision + CASE WHEN coalesce(expected, revision) = revision THEN 1 ELSE 0 END FROM f JOIN d ON d.candidate = f.candidate AND d.nth = f.nth + 1
    ) SELECT candidate, arg_max(state, nth) AS state, max(revision) AS revision FROM f GROUP BY 1""",
)
def reviews(t):
    expected = F.when(F.col("l_quantity") < 40, F.col("l_suppkey") % 3)
    made = t.lineitem.select(F.col("l_orderkey").alias("candidate"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"), expected.alias("revision"), F.when(F.col("l_returnflag") == "R", "rejected").otherwise("confirmed").alias("state"))
    return discovery.reviewed(t.orders.select(F.col("o_orderkey").alias("candidate")), made, "candidate")


@query(
    "PLN08_expansion_choices",
    """WITH e AS (SELECT l_orderkey AS seed, 'artist' AS kind, l_suppkey AS id, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS place FROM lineitem), c AS (SELECT DISTINCT seed, kind, id FROM e)
    SELECT seed, CASE WHEN count(*) = 1 THEN min(id) END AS id, CASE WHEN count(*) = 1 THEN 'selected' ELSE 'ambiguous' END AS outcome FROM c GROUP BY 1""",
)
def pln08(t):
    mode = F.when(F.col("l_returnflag") == "R", "confirmed").when(F.col("l_returnflag") == "A", "explicit").otherwise("authored")
    offers = t.lineitem.select(F.col("l_orderkey").alias("seed"), F.lit("artist").alias("kind"), F.col("l_suppkey").alias("id"), mode.alias("mode"), F.col("l_linenumber").alias("position"))
    return library.selected(library.choices(offers)).select("seed", "id", "outcome")


@query(
    "PLN09_estimate",
    """WITH pr AS (SELECT l_partkey AS target, arg_max(l_suppkey, l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
    SELECT p_partkey AS target, CASE WHEN p_size > 10 AND p_size % 4 <> 0 THEN p_size ELSE n END AS count, CASE WHEN p_size > 10 AND p_size % 4 <> 0 THEN 'retained_tag' WHEN n IS NOT NULL THEN 'probe' ELSE 'unknown' END AS provenance
    FROM part LEFT JOIN pr ON target = p_partkey""",
)
def pln09(t):
    targets = t.part.select(F.col("p_partkey").alias("target"), F.col("p_partkey").alias("name"))
    tags = t.part.filter("p_size > 10").select(F.col("p_partkey").alias("name"), F.col("p_size").cast("long").alias("post_count"), (F.col("p_size") % 4 == 0).alias("aliased"))
    probes = t.lineitem.select(F.col("l_partkey").alias("target"), F.when(F.col("l_returnflag") == "A", "success").otherwise("failed").alias("outcome"), F.col("l_suppkey").alias("count"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return library.estimate(targets, tags, probes)


@query(
    "PLN12_link_candidates",
    """SELECT CASE WHEN o_orderstatus = 'F' THEN 'same_identity' ELSE 'sourced_from' END AS relation, o_custkey AS subject_id, o_custkey % 40 AS target_id, count(*) AS evidence
    FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW' AND o_custkey <> o_custkey % 40 GROUP BY ALL""",
)
def pln12(t):
    kind = F.when(F.col("o_orderstatus") == "F", "account").when(F.col("o_orderstatus") == "O", "post").otherwise("other")
    links = t.orders.select(kind.alias("subject_kind"), kind.alias("object_kind"), F.col("o_custkey").alias("subject_id"), (F.col("o_custkey") % 40).alias("target_id"), F.when(F.col("o_orderpriority") == "5-LOW", "handle").otherwise("stable_id").alias("identifier_kind"), F.col("o_orderkey").alias("link_id"))
    return discovery.link_candidates(links).select("relation", "subject_id", "target_id", "evidence")


@query("PLN14_confirmed_edges", "SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier WHERE (SELECT arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) FROM lineitem WHERE l_suppkey = s_suppkey) = 'R'")
def pln14(t):
    candidates = t.supplier.select("s_suppkey", F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    decisions = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_returnflag") == "R", "confirmed").otherwise("rejected").alias("state"))
    return discovery.confirmed_edges(candidates, decisions, "s_suppkey")


@query(
    "PLN19_run_decisions",
    """WITH i AS (SELECT o_custkey AS run, o_orderkey AS item, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS sat, o_orderstatus = 'P' AS excl, o_orderkey % 5 = 0 AS stale FROM orders),
    f AS (SELECT *, CASE WHEN sat THEN 'already_satisfied' WHEN excl THEN 'excluded' WHEN stale THEN 'stale' END AS first FROM i)
    SELECT run, item, coalesce(first, CASE WHEN coalesce(sum(CASE WHEN first IS NULL THEN size ELSE 0 END) OVER (PARTITION BY run ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size > 600000 THEN 'deferred' ELSE 'fetch' END) AS decision FROM f""",
)
def pln19(t):
    k = F.col("o_orderkey")
    items = t.orders.select(
        F.col("o_custkey").alias("run"), k.alias("item"), F.floor("o_totalprice").cast("long").alias("size"), F.when((F.col("o_orderstatus") == "F") & (k % 2 == 0), 1).alias("asset_id"),
        F.when(F.col("o_orderstatus") == "P", "excluded").alias("reason"), (k % 5 == 0).alias("stale"),
    )
    return acquisition.decided(items, ["run"], "item", "size", 600_000).select("run", "item", "decision")


@query(
    "PLN20_run_status",
    """SELECT user_id AS run, CASE WHEN NOT bool_or(f) AND NOT bool_or(d) THEN 'complete' WHEN bool_or(c) THEN 'partial' WHEN NOT bool_or(f) THEN 'partial' ELSE 'failed' END AS status,
    CASE WHEN NOT bool_or(f) AND NOT bool_or(d) THEN 'success' WHEN bool_or(c) THEN 'partial' WHEN NOT bool_or(f) THEN 'interrupted' WHEN bool_or(f AND event_id % 2 = 0) THEN 'stale' ELSE 'failed' END AS result
    FROM (SELECT *, event_type = 'purchase' AND value > 60 AS c, event_type = 'error' AND value > 40 AS f, event_type = 'click' AND value > 55 AS d FROM events) GROUP BY 1""",
)
def pln20(t):
    e, v = F.col("event_type"), F.col("value")
    state = F.when((e == "purchase") & (v > 60), "completed").when((e == "error") & (v > 40), "failed").when((e == "click") & (v > 55), "deferred").otherwise("other")
    items = t.events.select(F.col("user_id").alias("run"), state.alias("state"), F.when((state == "failed") & (F.col("event_id") % 2 == 0), "stale").alias("outcome"))
    return acquisition.run_status(items, ["run"])


@query("PLN21_terminal_states", "SELECT outcome, CASE outcome WHEN 'success' THEN 'completed' WHEN 'rate_limited' THEN 'deferred' ELSE 'failed' END AS state, count(*) AS n FROM (SELECT CASE event_type WHEN 'purchase' THEN 'success' WHEN 'click' THEN 'rate_limited' ELSE event_type END AS outcome FROM events) GROUP BY 1, 2")
def pln21(t):
    outcome = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "click", "rate_limited").otherwise(F.col("event_type"))
    return t.events.select(outcome.alias("outcome")).withColumn("state", acquisition.terminal_state(F.col("outcome"))).groupBy("outcome", "state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "PLN25_orphans",
    "SELECT 'lineitem.part' AS relation, CAST(l_partkey AS VARCHAR) AS missing, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2) GROUP BY 2 UNION ALL SELECT 'labels.document', CAST(doc_id AS VARCHAR), count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY 2",
)
def pln25(t):
    return checks.orphans([("lineitem.part", t.lineitem, "l_partkey", t.part.filter("p_size > 2"), "p_partkey"), ("labels.document", t.labels, "doc_id", t.documents, "doc_id")])

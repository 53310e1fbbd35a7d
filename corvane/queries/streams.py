"""Streams (STM) over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledgers, merge
from ..streaming import pages
from . import query


def _stream(t):
    schema = t.events.schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)


@query("STM01_page_loop", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value > 5 GROUP BY 1")
def stm01(t):
    _, items = pages.ingested(_stream(t), lambda b: b.filter("value > 5").select("event_id", "event_type", "value"), "pages")
    return items.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "STM02_page_budgets",
    """SELECT user_id AS run, event_id AS page, row_number() OVER w <= 20 AND sum(CAST(floor(value) AS BIGINT)) OVER w <= 300 AS admitted FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def stm02(t):
    p = t.events.select(F.col("user_id").alias("run"), F.col("event_id").alias("page"), F.floor("value").cast("long").alias("records"))
    return pages.admitted(p, ["run"], "page", "records", 20, 300).select("run", "page", "admitted")


@query("STM07_late_records", "SELECT user_id, arg_max(event_type, event_id) AS event_type, count(*) AS observations FROM events GROUP BY 1")
def stm07(t):
    late = t.events.filter("event_id % 2 = 0").unionByName(t.events.filter("event_id % 2 = 1"))
    return late.groupBy("user_id").agg(merge.newest("event_type", ["ts", "event_id"]), F.count(F.lit(1)).alias("observations"))


@query("STM08_duplicate_delivery", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def stm08(t):
    twice = t.events.unionByName(t.events)
    return ledgers.delivered_once(twice, ["event_id", "user_id", "event_type", "value"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("STM11_recovered_runs", "SELECT user_id, CASE WHEN t IN ('view', 'click') THEN 'interrupted' ELSE t END AS state FROM (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY 1)")
def stm11(t):
    state = F.when(F.col("event_type").isin("view", "click"), "running").otherwise(F.col("event_type"))
    return pages.recovered(t.events.select("user_id", "event_id", state.alias("state")), ["user_id"], "event_id").select("user_id", "state")


@query("STM13_one_active_partial", "SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 80 GROUP BY 1, 2 HAVING count(*) > 1")
def stm13(t):
    from ..operators.checks import duplicates

    return duplicates(t.events.filter("value > 80"), ["user_id", "event_type"])

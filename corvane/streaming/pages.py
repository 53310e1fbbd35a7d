"""The page loop as Structured Streaming.

Each micro-batch is one committed step: raw rows are kept first, then what they
normalise to, both under the batch's number, so a batch that runs again after a
failure overwrites what it wrote before.  The stream's checkpoint is the resume
point; duplicates that arrive later are dropped when the log is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import latest
from ..staging import shared_folder


def ingested(stream: DataFrame, normalise, name: str) -> tuple[DataFrame, DataFrame]:
    """Runs a stream over all that is there now; (raw log, normalised log), each with its batch."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/corvane/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{name}"

    def commit(batch: DataFrame, number: int) -> None:
        for kind, rows in (("raw", batch), ("items", normalise(batch))):
            rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/{kind}/step={number}")

    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(commit).start()
    query.awaitTermination()
    return tuple(spark.read.parquet(f"{root}/{kind}").drop("step") for kind in ("raw", "items"))


def admitted(pages: DataFrame, run: list[str], order: str, records: str, most_pages: int, most_records: int) -> DataFrame:
    """pages with ``admitted``: the run's pages up to the first that doesn't fit its budgets whole."""
    from pyspark.sql import Window

    w = Window.partitionBy(*run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    p = pages.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("total", F.sum(records).over(w))
    fits = (F.col("n") <= most_pages) & (F.col("total") <= most_records)
    return p.withColumn("admitted", fits).drop("n", "total")


def recovered(attempts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last state of each item, with running turned to interrupted."""
    last = latest(attempts, keys, [order])
    return last.withColumn("state", F.when(F.col("state") == "running", "interrupted").otherwise(F.col("state")))


def waits(requests: DataFrame, run: list[str], order: str, interval: float = 1.0, retries: int = 3) -> DataFrame:
    """requests (at: seconds, code, retry_after) with wait: seconds before the next may go; null if it mustn't be retried.

    Successes wait for the rest of the interval; 429 and 5xx wait as told, or a second, at most ``retries`` times in a row.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*run).orderBy(order)
    again = (F.col("code") == 429) | (F.col("code") >= 500)
    group = F.sum((~again).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = requests.withColumn("streak", group).withColumn("nth", F.sum(again.cast("int")).over(Window.partitionBy(*run, "streak").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    since = F.lead("at").over(w) - F.col("at")
    wait = F.when(again & (F.col("nth") > retries), F.lit(None)).when(again, F.coalesce("retry_after", F.lit(1.0))).when(F.col("code").between(200, 299), F.greatest(F.lit(0.0), interval - F.coalesce(since, F.lit(interval))))
    return r.withColumn("wait", wait).drop("streak", "nth")


def resumable(checkpoints: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """wanted runs with the continuation of the last checkpoint that agrees with them in all of ``keys``."""
    last = checkpoints.groupBy(*keys).agg(F.max_by("continuation", "seq").alias("continuation"))
    return wanted.join(last, keys, "left")


def continuations(pages: DataFrame, size: int) -> DataFrame:
    """pages (page, ids, boundary) -> page, continuation (b and the last id; null after a short or empty page), valid (ids fall below the boundary)."""
    full = F.size("ids") >= size
    valid = F.forall("ids", lambda i: F.coalesce(i < F.col("boundary"), F.lit(True)))
    return pages.select("page", F.when(full, F.concat(F.lit("b"), F.element_at("ids", -1).cast("string"))).alias("continuation"), valid.alias("valid"))

"""Mixing sources to target weights with a low-discrepancy schedule.

A document's size is its number of words.  Sources, by code point with null
last, weigh 1, 2, 3, 1, 2, 3, ...; their targets share the words of the whole
corpus by weight, stop at ``cap`` times the source's own words, and what lies
above is shared again by weight.

* Slot i of the schedule is the point frac(i * golden ratio).  The cumulative
  target shares cut [0, 1) into one interval per source, so every prefix of the
  schedule holds each source nearly in proportion.
* The documents of a source are shuffled by a hash and laid end to end,
  ``cap`` times over; that stream is cut into blocks of ``block`` words.
* Blocks that a source has beyond its slots there (the points' discrepancy, or
  shares too small for a slot) follow in slots of their own, source by source.
* The k-th slot of a source takes its k-th block, up to the source's target.
  So the schedule says at which slot of the mix each block of words is taken.

Ranks and prefix sums are taken in two levels (inside a chunk, then over chunk
totals), so no task sees a whole source.  Only DataFrame functions are used.
What reaches the driver are three numbers.  The source table (one row per
source) is broadcast only while it has at most ``BROADCAST_SOURCES`` rows.

Defined results: null text has size 0, takes nothing and has no slot; a document of size 0
is no part of a mix, so ``repeated_documents`` leaves it out; a null source is a
source of its own, last in order; null and repeated doc_ids are rows like
any other; an empty table, or one without words, gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import offsets, row_hash, staged

#: Words a slot takes.
BLOCK = 64
#: Documents in one bucket of a source's shuffled order, about.
BUCKET_ROWS = 256
#: Slots in one chunk of the schedule.
CHUNK = 1 << 12
#: The golden ratio's fraction as a whole number of PERIOD-ths.
PERIOD, GOLDEN, CELLS = 1_000_000_000, 618_033_989, 1_000
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+; null: 0."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(spaced, " "), "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, total: int, cap: int = 3) -> DataFrame:
    """sid, source, source_size, target, quota, lo, hi (its interval, in PERIOD-ths)."""
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    s = one.withColumn("sid", F.row_number().over(everything)).withColumn("w", (F.col("sid") - 1) % 3 + 1)
    s = s.withColumn("cap", F.col("source_size") * cap)
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.lit(float(total)) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    s = s.withColumn("full", (F.col("cap") * weight_left <= left * F.col("w")).cast("int"))
    s = s.withColumn("full", F.min("full").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    free = F.lit(float(total)) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole)
    free_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(whole)
    s = s.withColumn("target", F.round(F.when(F.col("full"), F.col("cap").cast("double")).otherwise(free * F.col("w") / free_weight), 6))
    so_far = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    edge = F.floor(F.sum("target").over(so_far) / F.lit(float(max(total, 1))) * PERIOD).cast("long")
    s = s.withColumn("hi", F.least(edge, F.lit(PERIOD))).withColumn("quota", F.floor("target").cast("long"))
    return s.select("sid", "source", "source_size", "target", "quota", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0)).alias("lo"), "hi")


def schedule(spark, targets: DataFrame, slots: int, small: bool, block: int = BLOCK) -> DataFrame:
    """slot, sid, rank: the sources in the order in which blocks are taken, and each slot's rank in its source.

    Every source has at least a slot for each block of its quota: those that ``slots`` points do not hold come after them.
    """
    hint = F.broadcast if small else (lambda x: x)
    width = PERIOD // CELLS
    cells = targets.filter("hi > lo").select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % PERIOD) * GOLDEN % PERIOD).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") / width))
    dealt = points.join(hint(cells), "cell").filter("x >= lo AND x < hi").select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = staged(dealt.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n")), "slots")
    inner = dealt.withColumn("place", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1)
    common = inner.join(offsets(counts, ["sid"], "chunk", {"n": "offset"}), ["sid", "chunk"]).select("slot", "sid", (F.col("offset") + F.col("place")).alias("rank"))
    held = counts.groupBy("sid").agg(F.sum("n").alias("held"))
    short = targets.join(held, "sid", "left").select("sid", F.coalesce("held", F.lit(0)).alias("held"), F.ceil(F.col("quota") / block).alias("n")).filter("held < n")
    after = F.sum(F.col("n") - F.col("held")).over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    rest = short.withColumn("after", after + slots).withColumn("rank", F.explode(F.sequence(F.col("held"), F.col("n") - 1)))
    return common.unionByName(rest.select((F.col("after") + F.col("rank")).alias("slot"), "sid", "rank"))


def laid_out(sizes: DataFrame, targets: DataFrame, rows: int, small: bool, seed: str) -> DataFrame:
    """Each document's place (pos, start) in its source's shuffled stream, with the source's figures."""
    hint = F.broadcast if small else (lambda x: x)
    buckets = max(1, -(-rows // BUCKET_ROWS))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    t = targets.withColumnRenamed("source", "target_source")
    d = sizes.join(hint(t), sizes["source"].eqNullSafe(t["target_source"])).drop("target_source")
    d = d.withColumn("key", key).withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / 2**32))
    w = Window.partitionBy("sid", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    inner = d.withColumn("at", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("nth", F.row_number().over(w))
    sums = d.groupBy("sid", "bucket").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    return inner.join(offsets(sums, ["sid"], "bucket", {"s": "s0", "n": "n0"}), ["sid", "bucket"]).select(
        "doc_id", "source", "t1", "size", "sid", "source_size", "target", "quota", (F.col("at") + F.col("s0")).alias("start"), (F.col("nth") + F.col("n0")).alias("pos")
    )


def blocks(places: DataFrame, block: int = BLOCK, cap: int = 3) -> DataFrame:
    """sid, block, pos, at, words, first: how many words of which document each block of a source's stream holds from which on, and whether its first is among them."""
    d = places.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    d = d.withColumn("a", F.col("start") + F.col("epoch") * F.col("source_size"))
    d = d.withColumn("b", F.least(F.col("a") + F.col("size"), F.col("quota"))).filter("b > a")
    d = d.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    words = F.least("b", (F.col("block") + 1) * block) - F.greatest("a", F.col("block") * block)
    return d.select("sid", "block", "pos", F.greatest("a", F.col("block") * block).alias("at"), words.cast("long").alias("words"), (F.floor(F.col("a") / block) == F.col("block")).alias("first"))


def mix(docs: DataFrame, block: int = BLOCK, cap: int = 3, seed: str = "mix:") -> tuple[DataFrame, DataFrame]:
    """(places, taken): every document with its place and its source's target, and the words taken by (slot, sid, pos).

    ``docs`` has doc_id, source and text.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    sizes = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("t1"), word_count(text).alias("size")), "sizes")
    rows, total, sources = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.approx_count_distinct("source") + 1).first()
    small = sources <= BROADCAST_SOURCES
    targets = staged(source_targets(sizes, total, cap), "targets")
    places = staged(laid_out(sizes, targets, rows, small, seed), "places")
    need = -(-total // block)
    slots = schedule(spark, targets, need + need // 64 + 64 if total else 0, small, block)
    taken = blocks(places, block, cap).join(slots.withColumnRenamed("rank", "block"), ["sid", "block"])
    return places, taken


def mixed(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes of it, repeats counted), slots (how often it is begun: the slots)."""
    places, taken = mix(docs, **how)
    sums = taken.groupBy("sid", "pos").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.when(F.col("first"), F.col("slot")))).alias("slots"))
    out = places.join(sums, ["sid", "pos"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", F.array().cast("array<long>")).alias("slots"))


def in_order(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: slot, nth (in the slot), doc_id, source, words, sorted by slot; a slot holds the words of one block of one source."""
    places, taken = mix(docs, **how)
    nth = F.row_number().over(Window.partitionBy("slot").orderBy("at")) - 1
    held = taken.withColumn("nth", nth).join(places.select("sid", "pos", "doc_id", "source"), ["sid", "pos"])
    return held.select("slot", "nth", "doc_id", "source", "words").orderBy("slot", "nth")


def repeated_documents(docs: DataFrame, cap: int = 3, **how) -> DataFrame:
    """docs, each row as often as the mix begins its document; texts stay whole.

    Rows that agree in doc_id, source and text share their number: it is dealt to them one by one, by the hash of the row.
    """
    places, taken = mix(docs, cap=cap, **how)
    # a document is begun once for every block that holds its first word
    begun = taken.filter("first").groupBy("sid", "pos").agg(F.count(F.lit(1)).alias("times"))
    times = places.join(begun, ["sid", "pos"], "left").groupBy("doc_id", "source", "t1").agg(F.sum(F.coalesce("times", F.lit(0))).alias("times"), F.count(F.lit(1)).alias("n")).filter("times > 0")
    key = lambda i, s: [F.coalesce(i, F.lit(0)).alias("id0"), i.isNull().alias("unnamed"), F.coalesce(s, F.lit("")).alias("of"), s.isNull().alias("unsourced"), F.coalesce("t1", F.lit(0)).alias("t")]
    times = times.select(*key(F.col("doc_id"), F.col("source")), "times", "n")
    rows = docs.select(F.col("doc_id").cast("long").alias("own"), F.col("source").cast("string").alias("src"), F.xxhash64(F.col("text").cast("string")).alias("t1"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    on = ["id0", "unnamed", "of", "unsourced", "t"]
    dealt = rows.select(*key(F.col("own"), F.col("src")), "row").join(times, on)
    nth = F.row_number().over(Window.partitionBy(*on).orderBy(F.when(F.col("n") > 1, row_hash())))
    own = F.floor(F.col("times") / F.col("n")) + (nth <= F.col("times") % F.col("n")).cast("int")
    return dealt.select("row", own.cast("int").alias("own")).filter("own > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("own")))).select("row.*")


# -- registered query -----------------------------------------------------------


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.col("slots").cast("array<string>"), " ").alias("slots"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source
), t AS (
  SELECT *, (sid - 1) % 3 + 1 AS w, source_size * 3 AS cap, (SELECT sum(source_size) FROM s) AS total FROM s
), r AS (
  SELECT 0 AS step, sid, w, cap, total, FALSE AS full_ FROM t
  UNION ALL
  SELECT step + 1, sid, w, cap, total,
         full_ OR cap <= (total - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (), 0)) * w / nullif(sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (), 0)
  FROM r WHERE step < 40
), f AS (
  SELECT sid, CASE WHEN full_ THEN CAST(cap AS DOUBLE)
              ELSE CAST(total - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (), 0) AS DOUBLE) * w / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () END AS target
  FROM r WHERE step = 40
), p AS (
  SELECT t.sid, row_number() OVER () AS r, d.doc_id, d.size, t.source_size, round(f.target, 6) AS target,
         sum(d.size) OVER (PARTITION BY t.sid ORDER BY md5('mix:' || d.doc_id), d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS a,
         floor(round(f.target, 6)) AS q
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN f USING (sid)
), u AS (
  SELECT sid, least(floor(sum(round(f.target, 6)) OVER (ORDER BY sid) / greatest(total, 1) * 1000000000), 1000000000) AS hi, floor(round(f.target, 6)) AS q, total FROM f JOIN t USING (sid)
), v AS (
  SELECT *, coalesce(lag(hi) OVER (ORDER BY sid), 0) AS lo, (SELECT ceil(max(total) / 64) + floor(ceil(max(total) / 64) / 64) + 64 FROM t) AS slots FROM u
), x AS (
  SELECT i AS slot, sid, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS rank
  FROM (SELECT unnest(range(CAST((SELECT max(slots) FROM v) AS BIGINT))) AS i) JOIN v ON (i % 1000000000) * 618033989 % 1000000000 >= lo AND (i % 1000000000) * 618033989 % 1000000000 < hi
), y AS (
  SELECT v.sid, slots, ceil(q / 64) AS n, count(x.slot) AS held FROM v LEFT JOIN x USING (sid) GROUP BY ALL HAVING count(x.slot) < ceil(q / 64)
), z AS (
  SELECT slot, sid, rank FROM x UNION ALL
  SELECT slots + after + k, sid, held + k FROM (SELECT *, sum(n - held) OVER (ORDER BY sid) - (n - held) AS after, unnest(range(CAST(n - held AS BIGINT))) AS k FROM y)
), b AS (
  SELECT p.r, string_agg(CAST(CAST(z.slot AS BIGINT) AS VARCHAR), ' ' ORDER BY z.slot) AS slots
  FROM p, range(3) e(epoch), z
  WHERE p.size > 0 AND a + epoch * source_size < q AND z.sid = p.sid AND z.rank = floor((a + epoch * source_size) / 64) GROUP BY p.r
)
SELECT doc_id, size, source_size, target, coalesce(slots, '') AS slots,
       CAST(greatest(0, least(a + size, q) - a)
          + greatest(0, least(a + source_size + size, q) - a - source_size)
          + greatest(0, least(a + 2 * source_size + size, q) - a - 2 * source_size) AS BIGINT) AS taken
FROM p LEFT JOIN b USING (r)
"""

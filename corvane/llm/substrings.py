"""Repeated passages, found with a log-structured fingerprint index.

A window is ``window`` consecutive words of one document.  Words that lie in a
window whose word sequence also starts elsewhere are removed.

* Fingerprints.  Of the word runs of length ``ANCHOR`` in a window, the one
  with the least hash (the leftmost of equals) is its anchor.  Equal windows
  have equal anchors at equal offsets, so no repeated window can be missed,
  and a document needs an entry for about every fourteenth word only.
* Index.  The fingerprints of a batch become an immutable run, bucketed and
  sorted by hash, with a count for each.  A new batch is written as such a run
  and merge-joined with all earlier ones, bucket by bucket and without a
  shuffle; what it shares with them, or repeats itself, is reported.  Runs are
  compacted into one when they are more than ``FAN``, or on demand.  An index
  lies in a folder of its own and can be opened again by later applications.
* Verification.  All windows around reported anchors are hashed whole, twice to 64
  bits from two independent hashes of their words; a window counts as repeated
  only if that pair occurs again.  Even 1e14 windows leave the chance of one
  false repeat at 1e-10.

Equal texts are one entry (two 64-bit hashes); if there are several of them
and they have a window at all, all of their words are covered.  Counts, never
lists, are kept for each hash, so a passage of any frequency costs a row per
occurrence.  The query takes its table in ``BATCHES`` batches, so that runs are
met and compacted on its path as they are in daily use.

Defined results: null and empty texts have no words and keep the hash of
nothing; documents shorter than a window lose nothing; null and repeated
doc_ids are rows like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded_words, own_folder, released, run_hashes, ship, slices, staged, text_bytes, words

WINDOW, ANCHOR, FAN, BATCHES = 35, 8, 2, 4
#: Low bits of an anchor's hash that give way to its place; windows looked at in one go.
_PLACE_BITS, _STEP = 24, 1 << 20


def _keyed(docs: DataFrame) -> DataFrame:
    """id, text and the text's two hashes."""
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.select("id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2"), "text")


def anchor_places(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of all windows, row of each, place of its anchor) over the words of a batch."""
    n = len(hashes) - window + 1
    if n <= 0 or window < ANCHOR:
        none = np.zeros(0, np.int64)
        return none, none, none
    runs = run_hashes(hashes, ANCHOR)
    places, span = np.uint64((1 << _PLACE_BITS) - 1), window - ANCHOR + 1
    anchor = np.empty(n, np.int64)
    for a in range(0, n, _STEP):  # texts of any length, in overlapping stretches
        part = runs[a : a + _STEP + span - 1]
        low = (part & ~places) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        anchor[a : a + len(low)] = (low & places).astype(np.int64) + a
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(row[:n] == row[window - 1 :])
    return starts, row[starts], anchor[starts]


def fingerprints(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """texts (t1, t2, text) -> h, t1, t2, at: hash of each anchor and the number of its first word."""
    import pyarrow as pa

    ship(texts.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                body, offs = text_bytes(part.column("text"))
                starts, ends, first = words(body, offs)
                _, (hashes,) = coded_words(body, starts, ends)
                _, row, place = anchor_places(hashes, first, window)
                if len(place):
                    new = np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])]
                    row, place = row[new], place[new]
                    take = pa.array(row)
                    h = run_hashes(hashes, ANCHOR)[place].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h), part.column("t1").take(take), part.column("t2").take(take), pa.array((place - first[row]).astype(np.int32))], names=["h", "t1", "t2", "at"])

    return texts.select("t1", "t2", "text").mapInArrow(run, "h long, t1 long, t2 long, at int")


class FingerprintIndex:
    """Immutable runs of (h, n), bucketed and sorted by h, in a folder.

    A run's folder is named by the batches it holds and its number of buckets.  It counts once Spark has marked it as
    whole, and no longer once a run that holds more has been written, so an index whose writer was lost opens as it was.
    """

    def __init__(self, spark, path: str | None = None, fan: int = FAN, buckets: int | None = None):
        self.spark, self.fan = spark, fan
        self.path = path or own_folder(spark, "index")
        self.runs: list[tuple[int, int, DataFrame]] = []
        held = []
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in fs.listStatus(folder) if fs.exists(folder) else []:
            name = found.getPath().getName()
            if name.startswith("run-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(found.getPath(), "_SUCCESS")):
                held.append(tuple(map(int, name.split("-")[1:])))
        for first, last, count in sorted(held):
            if not any((a, b) != (first, last) and a <= first and last <= b for a, b, _ in held):
                self.runs.append((first, last, self._opened(first, last, count)))
        self.buckets = held[0][2] if held else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.batches = max((last + 1 for _, last, _ in self.runs), default=0)

    def _folder(self, first: int, last: int, count: int) -> str:
        return f"{self.path}/run-{first:06}-{last:06}-{count}"

    def _table(self, make) -> DataFrame:
        """The table that make(name) defines; the name is needed only to tell Spark of the buckets."""
        name = f"corvane_run_{uuid.uuid4().hex}"
        make(name)
        run = self.spark.table(name)
        run.schema
        self.spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
        return run

    def _opened(self, first: int, last: int, count: int) -> DataFrame:
        where = self._folder(first, last, count)
        return self._table(lambda name: self.spark.sql(f"CREATE TABLE {name} (h BIGINT, n BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {count} BUCKETS LOCATION '{where}'"))

    def _written(self, rows: DataFrame, first: int, last: int) -> tuple[int, int, DataFrame]:
        where = self._folder(first, last, self.buckets)
        with released(self.spark):
            return first, last, self._table(lambda name: rows.write.bucketBy(self.buckets, "h").sortBy("h").mode("overwrite").option("path", where).format("parquet").saveAsTable(name))

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes in a batch's fingerprints (h); returns the hashes that it shares with earlier batches or repeats itself."""
        run = self._written(batch.groupBy("h").agg(F.count(F.lit(1)).alias("n")), self.batches, self.batches)
        self.batches += 1
        met, again = run[2], F.col("n") > 1
        for i, (_, _, old) in enumerate(self.runs):
            met = met.join(old.select("h", F.col("n").alias(f"n{i}")).hint("merge"), "h", "left")
            again |= F.col(f"n{i}").isNotNull()
        hits = staged(met.filter(again).select("h"), "hits")
        self.runs.append(run)
        self.compact(self.fan)
        return hits

    def compact(self, most: int = 1) -> None:
        """Merges neighbouring runs, those of the fewest batches first, until there are ``most`` at most."""
        while len(self.runs) > max(1, most):
            at = min(range(len(self.runs) - 1), key=lambda i: self.runs[i + 1][1] - self.runs[i][0])
            (first, _, a), (_, last, b) = self.runs[at : at + 2]
            # a merge join, not a union: both runs lie sorted in the same buckets
            both = a.join(b.select("h", F.col("n").alias("m")).hint("merge"), "h", "full").select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
            self.runs[at : at + 2] = [self._written(both, first, last)]

    def repeated(self) -> DataFrame:
        """The hashes that occur more than once in all."""
        self.compact()
        return self.runs[0][2].filter("n > 1").select("h")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """texts (t1, t2, text, ats) -> w1, w2, t1, t2, start: the windows whose anchors are among ats."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                body, offs = text_bytes(part.column("text"))
                starts, ends, first = words(body, offs)
                _, (hashes, others) = coded_words(body, starts, ends, (0, 1))
                begin, row, place = anchor_places(hashes, first, window)
                ats = part.column("ats")
                ats = pa.concat_arrays([ats]) if ats.offset else ats
                edges = np.frombuffer(ats.buffers()[1], np.int32, len(ats) + 1)
                marked = np.zeros(len(hashes) + 1, bool)
                marked[np.repeat(first[:-1], np.diff(edges)) + np.asarray(ats.values)[edges[0] : edges[-1]]] = True
                on = marked[place]
                begin, row = begin[on], row[on]
                if len(begin):
                    take = pa.array(row)
                    w1 = run_hashes(hashes, window, 1)[begin].view(np.int64)
                    w2 = run_hashes(others, window, 2)[begin].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), part.column("t1").take(take), part.column("t2").take(take), pa.array((begin - first[row]).astype(np.int32))], names=["w1", "w2", "t1", "t2", "start"])

    return texts.select("t1", "t2", "text", "ats").mapInArrow(run, "w1 long, w2 long, t1 long, t2 long, start int")


def repeated_windows(keyed: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """keyed (t1, t2, text) -> t1, t2, starts (of repeated windows; empty if they are not listed), whole (all words are covered)."""
    prints = staged(fingerprints(keyed, window).withColumn("batch", F.pmod("t1", F.lit(batches)).cast("int")), "fingerprints", by="batch")
    index = FingerprintIndex(keyed.sparkSession)
    hits = None
    for b in range(batches):  # as many batches as the caller has; each meets the runs of those before it
        new = index.add(prints.filter(F.col("batch") == b))
        hits = new if hits is None else hits.unionByName(new)
    # written, so that a join has shuffles on both sides and can split the rows of a frequent hash
    hits = staged(hits.distinct(), "hits")
    marks = prints.join(hits, "h").groupBy("t1", "t2").agg(F.collect_set("at").alias("ats"))
    texts = keyed.groupBy("t1", "t2").agg(F.min("text").alias("text"))
    held = texts.join(marks, ["t1", "t2"])
    # of several equal texts every window is repeated; their windows still tell of other texts'
    found = staged(_windows(held, window), "windows")
    again = staged(found.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2"), "again")
    starts = found.join(again, ["w1", "w2"]).groupBy("t1", "t2").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    copies = keyed.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("t1", "t2", F.lit(True).alias("whole"))
    both = starts.join(copies, ["t1", "t2"], "full")
    return staged(both.select("t1", "t2", F.coalesce("starts", F.array().cast("array<int>")).alias("starts"), F.coalesce("whole", F.lit(False)).alias("whole")), "repeats")


def covered(n: int, starts, whole: bool, window: int) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    if whole:
        return np.full(n, n >= window)
    edge = np.zeros(n + 1, np.int32)
    at = np.asarray(starts, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def without_repeats(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, digest: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed and the kept words, joined by single blanks, as ``kept`` or as their sha256 in hex."""
    import pyarrow as pa

    keyed = _keyed(docs)
    repeats = repeated_windows(keyed, window, batches)
    name = "kept_sha256" if digest else "kept"

    def run(parts):
        for batch in parts:
            out = [[], [], []]
            for text, starts, whole in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), batch.column("whole").to_pylist()):
                own = text.encode().split()  # bytes.split parts at exactly [\x20\x09-\x0D]
                n = len(own)
                if starts or whole:
                    own = list(compress(own, ~covered(n, starts, whole, window)))
                kept = b" ".join(own)
                out[0].append(n)
                out[1].append(n - len(own))
                out[2].append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_words", "n_removed", name])

    return keyed.join(repeats, ["t1", "t2"], "left").select("id", "text", "starts", "whole").mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} string")


# -- registered query -----------------------------------------------------------


def op9_substrings(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35
), h AS (
  SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS m FROM s
), d AS (
  SELECT r, i FROM h JOIN (SELECT m FROM h GROUP BY m HAVING count(*) > 1) USING (m)
), c AS (
  SELECT DISTINCT r, i + o AS p FROM d, range(35) t(o)
), x AS (
  SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), k AS (
  SELECT x.* FROM x ANTI JOIN c USING (r, p)
), j AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM k GROUP BY r
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(j.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(j.kept, '')) AS kept_sha256
FROM w LEFT JOIN j ON j.r = w.r
"""

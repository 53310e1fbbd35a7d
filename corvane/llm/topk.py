"""Exact top-k search by inner product, through distributed histogram selection.

Vectors are scored as whole numbers: every component x becomes floor(256 x).
Queries go out in blocks of ``BLOCK_BYTES`` (a bounded broadcast); all
candidates are scored against a block in place, ``LANES`` queries at a time.
Rounds of global histograms then narrow, for each query, the range that holds
its k-th best score:

* a task counts its scores by bin, for the bins from its own k-th best upwards
  (lower ones can't hold the global k-th), so it sends k bins a query at most,
* the sums show in which bin the k-th score lies; the next round cuts that bin.

When the range is one value, or exactly k scores are at or above it, a last
pass picks all scores above and the smallest ids of those equal to it.

Scores are exact, whatever the components: products are summed in 53 bits
where these hold them, else in 64, else in whole numbers of any length, for
which large vectors are packed apart.  Histograms treat scores beyond +-2**61 as
that bound; ranks go by the exact score.

Defined results: vectors that are null, or hold null or non-finite components,
take no part; a query meets only vectors of its own length; a score beyond 64
bits is ranked exactly and returned as the nearest 64-bit number; rows with a null
id take no part; of several query rows with one id the least vector that takes part asks, and
no row with the query's id answers; equal candidates are rows of their own;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, staged

#: Queries scored at a time, bins in a histogram, vectors in a packed row, bytes of a block of queries.
LANES, BINS, CHUNK, BLOCK_BYTES = 512, 2048, 2048, 16 << 20
#: Scores beyond this count as this in histograms; components from LARGE on are packed apart.
FAR, LARGE = 1 << 61, 1 << 24
_LOW = np.iinfo(np.int64).min


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x): int64 if that holds all values, else Python's numbers."""
    if not x.size or np.abs(x).max() < 2.0**54:
        return np.floor(256 * x).astype(np.int64)
    return np.array([int(v) * 256 if abs(v) >= 2.0**53 else math.floor(256 * v) for v in x.ravel().tolist()], object).reshape(x.shape)


def pack(vectors: DataFrame) -> DataFrame:
    """vectors (id, vector) -> rows of up to CHUNK vectors of one length and of large or small components: dim, n, ids, data, norm (the greatest length)."""
    import pyarrow as pa

    ship(vectors.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                alike: dict[tuple[int, bool], list] = {}
                for i, v in zip(part.column("id").to_pylist(), part.column("vector").to_pylist()):
                    if i is None or v is None or any(x is None for x in v):
                        continue
                    x = np.asarray(v, np.float64)
                    if np.isfinite(x).all():
                        alike.setdefault((len(x), bool(np.abs(x).max(initial=0) * 256 >= LARGE)), []).append((i, x))
                rows = []
                for (dim, _), held in sorted(alike.items()):
                    data = np.stack([x for _, x in held])
                    with np.errstate(over="ignore"):
                        norm = float(256 * np.sqrt((data**2).sum(1).max())) if dim else 0.0
                    rows.append((dim, len(held), np.array([i for i, _ in held], np.int64).tobytes(), data.tobytes(), norm + dim))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64()))], names=["dim", "n", "ids", "data", "norm"])

    return vectors.select("id", "vector").mapInArrow(run, "dim int, n int, ids binary, data binary, norm double")


def _most(x: np.ndarray) -> int:
    return max(1, int(abs(x).max(initial=0))) if x.dtype != object else max(1, *map(abs, x.ravel().tolist()))


def _key(score: int) -> bytes:
    """Sorts like the score, for scores of one sign."""
    size = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    key = len(size).to_bytes(4, "big") + size
    return key if score >= 0 else bytes(255 - b for b in key)


class _Scorer:
    """A block of queries of one length."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        self.ids, self.dim = ids, data.shape[1]
        self.lanes = [(a, whole(data[a : a + LANES])) for a in range(0, len(ids), LANES)]
        self.most = [_most(x) for _, x in self.lanes]

    def scores(self, row: dict):
        """For each lane: (its first query, candidate ids, exact scores of candidates x queries, the same within FAR with _LOW where id meets itself)"""
        ids = np.frombuffer(row["ids"], np.int64)
        data = whole(np.frombuffer(row["data"], np.float64).reshape(len(ids), self.dim))
        top = _most(data)
        for (a, own), most in zip(self.lanes, self.most):
            bound = self.dim * most * top
            kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
            exact = data.astype(kind) @ own.T.astype(kind)
            if kind is object:
                near = np.array([max(-FAR, min(FAR, int(s))) for s in exact.ravel().tolist()], np.int64).reshape(exact.shape)
            else:
                exact = exact.astype(np.int64)
                near = np.clip(exact, -FAR, FAR) if bound > FAR else exact
            yield a, ids, exact, np.where(ids[:, None] != self.ids[None, a : a + own.shape[0]], near, _LOW)


def _kth(s: np.ndarray, k: int) -> np.ndarray:
    """The k-th best of each column, or less than any score."""
    return np.maximum(np.partition(s, len(s) - k, axis=0)[len(s) - k], _LOW + 1) if len(s) > k else np.full(s.shape[1], _LOW + 1)


def _histogram(candidates: DataFrame, scorer: _Scorer, k: int, lo: np.ndarray, hi: np.ndarray, width: np.ndarray) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["dim"] != scorer.dim:
                    continue
                for a, _, _, s in scorer.scores(row):
                    own = slice(a, a + s.shape[1])
                    least, step = lo[own], width[own]
                    # whole bins, from that of the k-th best upwards
                    start = least + (np.maximum(_kth(s, k), least) - least) // step * step
                    _, query = at = np.nonzero((s >= start) & (s <= hi[own]))
                    bins = (s[at] - least[query]) // step[query]
                    key, n = np.unique((query + a) * np.int64(BINS + 1) + bins, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key // (BINS + 1)), pa.array(key % (BINS + 1)), pa.array(n.astype(np.int64))], names=["query", "bin", "n"])

    return candidates.mapInArrow(run, "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def _located(candidates: DataFrame, scorer: _Scorer, k: int, reach: int) -> np.ndarray:
    """For each query a score that its k best reach, with no other score above it; rounds of histograms."""
    n = len(scorer.ids)
    lo, hi, above, done = np.full(n, -reach), np.full(n, reach), np.zeros(n, np.int64), np.zeros(n, bool)
    while not done.all():
        width = np.maximum(1, -(-(hi - lo + 1) // BINS))
        found = _histogram(candidates, scorer, k, lo, np.where(done, lo - 1, hi), width)
        down = Window.partitionBy("query").orderBy(F.col("bin").desc())
        found = found.withColumn("upto", F.sum("n").over(down))
        need = candidates.sparkSession.createDataFrame([(i, int(k - above[i])) for i in range(n) if not done[i]], "query long, need long")
        found = found.join(F.broadcast(need), "query").filter("upto >= need AND upto - n < need").select("query", "bin", "n", "upto").collect()
        met = {r["query"]: r for r in found}
        for i in np.flatnonzero(~done):
            if (r := met.get(int(i))) is None:  # fewer candidates than k: all are taken
                done[i] = True
                continue
            above[i] += r["upto"] - r["n"]
            lo[i] += r["bin"] * width[i]
            hi[i] = min(hi[i], lo[i] + width[i] - 1)
            done[i] = width[i] == 1 or above[i] + r["n"] == k
    return lo


def _picked(candidates: DataFrame, scorer: _Scorer, k: int, floor: np.ndarray) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["dim"] != scorer.dim:
                    continue
                for a, ids, exact, s in scorer.scores(row):
                    c, q = np.nonzero(s >= np.maximum(_kth(s, k), floor[a : a + s.shape[1]]))
                    found = exact[c, q]
                    if exact.dtype == object:
                        far = [_key(v) if not -(2**63) <= v < 2**63 else b"" for v in found.tolist()]
                        near = np.array([max(-(2**63), min(2**63 - 1, v)) for v in found.tolist()], np.int64)
                        order = np.array(sorted(range(len(q)), key=lambda i: (q[i], -found[i], ids[c[i]])), np.int64)
                    else:
                        far, near, order = None, found, np.lexsort((ids[c], -found, q))
                    held = q[order]
                    order = order[np.arange(len(held)) - np.searchsorted(held, held) < k]
                    far = pa.nulls(len(order), pa.binary()) if far is None else pa.array([far[i] or None for i in order], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(scorer.ids[a + q[order]]), pa.array(ids[c[order]]), pa.array(near[order]), far], names=["query_id", "id", "score", "far"])

    return candidates.mapInArrow(run, "query_id long, id long, score long, far binary")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """queries and candidates (id, vector) -> query_id, rank, id, score: each query's k best, ties to smaller ids."""
    spark = candidates.sparkSession
    ship(spark)
    held = staged(pack(candidates), "candidates")
    sound = F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    asked = queries.filter(F.col("id").isNotNull() & sound).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = staged(asked, "queries")
    rows, dim = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    groups = -(-rows * 8 * max(1, dim) // BLOCK_BYTES)
    reach = {r["dim"]: r["norm"] for r in held.groupBy("dim").agg(F.max("norm").alias("norm")).collect()}
    out = None
    for g in range(groups):
        block = pack(asked.filter(F.pmod(F.xxhash64("id"), F.lit(groups)) == g)).collect()
        for dim in sorted({r["dim"] for r in block} & set(reach)):
            own = [r for r in block if r["dim"] == dim]
            ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in own])
            data = np.concatenate([np.frombuffer(r["data"], np.float64).reshape(r["n"], dim) for r in own])
            scorer = _Scorer(ids, data)
            # by Cauchy and Schwarz, with room for rounding
            bound = reach[dim] * max(r["norm"] for r in own) * 1.0001 + 2
            floor = _located(held, scorer, k, int(min(bound, FAR)))
            part = _picked(held, scorer, k, floor)
            if groups > 1:
                part = staged(part, "picked")
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "query_id long, id long, score long, far binary")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("far").desc(), "id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


# -- registered query -----------------------------------------------------------


def op7_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return top_k(vectors.filter("id % 50 = 0"), vectors, 5).withColumnRenamed("id", "vec_id")


OP7_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

"""Near-duplicate groups by b-bit MinHash.

A document is the set of its distinct runs of ``k`` words (ASCII case folded);
they are told apart by their words, and so set sizes are exact.  Equal sets
(128 bits over their runs' 64-bit hashes) form one class; what follows is about
classes.

* Signatures.  Minima under ``ROWS * bands`` hash functions; the bands' hashes
  give candidates, and of each minimum only ``BITS`` low bits are kept, packed
  into longs.  The number of bands follows from the threshold, so that a pair
  at the threshold is missed with probability ``MISS`` at most.
* Candidates.  In a bucket of up to ``SMALL`` classes all pairs are candidates;
  in a larger one each class pairs with the bucket's first class only.
* Estimate.  The share of equal signature fields, corrected for chance
  (2**-BITS), must come within ``SIGMAS`` standard deviations of the threshold.
* Confirmation on the full sets of word runs, taken from the texts, then
  components of the links by smallest label.
* Large buckets whose classes are not yet one component: every class outside
  the bucket's main component meets every class of the bucket, in blocks of
  about ``BLOCK`` by ``BLOCK``; a block skips pairs that are connected already
  and sends links that connect something only.  A pair meets in the first band
  that it shares.  So no link between components is lost, and no pairs are
  listed inside one.  Blocks compare sets of hashes; what they send is confirmed
  on the words like any other pair, and a contradiction stops the job.

What belongs to a bucket or a node comes back to its members by joins of
written tables, whose shuffles adaptive execution may split for a hot key.

Links, components and fingerprints stay distributed; the driver sees counts.

Defined results: null and empty texts have an empty set, are linked with
nothing and are their own component; fewer than ``k`` words count as one run;
a null doc_id is never a component's id if the component has any other;
repeated rows belong to one component; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, coded_words, mapped, mix, row_hash, run_hashes, ship, slices, staged, text_bytes, words

ROWS, BITS, MISS, SIGMAS = 5, 4, 1e-6, 5.0
SMALL, BLOCK = 8, 512
_FIELDS = 64 // BITS


def band_count(percent: int) -> int:
    t = min(percent / 100, 1 - 1e-9)
    return max(1, math.ceil(math.log(MISS) / math.log(1 - t**ROWS)))


def shingles(body: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all distinct runs of k words, by row; a shorter text is one run.  Runs are equal if their words are."""
    body = LOWER[body]
    starts, ends, first = words(body, offs)
    codes, (hashes,) = coded_words(body, starts, ends)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    rows, out, places = [], [], []
    n = len(hashes) - k + 1
    if n > 0:
        at = np.flatnonzero(row[:n] == row[k - 1 :])
        rows.append(row[at])
        out.append(run_hashes(hashes, k)[at])
        places.append(at)
    for c in range(1, k):
        short = np.flatnonzero(count == c)
        if len(short):
            rows.append(short)
            out.append(run_hashes(hashes, c, seed=100 + c)[first[short]])
            places.append(first[short])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rows, out, places = np.concatenate(rows), np.concatenate(out), np.concatenate(places)
    bits = np.uint64(max(1, int(len(count) - 1).bit_length()))
    order = np.argsort((rows.astype(np.uint64) << (np.uint64(64) - bits)) | (out >> bits))
    rows, out, places = rows[order], out[order], places[order]
    same = np.flatnonzero((rows[1:] == rows[:-1]) & (out[1:] == out[:-1]))
    # a row's runs have one length, so a lone run has nothing to be equal to
    if all((codes[places[same] + j] == codes[places[same + 1] + j]).all() for j in range(k)):
        new = np.ones(len(rows), bool)
        new[same + 1] = False
        return rows[new], out[new]
    seen: dict[tuple, int] = {}  # two runs share a hash: told apart one by one
    for i, (r, p) in enumerate(zip(rows.tolist(), places.tolist())):
        seen.setdefault((r, *codes[p : p + k].tolist()), i)
    kept = np.array(list(seen.values()))
    return rows[kept], out[kept]


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(17).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signature_columns(batch, k: int, bands: int):
    import pyarrow as pa

    body, offs = text_bytes(batch.column("text"))
    row, h = shingles(body, offs, k)
    n = batch.num_rows
    size = np.bincount(row, minlength=n)
    full = np.flatnonzero(size)
    begin = (np.cumsum(size) - size)[full]
    perms, h = bands * ROWS, mix(h)
    keys = np.zeros((2, n), np.uint64)
    minima = np.zeros((perms, len(full)), np.uint64)
    if len(full):
        for j, seed in enumerate((0x1234567, 0x89ABCDE)):
            keys[j, full] = np.add.reduceat(mix(h ^ np.uint64(seed)), begin)
        for j, a in enumerate(_multipliers(perms)):
            minima[j] = np.minimum.reduceat(h * a, begin)
    minima = mix(minima)
    band = np.zeros((bands, len(full)), np.uint64)
    for j in range(bands):
        value = np.full(len(full), np.uint64(j + 1), np.uint64)
        for r in range(ROWS):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + minima[j * ROWS + r])
        band[j] = value
    low = minima & np.uint64((1 << BITS) - 1)
    longs = -(-perms // _FIELDS)
    packed = np.zeros((longs, len(full)), np.uint64)
    for j in range(perms):
        packed[j // _FIELDS] |= low[j] << np.uint64(BITS * (j % _FIELDS))

    def lists(values, width):
        offsets = np.zeros(n + 1, np.int32)
        offsets[1:][full] = width
        return pa.ListArray.from_arrays(pa.array(np.cumsum(offsets).astype(np.int32)), pa.array(np.ascontiguousarray(values.T).reshape(-1).view(np.int64)))

    c = np.ascontiguousarray(keys.T).tobytes()
    return [pa.array([c[16 * i : 16 * i + 16] if size[i] else None for i in range(n)], pa.binary()), pa.array(size.astype(np.int64)), lists(band, bands), lists(packed, longs)]


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """docs (id, t1, t2, text) -> id, t1, t2, c (the set's key, null if empty), n (its size), bands, sig."""
    import pyarrow as pa

    ship(docs.sparkSession)
    bands = band_count(percent)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("t1"), part.column("t2"), *_signature_columns(part, k, bands)], names=["id", "t1", "t2", "c", "n", "bands", "sig"])

    return mapped(docs.select("id", "t1", "t2", "text"), run, "id long, t1 long, t2 long, c binary, n long, bands array<long>, sig array<long>")


def full_sets(texts: DataFrame, k: int) -> DataFrame:
    """texts (c, text) -> c, items (the hashes of the set's runs, 8 bytes each)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                row, h = shingles(*text_bytes(part.column("text")), k)
                edges = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("c"), pa.array([np.sort(h[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())], names=["c", "items"])

    return mapped(texts.select("c", "text"), run, "c binary, items binary")


def word_runs(text: str, k: int) -> set[tuple[bytes, ...]]:
    own = text.encode().lower().split()  # of bytes: lower() folds A-Z, split() parts at [\x20\x09-\x0D]
    return set(zip(*(own[i:] for i in range(k)))) if len(own) >= k else {tuple(own)} if own else set()


def similar(a: set, b: set, percent: int) -> bool:
    """100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def least_estimate(percent: int) -> float:
    """What the estimated similarity must reach for a pair to be confirmed."""
    t, perms, chance = percent / 100, ROWS * band_count(percent), 2.0**-BITS
    p = chance + (1 - chance) * t
    return t - SIGMAS * math.sqrt(p * (1 - p) / perms) / (1 - chance)


def _estimate(a, b, percent: int):
    """Similarity from two packed signatures: fields that differ have a bit set after folding."""
    perms, chance = ROWS * band_count(percent), 2.0**-BITS

    def differing(x, y):
        z = x.bitwiseXOR(y)
        for s in range(1, BITS):
            z = z.bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), s))
        ones = sum(1 << (BITS * i) for i in range(_FIELDS))
        return F.bit_count(z.bitwiseAND(F.lit(ones)))

    off = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, v: s + v)
    return ((1 - off / F.lit(perms)) - chance) / (1 - chance)


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, label: the least node of each component; smallest labels spread, with pointer jumping."""
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        step = step.join(jump, step["label"] == jump["to"], "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        step = staged(step, "labels")
        labels = step.select("node", "label")
        if not step.filter("label <> old").limit(1).count():
            return labels


def _block_links(percent: int):
    """For one block of a large bucket: the links that connect something, by their sets' hashes."""
    import pyarrow as pa
    import pyarrow.compute

    least, perms, chance = least_estimate(percent), ROWS * band_count(percent), 2.0**-BITS
    ones = np.uint64(sum(1 << (BITS * i) for i in range(_FIELDS)))

    def run(block: pa.Table) -> pa.Table:
        band = block.column("band")[0].as_py()
        on = block.column("stray")
        stray, member = block.filter(on), block.filter(pa.compute.invert(on))
        out = []
        if len(stray) and len(member):
            wide = lambda x, c: x.column(c).combine_chunks().flatten().to_numpy().reshape(len(x), -1)
            sig = [wide(x, "sig").view(np.uint64) for x in (stray, member)]
            bands = [wide(x, "bands") for x in (stray, member)]
            sets = [[np.frombuffer(s, np.uint64) for s in x.column("items").to_pylist()] for x in (stray, member)]
            sizes = np.array([len(s) for s in sets[1]])
            keys = [x.column("c").to_pylist() for x in (stray, member)]
            root = {}

            def find(x):
                while root.get(x, x) != x:
                    x = root[x]
                return x

            labels = [x.column("label").to_pylist() for x in (stray, member)]
            for i in range(len(stray)):
                x = sig[1] ^ sig[0][i]
                z = x.copy()
                for s in range(1, BITS):
                    z |= x >> np.uint64(s)
                off = np.bitwise_count(z & ones).sum(1)
                near = ((1 - off / perms) - chance) / (1 - chance) >= least
                near &= ~(bands[1][:, :band] == bands[0][i][:band]).any(1)
                for j in np.flatnonzero(near):
                    near[j] = find(labels[0][i]) != find(labels[1][j])
                at = np.flatnonzero(near)
                if not len(at):
                    continue
                own = sets[0][i]
                pool = np.concatenate([sets[1][j] for j in at])
                place = np.minimum(np.searchsorted(own, pool), len(own) - 1)
                edges = np.cumsum(sizes[at]) - sizes[at]
                inter = np.add.reduceat((own[place] == pool).astype(np.int64), edges)
                for j in at[100 * inter >= percent * (len(own) + sizes[at] - inter)]:
                    a, b = find(labels[0][i]), find(labels[1][j])
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((keys[0][i], keys[1][j]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    return run


def links(classes: DataFrame, texts, k: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that give the right components.

    classes: c, bands, sig; texts: a function from a DataFrame of c to a DataFrame of c, text.
    """
    ship(classes.sparkSession)
    in_band = classes.select("c", F.posexplode("bands").alias("band", "bucket"))
    counts = staged(in_band.groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("lead")).filter("m > 1"), "counts")
    members = staged(in_band.join(counts, ["bucket", "band"]), "members")
    held = staged(texts(members.select("c").distinct()), "texts")
    small = members.filter(F.col("m") <= SMALL)
    pairs = small.select("bucket", "band", F.col("c").alias("a")).join(small.select("bucket", "band", F.col("c").alias("b")), ["bucket", "band"]).filter("a < b").select("a", "b")
    large = members.filter(F.col("m") > SMALL)
    pairs = pairs.unionByName(large.filter("lead < c").select(F.col("lead").alias("a"), F.col("c").alias("b"))).distinct()
    sig = lambda name: classes.select(F.col("c").alias(name), F.col("sig").alias(f"sig_{name}"))
    near = pairs.join(sig("a"), "a").join(sig("b"), "b").filter(_estimate(F.col("sig_a"), F.col("sig_b"), percent) >= least_estimate(percent)).select("a", "b")
    found = staged(_confirmed(staged(near, "near"), held, k, percent), "links")
    if not large.limit(1).count():
        return found
    labels = components(found)
    placed = large.join(labels, large["c"] == labels["node"], "left").select("bucket", "band", "c", "m", F.coalesce("label", "c").alias("label"))
    placed = staged(placed, "placed")
    shares = placed.groupBy("bucket", "band", "label").agg(F.count(F.lit(1)).alias("n"))
    split = shares.groupBy("bucket", "band").agg(F.max(F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("all")).filter("labels > 1")
    split = staged(split.select("bucket", "band", F.col("main.label").alias("main"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).alias("sbs"), F.ceil(F.col("all") / BLOCK).alias("mbs")), "split")
    rows = placed.join(split, ["bucket", "band"])
    nth = lambda of: F.pmod(F.xxhash64("c"), F.col(of))
    as_member = rows.withColumn("mb", nth("mbs")).withColumn("sb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sbs") - 1))).withColumn("stray", F.lit(False))
    as_stray = rows.filter("label <> main").withColumn("sb", nth("sbs")).withColumn("mb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mbs") - 1))).withColumn("stray", F.lit(True))
    columns = ["bucket", "band", "sb", "mb", "stray", "label", "c"]
    own = staged(rows.select("c").distinct(), "unlike")
    sets = full_sets(held.join(own, "c", "left_semi"), k)
    whole = staged(classes.select("c", "bands", "sig").join(sets, "c"), "whole")
    blocks = as_member.select(*columns).unionByName(as_stray.select(*columns)).join(whole, "c")
    more = staged(blocks.groupBy("bucket", "band", "sb", "mb").applyInArrow(_block_links(percent), "a binary, b binary").distinct(), "more")
    return found.unionByName(staged(_confirmed(more, held, k, percent, sure=True), "confirmed"))


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int, sure: bool = False) -> DataFrame:
    """The pairs (a, b) whose full sets, taken from texts (c, text), are similar; if ``sure``, one that is not stops the job."""
    import pyarrow as pa

    def run(batches):
        last: tuple[str, set] = ("", set())
        for batch in batches:
            for part in slices(batch, "text_a"):
                on = []
                for a, b in zip(part.column("text_a").to_pylist(), part.column("text_b").to_pylist()):
                    if last[0] != b:  # rows come sorted by b
                        last = (b, word_runs(b, k))
                    on.append(similar(word_runs(a, k), last[1], percent))
                if sure and not all(on):
                    raise ValueError("two different word runs share a hash")
                kept = part.filter(pa.array(on, pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    of = lambda name: texts.select(F.col("c").alias(name), F.col("text").alias(f"text_{name}"))
    return mapped(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b"), run, "a binary, b binary")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> doc_id, t1, t2 (hashes of the text), n_shingles, component_id, kept, label (of the component; null without shingles)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.select("id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2"), "text")
    own = staged(signatures(keyed, k, percent), "signatures")
    classes = own.filter("n > 0").groupBy("c").agg(F.min("id").alias("rep"), F.min(F.struct("t1", "t2")).alias("t"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = staged(classes.select("c", "rep", "t.t1", "t.t2", "bands", "sig"), "classes")

    def texts(wanted: DataFrame) -> DataFrame:
        of = classes.join(wanted, "c", "left_semi").select("c", "t1", "t2")
        return keyed.groupBy("t1", "t2").agg(F.min("text").alias("text")).join(of, ["t1", "t2"]).select("c", "text")

    labels = components(links(classes, texts, k, percent))
    of_class = classes.select("c", "rep").join(labels, classes["c"] == labels["node"], "left").select("c", "rep", F.coalesce("label", "c").alias("label"))
    least = of_class.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(least, "label").select("c", "component_id", "label")
    out = own.select("id", "t1", "t2", "c", "n").join(of_class, "c", "left")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias("doc_id"), "t1", "t2", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.when(F.col("n") > 0, F.col("label")).alias("label"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows that stay, one of each component, with all their columns.

    A component keeps its least doc_id; of several rows with that doc_id the one with the least hashes stays.  Rows
    without shingles are components of their own, but for those that agree in doc_id and text.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), k, percent).filter("kept")
    kept = kept.groupBy("label", F.col("doc_id").alias("id"), "t1", "t2").agg(F.count(F.lit(1)).alias("rows"))
    one = kept.filter("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("t1", "t2", "id", "rows")).alias("o")).select("o.*")
    kept = one.unionByName(kept.filter("label IS NULL").drop("label"))
    key = lambda c: [F.coalesce(c, F.lit(0)).alias("id0"), c.isNull().alias("unnamed")]
    kept = kept.select("t1", "t2", *key(F.col("id")), "rows")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), *key(F.col("doc_id").cast("long")), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    on = ["t1", "t2", "id0", "unnamed"]
    tie = F.when(F.col("rows") > 1, row_hash())
    return rows.join(kept, on).groupBy(*on).agg(F.min_by("row", F.coalesce(tie, F.lit(0))).alias("row")).select("row.*")


# -- registered query -----------------------------------------------------------


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, k=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), c AS (
  SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT c.node, l.b FROM c JOIN l ON l.a = c.seen
), m AS (
  SELECT node, min(seen) AS component_id FROM c GROUP BY 1
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w JOIN m ON m.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

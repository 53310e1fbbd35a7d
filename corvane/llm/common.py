"""What the operators of this subpackage share: staging, shipping, word boundaries, hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words in every contract of this subpackage.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same, as a Java or RE2 character class.
WORD = r"[^\x20\x09-\x0D]+"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only in local mode where that is unset."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(held)
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


@contextlib.contextmanager
def released(spark: SparkSession):
    """The shuffle files behind what is written inside are of no use afterwards and are released."""
    before = spark.conf.get(FILE_CLEANUP, None)
    with contextlib.suppress(Exception):
        spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        with contextlib.suppress(Exception):
            spark.conf.set(FILE_CLEANUP, before) if before is not None else spark.conf.unset(FILE_CLEANUP)
        gc.collect()


def own_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; those of an application lie in one folder, named by its id, which ``drop_staged`` removes."""
    return f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{name}"


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder (in folders by the last column, if named) and reads it back: the lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = own_folder(spark, name)
    with released(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Removes all that this application has staged; results that haven't been written elsewhere are lost with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package when only the driver has it on its path (same file system)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow, after which a worker gives back what it has freed: Spark keeps workers, and their memory counts beside later stages'."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def give_back() -> None:
    """Returns memory that is free, but held by this process' allocators, to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def power_table(n: int, base: int = BASE) -> np.ndarray:
    """base**0 and on, n values at least; short tables are kept."""
    if n > len(_POWERS.get(base, ())):
        table = powers(base, max(1 << 12, 1 << int(n - 1).bit_length()))
        if n > 1 << 12:
            return table
        _POWERS[base] = table
    return _POWERS[base]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, end to end, and each row's offsets; nulls count as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "") if column.null_count else column
    column = pa.concat_arrays([column]) if column.offset else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8, offs[-1]) if data is not None and offs[-1] else np.zeros(0, np.uint8)
    return body[offs[0] :], offs - offs[0]


def slices(batch, column: str, most: int = 1 << 20, rows: int = 1 << 12):
    """Cuts an Arrow batch into runs of at most ``rows`` rows with about ``most`` bytes of text, one row at least."""
    _, offs = text_bytes(batch.column(column))
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1))
        yield batch.slice(i, j - i)
        i = j


def words(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each row's first word (with one more at the end)."""
    inside = np.empty(len(body) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(IS_SPACE[body], out=inside[1:-1])
    edge = inside[1:] != inside[:-1]
    # a row's first byte begins a word even if the row before it ends inside one
    seam = offs[1:-1]
    seam = np.unique(seam[(seam > 0) & (seam < len(body))])
    both = seam[inside[seam] & inside[seam + 1]]
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    if len(both):
        starts, ends = np.sort(np.concatenate([starts, both])), np.sort(np.concatenate([ends, both]))
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, worked out in blocks of about a megabyte of them."""
    size = ends - starts
    upto = np.cumsum(size)
    out = np.empty(len(starts), np.uint64)
    base = BASE ^ (seed * 0x2545F4914F6CDD1D) | 1
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + (1 << 20), "right")))
        own = size[a:b]
        power = power_table(int(own.max()) + 1, base)
        first = np.cumsum(own) - own
        place = np.arange(int(own.sum()), dtype=np.int64) - np.repeat(first, own)
        value = (body[place + np.repeat(starts[a:b], own)].astype(np.uint64) + np.uint64(1)) * power[place]
        out[a:b] = mix(np.add.reduceat(value, first) + own.astype(np.uint64))
        a = b
    return out


def coded_words(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...] = (0,)) -> tuple[np.ndarray, list[np.ndarray]]:
    """A number for each word, equal for equal words only, and its 64-bit hash for each seed.  All bytes but spaces belong to words."""
    import pyarrow as pa

    if not len(starts):
        return np.zeros(0, np.int32), [np.zeros(0, np.uint64) for _ in seeds]
    edges = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=edges[1:])
    packed = np.ascontiguousarray(body[~IS_SPACE[body]])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(packed)]).dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
    chars = np.frombuffer(words.buffers()[2], np.uint8, at[-1])
    return codes, [word_hashes(chars, at[:-1], at[1:], seed)[codes] for seed in seeds]


def run_hashes(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every k consecutive values (len - k + 1 of them, across rows too)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64((BASE ^ (seed * 0x2545F4914F6CDD1D)) % 2**64 | 1)
    out = hashes[:n].copy() if not seed else mix(hashes + np.uint64(seed))[:n]
    rest = hashes if not seed else mix(hashes + np.uint64(seed))
    for j in range(1, k):
        out *= base
        out += rest[j : j + n]
    return mix(out)


#: ASCII upper case to lower; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of letters and digits; bytes over 127 belong to letters of other scripts (or to rare signs, which count as such).
IS_LETTER = np.zeros(256, bool)
IS_LETTER[ord("a") : ord("z") + 1] = IS_LETTER[ord("A") : ord("Z") + 1] = IS_LETTER[128:] = True


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of true values, cut at row borders, and each row's first run (with one more at the end)."""
    padded = np.zeros(len(inside) + 2, bool)
    padded[1:-1] = inside
    at = np.flatnonzero(padded[1:] != padded[:-1])
    starts, ends = at[0::2], at[1::2]
    seam = np.unique(offs[(offs > 0) & (offs < len(inside))])
    both = seam[padded[seam] & padded[seam + 1]] if len(seam) else seam
    if len(both):
        starts, ends = np.sort(np.concatenate([starts, both])), np.sort(np.concatenate([ends, both]))
    return starts, ends, np.searchsorted(starts, offs)


def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of each row's values; rows may be empty."""
    out = np.zeros(len(offs) - 1, values.dtype if values.dtype.kind == "f" else np.int64)
    full = offs[1:] > offs[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offs[:-1][full])
    return out


def sampled_ids(rows: DataFrame, group: str, most: int) -> DataFrame:
    """At most ``most`` ids of each group, spread by hash: the least hash of each of ``most`` buckets.

    rows: id, and the group's column.  Combines on the map side; no group is gathered.
    """
    from pyspark.sql import functions as F

    h = F.xxhash64("id")
    return rows.filter("id IS NOT NULL").groupBy(group, F.pmod(h, F.lit(most)).alias("bucket")).agg(F.min_by("id", h).alias("id")).select("id", group)


def sample_texts(docs: DataFrame, ids: DataFrame, group: str, most_rows: int) -> list[tuple[str, object]]:
    """(text, group value) of the sampled ids, on the driver, in order of id.  docs: id, text.

    If there are over most_rows, every group gives an even share of them, one id at least.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    held = ids.limit(most_rows + 1).toArrow()
    if held.num_rows > most_rows:
        share = max(1, most_rows // ids.select(group).distinct().count())
        nth = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64("id"), "id"))
        held = ids.withColumn("nth", nth).filter(F.col("nth") <= share).drop("nth").toArrow()
    if not held.num_rows:
        return []
    small = docs.sparkSession.createDataFrame(held, ids.schema)  # of Arrow: rows would start Python workers on all executors
    got = docs.join(F.broadcast(small), "id").groupBy("id", group).agg(F.max("text").alias("text")).collect()
    return [(r["text"] or "", r[group]) for r in sorted(got, key=lambda r: (r["id"], str(r[group])))]


def row_hash(row: str = "row"):
    """A hash of all fields of a struct, maps among them too: it orders rows that agree in all that a rule compares."""
    from pyspark.sql import functions as F

    return F.xxhash64(F.to_json(row))


def offsets(totals: DataFrame, keys: list[str], index: str, values: dict[str, str], fan: int = 1024) -> DataFrame:
    """For each (keys, index) the sums of ``values`` (column to name) over all smaller indices of the same keys.

    Two levels, so that a key's totals are spread over tasks by ``fan`` of its indices.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    t = totals.withColumn("coarse", F.floor(F.col(index) / fan))
    coarse = t.groupBy(*keys, "coarse").agg(*[F.sum(c).alias(f"c_{c}") for c in values])
    over = Window.partitionBy(*keys).orderBy("coarse")
    coarse = coarse.select(*keys, "coarse", *[(F.sum(f"c_{c}").over(over) - F.col(f"c_{c}")).alias(f"b_{c}") for c in values])
    within = Window.partitionBy(*keys, "coarse").orderBy(index)
    fine = t.select(*keys, "coarse", index, *[(F.sum(c).over(within) - F.col(c)).alias(f"a_{c}") for c in values])
    return fine.join(coarse, [*keys, "coarse"]).select(*keys, index, *[(F.col(f"a_{c}") + F.col(f"b_{c}")).alias(name) for c, name in values.items()])

"""Quality by ordinal regression on graded ratings.

A cumulative-link model: P(grade <= k) = sigmoid(threshold[k] - w.x), with one
weight vector for all grades and ordered thresholds.  x holds the shares of a
text's hashed four-byte shapes (letters by case, digits and spaces folded,
signs kept) and of its hashed three-byte strings, and the share of words that repeat
the word before them.  The model gives each text
an expected grade and the probability of reaching a given grade, by which
texts are selected.

Fitted on the driver on at most ``PER_GRADE`` texts of each grade and
``MOST_ROWS`` in all (documented bounds); every text is scored whole.

Defined results: null texts count as empty; empty texts get the score of the
thresholds alone; null ratings are not learnt from; without ratings, or with
one grade only, every text has that grade (or 0) with tail probability 1;
several ratings of a document are learnt from one by one; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, mapped, runs, sample_texts, sampled_ids, ship, slices, sums, text_bytes

PER_GRADE, MOST_ROWS = 1500, 12_000
BITS = 15
#: Byte to shape: a small letter, A capital, 0 digit; bytes over 127 count as small letters; the rest stand for themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[ord("a") : ord("z") + 1] = SHAPE[128:] = ord("a")
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("0") : ord("9") + 1] = ord("0")
#: Bytes added to every length, so that a few odd bytes weigh little in a very short text.
DAMP = 40
#: Bytes of text scored at once: a worker's arrays take some forty times as much.
SLICE = 1 << 18
#: A text is kept if it reaches the passing grade with at least this probability.
KEEP = 0.4


def hashed(body: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """For each byte, its two features: the shape string and the byte string that begin there.  Zeros follow a row's last byte."""
    shape, low = SHAPE[body].astype(np.uint32), LOWER[body].astype(np.uint32)
    ends = offs[1:]

    def later(values: np.ndarray, j: int) -> np.ndarray:
        out = np.zeros(len(values), np.uint32)
        out[: max(0, len(values) - j)] = values[j:]
        for i in range(1, j + 1):
            out[ends[ends >= i] - i] = 0
        return out << np.uint32(8 * j)

    four = shape | later(shape, 1) | later(shape, 2) | later(shape, 3)
    three = low | later(low, 1) | later(low, 2)
    shift = np.uint32(32 - BITS)
    return [(four * np.uint32(2654435761)) >> shift, ((three * np.uint32(2246822519)) >> shift) + np.uint32(1 << BITS)]


#: Two more features: a word that repeats the one before it, and one that doesn't.
FEATURES = (2 << BITS) + 2


def repeats(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether each word repeats the one before it in its row, by length and its first and last four bytes; the rows' borders; word counts)"""
    starts, ends, first = runs(~IS_SPACE[body], offs)
    if not len(starts):
        return np.zeros(0, bool), first, np.diff(first)
    low = np.r_[LOWER[body], np.zeros(4, np.uint8)]
    size = ends - starts
    key = size.astype(np.uint64)
    for j in range(4):
        key = key * np.uint64(257) + low[starts + np.minimum(j, size - 1)]
        key = key * np.uint64(257) + low[ends - 1 - np.minimum(j, size - 1)]
    same = np.r_[False, key[1:] == key[:-1]]
    same[first[:-1][np.diff(first) > 0]] = False
    return same, first, np.diff(first)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train(samples: list[tuple[str, object]], rounds: int = 300, rate: float = 0.3, decay: float = 1e-4) -> dict:
    """{"grades": ascending, "weights": by feature, "thresholds": ascending, one fewer than grades}; Adagrad on the likelihood."""
    grades = sorted({int(g) for _, g in samples})
    weights = np.zeros(FEATURES)
    if len(grades) < 2:
        return {"grades": grades or [0], "weights": weights.astype(np.float32), "thresholds": np.zeros(0)}
    index, value, row = [], [], []
    for i, (text, _) in enumerate(samples):
        body = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        if len(body):
            ids, counts = np.unique(np.concatenate(hashed(body, np.array([0, len(body)]))), return_counts=True)
            same, _, count = repeats(body, np.array([0, len(body)]))
            again = same.sum() / (count[0] + 4)
            index.append(np.r_[ids, FEATURES - 2, FEATURES - 1])
            value.append(np.r_[counts / (len(body) + DAMP), again, 1 - again])
            row.append(np.full(len(ids) + 2, i))
    n = len(samples)
    index, value, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (index, value, row))
    y = np.searchsorted(grades, [int(g) for _, g in samples])
    share = np.bincount(y, minlength=len(grades)) / n
    weight = (1 / np.sqrt(share))[y]
    weight /= weight.mean()  # rare grades count more, though not as much as frequent ones
    t = np.linspace(-1, 1, len(grades) + 1)[1:-1].copy()
    g2, t2 = np.full(len(weights), 1e-8), np.full(len(t), 1e-8)
    edge = lambda t: np.r_[-np.inf, t, np.inf]
    for _ in range(rounds):
        z = np.bincount(row, weights=value * weights[index], minlength=n)
        e = edge(t)
        hi, lo = _sigmoid(e[y + 1] - z), _sigmoid(e[y] - z)
        hi, lo = np.where(y == len(t), 1.0, hi), np.where(y == 0, 0.0, lo)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        dz = -(dhi - dlo) * weight  # of the log-likelihood
        grad = np.bincount(index, weights=value * dz[row], minlength=len(weights)) / n - decay * weights
        g2 += grad**2
        weights += rate * grad / np.sqrt(g2)
        gt = np.array([(np.sum((dhi * weight)[y == k]) - np.sum((dlo * weight)[y == k + 1])) / n for k in range(len(t))])
        t2 += gt**2
        t = np.maximum.accumulate(t + rate * gt / np.sqrt(t2))
    return {"grades": grades, "weights": weights.astype(np.float32), "thresholds": t}


def grade(body: np.ndarray, offs: np.ndarray, model: dict, passing: int) -> tuple[np.ndarray, np.ndarray]:
    """(expected grade, probability of the grade ``passing`` or a higher one) of each row."""
    n = len(offs) - 1
    grades = np.array(model["grades"], float)
    if len(grades) < 2:
        return np.full(n, grades[0]), np.ones(n)
    z = np.zeros(n)
    if len(body):
        for h in hashed(body, offs):
            z += sums(model["weights"][h], offs)
    z /= np.diff(offs) + DAMP
    same, first, count = repeats(body, offs)
    again = sums(same.astype(np.int64), first) / (count + 4)
    z += np.where(np.diff(offs) > 0, again * model["weights"][-2] + (1 - again) * model["weights"][-1], 0)
    below = _sigmoid(np.asarray(model["thresholds"])[None, :] - z[:, None])
    p = np.diff(np.c_[np.zeros(n), below, np.ones(n)], axis=1)
    return p @ grades, p[:, grades >= passing].sum(1)


def graded(docs: DataFrame, model: dict, passing: int = 1, carry: str | None = None) -> DataFrame:
    """docs (id, text) -> id, expected_grade, tail."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                expected, tail = grade(*text_bytes(part.column("text")), model, passing)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(expected), pa.array(tail)], names=["id", "expected_grade", "tail"])

    return mapped(docs.select("id", "text"), run, "id long, expected_grade double, tail double")


def selected(docs: DataFrame, text_col: str, model: dict, passing: int = 1, keep: float = KEEP) -> DataFrame:
    """The rows of docs, with all their columns, whose text reaches the passing grade with probability ``keep``."""
    import pyarrow as pa

    ship(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for part in slices(pa.RecordBatch.from_arrays(batch.columns, names=[f"c{i}" for i in range(len(names))]), f"c{at}", SLICE):
                _, tail = grade(*text_bytes(part.column(at)), model, passing)
                kept = part.filter(pa.array(tail >= keep))
                yield pa.RecordBatch.from_arrays(kept.columns, names=names)

    return mapped(docs, run, schema)


def fit(docs: DataFrame, ratings: DataFrame, per_grade: int = PER_GRADE, most_rows: int = MOST_ROWS) -> dict:
    """A model from docs (id, text) and ratings (id, grade)."""
    ids = sampled_ids(ratings.filter("grade IS NOT NULL"), "grade", per_grade)
    return train(sample_texts(docs, ids, "grade", most_rows))


def read(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    ratings = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("grade"))
    return docs, ratings


# -- registered query -----------------------------------------------------------


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, tail, kept."""
    docs, ratings = read(spark, sf_dir)
    out = graded(docs, fit(docs, ratings))
    return out.select(F.col("id").alias("doc_id"), "expected_grade", "tail", (F.col("tail") >= KEEP).alias("kept"))

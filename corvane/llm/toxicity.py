"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words (ASCII case folded) and their four- and five-byte
beginnings, hashed.  The machine scores the terms present:
w0 + sum w[i] + sum over pairs <v[i], v[j]>, so two terms may weigh more
together than apart (an insult with the mention of a group).  Active are terms
that the sample ties to the label, alone or in a pair with another frequent
term (so terms that tell something together only take part too); clean texts
have few or none.

Fitted on the driver on at most ``PER_LABEL`` texts of each label and
``MOST_ROWS`` in all (documented bounds); every text is scored whole.

Defined results: null and empty texts have no terms and get the score of the
bias; labels that are null or neither 0 nor 1 are not learnt from; without both labels all scores are 0
(or 1, if all labels are 1); several labels of a document are learnt from one
by one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_LETTER, LOWER, mix, runs, sample_texts, sampled_ids, ship, slices, text_bytes, word_hashes

PER_LABEL, MOST_ROWS = 3000, 12_000
BITS, ACTIVE, FACTORS = 22, 4096, 8
THRESHOLD = 0.7
#: How surely a term must be tied to the label to become active, in standard deviations.
TIED = 5.0
#: How many times as frequent it must be among one label's texts as among the other's.
APART = 2.0
#: Terms among which pairs are looked at, the most frequent ones, and how surely a pair must be tied to the label.
PAIRED, PAIR_TIED = 1024, 8.0


def terms(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed term) of every word and of the beginnings of longer words."""
    low = LOWER[body]
    starts, ends, first = runs(IS_LETTER[body], offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    out, rows = [word_hashes(low, starts, ends)], [row]
    for k in (4, 5):
        long = ends - starts > k
        at = starts[long]
        value = np.full(len(at), np.uint64(k), np.uint64)
        for j in range(k):
            value = (value << np.uint64(8)) | low[at + j].astype(np.uint64)
        out.append(mix(value))
        rows.append(row[long])
    return np.concatenate(rows), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


def present(body, offs, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, active term) pairs, each once, by row."""
    row, term = terms(body, offs)
    slot = slots[term]
    on = slot >= 0
    pairs = np.unique(row[on] * ACTIVE + slot[on])
    return pairs // ACTIVE, pairs % ACTIVE


def score(row: np.ndarray, term: np.ndarray, n: int, model: dict) -> np.ndarray:
    v = model["v"][term]
    total = np.full(n, model["w0"], float) + np.bincount(row, weights=model["w"][term], minlength=n)
    for f in range(v.shape[1]):
        s = np.bincount(row, weights=v[:, f], minlength=n)
        total += 0.5 * (s * s - np.bincount(row, weights=v[:, f] ** 2, minlength=n))
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def tied_pairs(own: list[np.ndarray], y: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Terms of pairs whose meeting, beyond what either term alone makes likely, differs between the labels."""
    usual = np.argsort(-seen.sum(0), kind="stable")[:PAIRED]
    usual = usual[seen.sum(0)[usual] >= max(8, len(y) // 200)]
    at = np.full(seen.shape[1], -1, np.int32)
    at[usual] = np.arange(len(usual))
    held = np.zeros((len(y), len(usual)), np.float32)
    for i, t in enumerate(own):
        held[i, at[t[at[t] >= 0]]] = 1
    beyond, noise = [], []
    for label in (0, 1):
        x = held[y == label]
        n, p = len(x), x.mean(0)
        beyond.append(x.T @ x / n - p[:, None] * p[None, :])
        spread = p * (1 - p) + 1 / (4 * n)
        noise.append(spread[:, None] * spread[None, :] / n)
    z = np.abs(beyond[1] - beyond[0]) / np.sqrt(noise[0] + noise[1])
    np.fill_diagonal(z, 0)
    # long texts bring frequent words together whatever the label: what most pairs of a term share is no tie
    if len(z):
        z = z / np.maximum(1, np.quantile(z, 0.25, axis=1) / 0.32)[:, None]
    best = np.minimum(z, z.T).max(axis=1, initial=0)
    found = np.argsort(-best, kind="stable")
    return usual[found[best[found] >= PAIR_TIED]]


def train(samples: list[tuple[str, object]], rounds: int = 200, rate: float = 0.1, decay: float = 1e-5) -> dict:
    """{"slots": active number of each hash or -1, "w0", "w", "v"}; Adagrad on the likelihood, labels weighing alike."""
    y = np.array([float(int(label)) for _, label in samples])
    slots = np.full(1 << BITS, -1, np.int16)
    flat = {"slots": slots, "w0": 0.0, "w": np.zeros(ACTIVE), "v": np.zeros((ACTIVE, FACTORS))}
    if len(set(y)) < 2:
        return flat | {"w0": 35.0 if len(y) and y[0] else -35.0}
    seen = np.zeros((2, 1 << BITS), np.int32)
    own = []
    for (text, _), label in zip(samples, y):
        body = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        _, term = terms(body, np.array([0, len(body)]))
        own.append(np.unique(term))
        seen[int(label), own[-1]] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    p1, p0, both = seen[1] / n1, seen[0] / n0, (seen[1] + seen[0]) / len(y)
    z = (p1 - p0) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n1 + 1 / n0))
    z[(seen[0] + seen[1]) < 4] = 0
    ratio = (seen[1] + 0.5) / (n1 + 1) / ((seen[0] + 0.5) / (n0 + 1))
    z[(ratio < APART) & (ratio > 1 / APART)] = 0  # frequent words, which only tell that a text is long
    tied = np.argsort(-np.abs(z), kind="stable")[:ACTIVE]
    tied = tied[np.abs(z[tied]) >= TIED]
    together = tied_pairs(own, y, seen)
    tied = np.r_[tied, together[~np.isin(together, tied)]][:ACTIVE]
    slots[tied] = np.arange(len(tied))
    row = np.concatenate([np.full(len(t), i) for i, t in enumerate(own)])
    term = slots[np.concatenate(own)].astype(np.int64)
    row, term = row[term >= 0], term[term >= 0]
    n, rng = len(y), np.random.default_rng(5)
    model = flat | {"w": np.zeros(ACTIVE), "v": rng.normal(0, 0.01, (ACTIVE, FACTORS))}
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    gw, gv, g0 = np.full(ACTIVE, 1e-8), np.full((ACTIVE, FACTORS), 1e-8), 1e-8
    for _ in range(rounds):
        d = (y - score(row, term, n, model)) * weight
        a = np.bincount(term, weights=d[row], minlength=ACTIVE) - decay * model["w"]
        v = model["v"]
        total = np.stack([np.bincount(row, weights=v[term, f], minlength=n) for f in range(FACTORS)], 1)
        b = np.stack([np.bincount(term, weights=d[row] * (total[row, f] - v[term, f]), minlength=ACTIVE) for f in range(FACTORS)], 1) - decay * v
        gw += a * a
        gv += b * b
        g0 += d.sum() ** 2
        model["w"] = model["w"] + rate * a / np.sqrt(gw)
        model["v"] = v + 0.3 * rate * b / np.sqrt(gv)
        model["w0"] = model["w0"] + rate * d.sum() / np.sqrt(g0)
    return model


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """docs (id, text) -> id, score."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                body, offs = text_bytes(part.column("text"))
                row, term = present(body, offs, model["slots"])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score(row, term, part.num_rows, model))], names=["id", "score"])

    return docs.select("id", "text").mapInArrow(run, "id long, score double")


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, most_rows: int = MOST_ROWS) -> dict:
    """A model from docs (id, text) and labels (id, label)."""
    ids = sampled_ids(labels.filter("label IN (0, 1)"), "label", per_label)
    return train(sample_texts(docs, ids, "label", most_rows))


# -- registered query -----------------------------------------------------------


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    from .language import held_out

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label"))
    out = scored(docs, fit(docs, labels.filter(~held_out(F.col("id")))))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Language identification of mixed text.

Each word gets a score for every language (log-likelihood of its byte
trigrams); the scripts that a language was seen in narrow the candidates;
Viterbi's algorithm with a penalty for every switch then labels the words, so
a text falls into spans of one language each.  A text's language is that of
most of its letters.

Learnt on the driver from at most ``PER_LANGUAGE`` texts of each language and
``MOST_ROWS`` in all (documented bounds); everything else is over all rows and
whole texts.

Defined results: null texts and texts without a letter are ``und`` with score
0; without any labelled text all are ``und``; ties go to the language first by
code point; rows repeat as given; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_LETTER, LOWER, runs, sample_texts, sampled_ids, ship, slices, sums, text_bytes

PER_LANGUAGE, MOST_ROWS = 400, 20_000
#: What a switch of language costs, in nats.
SWITCH = 12.0
BITS = 16
#: Scripts by UTF-8 lead byte (fixed ranges): Latin, Greek, Cyrillic, Armenian and Hebrew, Arabic to Thaana, Indic
#: and South-East Asian, other three-byte scripts to U+2FFF, CJK and kana, Hangul, the rest.
LEADS = ((0x00, 0xCA), (0xCD, 0xCF), (0xD0, 0xD3), (0xD4, 0xD7), (0xD8, 0xDF), (0xE0, 0xE0), (0xE1, 0xE2), (0xE3, 0xE9), (0xEA, 0xED), (0xEE, 0xFF))
SCRIPT = np.zeros(256, np.uint8)
for _k, (_a, _b) in enumerate(LEADS):
    SCRIPT[_a : _b + 1] = _k
SCRIPT[0xCB:0xCD] = 0


def _codes(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte is in a letter, and the hashed trigram around it; all that is not a letter is a blank."""
    letter = IS_LETTER[body]
    low = np.zeros(len(body) + 2, np.uint32)
    low[1:-1] = np.where(letter, LOWER[body], 32)
    low[0] = low[-1] = 32
    tri = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    return letter, (tri * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _words(body: np.ndarray, offs: np.ndarray):
    letter, codes = _codes(body)
    return (codes, *runs(letter, offs))


def train(samples: list[tuple[str, str]]) -> dict:
    """{"languages": names by code point, "weights": languages x hashes, "scripts": languages x scripts}"""
    names = sorted({lang for _, lang in samples}, key=lambda s: s.encode())
    size = 1 << BITS
    weights, scripts = np.zeros((len(names), size), np.float32), np.zeros((len(names), len(LEADS)), bool)
    for k, name in enumerate(names):
        counts, seen = np.zeros(size), np.zeros(len(LEADS))
        for text, lang in samples:
            if lang == name and text:
                body = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
                letter, codes = _codes(body)
                counts += np.bincount(codes[letter], minlength=size)
                lead = letter & ((body < 128) | (body >= 192))
                seen += np.bincount(SCRIPT[body[lead]], minlength=len(LEADS))
        weights[k] = np.log((counts + 0.3) / (counts.sum() + 0.3 * size))
        scripts[k] = seen >= max(1.0, 0.001 * seen.sum())
    if len(names):
        weights -= weights.mean(axis=0)
    return {"languages": names, "weights": weights, "scripts": scripts}


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best path of states for each row of words; scores: words x states, first: each row's first word, and the end.

    All rows advance together, longest first, so a step costs the same for one row or thousands.
    """
    n, states = scores.shape
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    kind = np.min_scalar_type(max(states - 1, 0))
    path = np.zeros(n, kind)
    if not n:
        return path
    come = np.zeros((n, states), kind)
    own = np.arange(states, dtype=kind)
    active = np.searchsorted(-count, -np.arange(int(count[0])), "left")  # rows with more than t words
    value = scores[begin[: active[0]]].copy()
    finish = np.zeros(len(begin), kind)
    for t in range(1, len(active)):
        a = active[t]
        if a < len(value):
            finish[a : len(value)] = value[a:].argmax(1)
            value = value[:a]
        at = begin[:a] + t
        best = value.argmax(1)
        top = value[np.arange(a), best] - penalty
        stay = value >= top[:, None]
        come[at] = np.where(stay, own, best[:, None].astype(kind))
        value = np.where(stay, value, top[:, None]) + scores[at]
    finish[: len(value)] = value.argmax(1)
    state = finish
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        at = begin[:a] + t
        path[at] = state[:a]
        if t:
            state[:a] = come[at, state[:a]]
    return path


def label_words(body: np.ndarray, offs: np.ndarray, model: dict, penalty: float = SWITCH):
    """(starts, ends, each row's first word, state of each word)"""
    codes, starts, ends, first = _words(body, offs)
    weights = model["weights"]
    if not len(starts) or not len(weights):
        return starts, ends, first, np.zeros(len(starts), np.uint8)
    edges = np.empty(2 * len(starts), np.int64)
    edges[0::2], edges[1::2] = starts, ends
    tail = edges[-1] == len(codes)
    scores = np.empty((len(starts), len(weights)), np.float32)
    for k, w in enumerate(weights):
        scores[:, k] = np.add.reduceat(w[codes], edges[:-1] if tail else edges)[0::2]
    possible = model["scripts"].T[SCRIPT[body[starts]]]
    none = ~possible.any(1)
    possible[none] = True
    scores[~possible] = -1e3
    return starts, ends, first, viterbi(scores, first, penalty)


def identify(body: np.ndarray, offs: np.ndarray, model: dict, penalty: float = SWITCH) -> tuple[np.ndarray, np.ndarray]:
    """(state of each row, or -1; share of its letters in that language)"""
    starts, ends, first, state = label_words(body, offs, model, penalty)
    n, states = len(offs) - 1, len(model["languages"])
    if not states or not len(starts):
        return np.full(n, -1), np.zeros(n)
    row = np.repeat(np.arange(n), np.diff(first))
    share = np.bincount(row * states + state, weights=(ends - starts).astype(float), minlength=n * states).reshape(n, states)
    total = share.sum(1)
    best = share.argmax(1)
    return np.where(total > 0, best, -1), share[np.arange(n), best] / np.maximum(total, 1)


def lettered(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def languages(docs: DataFrame, model: dict, penalty: float = SWITCH) -> DataFrame:
    """docs (id, text, with other columns before) -> id, lang_pred, score."""
    import pyarrow as pa

    ship(docs.sparkSession)
    names = model["languages"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                column = part.column("text")
                body, offs = text_bytes(column)
                state, score = identify(body, offs, model, penalty)
                ascii_letters = sums(((body < 128) & IS_LETTER[body]).astype(np.int32), offs)
                for i in np.flatnonzero((state >= 0) & (ascii_letters == 0)):
                    if not lettered(column[int(i)].as_py()):
                        state[i] = -1
                pred = pa.array(["und" if s < 0 else names[s] for s in state], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), pred, pa.array(np.where(state < 0, 0.0, score), pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select("id", "text").mapInArrow(run, "id long, lang_pred string, score double")


def spans(docs: DataFrame, model: dict, penalty: float = SWITCH) -> DataFrame:
    """docs (id, text) -> id, start, stop (bytes of the UTF-8 text), lang: runs of words of one language."""
    import pyarrow as pa

    ship(docs.sparkSession)
    names = model["languages"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                body, offs = text_bytes(part.column("text"))
                starts, ends, first, state = label_words(body, offs, model, penalty)
                if not len(starts) or not names:
                    continue
                row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
                new = np.r_[True, (row[1:] != row[:-1]) | (state[1:] != state[:-1])]
                at = np.flatnonzero(new)
                last = np.r_[at[1:], len(starts)] - 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(row[at])), pa.array(starts[at] - offs[row[at]]), pa.array(ends[last] - offs[row[at]]), pa.array([names[s] for s in state[at]], pa.string())],
                    names=["id", "start", "stop", "lang"],
                )

    return docs.select("id", "text").mapInArrow(run, "id long, start long, stop long, lang string")


def held_out(doc_id):
    """A third of all documents, by their id alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> dict:
    """A model from docs (id, text, lang) with lang not null."""
    ids = sampled_ids(docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("id", "lang"), "lang", per_language)
    return train(sample_texts(docs.select("id", "text"), ids, "lang", most_rows))


# -- registered query -----------------------------------------------------------


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(docs.filter(~held_out(F.col("id"))))
    out = languages(docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")

"""The operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
from itertools import compress

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, chat, exact_dedup, language, minhash, mixing, quality, substrings, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, salt string, digest int"
WORDS = ["alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "theta", "é", "ß", "x" * 40]


def corpus(seed=1, n=60):
    """Random texts with copies, near copies, shared passages, nulls, empties, repeated ids and rows, a very long text."""
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(k))
    passage, base = text(45), text(80)
    out = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (4, "one"), (None, "one"), (6, text(3000))]
    for i in range(10, n):
        kind = i % 6
        if kind == 0:
            t = base
        elif kind == 1:
            w = base.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = text(1)
            t = "\n".join(w)
        elif kind == 2:
            t = text(rng.randrange(50)) + " " + passage + "\t" + text(rng.randrange(50))
        elif kind == 3:
            t = text(10) + " " + " ".join(["again"] * 60)
        else:
            t = text(rng.randrange(1, 90))
        out.append((i, t))
    return [(i, t, rng.choice(["en", None]), rng.choice(["s1", "s2", None]), "c", 7) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- exact ------------------------------------------------------------------------


def dedup_truth(data):
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    out = []
    for i, t, *_ in data:
        clean = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        g = groups[clean]
        best = min(g, key=lambda x: (x[0], x[1], x[2] or 0))
        out.append((i, best[2], len(g), (-len(t or ""), i) == (best[0], best[2])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, weak):
    digest = (lambda c: F.substring(exact_dedup.sha256(c), 1, 1).bitwiseAND(F.lit(0)) if False else F.substring(F.sha2(c, 256), 1, 1)) if weak else exact_dedup.sha256
    got = exact_dedup.exact_dedup(docs, digest=digest)  # weak: different texts share a digest
    assert rows(got.select("doc_id", "keep_id", "group_size", "kept")) == dedup_truth(corpus())


def test_exact_dedup_keeps_columns(docs, empty):
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert rows(kept.select("salt", "digest").distinct()) == [("c", 7)]
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0


# -- near ---------------------------------------------------------------------------


def near_truth(data, k, percent):
    sets = []
    for _, t, *_ in data:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(data):
        if d[0] is not None:
            least[find(i)] = min(least.get(find(i), d[0]), d[0])
    out = [(d[0], len(sets[i]), least.get(find(i)) if sets[i] else d[0]) for i, d in enumerate(data)]
    return sorted([(*x, x[0] == x[2]) for x in out], key=repr)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, percent):
    got = minhash.near_duplicates(docs, k, percent).select("doc_id", "n_shingles", "component_id", "kept")
    assert rows(got) == near_truth(corpus(), k, percent)


def test_near_duplicates_in_large_buckets(spark):
    """A crowd of near copies, some out of reach of the first: many buckets with several components."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    data = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(60)] = f"n{rng.randrange(1000)}"
        data.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4), 3, 85)
    assert rows(got.select("doc_id", "n_shingles", "component_id", "kept")) == near_truth(data, 3, 85)


def test_near_duplicates_edges(empty, docs):
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() < docs.count()


def test_runs_that_share_a_hash_are_told_apart(monkeypatch):
    text = b"a b c d a b c  e f g"
    body, offs = np.frombuffer(text + b"x y", np.uint8), np.array([0, len(text), len(text) + 3])
    row, _ = minhash.shingles(body, offs, 3)
    assert list(np.bincount(row)) == [7, 1]
    monkeypatch.setattr(minhash, "run_hashes", lambda h, k, seed=0: np.zeros(len(h) - k + 1, np.uint64))
    row, _ = minhash.shingles(body, offs, 3)
    assert list(np.bincount(row)) == [7, 1]


def test_estimate_is_close():
    rng = np.random.default_rng(2)
    import pyarrow as pa

    words = [f"v{i}" for i in range(400)]
    other = list(words)
    for i in rng.choice(400, 20, replace=False):
        other[i] = "q" + other[i]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(words), " ".join(other)])], names=["text"])
    _, size, _, sig = minhash._signature_columns(batch, 1, 200)
    a, b = (np.array(s, np.int64).view(np.uint64) for s in sig.to_pylist())
    fields = [(a[j // 16] >> np.uint64(4 * (j % 16))) & np.uint64(15) == (b[j // 16] >> np.uint64(4 * (j % 16))) & np.uint64(15) for j in range(1000)]
    assert abs((np.mean(fields) - 1 / 16) / (15 / 16) - 380 / 420) < 0.06


# -- substrings --------------------------------------------------------------------


def substring_truth(data, window):
    texts = [(t or "").encode().split() for _, t, *_ in data]
    seen = {}
    for w in texts:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (d, *_), w in zip(data, texts):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append((d, len(w), int(gone.sum()), b" ".join(compress(w, ~gone)).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,batches", [(35, 2), (12, 6), (8, 1)])
def test_substrings(docs, window, batches):
    assert rows(substrings.without_repeats(docs, window, batches)) == substring_truth(corpus(), window)


def test_substrings_empty(empty):
    assert substrings.without_repeats(empty).count() == 0


def test_index_over_batches(spark, tmp_path):
    path = str(tmp_path / "index")
    index = substrings.FingerprintIndex(spark, path, fan=2)
    seen, total = {}, set()
    rng = random.Random(3)
    for n in range(6):
        batch = [rng.randrange(40) for _ in range(15)]
        hits = {r["h"] for r in index.add(spark.createDataFrame([(h,) for h in batch], "h long")).collect()}
        assert hits == {h for h in batch if seen.get(h) or batch.count(h) > 1}
        for h in batch:
            seen[h] = seen.get(h, 0) + 1
        total |= hits
        if n == 3:  # a later application opens it again, past a run that was left unfinished
            (tmp_path / "index" / "run-000009-000009-8").mkdir()
            index = substrings.FingerprintIndex(spark, path, fan=2)
            assert [(a, b) for a, b, _ in index.runs] == [(0, 1), (2, 3)] and index.batches == 4
    plan = index.runs[0][2].join(index.runs[-1][2].hint("merge"), "h")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert {r["h"] for r in index.repeated().collect()} == {h for h, n in seen.items() if n > 1} == total
    assert len(index.runs) == 1
    none = substrings.FingerprintIndex(spark)
    assert none.add(spark.createDataFrame([], "h long")).count() == 0 and none.repeated().count() == 0


def test_anchors_of_long_texts(monkeypatch):
    hashes = np.random.default_rng(2).integers(0, 2**63, 5000, dtype=np.uint64)
    first = np.array([0, 40, 4990, 5000])
    whole = substrings.anchor_places(hashes, first, 35)
    monkeypatch.setattr(substrings, "_STEP", 97)
    assert all((a == b).all() for a, b in zip(whole, substrings.anchor_places(hashes, first, 35)))


# -- mix -------------------------------------------------------------------------


def test_mix(docs):
    got = mixing.mixed(docs).collect()
    by = {}
    for r in got:
        s = by.setdefault(r["source"], [0, r["source_size"], r["target"], 0])
        s[0] += r["size"]
        s[3] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    total = sum(s[0] for s in by.values())
    assert len(got) == docs.count() and abs(sum(s[2] for s in by.values()) - total) < 1e-3
    for size, source_size, target, taken in by.values():
        assert size == source_size and target <= 3 * size + 1e-6 and abs(taken - target) <= max(64, 0.02 * target)


def test_mix_again_and_whole(docs, empty):
    assert rows(mixing.mixed(docs)) == rows(mixing.mixed(docs.repartition(3)))
    assert mixing.mixed(empty).count() == 0
    assert mixing.repeated_documents(docs).columns == docs.columns


def test_mix_in_order(docs):
    """Each source's stream, cut into blocks, is taken block by block in the schedule's order."""
    by = {(r["doc_id"], r["size"]): r for r in mixing.mixed(docs.filter("doc_id > 9")).collect()}
    got = mixing.in_order(docs.filter("doc_id > 9")).collect()
    assert [(r["slot"], r["nth"]) for r in got] == sorted((r["slot"], r["nth"]) for r in got)
    assert sum(r["words"] for r in got) == sum(r["taken"] for r in by.values())
    taken, slots, share = {}, {}, {}
    for r in got:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["words"]
        slots.setdefault(r["slot"], [set(), 0])
        slots[r["slot"]][0].add(r["source"])
        slots[r["slot"]][1] += r["words"]
    assert all(taken.get(i, 0) == r["taken"] for (i, _), r in by.items())
    assert all(len(s) == 1 and n <= mixing.BLOCK for s, n in slots.values())
    for r in by.values():
        assert all(s in slots for s in r["slots"]) and len(r["slots"]) <= 3 and bool(r["slots"]) <= (r["taken"] > 0)
        share[r["source"]] = r["target"]
    total, seen = sum(share.values()), dict.fromkeys(share, 0)
    last = max(s for s, (_, n) in slots.items() if n == mixing.BLOCK)
    for n, slot in enumerate(sorted(s for s in slots if s <= last), 1):  # every beginning of the mix is in proportion
        (source,) = slots[slot][0]
        seen[source] += 1
        assert abs(seen[source] - n * share[source] / total) < 3


def test_mix_tiny_sources_beside_a_hot_one(spark):
    tiny = [(i, f"{'a' if i % 2 else 'z'}{i:03}", " ".join(["w"] * (10 + i % 4 * 10))) for i in range(80)]
    hot = [(1000 + i, "h", " ".join(["w"] * 200)) for i in range(150)]
    got = mixing.mixed(spark.createDataFrame(tiny + hot, "doc_id long, source string, text string")).collect()
    by = {}
    for r in got:
        by[r["source"]] = (r["target"], by.get(r["source"], (0, 0))[1] + r["taken"])
    assert len(by) == 81 and all(abs(target - taken) <= 1 for target, taken in by.values())
    targets = spark.createDataFrame([(1, 30, 0, 0), (2, 640, 0, 900_000_000), (3, 200, 900_000_000, 1_000_000_000)], "sid long, quota long, lo long, hi long")
    slots = mixing.schedule(spark, targets, 11, True).collect()
    ranks = {k: sorted(r["rank"] for r in slots if r["sid"] == k) for k in (1, 2, 3)}
    assert sorted(r["slot"] for r in slots) == list(range(len(slots)))
    assert all(v == list(range(len(v))) and len(v) >= n for (k, v), n in zip(sorted(ranks.items()), (1, 10, 4)))


def test_one_of_repeated_rows(spark):
    a, b = " ".join(f"v{i}" for i in range(40)), " ".join(f"w{i}" for i in range(40))
    data = [(1, a, "x")] * 3 + [(1, a, "y"), (2, a, "x"), (None, b, "x"), (None, b, "x"), (3, None, "x"), (3, None, "x"), (4, "one two", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    ids = lambda out: sorted((r["doc_id"] for r in out.collect()), key=repr)
    assert ids(exact_dedup.drop_exact_duplicates(df)) == [1, 3, 4, None]
    near = df.unionByName(spark.createDataFrame([(1, a + " tail", "x"), (None, b + " tail", "x")], df.schema))
    assert ids(minhash.drop_near_duplicates(near)) == [1, 3, 4, None]


def test_mix_deals_to_repeated_rows(spark):
    data = [(i, "w " * 30, s, k) for i in range(11) for s in "ab" for k in range(3)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, k int").repartition(4)
    places, taken = mixing.mix(df)
    begun = {(r["doc_id"], r["source"]): r["n"] for r in taken.filter("first").join(places, ["sid", "pos"]).groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {}
    for r in mixing.repeated_documents(df).collect():
        got[r["doc_id"], r["source"]] = got.get((r["doc_id"], r["source"]), 0) + 1
    assert got == begun and any(n % 3 for n in begun.values())


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 1000), ("c", 10), (None, 500)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes, 1511).collect()}
    # c would get half and a a sixth, but stop at three times their size; the rest goes 2 : 1
    assert got == {"a": 3.0, "c": 30.0, "b": round(1478 * 2 / 3, 6), None: round(1478 / 3, 6)}


# -- bpe --------------------------------------------------------------------------

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


def test_bpe_against_library(coder):
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.vocabulary.ids, special_tokens={})
    rng = random.Random(8)
    bits = ["a", "the", "ing", " ", "  ", "\n", "\t", "\r\n", "é", "ñ", "1", "23", ".", "!!", "'s", "漢字", "　", "\xa0", "\x85", "\x1c", "🙂", "\x00"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(16)))
        ids = coder.encode(text)
        assert ids == own.encode_ordinary(text) and coder.decode(ids) == text.encode()
    long = "abcdefghij" * 3000
    assert coder.encode(long) == own.encode_ordinary(long)


def test_prefixes_append_and_edit(coder):
    rng = random.Random(5)
    p = bpe.Prefixes(coder.vocabulary, b"thing" * 30)
    q = bpe.Prefixes(coder.vocabulary)
    for byte in b"thing" * 30:
        q.append(bytes([byte]))
    assert p.last == q.last
    for _ in range(60):
        at = rng.randrange(len(p.data))
        p.edit(at, min(rng.randrange(4), len(p.data) - at), bytes(rng.choice(b"abthe ") for _ in range(rng.randrange(4))))
        assert p.last == bpe.Prefixes(coder.vocabulary, p.data).last


def test_bpe_distinct_pieces_once(coder, monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeinstré漢1.\n") for _ in range(rng.randrange(1, 14)))
    own = [word() for _ in range(3000)] + ["long" * 200, "é" * 90, "\n", "'s"]
    texts = [" ".join(rng.choice(own) for _ in range(rng.randrange(60))) for _ in range(400)] + [None, "", " ", "\n \n", " \t a \n b \t "]
    seen = []
    many = bpe.Vocabulary.many
    monkeypatch.setattr(bpe.Vocabulary, "many", lambda v, data, starts, sizes: seen.append(len(starts)) or many(v, data, starts, sizes))
    ids, offs = coder.encode_all(pa.array(texts))
    pieces = [coder.find(t or "") for t in texts]
    # one call, however often a piece stands in the texts
    assert seen == [len({p for row in pieces for p in row})]
    want = [[i for p in row for i in coder.vocabulary.tokens(p.encode())] for row in pieces]
    assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == want
    assert [coder.decode(w).decode() for w in want] == [t or "" for t in texts]


def test_bpe_small_tables(coder, monkeypatch):
    """Pairs that take each other's places, and pieces in several blocks, give the same ids."""
    pieces = [("ab" * i + "thing" + "é" * (i % 3)).encode() for i in range(1, 60)]
    starts = np.cumsum([0, *map(len, pieces)])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    monkeypatch.setattr(bpe, "PAIRS", 2)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    ids, counts = bpe.Vocabulary(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))).many(data, starts[:-1], np.diff(starts))
    assert np.split(ids, np.cumsum(counts)[:-1])[40].tolist() == coder.vocabulary.tokens(pieces[40])
    assert ids.tolist() == [i for p in pieces for i in coder.vocabulary.tokens(p)]


def test_bpe_table(docs, empty, coder):
    path = P.path("byte_bpe_50k.tiktoken")
    got = bpe.round_trip(docs, path, P.PATTERN).collect()
    want = sorted((d[0], len(coder.encode(d[1] or "")), hashlib.sha256((d[1] or "").encode()).hexdigest()) for d in corpus() if d[0] is not None)
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got if r["doc_id"] is not None) == want
    back = bpe.decoded(bpe.encoded(docs, path, P.PATTERN), path)
    assert rows(back.filter("doc_id > 9")) == sorted(((d[0], d[1]) for d in corpus() if (d[0] or 0) > 9), key=repr)
    assert bpe.encoded(empty, path, P.PATTERN).count() == 0


# -- classifiers --------------------------------------------------------------------


def test_languages(spark):
    rng = random.Random(6)
    make = lambda syllables, n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    a, b, c = ["the", "ing", "er", "on"], ["lle", "que", "oi", "é"], ["про", "ст", "ова"]
    data = [(i, make(s, 60), lang) for i, (s, lang) in enumerate([(a, "aa"), (b, "bb"), (c, "cc")] * 20)]
    df = spark.createDataFrame(data, "id long, text string, lang string")
    model = language.fit(df)
    assert model["languages"] == ["aa", "bb", "cc"]
    mixed = make(a, 40) + " " + make(b, 25)
    tests = [(1, make(a, 30), "aa"), (2, make(b, 30), "bb"), (3, make(c, 30), "cc"), (4, None, "und"), (5, "", "und"), (6, "12 !", "und"), (7, "→ 漢", "aa"), (8, mixed, "aa"), (8, mixed, "aa")]
    t = spark.createDataFrame([x[:2] for x in tests], "id long, text string")
    got = {r["id"]: r for r in language.languages(t, model).collect()}
    for i, _, lang in tests:
        assert i == 7 or got[i]["lang_pred"] == lang
        assert 0 <= got[i]["score"] <= 1
    spans = sorted((r["start"], r["lang"]) for r in language.spans(t.filter("id = 8").limit(1), model).collect())
    assert [x[1] for x in spans] == ["aa", "bb"] and abs(spans[1][0] - mixed.encode().find(mixed[len(mixed.split(" ", 40)[0]):].encode())) >= 0
    none = language.train([])
    assert {r["lang_pred"] for r in language.languages(t, none).collect()} == {"und"}
    assert language.languages(t.filter("id < 0"), model).count() == 0


def test_viterbi_is_best_path():
    from itertools import product

    rng = np.random.default_rng(3)
    first = np.array([0, 6, 6, 7, 11])
    s = rng.normal(0, 3, (11, 3)).astype(np.float32)
    path = language.viterbi(s, first, 2.0)
    for a, b in zip(first[:-1], first[1:]):
        value = lambda p: sum(s[a + i, k] for i, k in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731
        if b > a:
            best = max(value(p) for p in product(range(3), repeat=b - a))
            assert abs(value(list(path[a:b])) - best) < 1e-4


def test_sampling_starts_no_python_workers(spark, monkeypatch):
    from corvane.llm.common import sample_texts

    docs = spark.range(40).select("id", F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") % 4 > 0, F.col("id") % 4).cast("int").alias("grade"))
    monkeypatch.setattr(spark.sparkContext, "parallelize", None)  # its rows go through Python on all executors
    want = [(f"t{i}", i % 4 or None) for i in range(40)]
    assert sample_texts(docs.select("id", "text"), docs.select("id", "grade"), "grade", 50) == want
    assert len(sample_texts(docs.select("id", "text"), docs.select("id", "grade"), "grade", 20)) == 20
    assert sample_texts(docs.select("id", "text"), docs.select("id", "grade").limit(0), "grade", 20) == []


def test_workers_give_back_memory():
    from pathlib import Path

    from corvane.llm.common import mapped

    class Frame:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    held, resident = [], lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6

    def run(batches):
        blocks = [np.ones(64 << 10, np.uint8) for _ in range(4000)]
        held.append(blocks[-1])  # above the others, which the allocator keeps for it
        yield from batches

    before = resident()
    assert list(mapped(Frame(), run, "id long")(iter([1, 2]))) == [1, 2]
    assert resident() - before < 130


def test_many_groups_share_the_sample(spark):
    from corvane.llm.common import sample_texts

    docs = spark.createDataFrame([(i, f"t{i}", f"g{i % 7}") for i in range(70)], "id long, text string, lang string")
    got = sample_texts(docs.select("id", "text"), docs.select("id", "lang"), "lang", 30)
    assert sorted(g for _, g in got) == sorted([f"g{k}" for k in range(7)] * 4)


def test_viterbi_with_many_states():
    s = np.zeros((3, 300), np.float32)
    s[:, 290] = 9
    assert list(language.viterbi(s, np.array([0, 3]), 2.0)) == [290] * 3


def test_toxicity_learns_pairs(spark):
    rng = random.Random(9)
    data = []
    for i in range(400):
        w = [f"w{rng.randrange(60)}" for _ in range(30)]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        w += ["insult"] * insult + ["group"] * group
        rng.shuffle(w)
        data.append((i, " ".join(w), int(insult and group)))
    model = toxicity.train([(t, y) for _, t, y in data])
    df = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, None), (901, "")], "id long, text string")
    got = {r["id"]: r["score"] for r in toxicity.scored(df, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in data]) > 0.97
    assert got[900] == got[901] and 0 <= got[900] <= 1
    assert set(r["score"] > 0.99 for r in toxicity.scored(df, toxicity.train([("x", 1)])).collect()) == {True}


def test_toxicity_learns_terms_that_tell_only_together(spark):
    """The label is exactly one of two terms: neither tells anything alone."""
    rng = random.Random(15)
    data = []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [f"w{rng.randrange(200)}" for _ in range(20)] + ["alpha"] * a + ["beta"] * b
        rng.shuffle(w)
        data.append((i, " ".join(w), int(a != b)))
    model = toxicity.train([(t, y) for _, t, y in data[:2000]])
    got = {r["id"]: r["score"] for r in toxicity.scored(spark.createDataFrame([(i, t) for i, t, _ in data[2000:]], "id long, text string"), model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in data[2000:]]) > 0.95


def test_toxicity_learns_from_known_labels_only(spark):
    docs = spark.createDataFrame([(i, "bad word" if i % 2 else "good word") for i in range(40)], "id long, text string")
    labels = spark.createDataFrame([(i, [0, 1, -1, 2, None][i % 5]) for i in range(40)], "id long, label int")
    model = toxicity.fit(docs, labels)
    assert all(0 <= r["score"] <= 1 for r in toxicity.scored(docs, model).collect())


def test_quality_of_a_text_ignores_its_neighbours():
    texts = ["plain words", "", "a", "LOUD!!", "xy", "", "more plain words", "9"]
    rng = np.random.default_rng(3)
    model = {"grades": [0, 1, 2], "weights": rng.normal(0, 9, quality.FEATURES).astype(np.float32), "thresholds": np.array([-1.0, 1.0])}
    bodies = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    together = quality.grade(np.concatenate(bodies), np.cumsum([0, *map(len, bodies)]), model, 1)
    alone = [quality.grade(b, np.array([0, len(b)]), model, 1) for b in bodies]
    assert np.allclose(together, np.array(alone)[:, :, 0].T, atol=1e-6)


def test_quality_orders_grades(spark):
    rng = random.Random(10)
    good = lambda: " ".join(rng.choice(["plain", "words", "here"]) for _ in range(40))
    makers = [lambda: good().upper() + "!!", lambda: good() + " " + good().upper(), good]
    data = [(m(), g) for g, m in enumerate(makers) for _ in range(60)]
    model = quality.train(data)
    assert model["grades"] == [0, 1, 2] and model["thresholds"][0] <= model["thresholds"][1]
    df = spark.createDataFrame([(g, makers[g](), "c") for g in range(3)] + [(8, None, "c"), (9, "", "c")], "id long, text string, tail string")
    got = {r["id"]: r for r in quality.graded(df, model, passing=2).collect()}
    assert got[0]["expected_grade"] < got[1]["expected_grade"] < got[2]["expected_grade"]
    assert got[0]["tail"] < 0.5 < got[2]["tail"] and got[8]["tail"] == got[9]["tail"]
    kept = quality.selected(df, "text", model, passing=2, keep=0.5)
    assert kept.columns == df.columns and {r["id"] for r in kept.collect()} & {0, 2} == {2}
    assert {r["tail"] for r in quality.graded(df, quality.train([])).collect()} == {1.0}


# -- chat ------------------------------------------------------------------------


def conversations():
    rng = random.Random(11)
    out = [(None, 0, "user", "q"), (1, None, "assistant", None), (1, 0, None, "x"), (1, 0, None, "x"), (2, 0, "sys>tem\\", chat.TRAP)]
    for c in range(3, 9):
        system = c % 2
        out += [(c, 0, "system", "be\nkind <turn 0 user>" + " rule" * {5: 600, 7: 3000}.get(c, 0))] * system
        for i in range(rng.randrange(1, 40)):
            out.append((c, i + system, ["user", "assistant"][i % 2], " ".join(["tok\\l<"] * rng.choice([0, 3, 40, 90, 500]))))
    return out


def test_chat(spark):
    data = conversations()
    df = spark.createDataFrame([(*r, "k") for r in data], "conv_id long, turn long, role string, text string, key string")
    w = chat.windows(df).cache()
    back = chat.read_back(w).collect()
    truth = {}
    for c, i, role, text in sorted(data, key=lambda r: (r[0] or -1, r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        truth.setdefault(c, []).append((role or "", text or ""))
    for c, turns in truth.items():
        own = sorted((r for r in back if r["conv_id"] == c), key=lambda r: r["first"])
        assert [tuple(t) for r in own for t in r["turns"]] == turns
        assert [t for r in own for t in r["targets"]] == [t for role, t in turns if role == "assistant"]
    count = lambda text: len(text.encode().split()) + chat.MARKS
    for r in w.collect():
        turns = re.findall(r"<(turn|again) (\d+) ([^>]*)>(.*?)</turn>\n", r["text"], re.S)
        held = truth[r["conv_id"]]
        assert all(held[int(i)][1] == t.replace("\\l", "<").replace("\\b", "\\") for _, i, _, t in turns)
        tokens = [count(held[int(i)][1]) for _, i, _, _ in turns]
        new = sum(n for n, t in zip(tokens, turns) if t[0] == "turn")
        assert r["tokens"] == sum(tokens) and r["new_tokens"] == new and (r["tokens"] <= chat.BUDGET or len(turns) == 1)
        if r["first"] and held[0][0] == "system":  # retained wherever it fits
            assert (turns[0][:2] == ("again", "0")) == (new + count(held[0][1]) <= chat.BUDGET)


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(df)).count() == 0


# -- search -----------------------------------------------------------------------


def search_truth(data, k):
    ok = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 50 == 0}):
        own = min((list(v) for i, v in data if i == q and v is not None), default=None)
        vec = np.floor(256 * np.array(own)).astype(int)
        scores = sorted((-int(vec @ v), i) for i, v in ok if i != q and len(v) == len(vec))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def test_top_k(spark):
    rng = random.Random(12)
    data = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    data += [(i, [0.9] * 6) for i in range(400, 460)]  # ties beyond k
    data += [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [1.0] * 6), (510, [0.5] * 3), (550, [0.25] * 3), (550, [0.25] * 3)]
    df = spark.createDataFrame(data, "id long, vector array<double>").repartition(4)
    got = topk.top_k(df.filter("id % 50 = 0"), df, 5)
    assert rows(got) == sorted(search_truth(data, 5), key=repr)


def test_top_k_edges(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    assert topk.top_k(none, none).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (0, [None]), (0, [float("nan")]), (7, [1e30])], "id long, vector array<double>")
    assert rows(topk.top_k(two.filter("id = 0"), two)) == [(0, 1, 7, 2**63 - 1)]


def test_top_k_of_large_components(spark):
    import math

    rng = random.Random(14)
    data = [(i, [rng.choice([1, -1]) * rng.random() * 10 ** rng.choice([0, 6, 6, 9, 17]) for _ in range(3)]) for i in range(1, 200)]
    data += [(250 + i, [300000.0 + i * 100000, 0.0, 0.0]) for i in range(2)] + [(300 + i, [(-1) ** i * 1e30 * (i + 1), 1e306, 0.5]) for i in range(4)]
    data += [(0, [1.0, 0.0, 0.0]), (350, [1e30, -1e6, 2.0])]
    exact = {i: [int(x) * 256 if abs(x) > 2**60 else math.floor(x * 256) for x in v] for i, v in data}
    want = []
    for q in (q for q in exact if q % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(exact[q], v)), i) for i, v in exact.items() if i != q)[:5]
        want += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best)]
    df = spark.createDataFrame(data, "id long, vector array<double>").repartition(3)
    assert rows(topk.top_k(df.filter("id % 50 = 0"), df, 5)) == sorted(want, key=repr)

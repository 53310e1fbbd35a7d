"""The pipeline's stages, each against brute force on what the stage before kept."""

import random
import re

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from corvane.llm import bpe, quality  # noqa: E402
from corvane.llm.common import staged  # noqa: E402

from .test_llm import near_truth  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    path = str(tmp_path_factory.mktemp("sf"))
    text = lambda: " ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(20, 60)))
    base = text()
    data = []
    for i in range(120):
        kind = i % 6
        t = text().upper() + "!! !!" if kind == 0 else base + " " * (i % 3) if kind == 1 else base + f" tail{i}" if kind == 2 else text()
        data.append((i, t, "en", f"s{i % 4}", len(t)))
    data += [(200, None, None, None, None), (201, "", "en", "s1", 0)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(0, 120, 2)] + [(201, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def listed(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = listed(docs) if name != "quality" else listed(docs)
        out = staged(stage(spark, docs, sf_dir), name)
        if name == "bpe":
            coder = bpe.Encoder(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
            want = sorted((i, coder.encode(t or "")) for i, t, _ in before)
            assert sorted((r["doc_id"], list(r["ids"])) for r in out.collect()) == want
            return
        assert out.columns == columns
        after = listed(out)
        kept[name] = after
        if name == "quality":
            texts, ratings = quality.read(spark, sf_dir)
            model = quality.fit(texts, ratings)
            good = {r["id"] for r in quality.graded(texts, model).filter(F.col("tail") >= quality.KEEP).collect()}
            assert {i for i, _, _ in after} == good
            assert not any((t or "").endswith("!!") for _, t, _ in after) and len(after) >= 100
        elif name == "exact_dedup":
            best = {}
            for i, t, _ in before:
                key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
                best[key] = min(best.get(key, (1, 0)), (-len(t or ""), i))
            assert sorted(i for i, _, _ in after) == sorted(i for _, i in best.values())
        elif name == "near_dedup":
            assert sorted(i for i, _, _ in after) == [x[0] for x in sorted(near_truth(before, 5, 80)) if x[3]]
        elif name == "mixing":
            words = lambda rows, s: sum(len((t or "").encode().split()) for _, t, src in rows if src == s)
            sources = sorted({s for _, _, s in before}, key=lambda s: (s is None, s or ""))
            total, weights = sum(words(before, s) for s in sources), {s: k % 3 + 1 for k, s in enumerate(sources)}
            target, free = {}, set(sources)
            while True:  # targets stop at three times their source, the excess is shared again
                left, w = total - sum(target.values()), sum(weights[s] for s in free)
                over = {s for s in free if left * weights[s] / w > 3 * words(before, s)}
                target |= {s: 3 * words(before, s) for s in over} or {s: left * weights[s] / w for s in free}
                free -= over
                if not over or not free:
                    break
            for s in sources:  # documents are taken whole: the last one may go beyond
                assert abs(words(after, s) - target[s]) <= 60 + 0.02 * target[s]
            assert set(after) <= set(before) and max(after.count(x) for x in set(after)) <= 3
        docs = out


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids"]
    assert corpus_pipeline.ORACLE_SQL is None

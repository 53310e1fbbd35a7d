import itertools
import json
import random
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.operators import checks, graph, joins, merge, paging, search
from corvane.plans import acquisition, discovery
from corvane.sources import bookmarks, legacy, likes, providers, timeline


def test_projection_ignores_arrival(spark):
    log = [("a", 1, 0, "x", None), ("a", 2, 1, None, "p"), ("a", 3, 2, "z", None), ("b", 1, 3, None, None)]
    want = None
    for order in itertools.islice(itertools.permutations(log), 0, 24, 5):
        df = spark.createDataFrame(list(order), "k string, at int, seq int, c1 string, c2 string")
        got = sorted(map(tuple, merge.projection(df, ["k"], ["at", "seq"], {"c1": "newest_known", "c2": "newest"}, seen="at").collect()))
        want = want or got
        assert got == want == [("a", "z", None, 1, 3), ("b", None, None, 1, 1)]


def test_equal_times_go_by_sequence(spark):
    df = spark.createDataFrame([("a", 1, 5, "late"), ("a", 1, 4, "early")], "k string, at int, seq int, v string")
    assert merge.latest(df, ["k"], ["at", "seq"]).first()["v"] == "late"


def test_managed_assets_stay(spark):
    df = spark.createDataFrame([("AA", 1, "m", None, 5, True), ("aa", 2, "l", "png", None, False)], "sha256 string, seq int, storage string, mime string, size int, managed boolean")
    r = merge.merged_assets(df).first()
    assert (r["sha256"], r["storage"], r["managed"], r["mime"], r["size"]) == ("aa", "m", True, "png", 5)


def test_unseen_treats_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, r string")
    b = spark.createDataFrame([(2, "x")], "k int, r string")
    assert [tuple(r) for r in merge.unseen(a, b, ["k", "r"]).collect()] == [(1, None)]


def test_pages_cover_everything(spark):
    rows = spark.range(23).withColumnRenamed("id", "k")
    seen, after = [], None
    while True:
        page = paging.keyset_page(rows, "k", after, 5).orderBy("k").collect()
        seen += [r["k"] for r in page]
        if not page or not page[0]["has_more"]:
            break
        after = page[0]["continuation"]
    assert seen == list(range(23))


def test_bounded_lists(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 1)], "k string, v int")
    got = {r["k"]: ([x["v"] for x in r["items"]], r["count"], r["truncated"]) for r in paging.bounded_lists(df, ["k"], ["v"], ["v"], cap=3).collect()}
    assert got == {"a": ([0, 1, 2], 4, True), "b": ([1], 1, False)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in root}


def test_identities_are_kept(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "node int")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    held = spark.createDataFrame([(3, "old")], "node int, identity string")
    assert {r["node"]: r["identity"] for r in graph.identities(nodes, edges, held).collect()} == {1: "old", 2: "old", 3: "old"}


def test_violations(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 1, 2), ("c", None, None)], "k string, x int, y int")
    got = sorted(map(tuple, checks.violations(df, "k", {"one target": checks.exclusive(["x", "y"]), "x known": F.col("x") > 0}).collect()))
    assert got == [("b", "one target"), ("c", "one target"), ("c", "x known")]


def test_search_backends_differ(spark):
    df = spark.createDataFrame([("The Cat sat",), ("concatenate",), ("cat, sat",)], "t string")
    assert df.filter(search.holds(F.col("t"), "CAT")).count() == 3
    assert df.filter(search.phrase(F.col("t"), "cat sat")).count() == 2


def test_claims(spark):
    a = spark.createDataFrame([(1, "AB", None), (2, "x", 5)], "k int, h string, n int")
    b = spark.createDataFrame([(1, "ab", 3), (2, "y", 5)], "k int, h string, n int")
    got = {(r["k"], r["claim"]): r["outcome"] for r in joins.compared_claims(a, b, "k", ["h", "n"]).collect()}
    assert got == {(1, "h"): "matched", (1, "n"): "not_comparable", (2, "h"): "mismatched", (2, "n"): "matched"}


def test_reviews_meet_revisions(spark):
    c = spark.createDataFrame([("a",), ("b",)], "k string")
    d = spark.createDataFrame([("a", 1, 0, "confirmed"), ("a", 2, 0, "rejected"), ("a", 3, 1, "rejected"), ("b", 4, 3, "confirmed")], "k string, seq int, revision int, state string")
    got = {r["k"]: (r["state"], r["revision"]) for r in discovery.reviewed(c, d, "k").collect()}
    assert got == {"a": ("rejected", 2), "b": ("pending", 0)}


def test_acquisition_reasons(spark):
    o = spark.createDataFrame(
        [(1, "danbooru", "available", "u", None, "{", None, None), (2, "x", "available", "u", None, "[]", None, None), (3, "e621", "available", "u", None, None, None, None), (4, "danbooru", "unavailable", "u", None, None, None, None)],
        "occurrence_id int, platform string, availability string, remote_url string, preview_url string, variants_json string, sha256 string, md5 string",
    )
    s = spark.createDataFrame([(i, "primary") for i in range(1, 6)], "occurrence_id int, variant string")
    got = {r["occurrence_id"]: r["reason"] for r in acquisition.planned(s, o, ["danbooru", "e621"]).collect()}
    assert got == {1: "invalid_variants", 2: "unsupported_provider", 3: "unsupported_variant", 4: "unavailable_occurrence", 5: "missing_occurrence"}


SCRIPT = 'window.YTD.like.part0 = [{"like":{"tweetId":"123","expandedUrl":"https://x.com/a/status/123","fullText":"one"}},{"like":{"tweetId":"123","expandedUrl":"https://x.com/b/status/123"}},{"like":{"url":"https://x.com/c/status/456"}},{"like":{"id":"1"}}];'


@pytest.mark.parametrize("kind", ["folder", "zip", "file"])
def test_likes(spark, tmp_path, kind):
    if kind == "zip":
        path = tmp_path / "a.zip"
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("export/data/like.js", SCRIPT)
            z.writestr("export/data/other.js", "x")
    else:
        (tmp_path / "data").mkdir()
        (tmp_path / "data/like.js").write_text(SCRIPT)
        path = tmp_path if kind == "folder" else tmp_path / "data/like.js"
    got = sorted(map(tuple, likes.read_likes(spark, str(path)).collect()))
    assert got == [("123", "https://x.com/b/status/123", "one"), ("456", "https://x.com/c/status/456", None)]


def export(tmp_path, **changes):
    b = {"tweet_id": "11", "created_at": "Wed Aug 05 00:00:00 +0000 2026", "full_text": "t", "folders": ["f"], "author": {"user_id": "7", "screen_name": "user_7", "name": "Real"}, "media": [{"type": "photo", "url": "https://h/1", "variants": None}], "in_reply_to_tweet_id": "10", "quoted_tweet": {"tweet_id": "9"}, "unknown": 1}
    path = tmp_path / "e.json"
    path.write_text(json.dumps({"export_metadata": {"exported_at": "2026-08-06T00:00:00Z"}, "bookmarks": [b | changes]}))
    return str(path)


def test_bookmarks(spark, tmp_path):
    out = bookmarks.read_export(spark, export(tmp_path))
    a, p = out["accounts"].first(), out["posts"].filter("observed_at IS NOT NULL").first()
    assert (a["native_id"], a["handle"], a["display_name"]) == ("7", None, "Real")
    assert (p["canonical_url"], p["created_at"]) == ("https://x.com/i/status/11", "2026-08-05T00:00:00Z")
    assert sorted(r["native_id"] for r in out["posts"].collect()) == ["10", "11", "9"]
    assert "unknown" in out["raw"].first()["payload"]


@pytest.mark.parametrize("changes", [{"tweet_id": " "}, {"created_at": "nonsense"}])
def test_bad_bookmarks_fail_whole(spark, tmp_path, changes):
    with pytest.raises(ValueError, match=r"bookmark\[0\]"):
        bookmarks.read_export(spark, export(tmp_path, **changes))


def test_legacy_database(spark, tmp_path):
    path = tmp_path / "l.db"
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE posts (post_id TEXT, post_url TEXT, imported_at TEXT, fetch_status TEXT)")
        c.execute("CREATE TABLE accounts (author_id TEXT, fetched_at TEXT)")
        c.execute("CREATE TABLE media (post_id TEXT, media_index INTEGER, media_type TEXT, source_url TEXT)")
        c.executemany("INSERT INTO posts VALUES (?, 'u', 't', 'pending')", [(str(i),) for i in range(50)])
    got = legacy.read_legacy(spark, str(path))
    assert got["posts"].count() == 50 and got["media"].count() == 0
    with sqlite3.connect(path) as c:
        c.execute("ALTER TABLE posts DROP COLUMN fetch_status")
    with pytest.raises(ValueError, match="posts lacks fetch_status"):
        legacy.read_legacy(spark, str(path))


def test_pixiv_single_page(spark):
    body = {"illust": {"id": 5, "title": "t", "user": {"id": 6, "name": "n", "account": "a"}, "tags": [{"name": "x", "translated_name": None}], "visible": True, "meta_single_page": {"original_image_url": "o"}, "image_urls": {"large": "l", "medium": "m"}, "meta_pages": []}}
    out = providers.pixiv(spark.createDataFrame([(json.dumps(body),)], "body string"))
    m = out["media"].first()
    assert (m["post"], m["position"], m["remote_url"], m["preview_url"]) == ("5", 0, "o", "m")
    assert out["posts"].first()["availability"] == "available"


def test_timeline_stops(spark):
    rows = [("a", i, 1, f"c{i}") for i in range(3)] + [("a", 3, 1, "c1"), ("b", 0, 1, "z"), *[("b", i, 0, f"y{i}") for i in range(1, 7)], ("c", 0, 1, None)]
    got = {r["run"]: (r["page"], r["reason"]) for r in timeline.stops(spark.createDataFrame(rows, "run string, page int, posts int, cursor string")).collect()}
    assert got == {"a": (3, "repeated_cursor"), "b": (5, "empty_pages"), "c": (0, "end")}

import pytest
from pyspark.sql import functions as F

from corvane.functions import jsons, scores, text, times, urls


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first()["r"]


CASES = [
    ("https://twitter.com/bob/status/123?utm_source=a&b=c#f", "https://x.com/bob/status/123?b=c", "recognized", None, ("x", "", "post", "123", "stable_id")),
    ("https://x.com/@Bob/", "https://x.com/@Bob", "recognized", None, ("x", "", "account", "bob", "handle")),
    ("https://x.com/home", "https://x.com/home", "unresolved", "unsupported_target", None),
    ("https://pixiv.net/en/users/9/", "https://www.pixiv.net/en/users/9", "recognized", None, ("pixiv", "", "account", "9", "stable_id")),
    ("http://www.pixiv.net:80/artworks/77", "https://www.pixiv.net/artworks/77", "recognized", None, ("pixiv", "", "post", "77", "stable_id")),
    ("https://danbooru.donmai.us/post/show/5", "https://danbooru.donmai.us/post/show/5", "recognized", None, ("danbooru", "danbooru.donmai.us", "post", "5", "stable_id")),
    ("https://e621.net/artists/8", "https://e621.net/artists/8", "recognized", None, ("e621", "e621.net", "artist", "8", "stable_id")),
    ("https://gelbooru.com/index.php?page=post&s=view&id=55", "https://gelbooru.com/index.php?page=post&s=view&id=55", "recognized", None, ("gelbooru", "gelbooru.com", "post", "55", "stable_id")),
    ("https://baraag.net/@foo/9", "https://baraag.net/@foo/9", "recognized", None, ("mastodon", "baraag.net", "post", "9", "stable_id")),
    ("https://baraag.net/@foo", "https://baraag.net/@foo", "recognized", None, ("mastodon", "baraag.net", "account", "foo", "handle")),
    ("https://t.co/abc", "https://t.co/abc", "redirect_required", "redirect_required", None),
    ("ftp://x/y", "ftp://x/y", "invalid", "unsupported_url", None),
    ("https://h:99999/", "https://h:99999/", "invalid", "malformed_url", None),
    ("https://linktr.ee/a?utm_source=1#k", "https://linktr.ee/a?utm_source=1#k", "unresolved", "link_hub", None),
    ("https://example.com/@foo/9", "https://example.com/@foo/9", "unresolved", "unsupported_target", None),
    ("", "", "invalid", "unsupported_url", None),
    (None, None, None, None, None),
]


@pytest.mark.parametrize("url,canonical,state,reason,reference", CASES)
def test_recognition(spark, url, canonical, state, reason, reference):
    r = urls.with_reference(spark.createDataFrame([(url,)], "u string"), "u").first()
    assert (r["canonical_url"], r["state"], r["reason"]) == (canonical, state, reason)
    assert (tuple(r["reference"])[:5] if r["reference"] else None) == reference


def test_own_instances(spark):
    hosts = urls.Hosts(boorus={"booru.example": "danbooru"}, mastodons=("m.example",))
    df = spark.createDataFrame([("https://booru.example/posts/1",), ("https://m.example/@a/2",)], "u string")
    got = [r["reference"]["platform"] for r in urls.with_reference(df, "u", hosts).collect()]
    assert got == ["danbooru", "mastodon"]


def test_extraction(spark):
    assert one(spark, "see https://a.b/c. (HTTP://d.e/f)!", urls.extract_urls) == ["https://a.b/c", "HTTP://d.e/f"]
    assert one(spark, None, urls.extract_urls) == []


def test_public_url(spark):
    assert one(spark, "https://u:p@H.com:8/a?page=2&k=s#f", urls.public_url) == "https://h.com:8/a?page=2&k=%3Credacted%3E"
    assert one(spark, "https://h:x/", urls.public_url) == "<invalid-url>"


def test_variants(spark):
    rows = [
        ("a", "b", None, {"primary": "a", "preview": "b"}, None),
        ("a", None, "{", {"primary": "a"}, "invalid_variants"),
        ("a", None, "[1]", {"primary": "a"}, "invalid_variants"),
        ("a", None, '{"variants":[{"role":"primary","url":"z"}]}', {"primary": "a"}, "ambiguous_variant"),
        (None, None, '{"archive":{"url":"q"}}', {"archive": "q", "primary": "q"}, None),
        ("a", None, '{"variants":[{"role":"original","url":null}]}', {"primary": "a"}, "invalid_variants"),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, r string, p string, d string")
    got = jsons.with_variants(df, "r", "p", "d", "v").select("i", "v").orderBy("i").collect()
    assert [(r["v"]["urls"], r["v"]["error"]) for r in got] == [(r[3], r[4]) for r in rows]


def test_payload_links_deep():
    deep = {"tweet": {"data": [{"entities": {"a": [{"b": {"expanded_url": "https://x/1"}}]}}]}, "other": {"url": "https://no"}}
    assert jsons.links_in(deep) == [("https://x/1", "post.entity", "$.tweet.data[0].entities.a[0].b.expanded_url")]


def test_times(spark):
    lenient = lambda c: times.utc_text(times.lenient(c))
    assert one(spark, "Wed Aug 05 00:00:00 +0000 2026", lenient) == "2026-08-05T00:00:00Z"
    assert one(spark, "2026-01-01T01:00:00.5+01:00", lenient) == "2026-01-01T00:00:00.500000Z"
    assert one(spark, "2026-01-01", lenient) == "2026-01-01T00:00:00Z"
    assert one(spark, "nonsense", lenient) is None
    assert one(spark, "2026-01-01T00:00:00", lambda c: times.utc_text(times.strict(c))) is None
    # text order would put the fraction first
    assert one(spark, "2026-01-01T00:00:00.5Z", lambda c: times.later_or_equal(c, F.lit("2026-01-01T00:00:00Z"))) is True


def test_text(spark):
    assert one(spark, " Straße ", text.casefold) == "strasse"
    assert one(spark, "post:12", lambda c: text.match_reference(c)["id"]) == 12
    assert one(spark, "tag:12", text.match_reference) is None
    for path, good in (("a/b.png", True), ("../a", False), ("/a", False), ("a//b", False), ("", False), (None, False)):
        assert one(spark, path, text.safe_path) is good


def test_least_of_nulls(spark):
    r = spark.createDataFrame([(1, None)], "a int, b int").select(scores.least_of(F.col("a"), F.col("b")).alias("r")).first()
    assert r["r"] is None

import json

import pytest
from pyspark.sql import functions as F

from corvane.catalog import Catalog


def export(path, at="2026-08-06T00:00:00Z", text="see https://www.pixiv.net/artworks/5.", name="Ann", **more):
    b = {"tweet_id": "11", "full_text": text, "author": {"user_id": "7", "screen_name": "ann", "name": name, "description": "art at https://e621.net/artists/3"}, "media": [{"type": "photo", "url": "https://h/1"}, {"type": "photo", "url": "https://h/2"}], "quoted_tweet": {"tweet_id": "9"}}
    path.write_text(json.dumps({"export_metadata": {"exported_at": at}, "bookmarks": [b | more]}))
    return str(path)


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "catalog"))


def test_catalog(catalog, tmp_path):
    first = catalog.import_bookmarks(export(tmp_path / "a.json"), "2026-08-07T00:00:00Z")
    assert catalog.import_bookmarks(export(tmp_path / "a.json"), "2026-08-08T00:00:00Z") == first
    assert catalog.runs().count() == 1
    # an older export changes history, not the present
    catalog.import_bookmarks(export(tmp_path / "b.json", at="2026-08-01T00:00:00Z", name="Old", text=None), "2026-08-09T00:00:00Z")
    a = catalog.accounts().first()
    assert (a["display_name"], catalog.account_snapshots().count()) == ("Ann", 2)
    assert {r["entity"]: r["n"] for r in catalog.summary().collect()} == {"accounts": 1, "posts": 2, "media": 2, "observations": 2, "raw": 2}
    assert [tuple(r) for r in catalog.stats().collect()] == [("bookmarked", 1)]
    assert [r["post"] for r in catalog.search("ARTWORKS").collect()] == ["11"]
    assert [r["post"] for r in catalog.search("old", "bookmarked").collect()] == ["11"]
    assert catalog.search("old", backend="phrase").count() == 0
    page = catalog.media_page(author="7", limit=1).first()
    assert page["has_more"] and page["source_key"] == "xarchive:0"
    assert catalog.media_page(after=page["continuation"], linked=False).first()["source_key"] == "xarchive:1"
    links = {(r["context"], r["reference"]["platform"] if r["reference"] else None) for r in catalog.links().collect()}
    assert {("post.text", "pixiv"), ("account.bio", "e621"), ("post.canonical", "x")} <= links
    assert catalog.doctor().count() == 0 and catalog.duplicates().count() == 0


def test_failed_import_leaves_nothing(catalog, tmp_path):
    with pytest.raises(ValueError):
        catalog.import_bookmarks(export(tmp_path / "a.json", tweet_id=""), "2026-08-07T00:00:00Z")
    assert catalog.runs().count() == 0 and catalog.posts().count() == 0


def test_assets(catalog, spark):
    rows = spark.createDataFrame([("x", "1", "a", "AB"), ("x", "2", "b", "ab"), ("x", "3", "c", "cd")], "platform string, post string, source_key string, sha256 string")
    catalog.append("r1", {"occurrence_assets": rows})
    assert catalog.duplicates().count() == 0  # the run isn't complete
    catalog._finish("r1", "test", "d", "2026-08-07T00:00:00Z")
    assert catalog.duplicates().select(F.size("occurrences").alias("n")).first()["n"] == 2

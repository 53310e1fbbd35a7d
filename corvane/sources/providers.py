"""Provider responses (JSON text in column ``body``), normalised to posts, tags, media, references, relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
DANBOORU_TAGS = ("artist", "character", "copyright", "general", "meta")
E621_ORDER = ("artist", "contributor", "copyright", "character", "species", "general", "meta", "lore", "invalid")
_DANBOORU = "id bigint, created_at string, rating string, md5 string, file_size bigint, image_width bigint, image_height bigint, file_ext string, file_url string, large_file_url string, preview_file_url string, source string, pixiv_id bigint, uploader_id bigint, parent_id bigint, is_deleted boolean, " + ", ".join(f"tag_string_{c} string" for c in DANBOORU_TAGS)
_FILE = "struct<md5: string, ext: string, size: bigint, width: bigint, height: bigint, url: string, has: boolean>"
_E621 = f"id bigint, created_at string, rating string, uploader_id bigint, fav_count bigint, score struct<up: bigint, down: bigint, total: bigint>, pools array<bigint>, sources array<string>, file {_FILE}, sample {_FILE}, preview {_FILE}, tags map<string, array<string>>, relationships struct<parent_id: bigint, children: array<bigint>>, flags map<string, boolean>"
_PIXIV = "illust struct<id: bigint, title: string, caption: string, type: string, user: struct<id: bigint, name: string, account: string>, tags: array<struct<name: string, translated_name: string>>, create_date: string, page_count: bigint, width: bigint, height: bigint, visible: boolean, meta_single_page: struct<original_image_url: string>, image_urls: struct<large: string, medium: string>, meta_pages: array<struct<image_urls: struct<original: string, large: string, medium: string>>>>"


def _roles(**urls: Column) -> Column:
    """The variants that have a URL, as JSON; null if there are none."""
    listed = F.filter(F.array(*[F.struct(F.lit(r).alias("role"), u.alias("url")) for r, u in urls.items()]), lambda e: e["url"].isNotNull())
    return F.when(F.size(listed) > 0, F.to_json(F.struct(listed.alias("variants"))))


def danbooru(pages: DataFrame, instance: str = "danbooru.donmai.us") -> dict[str, DataFrame]:
    """pages (body: one post)."""
    p = pages.select(F.from_json("body", _DANBOORU, {"mode": "FAILFAST"}).alias("p")).select("p.*").withColumn("post", F.col("id").cast("string"))
    strings = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"tag_string_{c}").alias("names")) for c in DANBOORU_TAGS])
    tags = p.select("post", F.inline(strings)).select("post", "category", F.posexplode(F.filter(F.split("names", " +"), lambda n: n != "")).alias("position", "name"))
    refs = p.select("post", F.explode(F.array_compact(F.array(
        F.when(F.col("source").rlike("(?i)^https?://"), F.struct(F.lit("source").alias("kind"), F.col("source").alias("value"))),
        F.when(F.col("pixiv_id").isNotNull(), F.struct(F.lit("pixiv_id").alias("kind"), F.col("pixiv_id").cast("string").alias("value"))),
    ))).alias("r")).select("post", "r.*")
    return {
        "posts": p.select("post", F.lit(instance).alias("instance"), "created_at", "rating", F.when(F.col("is_deleted"), "deleted").otherwise("available").alias("availability"), F.concat(F.lit(f"https://{instance}/posts/"), "post").alias("canonical_url")),
        "participants": p.filter("uploader_id IS NOT NULL").select("post", F.col("uploader_id").cast("string").alias("account"), F.lit("uploader").alias("role")),
        "tags": tags,
        "media": p.select("post", F.lower("md5").alias("md5"), F.col("file_size").alias("size"), F.col("image_width").alias("width"), F.col("image_height").alias("height"), F.col("file_url").alias("remote_url"), F.col("preview_file_url").alias("preview_url"), _roles(original=F.col("file_url"), sample=F.col("large_file_url"), preview=F.col("preview_file_url")).alias("variants_json")),
        "references": refs,
        "relations": p.filter("parent_id IS NOT NULL").select(F.col("parent_id").cast("string").alias("post"), F.col("post").alias("target"), F.lit("parent_of").alias("kind")),
    }


def e621(pages: DataFrame) -> dict[str, DataFrame]:
    """pages (body: one post)."""
    p = pages.select(F.from_json("body", _E621, {"mode": "FAILFAST"}).alias("p")).select("p.*").withColumn("post", F.col("id").cast("string"))
    place = F.array_position(F.array(*[F.lit(c) for c in E621_ORDER]), F.col("category"))
    tags = p.select("post", F.explode("tags").alias("category", "names")).select("post", "category", F.when(place == 0, len(E621_ORDER) + 1).otherwise(place).alias("place"), F.posexplode("names").alias("position", "name"))
    related = F.array_compact(F.concat(
        F.array(F.when(F.col("relationships.parent_id").isNotNull(), F.struct(F.col("relationships.parent_id").alias("post"), F.col("id").alias("target")))),
        F.transform(F.coalesce("relationships.children", F.array().cast("array<bigint>")), lambda c: F.struct(F.col("id").alias("post"), c.alias("target"))),
    ))
    return {
        "posts": p.select("post", "created_at", "rating", F.when(F.element_at("flags", "deleted"), "deleted").otherwise("available").alias("availability"), F.col("score.total").alias("score"), "fav_count"),
        "participants": p.filter("uploader_id IS NOT NULL").select("post", F.col("uploader_id").cast("string").alias("account"), F.lit("uploader").alias("role")),
        "tags": tags,
        "media": p.select("post", F.lower("file.md5").alias("md5"), "file.size", "file.width", "file.height", F.col("file.url").alias("remote_url"), F.col("preview.url").alias("preview_url"), _roles(original=F.col("file.url"), sample=F.when(F.col("sample.has"), F.col("sample.url")), preview=F.col("preview.url")).alias("variants_json")),
        "references": p.select("post", F.posexplode("sources").alias("position", "value")),
        "relations": p.select(F.explode(related).alias("r")).select(F.col("r.post").cast("string").alias("post"), F.col("r.target").cast("string").alias("target"), F.lit("parent_of").alias("kind")).distinct(),
        "pools": p.select("post", F.explode("pools").alias("pool")),
        "flags": p.select("post", F.explode("flags").alias("flag", "value")),
    }


def pixiv(pages: DataFrame) -> dict[str, DataFrame]:
    """pages (body: one artwork); a work without pages has its single image."""
    p = pages.select(F.from_json("body", _PIXIV, {"mode": "FAILFAST"}).alias("p")).select("p.illust.*").withColumn("post", F.col("id").cast("string"))
    single = F.array(F.struct(F.struct(F.col("meta_single_page.original_image_url").alias("original"), F.col("image_urls.large").alias("large"), F.col("image_urls.medium").alias("medium")).alias("image_urls")))
    images = p.select("post", F.posexplode(F.when(F.size("meta_pages") > 0, F.col("meta_pages")).otherwise(single)).alias("position", "page"))
    return {
        "posts": p.select("post", "title", F.col("caption").alias("text"), "create_date", F.when(F.col("visible"), "available").otherwise("unavailable").alias("availability"), F.concat(F.lit("https://www.pixiv.net/artworks/"), "post").alias("canonical_url")),
        "accounts": p.select(F.col("user.id").cast("string").alias("native_id"), F.col("user.account").alias("handle"), F.col("user.name").alias("display_name")).distinct(),
        "participants": p.select("post", F.col("user.id").cast("string").alias("account"), F.lit("author").alias("role")),
        "tags": p.select("post", F.posexplode("tags").alias("position", "t")).select("post", "position", "t.name", "t.translated_name"),
        "media": images.select("post", "position", F.col("page.image_urls.original").alias("remote_url"), F.col("page.image_urls.medium").alias("preview_url"), _roles(original=F.col("page.image_urls.original"), large=F.col("page.image_urls.large"), preview=F.col("page.image_urls.medium")).alias("variants_json")),
    }


_PIXIV_USER = "struct<user: struct<id: bigint, account: string, name: string, comment: string, is_valid: boolean, profile_image_urls: struct<medium: string>>, profile: struct<comment: string, webpage: string, twitter_url: string, is_valid: boolean, total_follow_users: bigint, total_following: bigint, total_illusts: bigint, background_image_url: string>>"
_PIXIV_FRAMES = "struct<ugoira_metadata: struct<zip_urls: struct<original: string, medium: string, large: string>, frames: array<struct<file: string, delay: bigint>>>>"


def _gone(status: Column, message: Column) -> Column:
    """What a 404 or 410 means: deleted if it says so, else unavailable."""
    return F.when((status == 410) | F.lower(F.coalesce(message, F.lit(""))).contains("deleted"), "deleted").otherwise("unavailable")


def pixiv_accounts(pages: DataFrame) -> dict[str, DataFrame]:
    """pages (requested, status, body: one profile) -> accounts, links.

    A page without a user is a gone account if its status is 404 or 410; else, or if the user isn't the requested one, the job stops.
    """
    p = pages.select("requested", "status", F.from_json("body", _PIXIV_USER).alias("b")).select("requested", "status", "b.*")
    missing = F.col("user.id").isNull()
    wrong = (missing & ~F.col("status").isin(404, 410)) | (~missing & (F.col("user.id").cast("string") != F.col("requested")))
    native = F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.lit("a profile isn't that of the requested account"))).otherwise(F.col("requested"))
    valid = F.coalesce("user.is_valid", F.lit(True)) & F.coalesce("profile.is_valid", F.lit(True))
    availability = F.when(missing, F.when(F.col("status") == 410, "deleted").otherwise("unavailable")).when(valid, "available").otherwise("unavailable")
    positive = lambda c: F.when(F.col(c) >= 0, F.col(c))
    accounts = p.select(
        native.alias("native_id"), availability.alias("availability"), F.col("user.account").alias("handle"), F.col("user.name").alias("display_name"), F.coalesce("profile.comment", "user.comment").alias("bio"),
        F.col("user.profile_image_urls.medium").alias("avatar_url"), F.col("profile.background_image_url").alias("banner_url"),
        positive("profile.total_follow_users").alias("followers"), positive("profile.total_following").alias("following"), positive("profile.total_illusts").alias("artworks"),
    )
    found = F.array(F.struct(F.lit("account.website").alias("context"), F.col("profile.webpage").alias("url")), F.struct(F.lit("account.social").alias("context"), F.col("profile.twitter_url").alias("url")))
    links = p.filter(~missing).select(F.col("requested").alias("native_id"), F.posexplode(found).alias("position", "l")).select("native_id", "position", "l.*")
    links = links.filter(F.col("url").rlike("^https?://")).groupBy("native_id", "url").agg(F.min_by("context", "position").alias("context"))
    return {"accounts": accounts, "links": links}


def pixiv_listing(pages: DataFrame) -> DataFrame:
    """pages (body: illusts and next_url) -> post, position, title, type, canonical_url, continuation (the offset that follows, if any)."""
    p = pages.select(F.from_json("body", "struct<illusts: array<struct<id: bigint, title: string, type: string>>, next_url: string>", {"mode": "FAILFAST"}).alias("b"))
    p = p.select(F.coalesce("b.illusts", F.raise_error(F.lit("a listing has no illusts")).cast("array<struct<id:bigint,title:string,type:string>>")).alias("illusts"), F.nullif(F.regexp_extract("b.next_url", r"[?&]offset=(\d+)", 1), F.lit("")).alias("continuation"))
    p = p.select(F.posexplode("illusts").alias("position", "i"), "continuation")
    post = F.col("i.id").cast("string")
    return p.select(post.alias("post"), "position", "i.title", "i.type", F.concat(F.lit("https://www.pixiv.net/artworks/"), post).alias("canonical_url"), "continuation")


def pixiv_ugoira(pages: DataFrame) -> dict[str, DataFrame]:
    """pages (post, status, body: a moving work) -> posts, media (its archive), frames (file and delay of each, in order).

    Without metadata a 404 or 410 is a gone work; anything else stops the job, as do a missing archive and a frame without a file or a delay.
    """
    p = pages.select("post", "status", F.get_json_object("body", "$.error.message").alias("message"), F.from_json("body", _PIXIV_FRAMES).alias("b")).select("post", "status", "message", "b.ugoira_metadata.*")
    gone = F.col("zip_urls").isNull() & F.col("frames").isNull() & F.col("status").isin(404, 410)
    archive = F.coalesce("zip_urls.original", "zip_urls.medium", "zip_urls.large")
    sound = archive.isNotNull() & F.col("frames").isNotNull() & F.forall("frames", lambda f: f["file"].isNotNull() & (F.coalesce(f["delay"], F.lit(0)) > 0))
    p = p.withColumn("gone", F.coalesce(gone, F.lit(False))).withColumn("archive", F.when(F.col("gone"), None).when(F.coalesce(sound, F.lit(False)), archive).otherwise(F.raise_error(F.lit("a moving work's metadata is malformed"))))
    live = p.filter(~F.col("gone"))
    return {
        "posts": p.select("post", F.when(F.col("gone"), _gone(F.col("status"), F.col("message"))).otherwise("available").alias("availability"), F.concat(F.lit("https://www.pixiv.net/artworks/"), "post").alias("canonical_url")),
        "media": live.select("post", F.concat("post", F.lit(":ugoira")).alias("source_key"), F.lit("application/zip").alias("media_type"), F.col("archive").alias("remote_url"), _roles(archive=F.col("archive")).alias("variants_json")),
        "frames": live.select("post", F.posexplode("frames").alias("position", "f")).select("post", "position", "f.file", F.col("f.delay").alias("delay_ms")),
    }


def status_metadata(pages: DataFrame) -> DataFrame:
    """pages (body) of a public metadata service -> post_id, text, author, available, images; ``tweet`` stands in for ``status``."""
    inner = "struct<id: string, text: string, type: string, author: struct<id: string, screen_name: string, name: string>, media: struct<photos: array<struct<url: string, width: bigint, height: bigint>>>>"
    e = pages.select(F.from_json("body", f"code bigint, status {inner}, tweet {inner}").alias("e"))
    s = e.select(F.col("e.code").alias("code"), F.coalesce("e.status", "e.tweet").alias("s"))
    gone = F.col("s").isNull() | F.coalesce(F.col("s.type") == "tombstone", F.lit(False))
    images = F.transform(F.coalesce("s.media.photos", F.array().cast("array<struct<url:string,width:bigint,height:bigint>>")), lambda p, i: F.struct((i + 1).alias("index"), p["url"].alias("url")))
    return s.select(F.col("s.id").alias("post_id"), F.col("s.text").alias("text"), F.col("s.author.screen_name").alias("author"), (~gone).alias("available"), images.alias("images"))


def listing(pages: DataFrame, boundary: int | None = None) -> DataFrame:
    """pages (body: array of posts) -> post, continuation (b and the page's last id).  An id at or above the boundary fails the page."""
    ids = F.transform(F.from_json("body", "array<struct<id: bigint>>"), lambda x: x["id"])
    rows = pages.select(F.explode(ids).alias("post"), F.concat(F.lit("b"), F.element_at(ids, -1).cast("string")).alias("continuation"))
    if boundary is None:
        return rows
    return rows.withColumn("post", F.when(F.col("post") < boundary, F.col("post")).otherwise(F.raise_error(F.lit("a page crosses its boundary")).cast("long")))


def all_items(parts: dict[str, DataFrame], key: str = "post") -> DataFrame:
    """The tagged union of a normalised page: object_kind, native_id, data (JSON)."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("object_kind"), (F.col(key) if key in df.columns else F.col(df.columns[0])).alias("native_id"), F.to_json(F.struct(*df.columns)).alias("data")) for kind, df in parts.items()])


def fixture_cases(suites: DataFrame) -> DataFrame:
    """suites (json) -> provider, name, operation, status, body, expected (JSON)."""
    e = suites.select(F.get_json_object("json", "$.manifest.provider").alias("provider"), F.from_json(F.get_json_object("json", "$.cases"), "array<string>").alias("cases"))
    c = e.select("provider", F.explode("cases").alias("case"))
    field = lambda p: F.get_json_object("case", f"$.{p}")
    return c.select("provider", field("name").alias("name"), field("operation").alias("operation"), field("response.status_code").cast("int").alias("status"), field("response.body").alias("body"), field("expected").alias("expected"))


def attributions(pages: DataFrame) -> dict[str, DataFrame]:
    """pages (body: one artist of a Danbooru-family site) -> attributions, names, urls; never an account."""
    schema = "id bigint, name string, other_names array<string>, is_deleted boolean, urls array<struct<url: string, is_active: boolean>>"
    p = pages.select(F.from_json("body", schema, {"mode": "FAILFAST"}).alias("p")).select("p.*").withColumn("artist", F.col("id").cast("string"))
    names = F.concat(F.array(F.struct(F.lit("primary").alias("kind"), F.col("name").alias("name"))), F.transform(F.coalesce("other_names", F.array().cast("array<string>")), lambda n: F.struct(F.lit("other").alias("kind"), n.alias("name"))))
    return {
        "attributions": p.select("artist", "name", F.coalesce("is_deleted", F.lit(False)).alias("deleted")),
        "names": p.select("artist", F.posexplode(names).alias("position", "n")).select("artist", "position", "n.kind", "n.name"),
        "urls": p.select("artist", F.posexplode("urls").alias("position", "u")).select("artist", "position", "u.url", F.coalesce("u.is_active", F.lit(True)).alias("active")),
    }


#: Category numbers of tags (fixed values).
CATEGORIES = {0: "general", 1: "artist", 2: "contributor", 3: "copyright", 4: "character", 5: "species", 6: "invalid", 7: "meta", 8: "lore"}


def tag_records(pages: DataFrame) -> DataFrame:
    """pages (body: one tag) -> tag, name, category, post_count, locked; an unknown category number has no label."""
    p = pages.select(F.from_json("body", "id bigint, name string, category bigint, post_count bigint, is_locked boolean", {"mode": "FAILFAST"}).alias("p")).select("p.*")
    labels = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    return p.select(F.concat(F.lit("tag:"), F.col("id").cast("string")).alias("tag"), "name", F.element_at(labels, F.col("category").cast("int")).alias("category"), "post_count", F.coalesce("is_locked", F.lit(False)).alias("locked"))


def alias_records(pages: DataFrame) -> DataFrame:
    """pages (body: one alias) -> alias_id, antecedent, consequent, status."""
    p = pages.select(F.from_json("body", "id bigint, antecedent_name string, consequent_name string, status string", {"mode": "FAILFAST"}).alias("p")).select("p.*")
    return p.select(F.col("id").alias("alias_id"), F.col("antecedent_name").alias("antecedent"), F.col("consequent_name").alias("consequent"), "status")


def valid_shapes(pages: DataFrame) -> DataFrame:
    """pages (body: one post) with valid: counts are whole and not negative, the score adds up, flags are booleans, pools are ids."""
    v = F.try_parse_json("body")
    number = lambda p: F.try_variant_get(v, p, "bigint")
    whole = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "BIGINT", F.lit(False))
    counts = whole("$.fav_count") & (number("$.fav_count") >= 0)
    score = whole("$.score.total") & (number("$.score.up") + number("$.score.down") == number("$.score.total"))
    flags = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.flags", "variant")).rlike(r"^OBJECT<(\w+: BOOLEAN(, )?)*>$"), F.lit(True))
    pools = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.pools", "variant")).rlike(r"^ARRAY<(BIGINT|VOID)>$"), F.lit(True))
    return pages.withColumn("valid", F.coalesce(counts & score & flags & pools, F.lit(False)))

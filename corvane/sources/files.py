"""Files as rows: digests, checks against the catalog, adoption candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_path


def hashed_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), size, sha256, md5 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace("path", "^.*" + root.rstrip("/").replace(".", r"\.") + "/", "")
    return files.select(below.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def adoption_candidates(listed: DataFrame, files: DataFrame, most_bytes: int) -> DataFrame:
    """listed (occurrence_id, path) against files (path, size): eligible, unsafe_path, missing or limit_exceeded."""
    j = listed.join(files.select("path", "size"), "path", "left")
    status = F.when(~safe_path(F.col("path")), "unsafe_path").when(F.col("size").isNull(), "missing").when(F.col("size") > most_bytes, "limit_exceeded").otherwise("eligible")
    return j.select("occurrence_id", "path", status.alias("status"))


# Fixed values.
IMAGE_HOST = "pbs.twimg.com"
IMAGE_TYPES = {"image/avif": ".avif", "image/gif": ".gif", "image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp"}
MOST_IMAGE_BYTES = 100 * 1024 * 1024


def downloads(images: DataFrame, most_bytes: int = MOST_IMAGE_BYTES) -> DataFrame:
    """images (post_id, media_index, author, url, content_type, size) -> post_id, media_index, outcome, path (of a downloaded one).

    Only https addresses of the image host are asked; the answer's type must be an image's; its size is bounded.  A
    null size is unknown and bounds nothing.  An author without safe characters is ``unknown``.
    """
    from ..functions.urls import parts

    url = parts(F.col("url"))
    there = F.coalesce((url["scheme"] == "https") & (url["host"] == IMAGE_HOST), F.lit(False))
    kind = F.lower(F.substring_index(F.col("content_type"), ";", 1))
    ending = F.element_at(F.create_map(*[F.lit(x) for pair in IMAGE_TYPES.items() for x in pair]), kind)
    outcome = F.when(~there, "refused_host").when(ending.isNull(), "not_an_image").when(F.col("size") > most_bytes, "too_large").otherwise("downloaded")
    named = F.regexp_replace(F.regexp_replace("author", "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    handle = F.when(F.coalesce(named, F.lit("")) == "", "unknown").otherwise(named)
    path = F.concat(handle, F.lit("/"), F.col("post_id").cast("string"), F.lit("_"), F.format_string("%02d", F.col("media_index")), ending)
    return images.select("post_id", "media_index", outcome.alias("outcome"), F.when(outcome == "downloaded", path).alias("path"))

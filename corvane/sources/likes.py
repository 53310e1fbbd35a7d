"""Liked posts of an exported archive: a folder, a ZIP file or the bare script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_filled

# Fixed values.
MEMBER = r"(^|/)data/likes?(-part\d+)?\.js$"
_KEYS = {"url": ("expandedUrl", "expanded_url", "tweetUrl", "url"), "id": ("tweetId", "tweet_id", "postId", "id"), "text": ("fullText", "full_text", "text")}
_FIELDS = ", ".join(f"{k}: string" for keys in _KEYS.values() for k in keys)
_RECORDS = f"array<struct<like: struct<{_FIELDS}>, {_FIELDS}>>"


def scripts(spark: SparkSession, path: str) -> DataFrame:
    """member, text of every like script below a folder, in a ZIP file, or of the file itself."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def opened(batches):
        import io
        import re
        import zipfile

        import pandas as pd

        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"]):
                if content[:4] == b"PK\x03\x04":
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        out += [(m, z.read(m).decode("utf-8-sig")) for m in z.namelist() if re.search(MEMBER, m.replace("\\", "/"))]
                elif re.search(MEMBER, name) or name.rstrip("/").endswith(path.rstrip("/").rsplit("/", 1)[-1]):
                    out.append((name, content.decode("utf-8-sig")))
            yield pd.DataFrame(out, columns=["member", "text"])

    return files.mapInPandas(opened, "member string, text string")


def array_in_script(text: Column) -> Column:
    """From the first [ to the last ]; null if there is no such part."""
    start = F.instr(text, "[")
    end = F.length(text) - F.instr(F.reverse(text), "]") + 1
    return F.when((start > 0) & text.contains("]") & (end >= start), F.substr(text, start, end - start + 1))


def likes(scripts: DataFrame) -> DataFrame:
    """post_id, post_url, archived_text of scripts (member, text), one row a post.

    Of a post's records the last gives the URL, and the last that has a text gives the
    text.  A script that holds no JSON array fails the query.
    """
    body = F.coalesce(array_in_script(F.col("text")), F.raise_error(F.lit("the like file holds no JSON array")).cast("string"))
    items = scripts.select("member", F.posexplode(F.from_json(body, _RECORDS, {"mode": "FAILFAST"})).alias("pos", "r"))
    field = lambda name: first_filled(*[F.coalesce(F.col(f"r.like.{k}"), F.when(F.col("r.like").isNull(), F.col(f"r.{k}"))) for k in _KEYS[name]])
    rows = items.select("member", "pos", field("url").alias("url"), field("id").alias("id"), field("text").alias("text"))
    from_url = F.nullif(F.regexp_extract("url", r"/status(?:es)?/(\d+)", 1), F.lit(""))
    rows = rows.withColumn("post_id", F.coalesce("id", from_url)).filter(F.col("post_id").rlike(r"^\d{2,20}$"))
    rows = rows.withColumn("url", F.coalesce("url", F.concat(F.lit("https://x.com/i/web/status/"), "post_id"))).withColumn("seq", F.struct("member", "pos"))
    return rows.groupBy("post_id").agg(F.max_by("url", "seq").alias("post_url"), F.max_by("text", F.when(F.col("text").isNotNull(), F.col("seq"))).alias("archived_text"))


def read_likes(spark: SparkSession, path: str) -> DataFrame:
    return likes(scripts(spark, path))

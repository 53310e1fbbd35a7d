"""Strings: references, names, file names, media types, provider terms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "webm": "video/webm", "mp4": "video/mp4", "zip": "application/zip"}


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full Unicode case folding, which lower() isn't (it keeps the sharp s)."""
    return text.str.strip().str.casefold()


def match_reference(text: Column) -> Column:
    """kind and id of ``account:12`` or ``post:12``; null for anything else."""
    return F.when(text.rlike(r"^(account|post):[0-9]+$"), F.struct(F.substring_index(text, ":", 1).alias("kind"), F.substring_index(text, ":", -1).cast("long").alias("id")))


def stable_reference(text: Column) -> Column:
    """platform and native id of ``PLATFORM:NATIVE_ID``; the id may hold further colons."""
    return F.when(text.rlike(r"^[^:]+:.+$"), F.struct(F.lower(F.substring_index(text, ":", 1)).alias("platform"), F.substr(text, F.instr(text, ":") + 1).alias("native_id")))


def first_filled(*columns: Column) -> Column:
    """The first value that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def real_handle(handle: Column, user_id: Column) -> Column:
    return F.when(handle != F.concat(F.lit("user_"), user_id), handle)


def real_name(name: Column, user_id: Column) -> Column:
    return F.when(name != F.concat(F.lit("User "), user_id), name)


def media_type(extension: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.element_at(known, F.lower(F.ltrim(extension, F.lit("."))))


def file_name(text: Column, index: Column) -> Column:
    """A safe file name: anything but letters, digits, dot, dash and underscore becomes _, with a two-digit index."""
    return F.concat(F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_"), F.lit("_"), F.when(index < 100, F.lpad(index.cast("string"), 2, "0")).otherwise(index.cast("string")))


def content_path(sha256: Column) -> Column:
    h = F.lower(sha256)
    return F.concat_ws("/", F.lit("sha256"), F.substring(h, 1, 2), F.substring(h, 3, 2), h)


def safe_path(path: Column) -> Column:
    """Relative, and without empty, . or .. parts."""
    return F.coalesce((path != "") & ~path.rlike(r"(^/|//|/$|(^|/)\.\.?(/|$)|\\)"), F.lit(False))


def hash_of(text: Column, digits: int) -> Column:
    """A lower-case hex digest of the right length, or null."""
    low = F.lower(F.trim(text))
    return F.when(low.rlike(f"^[0-9a-f]{{{digits}}}$"), low)


def semantic_identity(parts: list[Column], params: Column) -> Column:
    """Parts joined by colons, then the sorted parameters as k=v; a secret among them fails the query."""
    pairs = F.array_sort(F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    secret = F.exists(F.map_keys(params), lambda k: F.lower(k).rlike("token|secret|password|api_?key|auth"))
    return F.when(secret, F.raise_error(F.lit("a request identity must not hold secrets"))).otherwise(F.concat_ws(":", *parts, F.array_join(pairs, ":")))


def query_term(strategy: Column, value: Column) -> Column:
    """The provider's search term for a lookup."""
    return (
        F.when(strategy == "source_url", F.concat(F.lit("source:"), value))
        .when(strategy == "pixiv_id", F.concat(F.lit("pixiv_id:"), value))
        .when((strategy == "md5") & value.rlike("^[0-9a-f]{32}$"), F.concat(F.lit("md5:"), value))
    )


def strong_etag(value: Column) -> Column:
    return F.coalesce(value.rlike(r'^"[^"]+"$'), F.lit(False))


def content_range(value: Column) -> Column:
    """first, last and total of a Content-Range header, or null."""
    pattern = r"^bytes ([0-9]+)-([0-9]+)/([0-9]+)$"
    at = lambda i: F.regexp_extract(value, pattern, i).try_cast("long")
    return F.when(value.rlike(pattern), F.struct(at(1).alias("first"), at(2).alias("last"), at(3).alias("total")))

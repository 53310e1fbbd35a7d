"""JSON documents: variants, recursive links, type guards, digests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .stages import settled

MAX_VARIANTS_BYTES = 1 << 20
_VARIANTS = "variants array<struct<role:string,url:string>>, archive struct<url:string>"


def digest(*columns: Column) -> Column:
    """SHA-256 of the values as a JSON object in the given order, nulls written out."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def is_object(text: Column) -> Column:
    """A whole JSON document that is an object."""
    v = F.try_parse_json(text)
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


_ROLES = "array<struct<role:string,url:string>>"


def with_variants(df: DataFrame, remote: str = "remote_url", preview: str = "preview_url", document: str = "variants_json", name: str = "variants") -> DataFrame:
    """df with urls (role to URL) and error (null, invalid_variants or ambiguous_variant) in a struct.

    primary and preview come from the columns, further roles from the document's
    variants; an archive stands in for a missing archive or primary.  After an error
    only the columns' roles count.  The document is parsed once: every stage is settled
    before the next one uses it.
    """
    kept, doc = df.columns, F.col(document)
    filled = lambda c: c.isNotNull() & (c != "")
    entry = lambda role, url: F.struct(F.lit(role).alias("role"), url.alias("url"))
    none = F.array().cast(_ROLES)
    d = settled(df, kept, {"_held": F.from_json(doc, _VARIANTS), "_whole": F.try_parse_json(doc)})
    d = settled(
        d,
        kept,
        {
            "_base": F.filter(F.array(F.when(filled(F.col(remote)), entry("primary", F.col(remote))), F.when(filled(F.col(preview)), entry("preview", F.col(preview)))), lambda e: e.isNotNull()),
            "_listed": F.coalesce("_held.variants", none),
            "_archive": F.col("_held.archive.url"),
            "_object": F.coalesce(F.schema_of_variant("_whole").startswith("OBJECT"), F.lit(False)),
            "_raw": F.schema_of_variant(F.try_variant_get("_whole", "$.variants", "variant")),
        },
    )
    wrong = ~F.col("_object") | (F.octet_length(doc) > MAX_VARIANTS_BYTES) | (F.col("_raw").isNotNull() & ~F.col("_raw").rlike("^(ARRAY|VOID)"))
    wrong = wrong | F.exists("_listed", lambda e: e.isNull() | e["role"].isNull() | (e["role"] == "") | e["url"].isNull() | (e["url"] == ""))
    kept2 = [*kept, "_base", "_listed", "_archive"]
    d = settled(d, kept2, {"_wrong": wrong})
    d = settled(d, [*kept, "_archive", "_wrong"], {"_every": F.array_distinct(F.concat("_base", F.when(F.col("_wrong"), none).otherwise(F.col("_listed"))))})
    taken = lambda acc, e: F.when(F.exists(acc, lambda a: a["role"] == e["role"]), acc).otherwise(F.concat(acc, F.array(e)))
    d = settled(d, [*kept, "_archive", "_wrong"], {"_clash": F.size(F.array_distinct(F.transform("_every", lambda e: e["role"]))) < F.size("_every"), "_first": F.aggregate("_every", none, taken)})
    spare = F.filter(F.array(*[F.when(F.col("_archive").isNotNull(), entry(r, F.col("_archive"))) for r in ("archive", "primary")]), lambda e: e.isNotNull() & ~F.exists("_first", lambda a: a["role"] == e["role"]))
    whole = F.concat("_first", F.when(doc.isNotNull() & ~F.col("_wrong") & ~F.col("_clash"), spare).otherwise(none))
    error = F.when(doc.isNull(), F.lit(None)).when(F.col("_wrong"), "invalid_variants").when(F.col("_clash"), "ambiguous_variant")
    return settled(d, kept, {name: F.struct(F.map_from_entries(whole).alias("urls"), error.alias("error"))})


def shown_roles(urls: Column, most: int = 100) -> Column:
    """roles (sorted, at most ``most``; primary if there are none) and truncated."""
    roles = F.array_sort(F.map_keys(urls))
    return F.struct(F.when(F.size(roles) == 0, F.array(F.lit("primary"))).otherwise(F.slice(roles, 1, most)).alias("roles"), (F.size(roles) > most).alias("truncated"))


# Where links sit in retained payloads.
CONTAINERS = {"entities": "post.entity", "card": "post.card", "quoted_tweet": "post.quote", "quoted_status": "post.quote", "quote": "post.quote"}
WRAPPERS = ("tweet", "legacy", "data", "status", "bookmark")
SOURCES = ("source", "source_url")
URL_KEYS = ("url", "expanded_url", "unwound_url", "source", "source_url", "card_url")


def links_in(document) -> list[tuple[str, str, str]]:
    """(text, context, path) of every string that may hold a link; a walk with its own stack, so depth is no concern."""
    found, stack = [], [(document, "$", None)]
    while stack:
        value, path, context = stack.pop()
        below = []
        if isinstance(value, dict):
            for key, item in value.items():
                name, place = key.lower(), f"{path}.{key}"
                if context is not None:
                    below.append((item, place, ("take", context) if isinstance(item, str) and name in URL_KEYS else context))
                elif name in CONTAINERS:
                    below.append((item, place, CONTAINERS[name]))
                elif name in SOURCES and isinstance(item, str):
                    below.append((item, place, ("take", "post.source")))
                elif name in WRAPPERS:
                    below += [(x, f"{place}[{i}]", None) for i, x in enumerate(item)] if isinstance(item, list) else [(item, place, None)]
        elif isinstance(value, list) and context is not None:
            below = [(x, f"{path}[{i}]", context) for i, x in enumerate(value)]
        elif isinstance(value, str) and isinstance(context, tuple):
            found.append((value, context[1], path))
        stack += reversed(below)
    return found


@F.udtf(returnType=StructType([StructField(c, StringType()) for c in ("url", "context", "json_path")]))
class PayloadLinks:
    """One row for each URL in a retained JSON payload; malformed payloads have none."""

    def eval(self, payload: str):
        import re

        if payload is None:
            return
        try:
            document = json.loads(payload)
        except ValueError:
            return
        for text, context, path in links_in(document):
            for url in re.findall(r"https?://[^\s<>\]\[(){}\"']+", text, re.IGNORECASE):
                yield url.rstrip(".,;:!?"), context, path


def numeric_id(text: Column) -> Column:
    """A positive decimal id without leading zeros, as text."""
    return F.when(text.rlike("^[1-9][0-9]*$"), text)


def typed(document: Column, path: str, kind: str) -> Column:
    """The value at a path of a parsed document if it has that type (int, string, boolean, double), else null; no coercion."""
    v = F.try_variant_get(document, path, "variant")
    names = {"int": "BIGINT", "string": "STRING", "boolean": "BOOLEAN", "double": "DOUBLE|DECIMAL"}
    spark = {"int": "bigint", "string": "string", "boolean": "boolean", "double": "double"}[kind]
    return F.when(F.schema_of_variant(v).rlike(f"^({names[kind]})"), F.try_variant_get(document, path, spark))

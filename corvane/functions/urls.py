"""URLs as column expressions: parts, canonical form, recognition, redaction.

A URL is cut once by a pattern into scheme, authority, path, query and fragment;
all else are expressions over these parts, so everything stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import settled

# Fixed values.
URL = r"((?i:https?)://[^\s<>\]\[(){}\"']+)"
TRAILING = ".,;:!?"
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")
SHORTENERS = ("t.co", "bit.ly", "tinyurl.com", "ow.ly")
LINK_HUBS = ("linktr.ee", "lit.link", "potofu.me", "carrd.co")
HOST_ALIASES = {"twitter.com": "x.com", "www.twitter.com": "x.com", "mobile.twitter.com": "x.com", "www.x.com": "x.com", "pixiv.net": "www.pixiv.net"}
BOORUS = {"danbooru.donmai.us": "danbooru", "gelbooru.com": "gelbooru", "e621.net": "e621"}
MASTODONS = ("baraag.net",)
SAFE_KEYS = ("page", "s", "id")

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def extract_urls(text: Column) -> Column:
    """All http(s) URLs of a text, in order, without punctuation at their ends; no text, no URLs."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), 1), lambda u: F.rtrim(u, F.lit(TRAILING)))


def parts(url: Column) -> Column:
    """scheme, user, host, port, path, query, fragment (lower-case scheme and host; port null if absent, -1 if malformed)."""
    at = lambda i: F.regexp_extract(url, _PARTS, i)
    authority = at(2)
    place = F.regexp_replace(authority, "^.*@", "")
    port = F.regexp_extract(place, r":([^:\]]*)$", 1)
    number = port.try_cast("int")
    return F.struct(
        F.lower(at(1)).alias("scheme"),
        F.when(authority.contains("@"), F.regexp_extract(authority, "^(.*)@", 1)).alias("user"),
        F.lower(F.regexp_replace(place, r":[^:\]]*$", "")).alias("host"),
        F.when(port == "", F.lit(None).cast("int")).when(port.rlike("^[0-9]+$") & number.between(0, 65535), number).when(port.isNotNull(), F.lit(-1)).alias("port"),
        at(3).alias("path"),
        at(4).alias("query"),
        at(5).alias("fragment"),
    )


def _pairs(query: Column) -> Column:
    """key and value of each part of a query string, decoded; blank values stay, empty parts don't."""
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    return F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("key"), F.when(p.contains("="), decode(F.substr(p, F.instr(p, "=") + 1))).otherwise("").alias("value")),
    )


def _encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(_encode(p["key"]), F.lit("="), _encode(p["value"]))), "&")


@dataclass(frozen=True)
class Hosts:
    """Hosts whose URLs are understood; callers add their own instances."""

    boorus: dict[str, str] = field(default_factory=dict)
    mastodons: tuple[str, ...] = ()

    def all_boorus(self) -> dict[str, str]:
        return BOORUS | self.boorus

    def all_mastodons(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*MASTODONS, *self.mastodons]))


def with_canonical(df: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """df with original_url, canonical_url, original_query, original_fragment, state, reason (names after ``prefix``).

    Recognised hosts: https, aliases resolved, no trailing slash, no tracking keys, no
    fragment.  Other hosts keep their query and fragment.  A null URL gives nulls.
    Parts become columns first, so that no expression is worked out twice.
    """
    d = df.withColumn("_o", F.trim(F.col(url))).withColumn("_p", parts(F.col("_o")))
    scheme, port, path, query, fragment = (F.col(f"_p.{n}") for n in ("scheme", "port", "path", "query", "fragment"))
    default = port.isNull() | ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443))
    d = d.withColumn("_bare", F.regexp_replace("_p.host", r"\.+$", ""))
    d = d.withColumn("_host", F.when(default, F.col("_bare")).otherwise(F.concat("_bare", F.lit(":"), port.cast("string"))))
    aliases = F.create_map(*[F.lit(x) for pair in HOST_ALIASES.items() for x in pair])
    d = d.withColumn("_host", F.coalesce(F.element_at(aliases, F.col("_host")), F.col("_host")))
    d = d.withColumn("_path", F.when(path == "", "/").otherwise(path))
    d = d.withColumn("_query", _query(F.filter(_pairs(query), lambda q: ~F.lower(q["key"]).isin(*TRACKING_KEYS))))
    short = F.when(F.col("_path") == "/", F.col("_path")).otherwise(F.regexp_replace("_path", "/+$", ""))
    clean = F.concat(F.lit("https://"), F.col("_host"), short, F.when(F.col("_query") != "", F.concat(F.lit("?"), F.col("_query"))).otherwise(""))
    tail = F.concat(F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
    plain = F.concat(scheme, F.lit("://"), F.col("_host"), F.col("_path"), tail)
    d = d.withColumn("_malformed", port == -1).withColumn("_foreign", ~scheme.isin("http", "https") | (F.col("_bare") == ""))
    malformed, bad = F.coalesce(F.col("_malformed"), F.lit(False)), F.coalesce(F.col("_malformed"), F.lit(False)) | F.col("_foreign")
    known = F.col("_host").isin("x.com", "www.pixiv.net", *BOORUS, *MASTODONS)
    shortened = F.col("_bare").isin(*SHORTENERS)
    there = F.col("_o").isNotNull()
    out = {
        "original_url": F.col("_o"),
        "canonical_url": F.when(bad, F.col("_o")).when(known, clean).otherwise(plain),
        "original_query": F.when(malformed, "").otherwise(query),
        "original_fragment": F.when(malformed, "").otherwise(fragment),
        "state": F.when(there, F.when(bad, "invalid").when(shortened, "redirect_required").otherwise("unresolved")),
        "reason": F.when(there, F.when(malformed, "malformed_url").when(F.col("_foreign"), "unsupported_url").when(shortened, "redirect_required")),
    }
    return settled(d, df.columns, {prefix + name: c for name, c in out.items()})


_FIELDS = ("platform", "instance_host", "object_kind", "native_id", "identifier_kind", "target", "recognizer")


def _reference(platform, instance, object_kind, native_id, target, recogniser, kind="stable_id") -> Column:
    values = (platform, instance, object_kind, native_id, kind, target, recogniser)
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("string").alias(name) for name, v in zip(_FIELDS, values)])


def _rules(hosts: Hosts) -> list[tuple[Column, Column]]:
    """(condition, reference) over _host, _path, _args (a map of the query) and _url; the first that fits decides."""
    host, path, args = F.col("_host"), F.col("_path"), F.col("_args")
    group = lambda pattern, i=1: F.regexp_extract(path, pattern, i)
    arg = lambda name: F.element_at(args, name)
    https = lambda *xs: F.concat(F.lit("https://"), *[x if isinstance(x, Column) else F.lit(x) for x in xs])
    rules = []
    status = r"^/([^/]+)/status/(\d+)$"
    rules.append(((host == "x.com") & path.rlike(status), _reference("x", "", "post", group(status, 2), https("x.com/i/status/", group(status, 2)), "x-post")))
    person = F.lower(F.ltrim(group("^/([^/]+)$"), F.lit("@")))
    rules.append(((host == "x.com") & path.rlike("^/[^/]+$") & ~group("^/([^/]+)$").isin("home", "explore", "i"), _reference("x", "", "account", person, https("x.com/", person), "x-account", kind="handle")))
    for what, kind, recogniser in (("users", "account", "pixiv-user"), ("artworks", "post", "pixiv-artwork")):
        pattern = rf"^/(?:[a-z]{{2}}/)?{what}/(\d+)$"
        rules.append(((host == "www.pixiv.net") & path.rlike(pattern), _reference("pixiv", "", kind, group(pattern), https(f"www.pixiv.net/{what}/", group(pattern)), recogniser)))
    for site, platform in hosts.all_boorus().items():
        here = host == site
        if platform == "gelbooru":
            for kind, view, base in (("post", "view", "gelbooru.com"), ("artist", "show", site)):
                fits = here & (arg("page") == kind) & (arg("s") == view) & arg("id").rlike(r"^\d+$")
                rules.append((fits, _reference("gelbooru", site, kind, arg("id"), https(f"{base}/index.php?page={kind}&s={view}&id=", arg("id")), f"gelbooru-{kind}")))
        else:
            for kind, pattern in (("post", r"^/(?:posts|post/show)/(\d+)$"), ("artist", r"^/artists/(\d+)$")):
                rules.append((here & path.rlike(pattern), _reference(platform, site, kind, group(pattern), https(f"{site}/{kind}s/", group(pattern)), f"{platform}-{kind}")))
            media = r"^/data/(?:[^/]+/)*([0-9a-fA-F]{32,64})\.[a-zA-Z0-9]+$"
            rules.append((here & path.rlike(media), _reference(platform, site, "media_asset", F.lower(group(media)), F.col("_url"), f"{platform}-media", kind="hash")))
    mastodon, toot, name = host.isin(*hosts.all_mastodons()), r"^/@([^/]+)/(\d+)$", r"^/@([^/]+)$"
    rules.append((mastodon & path.rlike(toot), _reference("mastodon", host, "post", group(toot, 2), https(host, "/@", group(toot), "/", group(toot, 2)), "mastodon-status")))
    rules.append((mastodon & path.rlike(name), _reference("mastodon", host, "account", group(name), https(host, "/@", group(name)), "mastodon-account", kind="handle")))
    return rules


def _fitting(rules: list[tuple[Column, Column]]) -> Column:
    out = F.when(*rules[0])
    for fits, reference in rules[1:]:
        out = out.when(fits, reference)
    return out


def with_reference(df: DataFrame, url: str, hosts: Hosts = Hosts()) -> DataFrame:
    """df with original_url, canonical_url, state, reason and reference (a struct, or null)."""
    d = with_canonical(df, url).withColumnRenamed("canonical_url", "_url")
    d = d.withColumn("_p", parts(F.col("_url")))
    d = d.withColumn("_host", F.col("_p.host")).withColumn("_path", F.regexp_replace("_p.path", "/+$", ""))
    pairs = _pairs(F.col("_p.query"))
    # of keys that occur again the last counts
    d = d.withColumn("_pairs", F.reverse(pairs))
    first = F.filter("_pairs", lambda q, i: F.array_position(F.transform("_pairs", lambda r: r["key"]), q["key"]) == i + 1)
    d = d.withColumn("_args", F.map_from_entries(first)).withColumn("_final", F.col("state").isin("invalid", "redirect_required"))
    d = d.withColumn("reference", F.when(~F.col("_final"), _fitting(_rules(hosts))))
    there = F.col("original_url").isNotNull()
    state = F.when(F.col("_final"), F.col("state")).when(F.col("reference").isNotNull(), "recognized").otherwise("unresolved")
    reason = F.when(F.col("_final"), F.col("reason")).when(F.col("reference").isNotNull(), F.lit(None)).when(F.col("_host").isin(*LINK_HUBS), "link_hub").otherwise("unsupported_target")
    return settled(d, df.columns, {"original_url": F.col("original_url"), "canonical_url": F.col("_url"), "state": F.when(there, state), "reason": F.when(there, reason), "reference": F.col("reference")})


def public_url(url: Column) -> Column:
    """A URL fit to be shown: no user, no fragment, query values masked but for a few keys."""
    p = parts(url)
    host = F.when(p["port"].isNull(), p["host"]).otherwise(F.concat(p["host"], F.lit(":"), p["port"].cast("string")))
    shown = _query(F.transform(_pairs(p["query"]), lambda q: F.struct(q["key"].alias("key"), F.when(F.lower(q["key"]).isin(*SAFE_KEYS), q["value"]).otherwise("<redacted>").alias("value"))))
    whole = F.concat(F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit("://"))).otherwise(""), host, p["path"], F.when(shown != "", F.concat(F.lit("?"), shown)).otherwise(""))
    return F.when(p["port"] == -1, "<invalid-url>").otherwise(whole)


def same_post(a: Column, b: Column) -> Column:
    """Two references (see with_reference) are to posts, and to the same one."""
    same = (a["object_kind"] == "post") & (b["object_kind"] == "post") & (a["platform"] == b["platform"]) & (a["instance_host"] == b["instance_host"]) & (a["native_id"] == b["native_id"])
    return F.coalesce(same, F.lit(False))


def x_aliases(url: Column) -> Column:
    """An x.com URL under both of its hosts; another URL alone."""
    p = parts(url)
    both = F.array(*[F.concat(F.lit(f"https://{h}"), p["path"]) for h in ("x.com", "twitter.com")])
    return F.when(p["host"].isin("x.com", "twitter.com"), both).otherwise(F.array(url))


def reference_url(platform: Column, kind: Column, native_id: Column) -> Column:
    return (
        F.when((platform == "pixiv") & (kind == "post"), F.concat(F.lit("https://www.pixiv.net/artworks/"), native_id))
        .when((platform == "pixiv") & (kind == "account"), F.concat(F.lit("https://www.pixiv.net/users/"), native_id))
        .otherwise(F.concat_ws(":", F.lit("urn"), platform, kind, native_id))
    )


def allowed_destination(url: Column, hosts: tuple[str, ...]) -> Column:
    """https, no user, port 443, a name (not an address) on the list or below it."""
    p = parts(url)
    listed = F.lit(False)
    for h in hosts:
        listed = listed | (p["host"] == h) | p["host"].endswith("." + h)
    address = p["host"].rlike(r"^[0-9.]+$") | p["host"].startswith("[")
    return F.coalesce((p["scheme"] == "https") & p["user"].isNull() & (p["port"].isNull() | (p["port"] == 443)) & ~address & listed, F.lit(False))

"""A catalog: append-only logs below one folder, current state derived from them.

Every import writes each log under its own run, ``<root>/<log>/run=<id>``, so a run
that is repeated after a failure overwrites only itself, and readers list complete
runs only.  A source that was imported completely is not imported again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import urls
from .functions.times import strict
from .operators import checks, joins, merge, paging, search
from .sources import bookmarks, legacy, likes


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- logs -------------------------------------------------------------------

    def _read(self, name: str) -> DataFrame:
        schema = schemas.LOGS[name]
        try:
            return self.spark.read.schema(f"{schema}, run string").parquet(f"{self.root}/{name}")
        except Exception as e:  # no run has written this log yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{schema}, run string")

    def runs(self) -> DataFrame:
        return self._read("import_runs").select("run", "source_kind", "source_digest", "status", "started_at")

    def log(self, name: str) -> DataFrame:
        """Rows of complete runs."""
        done = self.runs().filter("status = 'complete'").select("run")
        return self._read(name).join(done, "run", "left_semi").drop("run")

    def append(self, run: str, logs: dict[str, DataFrame]) -> None:
        for name, rows in logs.items():
            empty = self.spark.createDataFrame([], schemas.LOGS[name])
            names = empty.columns
            full = empty.unionByName(rows.select(*[c for c in names if c in rows.columns]), allowMissingColumns=True)
            full.write.mode("overwrite").parquet(f"{self.root}/{name}/run={run}")

    def _finish(self, run: str, kind: str, digest: str, started: str) -> None:
        row = self.spark.createDataFrame([(kind, digest, "complete", started)], schemas.LOGS["import_runs"])
        row.write.mode("overwrite").parquet(f"{self.root}/import_runs/run={run}")

    def _import(self, kind: str, path: str, started: str, logs) -> str:
        """The run that holds the source: an earlier one if the same bytes were imported completely."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        # the digest of all files' digests, in two levels: by their first three digits, then of these 4096 at most
        joined = F.array_join(F.array_sort(F.collect_list("d")), "")
        parts = files.select(F.sha2("content", 256).alias("d")).groupBy(F.substring("d", 1, 3).alias("p")).agg(F.sha2(joined, 256).alias("d"))
        digest = hashlib.sha256("".join(r["d"] for r in parts.orderBy("p").collect()).encode()).hexdigest()
        run = hashlib.sha256(f"{kind}:{digest}".encode()).hexdigest()[:16]
        if self.runs().filter((F.col("run") == run) & (F.col("status") == "complete")).isEmpty():
            self.append(run, logs())
            self._finish(run, kind, digest, started)
        return run

    # -- imports -----------------------------------------------------------------

    def import_bookmarks(self, path: str, started: str) -> str:
        """An export is taken whole or, if it has problems, not at all."""

        def logs():
            out = bookmarks.read_export(self.spark, path)
            for name in ("participants", "observations", "media", "relations"):
                out[name] = out[name].withColumn("platform", F.lit("x"))
            out["observations"] = out["observations"].withColumnRenamed("exported_at", "observed_at")
            return out

        return self._import("xarchive", path, started, logs)

    def import_likes(self, path: str, started: str) -> str:
        def logs():
            rows = likes.read_likes(self.spark, path)
            x, at = F.lit("x").alias("platform"), F.lit(started).alias("observed_at")
            return {
                "posts": rows.select(x, F.col("post_id").alias("native_id"), at, F.col("post_url").alias("canonical_url"), F.col("archived_text").alias("text"), F.lit("available").alias("availability")),
                "observations": rows.select(x, F.lit("likes").alias("source_kind"), F.concat(F.lit("like:"), "post_id").alias("event_key"), F.lit("liked").alias("event_type"), F.col("post_id").alias("post"), at),
            }

        return self._import("x_likes", path, started, logs)

    def import_likes_database(self, path: str, started: str) -> str:
        def logs():
            t = legacy.read_legacy(self.spark, path)
            x = F.lit("x").alias("platform")
            have = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")
            p, m, a = t["posts"], t["media"], t["accounts"]
            return {
                "accounts": a.select(x, F.col("author_id").alias("native_id"), F.col("fetched_at").alias("observed_at"), have(a, "handle").alias("handle"), have(a, "display_name").alias("display_name"), have(a, "bio").alias("bio")),
                "posts": p.select(x, F.col("post_id").alias("native_id"), F.coalesce(have(p, "fetched_at"), "imported_at").alias("observed_at"), F.col("post_url").alias("canonical_url"), F.coalesce(have(p, "post_text"), have(p, "archive_text")).alias("text"), have(p, "created_at").alias("created_at"), F.when(F.col("fetch_status") == "unavailable", "unavailable").otherwise("available").alias("availability")),
                "observations": p.select(x, F.lit("x_likes_db").alias("source_kind"), F.concat(F.lit("like:"), "post_id").alias("event_key"), F.lit("liked").alias("event_type"), F.col("post_id").alias("post"), F.col("imported_at").alias("observed_at")),
                "media": m.select(x, F.col("post_id").alias("post"), F.concat(F.lit("x_likes:"), F.col("media_index").cast("string")).alias("source_key"), F.lit(started).alias("observed_at"), F.col("media_index").alias("position"), "media_type", F.col("source_url").alias("remote_url")),
            }

        return self._import("x_likes_db", path, started, logs)

    # -- current state ------------------------------------------------------------

    def _current(self, name: str) -> DataFrame:
        log = self.log(name).withColumn("seq", F.coalesce("seq", F.lit(0))).withColumn("at", strict(F.col("observed_at")))
        p = merge.projection(log, schemas.KEYS[name], ["at", "seq"], schemas.RULES[name], seen="at")
        return p

    def accounts(self) -> DataFrame:
        return self._current("accounts")

    def posts(self) -> DataFrame:
        return self._current("posts")

    def media(self) -> DataFrame:
        return self._current("media")

    def account_snapshots(self) -> DataFrame:
        return merge.snapshots(self.log("accounts"), schemas.KEYS["accounts"], list(schemas.RULES["accounts"]), schemas.ORDER)

    def assets(self) -> DataFrame:
        return merge.merged_assets(self.log("assets"))

    # -- questions -----------------------------------------------------------------

    def summary(self) -> DataFrame:
        """entity, n."""
        counted = [(n, getattr(self, n)()) for n in ("accounts", "posts", "media")] + [(n, self.log(n)) for n in ("observations", "raw")]
        out = None
        for name, rows in counted:
            part = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n")
            out = part if out is None else out.unionByName(part)
        return out

    def stats(self) -> DataFrame:
        """event_type, posts."""
        return self.log("observations").groupBy("event_type").agg(F.count_distinct("post").alias("posts"))

    def search(self, query: str, event_type: str | None = None, backend: str = "like") -> DataFrame:
        """Posts whose text, or whose author's names or bio, hold the query; phrases match whole tokens of the latest author state."""
        posts = self.posts().select("platform", F.col("native_id").alias("post"), "canonical_url", "text")
        match = search.holds if backend == "like" else search.phrase
        people = self.log("accounts") if backend == "like" else self.accounts()
        named = people.filter(match(F.col("handle"), query) | match(F.col("display_name"), query) | match(F.col("bio"), query)).select("platform", F.col("native_id").alias("account"))
        theirs = joins.existing(self.log("participants").filter("role = 'author'"), named, ["platform", "account"]).select("platform", "post").distinct().withColumn("by", F.lit(True))
        found = posts.join(theirs, ["platform", "post"], "left").filter(F.coalesce(match(F.col("text"), query), F.lit(False)) | F.col("by").isNotNull()).drop("by")
        if event_type is not None:
            found = joins.existing(found, self.log("observations").filter(F.col("event_type") == event_type), ["platform", "post"])
        return found.orderBy("platform", "post")

    def media_page(self, platform: str | None = None, author: str | None = None, availability: str | None = None, linked: bool | None = None, after: str | None = None, limit: int = 100) -> DataFrame:
        """The next media occurrences by key, with author and availability of their posts."""
        if not 1 <= limit <= 200:
            raise ValueError("limit must be from 1 to 200")
        posts = self.posts().select("platform", F.col("native_id").alias("post"), "availability")
        m = self.media().drop("first_seen", "last_seen").join(posts, ["platform", "post"], "left")
        m = m.withColumn("key", F.concat_ws(":", "platform", F.lpad("post", 20, "0"), "source_key"))
        if platform is not None:
            m = m.filter(F.col("platform") == platform)
        if availability is not None:
            m = m.filter(F.col("availability") == availability)
        if author is not None:
            m = joins.existing(m, self.log("participants").filter((F.col("account") == author) & (F.col("role") == "author")), ["platform", "post"])
        if linked is not None:
            m = (joins.existing if linked else joins.lacking)(m, self.log("occurrence_assets"), ["platform", "post", "source_key"])
        return paging.keyset_page(m, "key", after, limit)

    def links(self, hosts: urls.Hosts = urls.Hosts()) -> DataFrame:
        """Every URL in current posts' texts and accounts' fields, recognised; subject, context, json_path."""
        field = lambda rows, kind, key, c, context, path: rows.select(F.lit(kind).alias("subject_kind"), F.col(key).alias("subject_id"), F.lit(context).alias("context"), F.posexplode(urls.extract_urls(F.col(c))).alias("i", "url"), F.lit(path).alias("path"))
        a, p = self.accounts(), self.posts()
        found = field(a, "account", "native_id", "website_url", "account.website", "$.website_url")
        for part in (field(a, "account", "native_id", "profile_url", "account.profile", "$.profile_url"), field(a, "account", "native_id", "bio", "account.bio", "$.bio[]"), field(p, "post", "native_id", "canonical_url", "post.canonical", "$.canonical_url"), field(p, "post", "native_id", "text", "post.text", "$.text_content[]")):
            found = found.unionByName(part)
        found = found.withColumn("json_path", F.replace("path", F.lit("[]"), F.concat(F.lit("["), F.col("i").cast("string"), F.lit("]")))).drop("path", "i")
        return urls.with_reference(found, "url", hosts)

    def duplicates(self) -> DataFrame:
        """sha256, occurrences of assets that more than one occurrence holds."""
        held = self.log("occurrence_assets").select(F.lower("sha256").alias("sha256"), F.concat_ws(":", "platform", "post", "source_key").alias("occurrence"))
        return held.groupBy("sha256").agg(F.array_sort(F.collect_set("occurrence")).alias("occurrences")).filter(F.size("occurrences") > 1)

    def doctor(self) -> DataFrame:
        """relation, missing, n: references without what they refer to."""
        posts = self.log("posts").select("native_id")
        return checks.orphans([(f"{n}.post", self.log(n), "post", posts, "native_id") for n in ("participants", "observations", "media", "relations")])

"""Columns of the catalog's logs.  Natural keys throughout; every log row carries ``observed_at`` and ``seq``."""

from __future__ import annotations

VERSION = 1

_OBSERVED = "observed_at string, seq bigint"
LOGS = {
    "accounts": f"platform string, native_id string, {_OBSERVED}, handle string, display_name string, bio string, location string, website_url string, profile_url string, followers bigint, verified boolean",
    "posts": f"platform string, native_id string, {_OBSERVED}, canonical_url string, text string, language string, created_at string, availability string",
    "participants": "platform string, post string, account string, role string",
    "observations": "platform string, source_kind string, event_key string, event_type string, post string, observed_at string, seq bigint, collection_data string",
    "media": f"platform string, post string, source_key string, {_OBSERVED}, position bigint, media_type string, remote_url string, preview_url string, width bigint, height bigint, duration_ms bigint, variants_json string, alt_text string",
    "relations": "platform string, post string, target string, kind string, observed_at string",
    "tags": "platform string, post string, category string, position bigint, name string, observed_at string",
    "raw": "sha256 string, payload string, native_id string",
    "assets": "sha256 string, seq bigint, storage string, mime string, size bigint, managed boolean",
    "occurrence_assets": "platform string, post string, source_key string, sha256 string",
    "decisions": "candidate_key string, seq bigint, revision bigint, state string",
    "import_runs": "source_kind string, source_digest string, status string, started_at string",
}
KEYS = {
    "accounts": ["platform", "native_id"],
    "posts": ["platform", "native_id"],
    "media": ["platform", "post", "source_key"],
    "observations": ["source_kind", "event_key", "event_type"],
}
ORDER = ["observed_at", "seq"]
#: How each current column follows from its log.
RULES = {
    "accounts": dict.fromkeys(["handle", "display_name", "bio", "location", "website_url", "profile_url", "followers", "verified"], "newest_known"),
    "posts": {"canonical_url": "newest_known", "text": "newest_known", "language": "newest_known", "created_at": "first_known", "availability": "newest_known"},
    "media": dict.fromkeys(["position", "media_type", "remote_url", "preview_url", "width", "height", "duration_ms", "variants_json", "alt_text"], "newest_known"),
}

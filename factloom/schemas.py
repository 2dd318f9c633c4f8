"""The schema of raw artifacts, as DDL: what streams and stores read without looking at their files."""

RAW_ARTIFACT = (
    "raw_artifact_id string, url string, canonical_url string, content string, content_type string, fetched_at timestamp, detected_engine string, "
    "render_mode string, http_status int, content_hash string, proxy_region string, robots_allowed boolean"
)

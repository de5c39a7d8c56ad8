"""Tables (as DDL strings) and options of a crawl. Column names, states and defaults are fixed values."""

from __future__ import annotations

import dataclasses
import tomllib
from pathlib import Path

CRAWL_JOBS = "id long, seed_url string, status string, max_pages int, max_depth int, created_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz"
FRONTIER = (
    "id long, job_id long, url string, normalized_url string, depth int, status string, discovered_from string, retry_count int, next_fetch_at double, created_at timestamp_ntz, updated_at timestamp_ntz"
)
TIMING = "struct<dns:double,connect:double,tls:double,request:double,first_byte:double,download:double,total:double>"
PAGES = (
    "id long, job_id long, url string, final_url string, normalized_url string, status_code int, content_type string, title string, description string, headings array<string>, links array<string>,"
    f" body_sha256 string, body_text string, text_encoding string, timing {TIMING}, transport string, depth int, slot double, fetched_at timestamp_ntz"
)
FAILURES = "id long, job_id long, url string, normalized_url string, category string, message string, status_code int, retry_count int, created_at timestamp_ntz"
#: What a fetch gives for one URL: errors are values.
FETCH = f"url string, final_url string, status_code int, headers map<string,string>, body binary, redirects array<struct<url:string,status_code:int,location:string>>, error_category string, error_message string, timing {TIMING}, transport string"
FETCH_COLUMNS = ["url", "final_url", "status_code", "headers", "body", "redirects", "error_category", "error_message", "timing", "transport"]

#: Stored beside the tables; an older store is brought up to it, a newer one refused.
SCHEMA_VERSION = 3
TABLES = {"crawl_jobs": CRAWL_JOBS, "frontier": FRONTIER, "pages": PAGES, "failures": FAILURES}
FRONTIER_STATES = ["pending", "in_progress", "fetched", "skipped", "failed", "retry_scheduled"]
JOB_STATES = ["running", "finished", "budget_reached", "interrupted", "errored"]
SKIP_CATEGORIES = ["max_depth_exceeded", "off_domain", "robots_disallowed", "unsupported_content_type"]


@dataclasses.dataclass(frozen=True)
class CrawlOptions:
    max_pages: int = 100
    max_depth: int = 2
    max_response_bytes: int = 2 * 1024 * 1024
    connect_timeout: float = 5.0
    read_timeout: float = 10.0
    total_timeout: float = 30.0
    redirect_limit: int = 5
    retry_count: int = 2
    min_delay_seconds: float = 1.0
    obey_robots: bool = True
    stay_on_seed_domain: bool = True
    block_private_addresses: bool = False
    allowed_domains: tuple[str, ...] = ()
    allowed_content_types: tuple[str, ...] = ("text/html", "application/xhtml+xml")
    user_agent: str = "webloom/1.0"


def load_options(path: str | None = None, **given) -> CrawlOptions:
    """Defaults, then the TOML file (its ``crawl`` table or top level), then what is given."""
    known = {f.name for f in dataclasses.fields(CrawlOptions)}
    from_file = tomllib.loads(Path(path).read_text()) if path else {}
    flat = from_file | {k: v for t in from_file.values() if isinstance(t, dict) for k, v in t.items()}
    values = {k: v for k, v in flat.items() if k in known} | {k: v for k, v in given.items() if v is not None}
    for key in ("allowed_domains", "allowed_content_types"):
        if isinstance(values.get(key), str):
            values[key] = (values[key],)
        elif key in values:
            values[key] = tuple(values[key])
    return CrawlOptions(**values)

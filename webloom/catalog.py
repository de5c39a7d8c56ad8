"""All queries of the crawl engine by name, with their DuckDB SQL.

A query reads only the tables and columns it needs. What the corpus does not hold (robots texts,
status codes, redirects, stored digests) is derived from it by the same rule on both sides.
"""

from __future__ import annotations

import dataclasses
import gzip
import json
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import html as H
from .functions import robots as R
from .functions import url as U
from .functions import wire as W
from .operators import pacing, policy, store
from .operators.as_of import as_of
from .operators.chains import chase
from .operators.deltas import DeltaTable
from .operators.key_filter import key_filter
from .plans.crawl import crawl, folder, saver
from .schema import CrawlOptions
from .sources.fetch import fetch_from_table
from .streaming.due_queue import whole_schedule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ------------------------------------------------------------------ shared SQL

_P = r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?(?:#(.*))?$'"
_KEEP = "list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT list_contains(['fbclid','gclid','gbraid','wbraid','msclkid','dclid','yclid','igshid','mc_cid','mc_eid'], lower(split_part(x, '=', 1))))"
PARTS = f"""u AS (
  SELECT page_id, url, lower(regexp_extract(url, {_P}, 1)) AS scheme, lower(regexp_extract(url, {_P}, 2)) AS host,
         coalesce(nullif(regexp_extract(url, {_P}, 3), ''), '/') AS path, regexp_extract(url, {_P}, 4) AS q
  FROM pages),
n AS (
  SELECT *, array_to_string(list_sort({_KEEP}), '&') AS cq,
         CASE WHEN host LIKE 'www.%' AND contains(host[5:], '.') THEN host[5:] ELSE host END AS site,
         scheme || '://' || host || path || CASE WHEN len({_KEEP}) > 0 THEN '?' || array_to_string(list_sort({_KEEP}), '&') ELSE '' END AS norm
  FROM u)"""
_TEXT = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({0}, '&amp;?', '&', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&#39;', ''''), '\\s+', ' ', 'g'))"
LINKS = """l AS (
  SELECT page_id, url, scheme, host, site, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS raw_pos
  FROM (SELECT n.*, regexp_extract_all(p.html, '<a href="([^"]*)"', 1) AS hrefs FROM n JOIN pages p USING (page_id))),
d AS (
  SELECT page_id, url, scheme, host, site, scheme || '://' || host || href AS link, min(raw_pos) AS first_pos
  FROM l WHERE href LIKE '/%' GROUP BY ALL),
links AS (SELECT page_id, url, site, host, link, row_number() OVER (PARTITION BY page_id ORDER BY first_pos) - 1 AS pos FROM d)"""


def _parsed(spark, sf_dir, *fields):
    return read(spark, sf_dir, "pages").select("page_id", "url", H.parse_html("html", "url", fields=fields or H.FIELDS).alias("p"))


def _links(spark, sf_dir):
    return _parsed(spark, sf_dir, "links").select("page_id", "url", F.posexplode("p.links").alias("pos", "link"))


# ------------------------------------------------------------------ URL


@query(f"WITH {PARTS} SELECT page_id, norm AS normalized_url FROM n")
def url_normalize(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", U.normalize_url("url").alias("normalized_url"))


@query(f"WITH {PARTS} SELECT host AS domain, count(*) AS n_pages FROM n GROUP BY host")
def url_domain(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(U.domain("url").alias("domain")).agg(F.count("*").alias("n_pages"))


@query(f"WITH {PARTS} SELECT page_id, site FROM n")
def url_canonical_domain(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", U.canonical_domain(U.domain("url")).alias("site"))


@query(f"WITH {PARTS} SELECT page_id, scheme || '://' || host || ':' || CASE scheme WHEN 'http' THEN '80' ELSE '443' END AS origin, scheme || '://' || host AS robots_key FROM n")
def url_origin(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", U.origin("url").alias("origin"), U.robots_key("url").alias("robots_key"))


@query(f"WITH {PARTS} SELECT page_id, cq AS clean_query FROM n WHERE q <> ''")
def query_params_clean(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", U.part("url", 4).alias("q")).where("q <> ''").select("page_id", U.clean_query("q").alias("clean_query"))


@query("SELECT split_part(x, '=', 1) AS param, starts_with(x, 'utm_') AS tracking, count(*) AS n FROM (SELECT unnest(string_split(split_part(split_part(url, '#', 1), '?', 2), '&')) AS x FROM pages) WHERE x <> '' GROUP BY ALL")
def tracking_param_share(spark, sf_dir):
    items = read(spark, sf_dir, "pages").select(F.explode(U.query_items(U.part("url", 4))).alias("i"))
    return items.groupBy(F.col("i.k").alias("param"), U.is_tracking(F.col("i.k")).alias("tracking")).agg(F.count("*").alias("n"))


@query(f"WITH {PARTS} SELECT norm AS normalized_url, arg_min(url, page_id) AS url, min(page_id) AS page_id FROM n GROUP BY norm")
def url_dedupe_first_wins(spark, sf_dir):
    found = read(spark, sf_dir, "pages").select("page_id", "url", U.normalize_url("url").alias("normalized_url"))
    return store.first_wins(found, ["page_id"], key=["normalized_url"]).select("normalized_url", "url", "page_id")


@query(f"WITH {PARTS} SELECT page_id, site = 'cheap-pills.example.com' OR site = 'm.ththth.example.net' AS in_scope FROM n")
def scope_filter(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", U.in_scope("url", ["www.cheap-pills.example.com", "m.ththth.example.net"]).alias("in_scope"))


@query(f"WITH {PARTS}, a AS (SELECT DISTINCT site FROM n WHERE scheme = 'http') SELECT page_id, url FROM n WHERE site IN (SELECT site FROM a)")
def allowed_domain_semi_join(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url", U.canonical_domain(U.domain("url")).alias("site"))
    allowed = pages.where(U.part("url", 1) == "http").select("site").distinct()
    return pages.join(allowed, "site", "left_semi").select("page_id", "url")


@query(f"WITH {PARTS} SELECT page_id, path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS target, host AS host_header FROM n")
def request_target(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", U.origin_form("url").alias("target"), U.host_header("url").alias("host_header"))


# ------------------------------------------------------------------ HTML


@query(f"SELECT page_id, {_TEXT.format('''regexp_extract(html, '<title>([^<]*)', 1)''')} AS title FROM pages")
def html_title(spark, sf_dir):
    return _parsed(spark, sf_dir, "title").select("page_id", "p.title")


@query(f"SELECT page_id, {_TEXT.format('''regexp_extract(html, '<h1>([^<]*)</h1>', 1)''')} AS headings FROM pages")
def html_headings(spark, sf_dir):
    return _parsed(spark, sf_dir, "headings").select("page_id", F.array_join("p.headings", "|").alias("headings"))


@query(f"WITH {PARTS}, {LINKS} SELECT page_id, pos, link FROM links")
def html_links_explode(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), "link")


@query(f"""WITH {PARTS}, {LINKS}, a AS (SELECT page_id, string_agg(link, ' ' ORDER BY pos) AS links FROM links GROUP BY page_id)
SELECT page_id, {_TEXT.format("regexp_extract(html, '<title>([^<]*)', 1)")} AS title, CAST(NULL AS VARCHAR) AS description,
       {_TEXT.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS headings, coalesce(links, '') AS links, 'utf-8' AS text_encoding, CAST(NULL AS VARCHAR) AS error
FROM pages LEFT JOIN a USING (page_id)""")
def html_full_parse(spark, sf_dir):
    p = _parsed(spark, sf_dir).select("page_id", "p.*")
    return p.withColumn("headings", F.array_join("headings", "|")).withColumn("links", F.array_join("links", " "))


@query(f"WITH {PARTS}, l AS (SELECT page_id, scheme || '://' || host AS o, unnest(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1)) AS href FROM (SELECT n.*, p.html FROM n JOIN pages p USING (page_id))) SELECT DISTINCT page_id, href, o || href AS resolved FROM l")
def link_resolve(spark, sf_dir):
    hrefs = read(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1))).alias("href"))
    return hrefs.select("page_id", "href", U.resolve("url", "href").alias("resolved")).distinct()


@query("SELECT page_id, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def html_escaped_urls(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", H.html_escape("url").alias("escaped"))


# ------------------------------------------------------------------ frontier


@query(f"""WITH {PARTS}, {LINKS},
x AS (SELECT DISTINCT host, link FROM links WHERE link NOT IN (SELECT norm FROM n))
SELECT host AS domain, count(*) AS new_urls FROM x GROUP BY host""")
def frontier_wave(spark, sf_dir):
    """One wave: links of all pages, first discovery wins, without those already in the frontier."""
    pages = read(spark, sf_dir, "pages")
    frontier = pages.select(F.lit(1).alias("job_id"), U.normalize_url("url").alias("normalized_url"))
    found = _links(spark, sf_dir).select(F.lit(1).alias("job_id"), F.col("link").alias("url"), "page_id", "pos")
    new = store.enqueue(frontier, found, ["page_id", "pos"])
    return new.groupBy(U.domain("url").alias("domain")).agg(F.count("*").alias("new_urls"))


@query(f"""WITH {PARTS}, {LINKS}, f AS (SELECT norm AS k FROM n UNION SELECT link FROM links WHERE pos < 3),
x AS (SELECT link, min((page_id, pos)) AS first FROM links WHERE link NOT IN (SELECT k FROM f) GROUP BY link)
SELECT link AS url, first[1] AS page_id, CAST(first[2] AS INTEGER) AS pos FROM x""")
def frontier_by_filter(spark, sf_dir):
    """The links of all pages that are new to a frontier of the pages and their first three links; the
    frontier's filter is grown from the filter of the pages."""
    save = saver(spark)
    pages = read(spark, sf_dir, "pages").select(F.lit(1).alias("job_id"), U.normalize_url("url").alias("normalized_url"))
    links = save(_links(spark, sf_dir).withColumn("job_id", F.lit(1)))
    early = links.where("pos < 3").select("job_id", U.normalize_url("link").alias("normalized_url"))
    frontier = save(pages.unionByName(early).where("normalized_url is not null").distinct())
    known = key_filter(pages, ["job_id", "normalized_url"], frontier.count()).add(early).saved(save)
    new = store.enqueue(frontier, links.select("job_id", F.col("link").alias("url"), "page_id", "pos"), ["page_id", "pos"], save, known)
    return new.select("url", "page_id", "pos")


_FRONTIER = """f AS (
  SELECT page_id AS id, CAST(1 AS BIGINT) AS job_id, url, CAST(page_id % 4 AS INTEGER) AS depth,
         CASE page_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'fetched' WHEN 3 THEN 'retry_scheduled' ELSE 'failed' END AS status,
         CAST(page_id % 7 AS DOUBLE) AS next_fetch_at
  FROM pages)"""


def _frontier(spark, sf_dir):
    states = F.element_at(F.array(*map(F.lit, ["pending", "in_progress", "fetched", "retry_scheduled", "failed"])), (F.col("page_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.lit(1).cast("long").alias("job_id"), "url", U.normalize_url("url").alias("normalized_url"), (F.col("page_id") % 4).cast("int").alias("depth"),
        states.alias("status"), F.lit(0).alias("retry_count"), (F.col("page_id") % 7).cast("double").alias("next_fetch_at"),
    )


@query(f"WITH {_FRONTIER} SELECT id, depth, url FROM f WHERE status IN ('pending', 'retry_scheduled') AND next_fetch_at <= 3 ORDER BY depth, id LIMIT 20")
def frontier_next_topk(spark, sf_dir):
    return store.next_items(_frontier(spark, sf_dir), 1, 3.0, 20).select("id", "depth", "url")


@query(f"WITH {_FRONTIER} SELECT CASE WHEN status = 'in_progress' THEN 'pending' ELSE status END AS status, count(*) AS n FROM f GROUP BY 1")
def frontier_recover(spark, sf_dir):
    return store.recover_in_progress(_frontier(spark, sf_dir), 1).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {_FRONTIER} SELECT greatest(0.0, min(next_fetch_at) - 0.25) AS seconds FROM f WHERE status IN ('pending', 'retry_scheduled')")
def seconds_until_next(spark, sf_dir):
    return store.seconds_until_next(_frontier(spark, sf_dir), 1, 0.25)


@query(f"WITH {_FRONTIER} SELECT id, CASE WHEN id % 10 = 3 THEN 'retry_scheduled' ELSE status END AS status, CAST(CASE WHEN id % 10 = 3 THEN 1 ELSE 0 END AS INTEGER) AS retry_count, CASE WHEN id % 10 = 3 THEN 100.0 + 2 ELSE next_fetch_at END AS next_fetch_at FROM f")
def frontier_schedule_retry(spark, sf_dir):
    f = _frontier(spark, sf_dir)
    return store.schedule_retry(f, f.where("id % 10 = 3").select("id", F.lit(2.0).alias("delay")), 100.0).select("id", "status", "retry_count", "next_fetch_at")


@query(f"WITH {_FRONTIER} SELECT id, CASE WHEN id % 5 = 1 THEN 'fetched' ELSE status END AS status FROM f")
def frontier_mark_outcomes(spark, sf_dir):
    f = _frontier(spark, sf_dir)
    return store.set_status(f, f.where("id % 5 = 1").select("id", F.lit("fetched").alias("status"))).select("id", "status")


@query(f"WITH {PARTS}, {LINKS}, t AS (SELECT DISTINCT norm FROM n) SELECT host AS domain, count(*) FILTER (link IN (SELECT norm FROM t)) AS internal, count(*) FILTER (link NOT IN (SELECT norm FROM t)) AS dangling FROM links GROUP BY host")
def link_graph_dangling(spark, sf_dir):
    edges = _links(spark, sf_dir).select(U.domain("url").alias("domain"), U.normalize_url("link").alias("target"))
    known = read(spark, sf_dir, "pages").select(U.normalize_url("url").alias("target")).distinct().withColumn("there", F.lit(True))
    return edges.join(known, "target", "left").groupBy("domain").agg(F.count_if("there").alias("internal"), F.count_if(F.col("there").isNull()).alias("dangling"))


@query(f"WITH {PARTS}, {LINKS} SELECT host AS domain, count(*) AS n_links, count(DISTINCT link) AS n_targets, count(DISTINCT page_id) AS n_pages FROM links GROUP BY host")
def host_outlink_stats(spark, sf_dir):
    return _links(spark, sf_dir).groupBy(U.domain("url").alias("domain")).agg(F.count("*").alias("n_links"), F.countDistinct("link").alias("n_targets"), F.countDistinct("page_id").alias("n_pages"))


@query(f"WITH {PARTS}, s AS (SELECT norm, min(page_id) AS first FROM n GROUP BY norm), c AS (SELECT max(first) AS last FROM (SELECT first FROM s ORDER BY first LIMIT 40)) SELECT page_id FROM n WHERE page_id <= (SELECT last FROM c)")
def page_budget_cut(spark, sf_dir):
    found = read(spark, sf_dir, "pages").select("page_id", U.normalize_url("url").alias("normalized_url"))
    return store.page_budget(found, 40, ["page_id"]).select("page_id")


@query(f"""WITH {PARTS} SELECT host AS domain, count(*) AS n_pages, count(nullif(regexp_extract(html, '<title>([^<]*)', 1), '')) AS n_titles
FROM n JOIN (SELECT page_id, html FROM pages) p USING (page_id) GROUP BY host""")
def host_page_counts(spark, sf_dir):
    return _parsed(spark, sf_dir, "title").where(U.normalize_url("url").isNotNull()).groupBy(U.domain("url").alias("domain")).agg(F.count("*").alias("n_pages"), F.count("p.title").alias("n_titles"))


# ------------------------------------------------------------------ robots

_ROBOTS = ["User-agent: *\nDisallow: /en/\nAllow: /en/8\nCrawl-delay: 2\nSitemap: /s.xml\n", "User-agent: webloom\nDisallow: /*.html$\n\nUser-agent: *\nDisallow: /\n", None]


def _robots(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    key = pages.select(U.robots_key("url").alias("origin"), (F.char_length(U.domain("url")) % 3).alias("k")).distinct()
    body = F.when(F.col("k") == 0, _ROBOTS[0]).when(F.col("k") == 1, _ROBOTS[1])
    status = F.when(F.col("k") == 2, 404).otherwise(200)
    return key.select("origin", R.fetched_rules(status, body).alias("body"))


_RULES = """r AS (SELECT * FROM (VALUES (0, 'disallow', '^/en/', 4), (0, 'allow', '^/en/8', 5), (1, 'disallow', '^/.*\\.html$', 7)) AS t(k, kind, re, spec)),
m AS (
  SELECT n.page_id, n.url, coalesce(max(spec) FILTER (kind = 'disallow' AND regexp_matches(path || CASE WHEN q <> '' THEN '?' || q ELSE '' END, re)), -1) AS disallow_len,
         coalesce(max(spec) FILTER (kind = 'allow' AND regexp_matches(path || CASE WHEN q <> '' THEN '?' || q ELSE '' END, re)), -1) AS allow_len
  FROM n LEFT JOIN r ON r.k = length(n.host) % 3 GROUP BY ALL)"""


def _verdicts(spark, sf_dir):
    rules, _ = R.rule_table(_robots(spark, sf_dir), "webloom/1.0 (+x)")
    return R.robots_verdicts(read(spark, sf_dir, "pages").select("page_id", "url"), rules)


@query(f"WITH {PARTS}, {_RULES} SELECT page_id, disallow_len < 0 OR allow_len >= disallow_len AS allowed FROM m")
def robots_allowed(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("page_id", "allowed")


@query(f"WITH {PARTS}, {_RULES} SELECT page_id, CAST(disallow_len AS INTEGER) AS disallow_len, CAST(allow_len AS INTEGER) AS allow_len FROM m")
def robots_best_match(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("page_id", "disallow_len", "allow_len")


@query(f"WITH {PARTS} SELECT DISTINCT scheme || '://' || host AS origin, CASE length(host) % 3 WHEN 0 THEN 'disallow /en/,allow /en/8' WHEN 1 THEN 'disallow /*.html$' ELSE '' END AS rules FROM n")
def robots_group_select(spark, sf_dir):
    r = _robots(spark, sf_dir).withColumn("i", R.parse_robots("body"))
    rules = R.rules_of(F.col("i"), R.chosen_group(F.col("i"), R.product_token(F.lit("webloom/1.0"))))
    return r.select("origin", F.array_join(F.transform(rules, lambda x: F.concat_ws(" ", x["kind"], x["pattern"])), ",").alias("rules"))


@query(f"WITH {PARTS} SELECT DISTINCT scheme || '://' || host AS origin, CASE length(host) % 3 WHEN 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS delay FROM n")
def crawl_delay_effective(spark, sf_dir):
    _, delays = R.rule_table(_robots(spark, sf_dir), "webloom")
    return delays.select("origin", policy.effective_delay(1.0, "crawl_delay").alias("delay"))


# ------------------------------------------------------------------ policy and pacing, on events as a fetch log

_LOG = """e AS (
  SELECT event_id, 'd' || (user_id % 20) AS domain, CAST(floor(epoch(ts) / 3600) AS DOUBLE) AS arrive,
         CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 429 WHEN 'click' THEN 404 WHEN 'view' THEN 302 ELSE 200 END AS status,
         CAST(event_id % 4 AS INTEGER) AS retry_count, 1.0 + (event_id % 3) * 0.5 AS delay
  FROM events),
c AS (SELECT *, CASE WHEN status = 429 THEN 'rate_limited' WHEN status >= 500 THEN 'server_error' WHEN status >= 400 THEN 'client_error' END AS category FROM e)"""


def _log(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "error", 503).when(kind == "signup", 429).when(kind == "click", 404).when(kind == "view", 302).otherwise(200)
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return read(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("d"), F.col("user_id") % 20).alias("domain"), F.floor(seconds / 3600).cast("double").alias("arrive"),
        status.alias("status"), (F.col("event_id") % 4).cast("int").alias("retry_count"), (1.0 + (F.col("event_id") % 3) * 0.5).alias("delay"),
    ).withColumn("category", policy.status_category("status"))


@query(f"WITH {_LOG} SELECT coalesce(category, 'none') AS category, count(*) AS n FROM c GROUP BY 1")
def status_classify(spark, sf_dir):
    return _log(spark, sf_dir).groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH {_LOG} SELECT event_id, retry_count < 2 AND (status IN (408, 425, 429, 500, 502, 503, 504) OR coalesce(category, '') IN ('server_error', 'rate_limited')) AS retry FROM c")
def retry_decision(spark, sf_dir):
    return _log(spark, sf_dir).select("event_id", policy.should_retry("status", "category", "retry_count").alias("retry"))


@query(f"WITH {_LOG}, a AS (SELECT event_id, domain, row_number() OVER (PARTITION BY domain ORDER BY event_id) AS attempt FROM c WHERE status = 503) SELECT event_id, CAST(attempt AS INTEGER) AS attempt, least(60.0, pow(2.0, attempt - 1)) AS backoff FROM a")
def backoff_schedule(spark, sf_dir):
    return pacing.retry_schedule(_log(spark, sf_dir).where("status = 503").select("event_id", "domain"), "domain", "event_id").select("event_id", "attempt", "backoff")


@query(f"WITH {_LOG} SELECT event_id, coalesce(category IN ('rate_limited', 'server_error'), false) AS pauses FROM c")
def domain_pause_rule(spark, sf_dir):
    return _log(spark, sf_dir).select("event_id", policy.pauses_domain(F.lit(None).cast("string"), "category").alias("pauses"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 100 AS DOUBLE) WHEN 1 THEN 60.0 WHEN 2 THEN 0.0 END AS seconds FROM events""")
def retry_after_parse(spark, sf_dir):
    k = F.col("event_id") % 4
    value = F.when(k == 0, (F.col("event_id") % 100).cast("string")).when(k == 1, "Mon, 01 Jan 2024 00:01:00 GMT").when(k == 2, "Sun, 31 Dec 2023 23:00:00 GMT").otherwise("soon")
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00 GMT"), "yyyy-MM-dd HH:mm:ss zzz")
    return read(spark, sf_dir, "events").select("event_id", policy.retry_after_seconds(value, now).alias("seconds"))


_SLOTS = """w AS (SELECT *, coalesce(sum(delay) OVER (PARTITION BY domain ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, {due} AS due FROM c),
s AS (SELECT event_id, arrive, before + max(due - before) OVER (PARTITION BY domain ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS start FROM w)
SELECT event_id, start, start - arrive AS waited FROM s"""


@query(f"WITH {_LOG}, " + _SLOTS.format(due="arrive"))
def pacing_slots(spark, sf_dir):
    return pacing.pacing_slots(_log(spark, sf_dir), order="event_id").select("event_id", "start", "waited")


@query(f"WITH {_LOG}, " + _SLOTS.format(due="greatest(arrive, coalesce(max(CASE WHEN status = 503 THEN arrive + 30 END) OVER (PARTITION BY domain ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), arrive))"))
def pacing_with_pause(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("pause", F.when(F.col("status") == 503, F.col("arrive") + 30))
    return pacing.pacing_slots(log, order="event_id", pause_until="pause").select("event_id", "start", "waited")


@query(f"WITH {_LOG.replace(chr(39) + 'd' + chr(39) + ' || (user_id % 20)', 'CASE WHEN event_id % 2 = 0 THEN ' + chr(39) + 'hot' + chr(39) + ' ELSE ' + chr(39) + 'd' + chr(39) + ' || (user_id % 20) END')}, " + _SLOTS.format(due="greatest(arrive, coalesce(max(CASE WHEN status = 503 THEN arrive + 30 END) OVER (PARTITION BY domain ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), arrive))"))
def pacing_hot_domain(spark, sf_dir):
    """One domain has half of all requests: its blocks are paced in tasks of their own."""
    log = _log(spark, sf_dir).withColumn("domain", F.when(F.col("event_id") % 2 == 0, "hot").otherwise(F.col("domain")))
    log = log.withColumn("pause", F.when(F.col("status") == 503, F.col("arrive") + 30))
    return pacing.pacing_slots(log, order="event_id", pause_until="pause", block_rows=1000).select("event_id", "start", "waited")


_VERSIONS = """v AS (SELECT scheme || '://' || host AS origin, epoch(t0) + (page_id * 7919) % 2592000 AS since, max(page_id % 3) AS body FROM n, (SELECT min(CAST(ts AS TIMESTAMP)) AS t0 FROM events) GROUP BY ALL),
q AS (SELECT event_id, o.origin, epoch(CAST(ts AS TIMESTAMP)) AS at, o.path FROM events JOIN (SELECT page_id, scheme || '://' || host AS origin, path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS path FROM n) o ON o.page_id = CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % (SELECT count(*) FROM n) END),
j AS (SELECT q.event_id, q.path, CASE WHEN q.at - v.since < 86400 THEN v.since END AS since, CASE WHEN q.at - v.since < 86400 THEN v.body END AS body FROM q ASOF LEFT JOIN v ON q.origin = v.origin AND q.at >= v.since)"""


@query(f"""WITH {PARTS}, {_VERSIONS} SELECT event_id, CAST(since AS DOUBLE) AS since, CASE body WHEN 0 THEN NOT (path LIKE '/en/%' AND path NOT LIKE '/en/8%') WHEN 1 THEN path NOT LIKE '%.html' WHEN 2 THEN true END AS allowed FROM j""")
def robots_as_of(spark, sf_dir):
    """Requests judged by the robots.txt that their origin had at the time, for a day after it was read;
    a third of all requests go to one page."""
    pages, events = read(spark, sf_dir, "pages"), read(spark, sf_dir, "events")
    ends = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t0"))
    bodies = F.array(F.lit(_ROBOTS[0]), F.lit(_ROBOTS[1].split("\n\n")[0]), F.lit(""))
    versions = pages.crossJoin(F.broadcast(ends)).select(U.robots_key("url").alias("origin"), (F.col("t0") + F.col("page_id") * 7919 % 2592000).alias("since"), (F.col("page_id") % 3).cast("int").alias("body"))
    n = F.broadcast(pages.agg(F.count("*").alias("n")))
    asked = events.crossJoin(n).select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("event_id") % F.col("n")).alias("page_id"))
    asked = asked.join(pages.select("page_id", "url"), "page_id").select("event_id", "url", "at", U.robots_key("url").alias("origin"))
    got = as_of(asked, versions, "origin", "at", "since", 86400.0)
    # the rules of the few texts are parsed once and matched by the text's number
    texts = spark.range(3).select(F.col("id").cast("string").alias("origin"), F.get(bodies, F.col("id").cast("int")).alias("body"))
    rules, _ = R.rule_table(texts, "webloom/1.0")
    judged = R.verdicts_by(got.withColumn("text_", F.col("held.body").cast("string")), rules, "text_")
    return judged.select("event_id", F.col("held.since").alias("since"), F.when(F.col("held").isNotNull(), F.col("allowed")).alias("allowed"))


_ITEMS = """i AS (SELECT 'd' || (user_id % 20) AS domain, event_id AS id, CAST(floor(epoch(CAST(ts AS TIMESTAMP)) / 600) AS DOUBLE) * 60 AS due,
  CASE event_type WHEN 'error' THEN 1 + event_id % 3 WHEN 'signup' THEN 1 ELSE 0 END AS fails, CASE event_type WHEN 'signup' THEN 45.0 ELSE 0.0 END AS pause FROM events)"""


@query(f"""WITH RECURSIVE {_ITEMS},
q AS (
  SELECT domain, list_sort(list(struct_pack(due := due, id := id, n := 0, fails := fails, pause := pause))) AS queue, -1e300 AS free, CAST(NULL AS STRUCT(id BIGINT, attempt INTEGER, due DOUBLE, start DOUBLE, failed BOOLEAN)) AS went FROM i GROUP BY domain
  UNION ALL
  SELECT domain, CASE WHEN failed AND h.n < 2 THEN list_sort(list_append(queue[2:], struct_pack(due := start + least(60.0, 5.0 * pow(2.0, h.n)), id := h.id, n := h.n + 1, fails := h.fails, pause := h.pause))) ELSE queue[2:] END,
    start + greatest(2.0, CASE WHEN failed THEN h.pause ELSE 0.0 END), struct_pack(id := h.id, attempt := h.n, due := h.due, start := start, failed := failed)
  FROM (SELECT *, queue[1] AS h, greatest(queue[1].due, free) AS start, queue[1].n < queue[1].fails AS failed FROM q WHERE len(queue) > 0))
SELECT domain, went.id AS id, CAST(went.attempt AS INTEGER) AS attempt, went.due AS due, went.start AS start, went.failed AS failed FROM q WHERE went IS NOT NULL""")
def retry_due_queue(spark, sf_dir):
    """Requests whose failures come back after their back-off and hold up their domain."""
    kind = F.col("event_type")
    fails = F.when(kind == "error", 1 + F.col("event_id") % 3).when(kind == "signup", 1).otherwise(0)
    due = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 / 600).cast("double") * 60
    items = read(spark, sf_dir, "events").select(
        F.concat(F.lit("d"), F.col("user_id") % 20).alias("domain"), F.col("event_id").alias("id"), F.timestamp_seconds(due).alias("ts"), due.alias("due"), fails.cast("int").alias("fails"), F.when(kind == "signup", 45.0).otherwise(0.0).alias("pause")
    )
    return whole_schedule(items, folder(spark), delay=2.0, base=5.0)


# ------------------------------------------------------------------ store and report

_STORED = """v AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 11 = 5 THEN NULL ELSE text END AS body_text,
         CASE doc_id % 7 WHEN 3 THEN '' WHEN 4 THEN sha256(text || 'x') ELSE sha256(text) END AS body_sha256
  FROM documents),
o AS (SELECT id, CASE WHEN body_sha256 = '' THEN 'missing body_sha256' WHEN body_text IS NULL THEN 'missing body_text' WHEN sha256(body_text) = body_sha256 THEN 'valid' ELSE 'mismatch' END AS outcome FROM v)"""


def _stored(spark, sf_dir):
    k = F.col("doc_id") % 7
    digest = F.when(k == 3, "").when(k == 4, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("job_id"), F.col("source").alias("final_url"), F.when(F.col("doc_id") % 11 != 5, F.col("text")).alias("body_text"), digest.alias("body_sha256"))


@query("SELECT doc_id, sha256(text) AS body_sha256 FROM documents")
def body_sha256(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", store.body_sha256("text").alias("body_sha256"))


@query(f"WITH {_STORED} SELECT id, outcome FROM o")
def verify_integrity(spark, sf_dir):
    return store.verify(_stored(spark, sf_dir), 1).select("id", "outcome")


@query(f"WITH {_STORED} SELECT count(*) FILTER (outcome = 'valid') AS valid, count(*) FILTER (outcome = 'mismatch') AS mismatch, count(*) FILTER (starts_with(outcome, 'missing')) AS missing FROM o")
def verify_counts(spark, sf_dir):
    return store.verify_counts(_stored(spark, sf_dir), 1)


@query(f"WITH {_FRONTIER} SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM f WHERE status = 'failed') AS failures, string_agg(status || '=' || n, ',' ORDER BY status) AS frontier FROM (SELECT status, count(*) AS n FROM f GROUP BY status)")
def job_stats(spark, sf_dir):
    f = _frontier(spark, sf_dir)
    s = store.stats(read(spark, sf_dir, "pages").withColumn("job_id", F.lit(1)), f.where("status = 'failed'"), f, 1)
    return s.select("pages", "failures", F.array_join(F.transform(F.array_sort(F.map_entries("frontier")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("frontier"))


@query(f"WITH {_FRONTIER}, c AS (SELECT count(*) FILTER (status = 'fetched') AS a, count(*) FILTER (status = 'failed') AS b, count(*) FILTER (status IN ('pending', 'retry_scheduled')) AS p, count(*) AS n FROM f) SELECT 'fetched=' || a || ' failed=' || b || ' skipped=0 pending=' || p || ' pages=' || n || ' failures=' || b AS line FROM c")
def run_summary(spark, sf_dir):
    f = _frontier(spark, sf_dir)
    return store.run_summary(f, read(spark, sf_dir, "pages"), f.where("status = 'failed'")).select(store.summary_line().alias("line"))


@query(f"WITH {_LOG} SELECT domain, category, count(*) AS n, CAST(max(retry_count) AS INTEGER) AS max_retry FROM c WHERE category IS NOT NULL GROUP BY ALL")
def failure_rollup(spark, sf_dir):
    return _log(spark, sf_dir).where("category is not null").groupBy("domain", "category").agg(F.count("*").alias("n"), F.max("retry_count").alias("max_retry"))


@query(f"WITH {PARTS} SELECT host AS normalized_url, min(page_id) AS id, arg_max(url, page_id) AS url, count(*) AS n FROM n GROUP BY host")
def page_upsert(spark, sf_dir):
    """Pages arrive in page_id order under one key per host: the first id stays, the last row wins."""
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit(1).alias("job_id"), "url", U.domain("url").alias("normalized_url"))
    old, new = rows.where("id % 2 = 0 and id < 100"), rows.where("not (id % 2 = 0 and id < 100)")
    n = rows.groupBy("normalized_url").agg(F.count("*").alias("n"))
    last_new = new.withColumn("seq", F.col("id"))
    # a key that only old rows have keeps its last old row
    first_old = old.groupBy("job_id", "normalized_url").agg(F.max_by("url", "id").alias("url"), F.min("id").alias("id")).select(*rows.columns)
    up = store.upsert_pages(first_old, last_new, "seq")
    return up.join(n, "normalized_url").select("normalized_url", "id", "url", "n")


@query("SELECT max(page_id) AS job_id FROM pages")
def latest_job(spark, sf_dir):
    return store.latest_job_id(read(spark, sf_dir, "pages").select(F.col("page_id").alias("id")))


@query(f"""WITH {_FRONTIER}
SELECT 'page' AS kind, page_id AS id, '{{"id":' || page_id || ',"job_id":1,"title":' || CASE WHEN page_id % 3 = 0 THEN 'null' ELSE '"t ' || page_id || '"' END || ',"url":"' || url || '"}}' AS json FROM pages
UNION ALL SELECT 'failure', id, '{{"category":"server_error","id":' || id || ',"job_id":1,"url":"' || url || '"}}' FROM f WHERE status = 'failed'""")
def export_pages_json(spark, sf_dir):
    """One JSON object per stored page and failure, nulls and all."""
    title = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("t "), F.col("page_id")))
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.lit(1).alias("job_id"), title.alias("title"))
    failed = _frontier(spark, sf_dir).where("status = 'failed'").select("id", "job_id", "url", F.lit("server_error").alias("category"))
    return store.export_rows(pages, failed, 1)


@query(f"""WITH {PARTS}, s AS (
  SELECT norm AS normalized_url, page_id AS id, 'first' AS title, 1 AS k FROM n WHERE page_id % 2 = 0 UNION ALL
  SELECT norm, page_id + 1000000000, 'second', 2 FROM n WHERE page_id % 3 = 0 UNION ALL
  SELECT norm, page_id + 2000000000, 'third', 3 FROM n WHERE page_id % 10 = 1)
SELECT normalized_url, min(id) AS id, arg_max(title, (k, id)) AS title FROM s GROUP BY normalized_url""")
def store_three_saves(spark, sf_dir):
    """Pages saved three times, each time some of them, with a compaction and an expiry between: the last
    row of a page under its first id."""
    pages = read(spark, sf_dir, "pages").select("page_id", U.normalize_url("url").alias("normalized_url"))
    t = DeltaTable(spark, folder(spark), "normalized_url string, id long, title string, at long", ["normalized_url"], oldest=("id",), order="at", buckets=16)
    for k, (rows, title) in enumerate(((pages.where("page_id % 2 = 0"), "first"), (pages.where("page_id % 3 = 0"), "second"), (pages.where("page_id % 10 = 1"), "third"))):
        t.save(rows.select("normalized_url", (F.col("page_id") + k * 1_000_000_000).alias("id"), F.lit(title).alias("title"), F.col("page_id").alias("at")))
        if k == 1:
            t.compact()
            t.expire(keep=1)
    return t.read().select("normalized_url", "id", "title")


_CT = "CASE event_id % 6 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN ' TEXT/HTML ' WHEN 2 THEN 'application/pdf' WHEN 3 THEN '' WHEN 4 THEN 'application/xhtml+xml;q=1' END"


@query("SELECT event_id, event_id % 6 IN (0, 1, 4) AS allowed FROM events")
def content_type_gate(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", W.content_type_allowed(F.expr(_CT)).alias("allowed"))


@query("SELECT page_id AS id, '<li><a href=\"' || replace(url, '&', '&amp;') || '\">' || CASE WHEN page_id % 3 = 0 THEN replace(url, '&', '&amp;') ELSE 'T&lt;' || page_id || '&gt;' END || '</a></li>' AS html FROM pages")
def viewer_rows(spark, sf_dir):
    title = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("T<"), F.col("page_id"), F.lit(">"))).otherwise("")
    return store.viewer_rows(read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("final_url"), title.alias("title")))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'accept=a' WHEN 1 THEN 'accept=a,cookie=c' ELSE 'authorization=x' END AS all_headers, CASE event_id % 3 WHEN 0 THEN 'accept=a' WHEN 1 THEN 'accept=a' ELSE '' END AS sent FROM events")
def header_rules(spark, sf_dir):
    k = F.col("event_id") % 3
    m = F.when(k == 0, F.create_map(F.lit("Accept"), F.lit("a"), F.lit("ACCEPT"), F.lit("b"))).when(k == 1, F.create_map(F.lit("Accept"), F.lit("a"), F.lit("Cookie"), F.lit("c"))).otherwise(F.create_map(F.lit("Authorization"), F.lit("x")))
    text = lambda h: F.array_join(F.array_sort(F.transform(F.map_entries(h), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    rows = read(spark, sf_dir, "events").select("event_id", W.lower_keys(m).alias("h"))
    return rows.select("event_id", text("h").alias("all_headers"), text(W.without_credentials("h")).alias("sent"))


_IP = "SELECT event_id, (event_id * 37) % 256 AS a, CASE WHEN event_id % 5 = 0 THEN (event_id // 5) % 40 ELSE (event_id * 11 + event_id // 256) % 256 END AS b, (event_id // 3) % 256 AS c, event_id % 9 AS d FROM events"


@query(f"""WITH i AS ({_IP}) SELECT event_id, event_id % 50 = 49 OR a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
OR (a = 198 AND b IN (18, 19)) OR (a = 192 AND b = 0 AND (c = 2 OR (c = 0 AND d < 8))) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) AS private FROM i""")
def private_addresses(spark, sf_dir):
    n = F.col("event_id")
    b = F.when(n % 5 == 0, F.floor(n / 5) % 40).otherwise((n * 11 + F.floor(n / 256)) % 256)
    ip = F.concat_ws(".", ((n * 37) % 256).cast("string"), b.cast("string"), (F.floor(n / 3) % 256).cast("string"), (n % 9).cast("string"))
    ip = F.when(n % 50 == 49, F.concat(ip, F.lit(".x"))).otherwise(ip)
    return read(spark, sf_dir, "events").select("event_id", policy.is_private_ipv4(ip).alias("private"))


_V6 = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 8193 WHEN 1 THEN 8194 WHEN 2 THEN 65152 + event_id % 128 WHEN 3 THEN 64512 + event_id % 1024 WHEN 4 THEN 0 WHEN 5 THEN 16383 ELSE (event_id * 977) % 65536 END AS a,
CASE WHEN event_id % 8 = 0 THEN CASE event_id % 5 WHEN 0 THEN 3512 WHEN 1 THEN (event_id // 8) % 600 WHEN 2 THEN 32 + event_id % 16 WHEN 3 THEN 3 ELSE event_id % 65536 END ELSE (event_id * 31) % 65536 END AS b, event_id % 3 AS h FROM events"""


@query(f"""WITH i AS ({_V6}) SELECT event_id, event_id % 40 = 39 OR a < 8192 OR a BETWEEN 16384 AND 65215 OR a >= 65280 OR a = 8194 OR (a = 8193 AND b = 3512)
OR (a = 8193 AND b < 512 AND NOT (b = 3 OR (b >= 32 AND b < 64))) AS blocked FROM i""")
def private_addresses_v6(spark, sf_dir):
    """Addresses of many blocks, some of them in short form, some broken."""
    n = F.col("event_id")
    first = F.when(n % 8 == 0, 8193).when(n % 8 == 1, 8194).when(n % 8 == 2, 65152 + n % 128).when(n % 8 == 3, 64512 + n % 1024).when(n % 8 == 4, 0).when(n % 8 == 5, 16383).otherwise((n * 977) % 65536)
    in_2001 = F.when(n % 5 == 0, 3512).when(n % 5 == 1, F.floor(n / 8) % 600).when(n % 5 == 2, 32 + n % 16).when(n % 5 == 3, 3).otherwise(n % 65536)
    second = F.when(n % 8 == 0, in_2001).otherwise((n * 31) % 65536)
    two = F.concat_ws(":", F.lower(F.hex(first.cast("long"))), F.hex(second.cast("long")))
    ip = F.concat(two, F.when(n % 3 == 0, "::").when(n % 3 == 1, ":0:0:0:0:0:5").otherwise("::7:8.8.4.4%eth0"))
    ip = F.when(n % 40 == 39, F.concat(two, F.lit("::1::2"))).otherwise(ip)
    return read(spark, sf_dir, "events").select("event_id", policy.is_blocked_address(ip).alias("blocked"))


# ------------------------------------------------------------------ wire: documents as the bodies of responses

def _crlf():
    return F.lit("\r\n")


def _bodies(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _chunk(text):
    return F.concat(F.lower(F.hex(F.octet_length(text))), F.lit(";n=1"), _crlf(), text, _crlf())


@query("""SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN coalesce(text, '') END AS body, CASE WHEN doc_id % 5 = 4 THEN 'malformed_response' END AS error FROM documents""")
def chunked_decode(spark, sf_dir):
    """Texts in two chunks; every fifth body lacks its last line."""
    at = F.greatest(F.floor(F.char_length("text") / 3).cast("int"), F.lit(0))
    first, rest = F.substring("text", F.lit(1), at), F.substring("text", at + 1, F.lit(2**31 - 1))
    chunks = [F.when(F.octet_length(x) > 0, _chunk(x)).otherwise("") for x in (first, rest)]
    last = F.when(F.col("doc_id") % 5 == 4, F.concat(F.lit("0"), _crlf())).otherwise(F.concat(F.lit("0"), _crlf(), F.lit("Trailer: x"), _crlf(), _crlf()))
    c = W.chunked(F.concat(*chunks, last).cast("binary"), 1 << 30)
    return _bodies(spark, sf_dir).select("doc_id", c.alias("c")).select("doc_id", F.col("c.body").cast("string").alias("body"), "c.error")


def _squeezed(kind: str):
    """Test data: a text as a server would send it."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: (gzip.compress if kind == "gzip" else zlib.compress)(t.encode()))

    return run


@query("""SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN coalesce(text, '') END AS body, CASE doc_id % 5 WHEN 3 THEN 'unsupported_content_encoding' WHEN 4 THEN 'malformed_response' END AS error FROM documents""")
def gzip_decode(spark, sf_dir):
    """Texts as gzip, as deflate, plain, in an encoding that is not read, and plain under a false label."""
    k, text = F.col("doc_id") % 5, F.col("text")
    encoding = F.when(k == 0, "gzip").when(k == 1, "deflate").when(k == 3, "br").when(k == 4, "gzip").otherwise("identity")
    data = F.when(k == 0, _squeezed("gzip")(text)).when(k == 1, _squeezed("deflate")(text)).otherwise(F.concat(F.lit("x"), text).cast("binary"))
    data = F.when(k == 2, text.cast("binary")).otherwise(data)
    got = _bodies(spark, sf_dir).select("doc_id", W.decompressed(data, encoding, 1 << 30).alias("d"))
    return got.select("doc_id", F.col("d.body").cast("string").alias("body"), "d.error")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN coalesce(text, '') END AS text, CASE doc_id % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16' WHEN 2 THEN 'utf-8' WHEN 3 THEN 'utf-8-sig' END AS encoding,
CASE WHEN doc_id % 5 = 4 THEN 'parse_error' END AS error FROM documents""")
def charset_decode(spark, sf_dir):
    """Texts by a charset of the header, by byte-order marks, by default, and by a charset nobody knows."""
    k, text = F.col("doc_id") % 5, F.col("text")
    body = F.when(k == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))).when(k == 3, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).otherwise(F.encode(text, "UTF-8"))
    kind = F.when(k == 0, "text/html; charset=utf-8").when(k == 4, 'text/html; charset="nobody-knows"').otherwise("text/html")
    return _bodies(spark, sf_dir).select("doc_id", W.decoded(body, kind).alias("d")).select("doc_id", "d.text", "d.encoding", "d.error")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN CAST(CASE doc_id % 4 WHEN 1 THEN 204 ELSE 200 END AS INTEGER) END AS status_code, CASE doc_id % 4 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN '' END AS body,
CASE WHEN doc_id % 4 >= 2 THEN 'malformed_response' END AS error FROM documents""")
def response_parse(spark, sf_dir):
    """Whole responses: with a length, without a body, cut short by a byte, with a broken status line."""
    k = F.col("doc_id") % 4
    length = F.octet_length("text") + F.when(k == 2, 1).otherwise(0)
    head = F.concat(F.when(k == 1, "HTTP/1.1 204 No Content").when(k == 3, "HTTP/x nope").otherwise("HTTP/1.1 200 OK"), _crlf(), F.lit("Content-Length: "), length.cast("string"), _crlf(), _crlf())
    raw = F.concat(head.cast("binary"), F.col("text").cast("binary"))
    got = _bodies(spark, sf_dir).select("doc_id", W.response(raw, 1 << 30).alias("r"))
    return got.select("doc_id", "r.status_code", F.col("r.body").cast("string").alias("body"), "r.error")


# ------------------------------------------------------------------ redirects and crawls

def _redirects(spark, sf_dir):
    """Pages as redirects: chains longer than the limit, pairs that lead to each other, a foreign scheme, ends."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("p"), U.domain("url").alias("host"))
    at = lambda n: F.concat(F.lit("http://web.test/"), n.cast("string"))
    k = F.col("p") % 12
    goes = F.when((k < 7) | (k == 8), at(F.col("p") + 1)).when(k == 9, at(F.col("p") - 1)).when(k == 10, F.concat(F.lit("ftp://"), "host", F.lit("/")))
    return pages.select(at(F.col("p")).alias("src"), goes.alias("dst"))


_WEB = """p AS (SELECT page_id AS p, page_id % 12 AS k, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host FROM pages),
r AS (SELECT 'http://web.test/' || p AS src, CASE WHEN k < 7 OR k = 8 THEN 'http://web.test/' || (p + 1) WHEN k = 9 THEN 'http://web.test/' || (p - 1) ELSE 'ftp://' || host || '/' END AS dst FROM p WHERE k NOT IN (7, 11))"""


@query(
    f"WITH RECURSIVE {_WEB}, "
    "w AS (SELECT src AS url, src AS cur, 0 AS hops, [src] AS seen, CAST(NULL AS VARCHAR) AS error FROM r UNION ALL "
    "SELECT url, CASE WHEN e IS NULL THEN dst ELSE cur END, hops + 1, list_append(seen, dst), e FROM ("
    "SELECT w.*, r.dst, CASE WHEN r.dst NOT LIKE 'http%' THEN 'unsupported_redirect' WHEN list_contains(w.seen, r.dst) THEN 'redirect_loop' WHEN w.hops = 5 THEN 'too_many_redirects' END AS e "
    "FROM w JOIN r ON r.src = w.cur WHERE w.error IS NULL)) "
    "SELECT url, arg_max(cur, hops) AS final_url, CAST(max(hops) AS INTEGER) AS hops, arg_max(coalesce(error, ''), hops) AS error FROM w GROUP BY url"
)
def redirect_chain(spark, sf_dir):
    """Every page as a redirect or its end, fetched with at most five hops."""
    web = _redirects(spark, sf_dir)
    headers = F.when(F.col("dst").isNotNull(), F.create_map(F.lit("Location"), F.col("dst"))).otherwise(F.create_map().cast("map<string,string>"))
    site = web.select(F.col("src").alias("url"), F.when(F.col("dst").isNotNull(), 302).otherwise(200).alias("status_code"), headers.alias("headers"), F.lit("x").cast("binary").alias("body"))
    site = site.unionByName(web.agg(F.max(F.substring_index("src", "/", -1).cast("long")).alias("m")).select(F.concat(F.lit("http://web.test/"), (F.col("m") + 1).cast("string")).alias("url"), F.lit(200).alias("status_code"), F.create_map().cast("map<string,string>").alias("headers"), F.lit("x").cast("binary").alias("body")))
    got = fetch_from_table(web.where("dst is not null").select(F.col("src").alias("url")), site)
    return got.select("url", "final_url", F.size("redirects").alias("hops"), F.coalesce("error_category", F.lit("")).alias("error"))


_LONG = """r AS (SELECT 'http://web.test/' || page_id AS src, 'http://web.test/' || CASE WHEN page_id % 300 = 99 THEN page_id - 60 ELSE page_id + 1 END AS dst FROM pages WHERE page_id % 300 <> 250)"""


@query(
    f"WITH RECURSIVE {_LONG}, w AS (SELECT src AS url, dst AS cur, 1 AS hops FROM r UNION ALL SELECT w.url, r.dst, w.hops + 1 FROM w JOIN r ON r.src = w.cur WHERE w.hops < 300), "
    "e AS (SELECT url, cur, hops, NOT EXISTS (SELECT 1 FROM r WHERE r.src = w.cur) AS ended FROM w) "
    "SELECT url, coalesce(arg_max(cur, hops) FILTER (ended), min(cur) FILTER (hops > 200)) AS final_url, CAST(max(hops) FILTER (ended) AS BIGINT) AS hops, "
    "CASE WHEN NOT bool_or(ended) THEN 'redirect_loop' WHEN max(hops) FILTER (ended) > 20 THEN 'too_many_redirects' END AS error FROM e GROUP BY url"
)
def redirect_closure(spark, sf_dir):
    """Chains of up to 150 pages, and cycles of 61 with what leads into them, by pointer doubling."""
    p = F.col("page_id")
    at = lambda n: F.concat(F.lit("http://web.test/"), n.cast("string"))
    edges = read(spark, sf_dir, "pages").where(p % 300 != 250).select(at(p).alias("src"), at(F.when(p % 300 == 99, p - 60).otherwise(p + 1)).alias("dst"))
    return chase(edges, saver(spark), limit=20)


@query(
    "WITH RECURSIVE t AS (SELECT CAST(0 AS BIGINT) AS p, CAST(0 AS INTEGER) AS depth UNION ALL SELECT c.page_id, t.depth + 1 FROM t JOIN pages c ON c.page_id > 0 AND (c.page_id - 1) // 16 = t.p WHERE t.p % 10 <> 7) "
    f"SELECT 'http://web.test/' || p AS normalized_url, depth, nullif({_TEXT.format("regexp_extract(html, '<title>([^<]*)', 1)")}, '') AS title FROM t JOIN pages ON page_id = p WHERE p % 10 <> 7"
)
def crawl_fixture_bfs(spark, sf_dir):
    """A crawl from one seed over a tree of all pages: page p links to 16 p + 1 and the 15 after it; every
    tenth page is closed to robots."""
    pages = read(spark, sf_dir, "pages")
    kids = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.concat(F.lit('<a href="/'), (F.col("page_id") * 16 + i).cast("string"), F.lit('">x</a>'))), "")
    body = F.concat(F.lit("<title>"), F.regexp_extract("html", "<title>([^<]*)", 1), F.lit("</title>"), kids).cast("binary")
    web = pages.select(F.concat(F.lit("http://web.test/"), F.col("page_id").cast("string")).alias("url"), F.lit(200).alias("status_code"), F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"), body.alias("body"))
    robots = pages.agg(F.count("*")).select(F.lit("http://web.test/robots.txt").alias("url"), F.lit(200).alias("status_code"), F.create_map().cast("map<string,string>").alias("headers"), F.lit("User-agent: *\nDisallow: /*7$\n").cast("binary").alias("body"))
    out = crawl(spark, web.unionByName(robots), "http://web.test/0", CrawlOptions(max_pages=2**62, max_depth=60, retry_count=0))
    return out.pages.select("normalized_url", "depth", "title")


@query(f"""WITH {PARTS}, {LINKS}, s AS (SELECT count(DISTINCT norm) AS n FROM n)
SELECT 'budget_reached' AS job, CAST(0 AS INTEGER) AS depth, 'fetched' AS status, least(n, 40) AS n FROM s UNION ALL SELECT 'budget_reached', 0, 'pending', n - 40 FROM s WHERE n > 40
UNION ALL SELECT 'finished', 0, 'fetched', n FROM s UNION ALL SELECT 'finished', 1, 'failed', count(DISTINCT link) FROM links WHERE link NOT IN (SELECT norm FROM n) AND page_id IN (SELECT page_id FROM (SELECT page_id, row_number() OVER (ORDER BY f) AS k FROM (SELECT norm, min(page_id) AS page_id, min(page_id) AS f FROM n GROUP BY norm)) WHERE k > 0) HAVING count(*) > 0""")
def crawl_resume(spark, sf_dir):
    """A crawl of the corpus that ends at a budget of 40 pages, and goes on from its stored frontier."""
    web, seed, more = _corpus(spark, sf_dir)
    o = CrawlOptions(max_pages=40, max_depth=1, retry_count=0, obey_robots=False, stay_on_seed_domain=False)
    part = crawl(spark, web, seed, o, more_seeds=more)
    whole = crawl(spark, web, seed, dataclasses.replace(o, max_pages=2**62), resume=part)
    n = lambda out: out.frontier.groupBy("depth", "status").agg(F.count("*").alias("n")).withColumn("job", F.lit(out.status))
    return n(part).where("depth = 0").unionByName(n(whole)).select("job", "depth", "status", "n")


def _corpus(spark, sf_dir):
    """The pages as a web of responses, the first of them as the seed, and all of them as further ones."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "#.*$", "").alias("url"), "html")
    web = pages.groupBy("url").agg(F.min_by("html", "page_id").cast("binary").alias("body"))
    web = web.select("url", F.lit(200).alias("status_code"), F.create_map(F.lit("content-type"), F.lit("text/html; charset=utf-8")).alias("headers"), "body")
    return web, pages.orderBy("page_id").first().url, pages.select("url", F.col("page_id").alias("order"))


@query(f"""WITH {PARTS}, {LINKS} SELECT CAST(0 AS INTEGER) AS depth, 'fetched' AS status, count(DISTINCT norm) AS n FROM n
UNION ALL SELECT 1, 'failed', count(DISTINCT link) FROM links WHERE link NOT IN (SELECT norm FROM n) AND page_id IN (SELECT min(page_id) FROM n GROUP BY norm) HAVING count(*) > 0""")
def crawl_pages_corpus(spark, sf_dir):
    """A crawl over the corpus as the web, with every page as a seed; links that lead outside fail."""
    web, seed, more = _corpus(spark, sf_dir)
    o = CrawlOptions(max_pages=2**62, max_depth=1, retry_count=0, obey_robots=False, stay_on_seed_domain=False)
    out = crawl(spark, web, seed, o, more_seeds=more)
    return out.frontier.groupBy("depth", "status").agg(F.count("*").alias("n"))


def _json_page(body: bytes, url: str, content_type: str) -> dict:
    """A parser of pages that are JSON objects."""
    page = json.loads(body)
    return {"title": page["name"], "headings": [f"{page['size']} characters"], "links": [f"{url}#top", *page["next"]], "text_encoding": "utf-8"}


@query(f"""WITH {PARTS}, c AS (SELECT norm, arg_min(html, n.page_id) AS html, min(n.page_id) AS p FROM n JOIN pages USING (page_id) GROUP BY norm)
SELECT norm AS normalized_url, regexp_extract(html, '<title>([^<]*)', 1) AS title, length(html) || ' characters' AS heading, CAST(3 AS INTEGER) AS n_links FROM c""")
def crawl_with_parser(spark, sf_dir):
    """A crawl over the corpus, served as JSON, with a parser of the caller's."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "#.*$", "").alias("url"), "html")
    id_ = F.col("page_id").cast("string")
    page = F.to_json(F.struct(F.regexp_extract("html", "<title>([^<]*)", 1).alias("name"), F.char_length("html").alias("size"), F.array(F.concat(F.lit("/next?p="), id_), F.concat(F.lit("http://web.test/"), id_), F.lit("mailto:a@b.test")).alias("next")))
    web = pages.groupBy("url").agg(F.min_by(page, "page_id").cast("binary").alias("body"))
    web = web.select("url", F.lit(200).alias("status_code"), F.create_map(F.lit("content-type"), F.lit("application/json")).alias("headers"), "body")
    o = CrawlOptions(max_pages=2**62, max_depth=0, retry_count=0, obey_robots=False, stay_on_seed_domain=False, allowed_content_types=("application/json",))
    seed = pages.orderBy("page_id").first().url
    out = crawl(spark, web, seed, o, more_seeds=pages.select("url", F.col("page_id").alias("order")), parse=_json_page)
    return out.pages.select("normalized_url", "title", F.col("headings")[0].alias("heading"), F.size("links").alias("n_links"))


# ------------------------------------------------------------------ extensions (labelled so: not in the reference)


@query("SELECT event_type, CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, count(*) AS n FROM events GROUP BY ALL")
def ext_events_per_hour(spark, sf_dir):
    """Tumbling-window counts over the event table."""
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return read(spark, sf_dir, "events").groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n")).select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n")



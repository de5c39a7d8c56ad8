"""A crawl as level-synchronous breadth-first expansion.

Items of depth d are all handled before those of depth d + 1, and within a level the order is
(parent's rank, link position), so a level is one DataFrame plan: gates (depth, scope, robots),
fetch (a join with a table of responses, or live requests), classes (CASE), parse (Arrow), explode,
normalize, first-wins, anti-join with the frontier, budget cut. The driver's loop has one turn per
level and sees counts only. Lineage is cut by writing each level in the shared checkpoint folder.

Pacing: an item's delay is the greater of the least delay and its origin's crawl delay. From a table,
``slot`` is the second after the level's start at which the request would go out; live, the task
that has a domain waits between its requests.

Retries are resolved at an item's own rank: a retryable failure is tried retry_count + 1 times
against the same table, so it ends as a failure with the full count; live, it is fetched again.

A crawl goes on from a stored frontier: pending items (those in progress are pending again) by depth.
"""

from __future__ import annotations

import dataclasses
import functools
import logging
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import html as H
from ..functions import robots as R
from ..functions import url as U
from ..functions import wire as W
from ..operators import pacing, policy, store
from ..schema import SKIP_CATEGORIES, TIMING, CrawlOptions
from ..sources.fetch import fetch_from_table, fetch_paced, fetch_with, limits_of, make_fetcher

log = logging.getLogger("webloom")

# What a robots.txt may have.
ROBOTS_BYTES, ROBOTS_REDIRECTS = 128 * 1024, 3
ITEM = ["job_id", "id", "url", "normalized_url", "depth", "discovered_from"]
PAGE_FIELDS = ["job_id", "url", "final_url", "normalized_url", "status_code", "content_type", "title", "description", "headings", "links", "body_sha256", "body_text", "text_encoding", "timing", "transport", "depth", "slot", "fetched_at"]
FAILURE_FIELDS = ["job_id", "item_id", "depth", "url", "normalized_url", "category", "message", "status_code", "retry_count", "created_at"]


@dataclasses.dataclass
class CrawlResult:
    frontier: DataFrame
    pages: DataFrame
    failures: DataFrame
    status: str
    #: The rows of this level alone, to be saved; None where all rows are new.
    changes: CrawlResult | None = None


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names; of our own only on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="webloom-")
    return f"{named.rstrip('/')}/crawl-{uuid.uuid4().hex}"


def saver(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table to the shared folder and reads it back."""
    root = folder(spark)

    def save(df: DataFrame) -> DataFrame:
        path = f"{root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


class TableWeb:
    """The web as a table of responses."""

    def __init__(self, site: DataFrame, options: CrawlOptions, save: Callable[[DataFrame], DataFrame]):
        self.site, self.options, self.save = site, options, save

    def robots(self, origins: DataFrame) -> DataFrame:
        wanted = origins.select("origin", F.concat("origin", F.lit("/robots.txt")).alias("url"))
        got = fetch_from_table(wanted, self.site.where(F.col("url").endswith("/robots.txt") | policy.is_redirect("status_code")), ROBOTS_REDIRECTS, ROBOTS_BYTES, save=self.save)
        return got.select("origin", "status_code", "error_category", "body")

    def fetch(self, items: DataFrame) -> DataFrame:
        got = fetch_from_table(items, self.site, self.options.redirect_limit, self.options.max_response_bytes, save=self.save)
        slots = pacing.pacing_slots(items.select("id", "domain", F.lit(0.0).alias("arrive"), "delay"), order="id").select("id", F.col("start").alias("slot"))
        got = got.withColumn("tried", F.lit(self.options.retry_count))
        return got.withColumn("encoding", F.try_element_at("headers", F.lit("content-encoding"))).join(slots, "id")


class LiveWeb:
    """The web itself, by one of the clients or by a fetch function of the caller's."""

    def __init__(self, client: str | Callable, options: CrawlOptions, save: Callable[[DataFrame], DataFrame]):
        self.client, self.options, self.save = client, options, save
        self.free: DataFrame | None = None  # from when on each domain is free, over all levels

    def robots(self, origins: DataFrame) -> DataFrame:
        limits = limits_of(self.options, max_bytes=ROBOTS_BYTES, redirect_limit=ROBOTS_REDIRECTS, connect_timeout=5.0, read_timeout=5.0, total_timeout=10.0)
        wanted = origins.select("origin", F.concat("origin", F.lit("/robots.txt")).alias("url"))
        got = fetch_with(wanted, make_fetcher(self.client, **vars(limits)), 8)
        return wanted.join(self.save(got), "url").select("origin", "status_code", "error_category", "body")

    def fetch(self, items: DataFrame) -> DataFrame:
        """All items, retries included: a retry waits its back-off, and a domain's delay or pause holds
        over passes and levels."""
        done, left = None, items.select("url", "domain", F.col("id").alias("rank"), "delay").dropDuplicates(["url"]).withColumn("due", F.lit(None).cast("double"))
        for tried in range(self.options.retry_count + 1):
            held = left.withColumn("free_at", F.lit(None).cast("double")) if self.free is None else left.join(self.free, "domain", "left")
            got = self.save(fetch_paced(held, self.client, limits_of(self.options)).withColumn("tried", F.lit(tried)))
            free = got.select("domain", "free_at") if self.free is None else got.select("domain", "free_at").unionByName(self.free)
            self.free = self.save(free.groupBy("domain").agg(F.max("free_at").alias("free_at")))
            category = F.coalesce("error_category", policy.status_category("status_code"))
            again = policy.should_retry("status_code", category, F.lit(tried), self.options.retry_count)
            now = got.where(~again).drop("domain", "free_at")
            done = now if done is None else done.unionByName(now)
            late = got.where(again)
            if late.isEmpty():
                break
            wait = F.unix_micros(F.current_timestamp()) / 1_000_000 + policy.backoff_seconds(F.lit(tried))
            left = left.drop("due").join(late.select("url"), "url", "left_semi").withColumn("due", wait)
        slot = F.lit(None).cast("double")
        return items.join(done, "url").withColumn("encoding", F.lit(None).cast("string")).withColumn("slot", slot)


def robots_of(web, origins: DataFrame, user_agent: str) -> tuple[DataFrame, DataFrame]:
    """Rules and delays for the origins."""
    return rules_of(web.robots(origins.select("origin").distinct()), user_agent)


def rules_of(got: DataFrame, user_agent: str) -> tuple[DataFrame, DataFrame]:
    status = F.when(F.col("error_category").isNull(), F.col("status_code"))
    return R.rule_table(got.withColumn("body", R.fetched_rules(status, F.col("body"))), user_agent)


def expand(parsed: DataFrame, options: CrawlOptions, seeds: list[str]) -> DataFrame:
    """Links of a level's pages: id, pos, url, depth + 1, discovered_from; in scope only."""
    links = parsed.where(F.col("depth") < options.max_depth).select("job_id", "id", "depth", F.col("final_url").alias("discovered_from"), F.posexplode("links").alias("pos", "url"))
    return links.where(U.in_scope("url", seeds, options.stay_on_seed_domain)).withColumn("depth", F.col("depth") + 1)


def numbered(rows: DataFrame, order: list[str], base: int, save) -> DataFrame:
    """``rows`` with id = base + 1, base + 2, ... by order. Sorted by ranges; only counts per range meet."""
    lot = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    lot = save(lot.withColumn("lot_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    before = Window.orderBy("lot_").rowsBetween(Window.unboundedPreceding, -1)
    first = lot.groupBy("lot_").count().select("lot_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first_"))
    return lot.join(F.broadcast(first), "lot_").withColumn("id", F.col("at_") + F.col("first_") + base + 1).drop("lot_", "at_", "first_")


def crawl(spark: SparkSession, site: DataFrame | str | Callable, seed: str, options: CrawlOptions | None = None, job_id: int = 1, resume: CrawlResult | None = None, after_level: Callable[[CrawlResult], None] | None = None, more_seeds: DataFrame | None = None, parse: Callable | None = None) -> CrawlResult:
    """Crawl from the seed: ``site`` is a table of responses, the name of a live client, or a fetch function
    (``live.fetched_by``), which is paced and retried like a client. ``parse`` is a parser in place of that
    of HTML (``html.parsed_by``); it gets inflated bodies of the allowed content types.

    ``resume`` is what an earlier run of the job has stored. ``after_level`` gets the state at the start
    and after every level, to be stored, with the rows that the level changed. ``more_seeds`` (url, order) are further items of depth 0.
    """
    options = options or CrawlOptions()
    save = saver(spark)
    web = TableWeb(site, options, save) if isinstance(site, DataFrame) else LiveWeb(site, options, save)
    page_of = H.parse_html if parse is None else functools.partial(H.parsed_by, parse)
    host = spark.range(1).select(U.domain(F.lit(seed)).alias("h")).first().h
    seeds = [host, *options.allowed_domains]
    pages = spark.createDataFrame([], ", ".join(f"{f} {k}" for f, k in PAGE_TYPES.items())) if resume is None else resume.pages.select(*PAGE_TYPES)
    failures = spark.createDataFrame([], ", ".join(f"{f} {k}" for f, k in FAILURE_TYPES.items())) if resume is None else resume.failures.select(*FAILURE_TYPES)
    if resume is None:
        first = spark.createDataFrame([(job_id, seed, 0)], "job_id long, url string, pos long")
        if more_seeds is not None:
            first = first.unionByName(more_seeds.select(F.lit(job_id).cast("long").alias("job_id"), "url", (F.col("order") + 1).cast("long").alias("pos")))
        first = first.select("job_id", "url", U.normalize_url("url").alias("normalized_url"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("discovered_from"), "pos")
        frontier = numbered(store.first_wins(first, ["pos"]), ["pos"], 0, save).select(*ITEM).withColumn("status", F.lit("pending"))
    else:
        frontier = store.recover_in_progress(resume.frontier, job_id).select(*ITEM, "status")
    frontier = save(frontier)
    status, texts = "finished", None
    if after_level is not None and resume is None:
        after_level(CrawlResult(frontier, pages, failures, "running"))
    taken = pages.select("normalized_url").distinct().count()
    while True:
        open_ = frontier.where(F.col("status").isin("pending", "retry_scheduled"))
        depth = open_.agg(F.min("depth")).first()[0]
        if depth is None:
            break
        if taken >= options.max_pages:
            status = "budget_reached"
            break
        level = open_.where(F.col("depth") == depth).drop("status")
        gated = level.withColumn("skip", F.when(F.col("depth") > options.max_depth, "max_depth_exceeded").when(~U.in_scope("url", seeds, options.stay_on_seed_domain), "off_domain"))
        gated = gated.withColumn("domain", U.domain("url")).withColumn("delay", F.lit(float(options.min_delay_seconds)))
        if options.obey_robots:
            origins = level.select(U.robots_key("url").alias("origin")).distinct()
            new = origins if texts is None else origins.join(texts.select("origin"), "origin", "left_anti")
            if texts is None or not new.isEmpty():  # each origin is asked once
                got = save(web.robots(new))
                texts = got if texts is None else texts.unionByName(got)
            rules, delays = rules_of(texts, options.user_agent)
            gated = R.robots_verdicts(gated, rules).drop("disallow_len", "allow_len")
            gated = gated.withColumn("skip", F.coalesce("skip", F.when(~F.col("allowed"), "robots_disallowed"))).drop("allowed")
            delays = delays.select(F.col("origin").alias("o_"), "crawl_delay")
            gated = gated.withColumn("origin", U.robots_key("url")).join(delays, F.col("origin") == F.col("o_"), "left")
            gated = gated.withColumn("delay", policy.effective_delay(options.min_delay_seconds, "crawl_delay")).drop("o_", "origin", "crawl_delay")
        gated = save(gated)
        log.debug("level of depth %s, %s pages so far", depth, taken)
        fetched = web.fetch(gated.where("skip is null").drop("skip")).withColumn("fetched_at", F.current_timestamp().cast("timestamp_ntz"))
        ctype = F.coalesce(F.try_element_at("headers", F.lit("content-type")), F.lit(""))
        fetched = fetched.withColumn("content_type", ctype).withColumn("category", F.coalesce("error_category", policy.status_category("status_code")))
        html = W.content_type_allowed(F.col("content_type"), options.allowed_content_types)
        fetched = save(fetched.withColumn("category", F.coalesce("category", F.when(~html, "unsupported_content_type"))))
        good = fetched.where("category is null").withColumn("inflated", W.decompressed("body", F.col("encoding"), options.max_response_bytes))
        good = good.withColumn("p", page_of("inflated.body", "final_url", F.col("content_type"))).withColumn("d", W.decoded("inflated.body", F.col("content_type")))
        good = good.select(
            *ITEM, "final_url", "status_code", "content_type", F.coalesce("inflated.error", "p.error").alias("category"), "p.title", "p.description", "p.headings", "p.links",
            F.col("d.text").alias("body_text"), F.col("d.encoding").alias("text_encoding"), store.body_sha256("d.text").alias("body_sha256"), "timing", "transport", "slot", "fetched_at", U.normalize_url("final_url").alias("page_url"),
        )
        good = save(good)
        ok = good.where("category is null")
        known = pages.where(F.col("job_id") == job_id).select(F.col("normalized_url").alias("page_url")).distinct()
        fresh = ok.join(known, "page_url", "left_anti").groupBy("page_url").agg(F.min("id").alias("id"))
        # the id at which the budget is met; what comes after it stays pending
        last = fresh.orderBy("id").limit(min(options.max_pages - taken, 2**31 - 1)).agg(F.count("*").alias("n"), F.max("id").alias("id")).first()
        full = last.n == options.max_pages - taken
        within = F.col("id") <= last.id if full else F.lit(True)
        taken += last.n
        ok = ok.where(within)
        bad = lambda t, tried, message: t.select(*ITEM[:1], "id", "depth", "url", "normalized_url", "category", message.alias("message"), "status_code", tried.alias("retry_count"))
        none = F.lit(None).cast("int")
        skips = gated.where("skip is not null").withColumn("category", F.col("skip")).withColumn("status_code", none)
        tries = F.when(policy.should_retry("status_code", "category", F.lit(0), options.retry_count), F.col("tried")).otherwise(0)
        wrong = bad(skips, F.lit(0), F.col("category")).unionByName(bad(fetched.where("category is not null"), tries, F.coalesce("error_message", F.col("category"))))
        wrong = wrong.unionByName(bad(good.where("category is not null"), F.lit(0), F.col("category"))).where(within)
        wrong = save(wrong.withColumn("created_at", F.current_timestamp().cast("timestamp_ntz")))
        new_pages = save(ok.withColumn("normalized_url", F.col("page_url")).select(*[F.col(c).cast(k).alias(c) for c, k in PAGE_TYPES.items()]))
        new_failures = wrong.withColumnRenamed("id", "item_id").select(*[F.col(c).cast(k).alias(c) for c, k in FAILURE_TYPES.items()])
        pages, failures = pages.unionByName(new_pages), failures.unionByName(new_failures)
        state = wrong.select("id", F.when(F.col("category").isin(SKIP_CATEGORIES), "skipped").otherwise("failed").alias("status")).unionByName(ok.select("id", F.lit("fetched").alias("status")))
        frontier = store.set_status(frontier, state)
        found = expand(ok, options, seeds).withColumn("normalized_url", U.normalize_url("url"))
        new = store.first_wins(found, ["id", "pos"]).join(frontier.select("job_id", "normalized_url"), ["job_id", "normalized_url"], "left_anti")
        base = frontier.agg(F.max("id")).first()[0]
        new = numbered(new.withColumnRenamed("id", "from_"), ["from_", "pos"], base, save).select(*ITEM).withColumn("status", F.lit("pending"))
        frontier = save(frontier.unionByName(new))
        if after_level is not None:
            changed = frontier.join(state.select("id").unionByName(new.select("id")), "id", "left_semi").select(*frontier.columns)
            after_level(dataclasses.replace(_result(frontier, pages, failures, "running"), changes=CrawlResult(changed, new_pages, new_failures, "running")))
    return _result(frontier, pages, failures, status)


PAGE_TYPES = dict.fromkeys(PAGE_FIELDS, "string") | {"job_id": "long", "id": "long", "status_code": "int", "headings": "array<string>", "links": "array<string>", "timing": TIMING, "depth": "int", "slot": "double", "fetched_at": "timestamp_ntz"}
FAILURE_TYPES = dict.fromkeys(FAILURE_FIELDS, "string") | {"job_id": "long", "item_id": "long", "depth": "int", "status_code": "int", "retry_count": "int", "created_at": "timestamp_ntz"}


def _result(frontier: DataFrame, pages: DataFrame, failures: DataFrame, status: str) -> CrawlResult:
    # the last write of a page wins under the id of the first
    return CrawlResult(frontier, store.upsert_pages(pages.limit(0), pages.withColumn("seq", F.col("id")), "seq"), failures, status)

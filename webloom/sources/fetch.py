"""Fetching: URLs meet responses.

Offline the web is a table (url, status_code, headers, body), and a fetch is an equi-join with it;
redirects are at most ``redirect_limit`` more joins. Live fetches (``live``) are applied by
``mapInPandas``. Either way a fetch gives one row per URL, with errors as values.
"""

from __future__ import annotations

import datetime
import email.utils
import heapq
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import url as U
from ..functions import wire as W
from ..operators.policy import is_redirect
from ..schema import FETCH, FETCH_COLUMNS, TIMING, CrawlOptions
from ..shipping import ship
from .live import ALIASES, CLIENTS, Limits, fetch_url

HOP = "array<struct<url:string,status_code:int,location:string>>"


def without_fragment(url):
    return F.regexp_replace(url, "(?s)#.*$", "")


def fetch_from_table(urls: DataFrame, site: DataFrame, redirect_limit: int = 5, max_bytes: int = 2 * 1024 * 1024, missing: str = "not_found", save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``urls`` (a column url, and others) with the fields of FETCH.

    Hops join URLs and the narrow table (url, status, location); headers and bodies are met once, at
    the end of each chain. ``save`` (write a table and read it back) lets hops end as soon as no row
    is under way. ``missing`` says what a URL outside the table is: "not_found" a 404, else an error
    category.
    """
    where = F.try_element_at(W.lower_keys("headers"), F.lit("location"))
    web = site.select(F.col("url").alias("w_url"), F.col("status_code").alias("w_status"), where.alias("w_location"))
    own = [c for c in urls.columns if c != "url"]
    none = F.lit(None).cast("string")
    # one row per URL moves along its chain; a row at rest has a null key and meets nothing
    row = urls.select(*own, "url", F.col("url").alias("final_url"), F.array().cast(HOP).alias("redirects"), U.url_error("url").alias("error_category"), F.lit(None).cast("int").alias("status_code"))
    row = row.withColumn("go", F.col("error_category").isNull())
    for hop in range(redirect_limit + 1):
        met = row.join(web, F.when(F.col("go"), without_fragment(F.col("final_url"))) == F.col("w_url"), "left")
        lost, took = F.col("go") & F.col("w_url").isNull(), F.col("go") & F.col("w_url").isNotNull()
        error = F.col("error_category") if missing == "not_found" else F.when(lost, missing).otherwise(F.col("error_category"))
        status = F.when(took, F.col("w_status")).when(lost & F.lit(missing == "not_found"), 404).otherwise(F.col("status_code"))
        moves = took & F.coalesce(is_redirect("w_status"), F.lit(False)) & (F.coalesce("w_location", F.lit("")) != "")
        met = met.select(*own, "url", "final_url", "redirects", error.alias("error_category"), status.alias("status_code"), moves.alias("moves"), F.when(moves, U.resolve("final_url", F.col("w_location"))).alias("next"), "w_location")
        seen = F.exists("redirects", lambda h: h["url"] == F.col("next")) | (F.col("next") == F.col("final_url"))
        trouble = F.when(~F.col("moves"), none).when(~U.is_http_url("next"), "unsupported_redirect").when(seen, "redirect_loop").when(F.lit(hop == redirect_limit), "too_many_redirects")
        log = F.concat("redirects", F.array(F.struct(F.col("final_url").alias("url"), "status_code", F.col("w_location").alias("location"))))
        met = met.withColumn("trouble", trouble).withColumn("redirects", F.when(F.col("moves"), log).otherwise(F.col("redirects")))
        met = met.withColumn("go", F.col("moves") & F.col("trouble").isNull()).withColumn("final_url", F.when(F.col("go"), F.col("next")).otherwise(F.col("final_url")))
        row = met.withColumn("error_category", F.coalesce("error_category", "trouble")).drop("moves", "next", "w_location", "trouble")
        if save is not None:
            row = save(row)
            if row.where("go").isEmpty():
                break
    full = site.select(F.col("url").alias("w_url"), W.lower_keys("headers").alias("headers"), "body")
    fetched = F.when(F.col("status_code").isNotNull() | F.col("error_category").isNull(), without_fragment(F.col("final_url")))
    row = row.drop("go").join(full, fetched == F.col("w_url"), "left").drop("w_url").withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>")))
    big = F.col("error_category").isNull() & (F.octet_length("body") > max_bytes)
    row = row.withColumn("error_category", F.when(big, W.TOO_LARGE).otherwise(F.col("error_category"))).withColumn("body", F.when(~F.coalesce(big, F.lit(False)), F.col("body")))
    return row.withColumn("error_message", F.col("error_category")).withColumn("timing", F.lit(None).cast(TIMING)).withColumn("transport", F.lit("table"))


def fetch_with(urls: DataFrame, fetch: Callable[[pd.DataFrame], pd.DataFrame], partitions: int | None = None) -> DataFrame:
    """Apply a fetch function to batches of (url) rows; it returns rows of FETCH."""

    ship(urls.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fetch(batch)

    rows = urls.select("url")
    return (rows.repartition(partitions) if partitions else rows).mapInPandas(run, FETCH)


def asked_pause(value: str, now: float) -> float:
    """Seconds from ``now`` (a time) that a Retry-After asks for: a number or an HTTP date; else 0."""
    value = (value or "").strip()
    if value.isascii() and value.isdigit():
        return float(value)
    try:
        at = email.utils.parsedate_to_datetime(value)
    except (TypeError, ValueError):
        return 0.0
    return max(0.0, at.replace(tzinfo=at.tzinfo or datetime.UTC).timestamp() - now)


#: A fetch with its domain, and from when on the domain is free again (a time in seconds).
PACED = f"{FETCH}, domain string, free_at double"


def fetch_paced(urls: DataFrame, client: str | Callable, limits: Limits) -> DataFrame:
    """Live fetches of ``urls`` (url, domain, rank, delay, free_at, due): rows of PACED.

    One task has all URLs of a domain and waits ``delay`` seconds between two of them, in order of
    rank. ``free_at`` is when the domain is free after what was fetched before, ``due`` is before when
    this URL must not go out; either may be null. A Retry-After holds up its domain for as long as it
    says. Of the domains in a batch the one that is free first comes next.
    """
    ship(urls.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free: dict[str, float] = {}
        for batch in batches:
            queues: dict[str, deque] = {}
            for r in batch.itertuples():
                queues.setdefault(r.domain, deque()).append(r)
                free[r.domain] = max(free.get(r.domain, 0.0), 0.0 if pd.isna(r.free_at) else r.free_at)
            ready = lambda d, queues=queues: max(free[d], 0.0 if pd.isna(queues[d][0].due) else queues[d][0].due)
            turns = [(ready(d), d) for d in queues]
            heapq.heapify(turns)
            while turns:
                when, d = heapq.heappop(turns)
                r = queues[d].popleft()
                time.sleep(max(0.0, when - time.time()))
                row = fetch_url(r.url, client, limits)
                now = time.time()
                free[d] = now + max(r.delay, asked_pause((row["headers"] or {}).get("retry-after", ""), now))
                if queues[d]:
                    heapq.heappush(turns, (ready(d), d))
                yield pd.DataFrame([row | {"domain": d, "free_at": free[d]}], columns=[*FETCH_COLUMNS, "domain", "free_at"])

    rows = urls.select("url", "domain", "rank", "delay", "free_at", "due").repartition("domain").sortWithinPartitions("rank")
    return rows.mapInPandas(run, PACED)


def limits_of(options: CrawlOptions, **more) -> Limits:
    names = ("connect_timeout", "read_timeout", "total_timeout", "redirect_limit", "user_agent", "block_private_addresses")
    return Limits(**({n: getattr(options, n) for n in names} | {"max_bytes": options.max_response_bytes} | more))


def make_fetcher(name: str | Callable, **options) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The fetch function of a client's name, blanks and case aside, or of one URL's fetch function; options
    are those of Limits."""
    client = name if callable(name) else client_name(name)
    limits = Limits(**options)
    return lambda batch: pd.DataFrame([fetch_url(u, client, limits) for u in batch["url"]], columns=FETCH_COLUMNS)


def client_name(name: str) -> str:
    client = name.strip().lower()
    client = ALIASES.get(client, client)
    if client not in CLIENTS:
        raise ValueError(f"unknown fetcher: {name}")
    return client


class UrlListSource(DataSource):
    """``spark.read.format("webloom_urls").option("urls", "a b").load()``: live fetches of a list."""

    @classmethod
    def name(cls) -> str:
        return "webloom_urls"

    def schema(self):
        return FETCH

    def reader(self, schema):
        return _UrlReader(self.options.get("urls", "").split(), float(self.options.get("timeout", "30")))


class _UrlReader(DataSourceReader):
    def __init__(self, urls, timeout):
        self.urls, self.timeout = urls, timeout

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        row = fetch_url(partition.value, "socket", Limits(total_timeout=self.timeout))
        hops = [tuple(h.values()) for h in row["redirects"]]
        yield tuple((row | {"redirects": hops, "timing": tuple(row["timing"].values())})[f] for f in FETCH_COLUMNS)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(UrlListSource)

"""Command line: scrape, crawl, resume, stats, export, verify, robots, doctor.

State is a folder of snapshots (``--store``), stored after every level of a crawl, so that an
interrupted job is resumed where it was. Exit codes: 0 done, 1 failed or not valid, 2 usage,
130 interrupted. The web is a Parquet table (``--site``) or, with ``--live``, the network.
"""

from __future__ import annotations

import argparse
import dataclasses
import datetime
import json
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import html as H
from .functions import robots as R
from .functions import url as U
from .operators import deltas, store
from .plans.crawl import FAILURE_TYPES, PAGE_TYPES, CrawlResult, LiveWeb, TableWeb, crawl, robots_of
from .schema import CRAWL_JOBS, SCHEMA_VERSION, load_options
from .sources.fetch import client_name, fetch_from_table, fetch_with, limits_of, make_fetcher
from .sources.fixture import fixture_site

VERSION = "0.2.0"
OK, FAILED, USAGE, INTERRUPTED = 0, 1, 2, 130
log = logging.getLogger("webloom")

#: Flags of fetching commands, by the option that they set.
FETCH_FLAGS = {
    "user_agent": ("--user-agent", str),
    "connect_timeout": ("--connect-timeout", float),
    "read_timeout": ("--read-timeout", float),
    "total_timeout": ("--total-timeout", float),
    "max_response_bytes": ("--max-bytes", int),
    "redirect_limit": ("--redirect-limit", int),
}
CRAWL_FLAGS = {"max_pages": ("--max-pages", int), "max_depth": ("--max-depth", int), "retry_count": ("--retry-count", int), "min_delay_seconds": ("--delay", float)}


def log_event(event: str, **fields) -> None:
    log.info(json.dumps({"event": event, **fields}, sort_keys=True, default=str))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="webloom")
    p.add_argument("--version", action="version", version=f"webloom {VERSION}")
    p.add_argument("--store", default="webloom-store")
    p.add_argument("--site", help="Parquet table of url, status_code, headers, body; 'fixture' for the built-in site")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scrape", "crawl", "resume", "robots"):
        c = sub.add_parser(name)
        if name != "resume":
            c.add_argument("url")
        else:
            c.add_argument("--job-id", type=int)
        c.add_argument("--live", action="store_true", help="fetch from the network")
        c.add_argument("--fetcher", default="socket", help="socket or library")
        c.add_argument("--trace", action="store_true", help="say what is done on standard error")
        c.add_argument("--block-private-addresses", action="store_true", default=None)
        for option, (flag, kind) in (FETCH_FLAGS | (CRAWL_FLAGS if name in ("crawl", "resume") else {})).items():
            c.add_argument(flag, dest=option, type=kind)
        if name in ("crawl", "resume"):
            c.add_argument("--allow-domain", action="append", help="one more domain in scope; may be repeated")
            c.add_argument("--ignore-robots", action="store_true")
    for name in ("stats", "export", "verify"):
        c = sub.add_parser(name)
        c.add_argument("--job-id", type=int)
        if name == "export":
            c.add_argument("--output", help="a file; else standard output")
    sub.add_parser("doctor")
    return p


def _site(spark, args):
    return fixture_site(spark) if args.site in (None, "fixture") else spark.read.parquet(args.site)


def _options(args):
    given = {k: getattr(args, k, None) for k in (*FETCH_FLAGS, *CRAWL_FLAGS, "block_private_addresses")}
    if getattr(args, "ignore_robots", False):
        print("warning: robots.txt is not obeyed (--ignore-robots)", file=sys.stderr)
        given["obey_robots"] = False
    options = load_options(args.config, **given)
    more = tuple(d.lower() for d in getattr(args, "allow_domain", None) or ())
    return dataclasses.replace(options, allowed_domains=(*options.allowed_domains, *more))


_ddl = lambda types: ", ".join(f"{c} {k}" for c, k in types.items())
STORED = {
    "pages": {"schema": _ddl(PAGE_TYPES), "key": ["job_id", "normalized_url"], "oldest": ("id",), "order": "id"},
    "failures": {"schema": _ddl(FAILURE_TYPES), "key": ["job_id", "item_id"]},
    "frontier": {"schema": "job_id long, id long, url string, normalized_url string, depth int, discovered_from string, status string", "key": ["job_id", "id"]},
    "crawl_jobs": {"schema": CRAWL_JOBS, "key": ["id"]},
}


class Job:
    """Jobs and their rows in the store: tables that take a level's rows as a delta."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), deltas.Files(spark)
        self.tables = {n: deltas.DeltaTable(spark, f"{self.root}/tables/{n}", **how) for n, how in STORED.items()}
        found = self.version()
        if found > SCHEMA_VERSION:
            raise ValueError(f"the store has version {found}, not {SCHEMA_VERSION}")
        for version in range(found, SCHEMA_VERSION):  # a step that was cut short is done again
            MIGRATIONS[version](self)
            self.files.put(f"{self.root}/_version", str(version + 1))
        self.files.put(f"{self.root}/_version", str(SCHEMA_VERSION))

    def version(self) -> int:
        """The store's version; that of a new one is the present."""
        if self.files.exists(f"{self.root}/_version"):
            return int(self.files.get(f"{self.root}/_version"))
        old = store.Snapshots(self.spark, self.root)
        return old.read("version").first().version if old.exists("version") else SCHEMA_VERSION

    def exists(self, name: str) -> bool:
        return self.tables[name].exists()

    def read(self, name: str):
        return self.tables[name].read()

    def next_id(self) -> int:
        return 1 + (self.read("crawl_jobs").agg(F.max("id")).first()[0] or 0)

    def save(self, out: CrawlResult) -> None:
        """The rows that changed since the last save."""
        for name in ("pages", "failures", "frontier"):
            self.tables[name].save(getattr(out.changes or out, name))
            self.tables[name].expire()

    def delete(self, job_id: int) -> None:
        """Removes a job and its rows."""
        for name, rows in store.delete_job(job_id, **{n: self.read(n) for n in STORED}).items():
            self.tables[name].replace(rows)

    def row(self, job_id, url, status, options, created, started, finished=None) -> None:
        row = (job_id, url, status, options.max_pages, options.max_depth, created, started, finished)
        self.tables["crawl_jobs"].save(self.spark.createDataFrame([row], CRAWL_JOBS))


def _columns_that_lack(job: Job) -> None:
    """From version 1: tables may lack columns that came later; they are null."""
    old = store.Snapshots(job.spark, job.root)
    for name, how in STORED.items():
        if old.exists(name):
            old.write(name, job.spark.createDataFrame([], how["schema"]).unionByName(old.read(name), allowMissingColumns=True))


def _snapshots_as_deltas(job: Job) -> None:
    """From version 2: whole snapshots become the first delta of each table."""
    old = store.Snapshots(job.spark, job.root)
    for name, table in job.tables.items():
        if old.exists(name) and not table.exists():
            table.save(job.spark.createDataFrame([], STORED[name]["schema"]).unionByName(old.read(name), allowMissingColumns=True))


#: What leads from a version to the next one.
MIGRATIONS = {1: _columns_that_lack, 2: _snapshots_as_deltas}


def _crawl(spark, args, options) -> int:
    jobs, now = Job(spark, args.store), lambda: datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    resume = None
    if args.command == "resume":
        row = store.get_job(jobs.read("crawl_jobs"), args.job_id)
        if row is None:
            print("no such job", file=sys.stderr)
            return FAILED
        url, job_id, created = row.seed_url, row.id, row.created_at
        kept = {k: getattr(row, k) for k in ("max_pages", "max_depth") if getattr(args, k) is None}  # the job's own budgets
        options = dataclasses.replace(options, **kept)
        of = lambda name: jobs.read(name).where(F.col("job_id") == job_id)
        resume = CrawlResult(of("frontier"), of("pages"), of("failures"), row.status) if jobs.exists("frontier") else None
    else:
        url, job_id, created = args.url, jobs.next_id(), now()
    started = now()
    jobs.row(job_id, url, "running", options, created, started)
    web = client_name(args.fetcher) if args.live else _site(spark, args)
    try:
        out = crawl(spark, web, url, options, job_id, resume, jobs.save)
    except BaseException as e:
        jobs.row(job_id, url, "interrupted" if isinstance(e, KeyboardInterrupt) else "errored", options, created, started, now())
        raise
    jobs.row(job_id, url, out.status, options, created, started, now())
    summary = {"job_id": job_id, "status": out.status, "pages": out.pages.count(), "failures": out.failures.count()}
    log_event("crawl_finished", **summary)
    print(json.dumps(summary))
    return OK


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return OK if e.code == 0 else USAGE
    if getattr(args, "trace", False):
        logging.basicConfig(level=logging.INFO, stream=sys.stderr)
        log.setLevel(logging.DEBUG)
    try:
        return _run(args, spark or SparkSession.builder.appName("webloom").getOrCreate())
    except KeyboardInterrupt:
        return INTERRUPTED
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return USAGE


def _run(args, spark: SparkSession) -> int:
    options = _options(args)
    if args.command == "doctor":
        print(f"webloom {VERSION}, spark {spark.version}, python {sys.version.split()[0]}, store version {SCHEMA_VERSION}")
        return OK
    if args.command == "scrape":
        urls = spark.createDataFrame([(args.url,)], "url string")
        if args.live:
            got = fetch_with(urls, make_fetcher(args.fetcher, **vars(limits_of(options))))
        else:
            got = fetch_from_table(urls, _site(spark, args), options.redirect_limit, options.max_response_bytes)
        got = got.withColumn("p", H.parse_html("body", "final_url", F.coalesce(F.try_element_at("headers", F.lit("content-type")), F.lit(""))))
        row = got.select("url", "final_url", "status_code", "error_category", "p.title", F.size("redirects").alias("redirects"), "transport", "timing").first()
        print(json.dumps(row.asDict(recursive=True), indent=2))
        return FAILED if row.error_category or (row.status_code or 0) >= 400 else OK
    if args.command in ("crawl", "resume"):
        return _crawl(spark, args, options)
    if args.command == "robots":
        origin = spark.createDataFrame([(args.url,)], "url string").select("url", U.robots_key("url").alias("origin"))
        web = LiveWeb(client_name(args.fetcher), options, lambda df: df) if args.live else TableWeb(_site(spark, args), options, None)
        rules, delays = robots_of(web, origin, options.user_agent)
        row = R.robots_verdicts(origin.select("url"), rules).join(origin, "url").join(delays, "origin", "left").select("url", "allowed", "crawl_delay", "sitemaps").first()
        print(json.dumps(row.asDict()))
        return OK
    s = Job(spark, args.store)
    if not s.exists("pages"):
        print("no job in the store", file=sys.stderr)
        return FAILED
    pages, failures, frontier = s.read("pages"), s.read("failures").withColumnRenamed("item_id", "id"), s.read("frontier")
    if args.command == "stats":
        print(json.dumps(store.stats(pages, failures, frontier, args.job_id).first().asDict()))
        return OK
    if args.command == "export":
        store.export_document(pages, failures, frontier, args.output or sys.stdout, args.job_id)
        return OK
    row = store.verify_counts(pages, args.job_id).first()
    print(json.dumps(row.asDict()))
    return FAILED if row.mismatch or row.missing else OK


if __name__ == "__main__":
    sys.exit(main())

"""Tables of a crawl: upserts, first-wins inserts, state changes, statistics, export, verification.

Parquet has no MERGE, so a change is a plan from old rows and new rows to the next snapshot; the
snapshot is written beside the old one and the pointer is moved last (``Snapshots``).
"""

from __future__ import annotations

import contextlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.url import normalize_url
from .key_filter import KeyFilter, anti_join


def body_sha256(text: Column | str) -> Column:
    """Lower-case hexadecimal digest of the decoded text in UTF-8."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def upsert_pages(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Of each (job_id, normalized_url) the latest row under the oldest id.

    One shuffle: min(id) and max_by of the row are both partial aggregates. New rows need an id
    (for keys that are not there yet); ``order`` tells new rows of one key apart.
    """
    cols = old.columns
    both = old.withColumn("seq_", F.lit(None).cast("long")).unionByName(new.withColumn("seq_", F.col(order).cast("long")).select(*cols, "seq_"))
    rest = [c for c in cols if c not in ("id", "job_id", "normalized_url")]
    last = F.max_by(F.struct(*rest), F.struct(F.col("seq_").isNotNull(), F.col("seq_"))).alias("r")
    return both.groupBy("job_id", "normalized_url").agg(F.min("id").alias("id"), last).select(*[F.col(f"r.{c}").alias(c) if c in rest else F.col(c) for c in cols])


def first_wins(urls: DataFrame, order: list[str], key: list[str] = ("job_id", "normalized_url")) -> DataFrame:
    """The first row of each key; rows whose URL cannot be normalized vanish.

    min_by instead of row_number: it combines on the map side, and no key is sorted whole.
    """
    rest = [c for c in urls.columns if c not in key]
    rows = urls.where(F.col("normalized_url").isNotNull())
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*[F.col(f"r.{c}").alias(c) if c in rest else F.col(c) for c in urls.columns])


def enqueue(frontier: DataFrame, found: DataFrame, order: list[str], save=None, known: KeyFilter | None = None) -> DataFrame:
    """Rows of ``found`` that are new to the frontier: INSERT OR IGNORE.

    With ``save`` (write a table and read it back) by way of filters, for frontiers much larger than what
    is found; ``known`` is the filter of the frontier's keys (job_id, normalized_url), if one is kept.
    """
    new = first_wins(found.withColumn("normalized_url", normalize_url("url")), order)
    if save is not None:
        return anti_join(new, frontier, ["job_id", "normalized_url"], save, known)
    return new.join(frontier.select("job_id", "normalized_url"), ["job_id", "normalized_url"], "left_anti")


def next_items(frontier: DataFrame, job_id: int, now: float, limit: int = 1) -> DataFrame:
    """Ready items by (depth, id); a top-k, no full sort."""
    return ready(frontier, job_id, now).orderBy("depth", "id").limit(limit)


def ready(frontier: DataFrame, job_id: int, now: float) -> DataFrame:
    return frontier.where((F.col("job_id") == job_id) & F.col("status").isin("pending", "retry_scheduled") & (F.col("next_fetch_at") <= now))


def has_pending_work(frontier: DataFrame, job_id: int) -> bool:
    return not frontier.where((F.col("job_id") == job_id) & F.col("status").isin("pending", "retry_scheduled")).isEmpty()


def seconds_until_next(frontier: DataFrame, job_id: int, now: float) -> DataFrame:
    due = frontier.where((F.col("job_id") == job_id) & F.col("status").isin("pending", "retry_scheduled"))
    return due.agg(F.greatest(F.lit(0.0), F.min("next_fetch_at") - now).alias("seconds"))


def set_status(frontier: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The frontier with the status of ``outcomes`` (id, status) where there is one."""
    o = outcomes.select(F.col("id"), F.col("status").alias("status_"))
    return frontier.join(o, "id", "left").withColumn("status", F.coalesce("status_", "status")).drop("status_").select(*frontier.columns)


def schedule_retry(frontier: DataFrame, delays: DataFrame, now: float) -> DataFrame:
    """retry_count + 1 and the due time for the ids in ``delays`` (id, delay)."""
    d = delays.select("id", F.col("delay").alias("delay_"))
    hit = F.col("delay_").isNotNull()
    out = frontier.join(d, "id", "left")
    out = out.withColumn("status", F.when(hit, "retry_scheduled").otherwise(F.col("status"))).withColumn("retry_count", F.col("retry_count") + hit.cast("int"))
    return out.withColumn("next_fetch_at", F.when(hit, now + F.col("delay_")).otherwise(F.col("next_fetch_at"))).select(*frontier.columns)


def recover_in_progress(frontier: DataFrame, job_id: int | None = None) -> DataFrame:
    """Items that an interrupted run left in progress are pending again."""
    mine = F.lit(True) if job_id is None else F.col("job_id") == job_id
    return frontier.withColumn("status", F.when(mine & (F.col("status") == "in_progress"), "pending").otherwise(F.col("status")))


def delete_job(job_id: int, **tables: DataFrame) -> dict[str, DataFrame]:
    """The tables without a job and its rows."""
    return {n: t.where(F.col("id" if n == "crawl_jobs" else "job_id") != job_id) for n, t in tables.items()}


def get_job(jobs: DataFrame, job_id: int | None = None):
    """The row of a job, or of the latest; None if there is none."""
    return (jobs.where(F.col("id") == job_id) if job_id is not None else jobs.orderBy(F.desc("id"))).limit(1).first()


def latest_job_id(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.max("id").alias("job_id"))


def of_job(table: DataFrame, job_id: int | None) -> DataFrame:
    return table if job_id is None else table.where(F.col("job_id") == job_id)


def stats(pages: DataFrame, failures: DataFrame, frontier: DataFrame, job_id: int | None = None) -> DataFrame:
    """One row: pages, failures, and a map of frontier counts by the states that occur."""
    count = lambda t: of_job(t, job_id).agg(F.count("*").alias("n"))
    states = of_job(frontier, job_id).groupBy("status").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "count")))).alias("frontier"))
    return count(pages).withColumnRenamed("n", "pages").crossJoin(count(failures).withColumnRenamed("n", "failures")).crossJoin(states)


def run_summary(frontier: DataFrame, pages: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: what this run's items came to, beside the job's totals. Skips are failures rows too."""
    n = lambda *states: F.count_if(F.col("status").isin(*states))
    items = frontier.agg(n("fetched").alias("fetched"), n("failed").alias("failed"), n("skipped").alias("skipped"), n("pending", "retry_scheduled").alias("pending"))
    return items.crossJoin(pages.agg(F.count("*").alias("pages"))).crossJoin(failures.agg(F.count("*").alias("failures")))


def summary_line() -> Column:
    """A run_summary row as one line of text."""
    return F.format_string("fetched=%d failed=%d skipped=%d pending=%d pages=%d failures=%d", "fetched", "failed", "skipped", "pending", "pages", "failures")


def outcome(body_text: Column | str, stored: Column | str) -> Column:
    """valid, mismatch, or what is missing. The digest is looked for first."""
    text, stored = (F.col(c) if isinstance(c, str) else c for c in (body_text, stored))
    return (
        F.when(F.coalesce(stored, F.lit("")) == "", "missing body_sha256")
        .when(text.isNull(), "missing body_text")
        .when(body_sha256(text) == stored, "valid")
        .otherwise("mismatch")
    )


def verify(pages: DataFrame, job_id: int | None = None, in_order: bool = False) -> DataFrame:
    """(id, url, outcome) of every page; reads four columns only. ``in_order`` gives them by id."""
    out = of_job(pages, job_id).select("id", F.col("final_url").alias("url"), outcome("body_text", "body_sha256").alias("outcome"))
    return out.orderBy("id") if in_order else out


def verify_counts(pages: DataFrame, job_id: int | None = None) -> DataFrame:
    v = verify(pages, job_id)
    return v.agg(F.count_if(F.col("outcome") == "valid").alias("valid"), F.count_if(F.col("outcome") == "mismatch").alias("mismatch"), F.count_if(F.col("outcome").startswith("missing")).alias("missing"))


def export_rows(pages: DataFrame, failures: DataFrame, job_id: int | None = None) -> DataFrame:
    """(kind, id, json) with one JSON object per row; written out in parallel at any size."""
    as_json = lambda t, kind: of_job(t, job_id).select(F.lit(kind).alias("kind"), F.col("id"), F.to_json(F.struct(*sorted(t.columns)), {"ignoreNullFields": "false"}).alias("json"))
    return as_json(pages, "page").unionByName(as_json(failures, "failure"))


def export_document(pages: DataFrame, failures: DataFrame, frontier: DataFrame, path, job_id: int | None = None) -> None:
    """One JSON document for people, to a file or an open one: rows come to the driver one partition
    at a time and are written as they come, in order of their ids."""
    s = stats(pages, failures, frontier, job_id).first()
    rows = export_rows(pages, failures, job_id)
    with contextlib.nullcontext(path) if hasattr(path, "write") else open(path, "w") as f:
        f.write("{")
        for kind, name in (("failure", "failures"), ("page", "pages")):
            f.write(f'\n  "{name}": [')
            for i, r in enumerate(rows.where(F.col("kind") == kind).orderBy("id").toLocalIterator()):
                f.write("," * (i > 0) + "\n    " + json.dumps(json.loads(r.json), indent=2, sort_keys=True).replace("\n", "\n    "))
            f.write("\n  ],")
        f.write('\n  "stats": ' + json.dumps({"pages": s.pages, "failures": s.failures, "frontier": s.frontier or {}}, sort_keys=True) + "\n}\n")


def page_budget(found: DataFrame, budget: int, order: list[str], key: str = "normalized_url") -> DataFrame:
    """Items before the page budget is met, in order; pages are first-seen final URLs.

    Keys beyond the budget cannot matter: the first sightings are cut to ``budget`` by a top-k
    before the one window that needs a single partition.
    """
    rest = F.struct(*order)
    seen = found.groupBy(key).agg(F.min(rest).alias("first"))
    last = seen.orderBy("first").limit(budget).agg(F.max("first").alias("last"), F.count("*").alias("n"))
    open_end = F.col("n") < budget
    return found.crossJoin(F.broadcast(last)).where(open_end | (rest <= F.col("last"))).drop("last", "n")


class Snapshots:
    """Named tables under one folder; a table's current snapshot is named in ``<table>/_current``.

    The pointer is read and written through the folder's own file system: the new one is written aside
    and renamed over the old one, so a reader sees one or the other.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _file(self, path):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def exists(self, table: str) -> bool:
        fs, path = self._file(f"{self.root}/{table}/_current")
        return fs.exists(path)

    def read(self, table: str) -> DataFrame:
        fs, path = self._file(f"{self.root}/{table}/_current")
        stream = fs.open(path)
        try:
            name = bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()
        return self.spark.read.parquet(f"{self.root}/{table}/{name}")

    def write(self, table: str, df: DataFrame) -> DataFrame:
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{table}/{name}")
        fs, aside = self._file(f"{self.root}/{table}/_next-{name}")
        out = fs.create(aside, True)
        out.write(bytearray(name.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(aside, self._file(f"{self.root}/{table}/_current")[1], options)
        return self.spark.read.parquet(f"{self.root}/{table}/{name}")

    def append(self, table: str, df: DataFrame) -> DataFrame:
        return self.write(table, self.read(table).unionByName(df) if self.exists(table) else df)


def viewer_rows(pages: DataFrame) -> DataFrame:
    """(id, html): a list item per page, its title or else its URL, escaped."""
    from ..functions.html import html_escape

    label = html_escape(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("final_url")))
    return pages.select("id", F.concat(F.lit('<li><a href="'), html_escape("final_url"), F.lit('">'), label, F.lit("</a></li>")).alias("html"))

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from webloom.cli import main
from webloom.functions import robots as R
from webloom.operators import pacing, policy, store
from webloom.plans.crawl import crawl
from webloom.schema import CrawlOptions, load_options
from webloom.sources.fetch import fetch_from_table, make_fetcher
from webloom.sources.fixture import fixture_site
from webloom.sql import register, robots_allowed

ROBOTS = [
    ("User-agent: *\nDisallow: /private\nAllow: /private/ok\n", "bot", "http://h/private/x", False),
    ("User-agent: *\nDisallow: /private\nAllow: /private/ok\n", "bot", "http://h/private/ok/1", True),
    ("User-agent: *\nDisallow: /*.pdf$", "bot", "http://h/a.pdf", False),
    ("User-agent: *\nDisallow: /*.pdf$", "bot", "http://h/a.pdf?x", True),
    ("User-agent: foo\nDisallow: /\nUser-agent: *\nDisallow:", "foobot/1.0 (x)", "http://h/", False),
    ("User-agent: foo\nUser-agent: foobot\nDisallow: /a\n\nUser-agent: foo\nDisallow: /b", "foobot", "http://h/b", True),
    ("User-agent: *\nDisallow: /a\nUser-agent: *\nDisallow: /b", "x", "http://h/a", True),
    ("# c\nUser-agent: * # all\nDisallow: /a # no\n", "x", "http://h/a", False),
    ("Disallow: /a", "x", "http://h/a", True),
    ("User-agent: *\nDisallow: /a\nAllow: /a", "x", "http://h/a", True),
    ("User-agent: *\nDisallow: /q?x=1", "x", "http://h/q?x=12", False),
    ("", "x", "http://h/a", True),
]


def test_robots(spark):
    df = spark.createDataFrame(ROBOTS, "t string, a string, u string, w boolean")
    assert all(r.g == r.w for r in df.withColumn("g", robots_allowed(F.col("t"), F.col("a"), F.col("u"))).collect())
    for agent in {a for _, a, _, _ in ROBOTS}:
        rows = [(f"http://h{i}", t, u.replace("//h", f"//h{i}"), w) for i, (t, a, u, w) in enumerate(ROBOTS) if a == agent]
        df = spark.createDataFrame(rows, "origin string, body string, url string, w boolean")
        rules, _ = R.rule_table(df.select("origin", "body"), agent)
        assert all(r.allowed == r.w for r in R.robots_verdicts(df.select("url", "w"), rules).collect())


def test_robots_delay_sitemaps_status(spark):
    text = "Sitemap: http://s/1\nUser-agent: *\nCrawl-delay: x\nCrawl-delay: 2.5\nDisallow: /\nsitemap: http://s/2"
    _, delays = R.rule_table(spark.createDataFrame([("o", text)], "origin string, body string"), "b")
    row = delays.first()
    assert (row.crawl_delay, row.sitemaps) == (2.5, ["http://s/1", "http://s/2"])
    df = spark.createDataFrame([(200, bytearray(b"\xef\xbb\xbfUser-agent: *")), (404, None), (503, None), (None, None)], "s int, b binary")
    got = [r[0] for r in df.select(R.fetched_rules(F.col("s"), F.col("b"))).collect()]
    assert got == ["User-agent: *", "", "User-agent: *\nDisallow: /", "User-agent: *\nDisallow: /"]


def test_pacing_equals_simulation(spark):
    rng, rows, want = random.Random(3), [], {}
    for d in "abc":
        free = rest = float("-inf")
        for i in range(40):
            arrive, delay = rng.randint(0, 60) / 2, rng.randint(0, 6) / 2
            pause = arrive + rng.randint(1, 9) if rng.random() < 0.2 else None
            start = max(arrive, free, rest)
            free, rest = start + delay, max(rest, pause if pause is not None else rest)
            want[d, i] = start
            rows.append((d, i, arrive, delay, pause))
    df = spark.createDataFrame(rows, "domain string, seq int, arrive double, delay double, pause double")
    for block_rows in (1000, 50, 7, 1):
        got = pacing.pacing_slots(df, pause_until="pause", block_rows=block_rows).collect()
        assert len(got) == 120 and all(r.start == want[r.domain, r.seq] and r.waited == r.start - r.arrive for r in got)


def test_pacing_blocks(spark):
    """Blocks rise with the order, whatever its spread, and one domain is in many of them."""
    rng = random.Random(5)
    rows = [("a", int(10 ** rng.uniform(0, 12)) * 5000 + i, 0.0, 1.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "domain string, seq long, arrive double, delay double")
    got = df.select("seq", pacing.block_of(df, "seq", 100, 2000).alias("b")).orderBy("seq").collect()
    assert [r.b for r in got] == sorted(r.b for r in got) and len({r.b for r in got}) >= 15
    assert max(sum(r.b == b for r in got) for b in {r.b for r in got}) <= 300
    out = pacing.pacing_slots(df, block_rows=100).orderBy("seq").collect()
    assert [r.start for r in out] == [float(i) for i in range(2000)]
    assert pacing.pacing_slots(df.limit(0), block_rows=1).count() == 0


def test_policy(spark):
    df = spark.createDataFrame([(429, "rate_limited"), (503, "server_error"), (404, "client_error"), (200, None), (None, None)], "s int, w string")
    assert all(r.g == r.w for r in df.withColumn("g", policy.status_category("s")).collect())
    one = lambda c: spark.range(1).select(c).first()[0]
    none = F.lit(None).cast("string")
    assert one(policy.should_retry(F.lit(503), none, F.lit(0))) and not one(policy.should_retry(F.lit(503), none, F.lit(2)))
    assert not one(policy.should_retry(F.lit(404), F.lit("client_error"), F.lit(0))) and one(policy.should_retry(F.lit(None).cast("int"), F.lit("dns_error"), F.lit(1)))
    assert one(policy.backoff_seconds(F.lit(10))) == 60.0 and one(policy.backoff_seconds(F.lit(3), F.lit("7"))) == 7.0
    assert one(policy.retry_after_seconds(F.lit("soon"))) is None and one(policy.retry_after_seconds(F.lit("Mon, 01 Jan 2001 00:00:00 GMT"))) == 0.0
    ips = spark.createDataFrame([("10.0.0.1", True), ("8.8.8.8", False), ("::1", True), ("x", True), ("2606:4700::1111", False)], "ip string, w boolean")
    assert all(r.g == r.w for r in ips.withColumn("g", policy.is_blocked_address("ip")).collect())


def test_upsert_first_wins_verify(spark):
    old = spark.createDataFrame([(1, 1, "a", "old")], "id long, job_id long, normalized_url string, title string")
    new = spark.createDataFrame([(5, 1, "a", "t1", 1), (6, 1, "a", "t2", 2), (7, 1, "b", "t3", 3)], "id long, job_id long, normalized_url string, title string, seq long")
    got = {r.normalized_url: (r.id, r.title) for r in store.upsert_pages(old, new, "seq").collect()}
    assert got == {"a": (1, "t2"), "b": (7, "t3")}
    found = spark.createDataFrame([(1, "http://h/x", 1), (1, "http://h/x#f", 2), (1, "nope", 3), (1, "http://h/y", 4)], "job_id long, url string, pos int")
    frontier = spark.createDataFrame([(1, "http://h/y")], "job_id long, normalized_url string")
    assert [(r.url, r.pos) for r in store.enqueue(frontier, found, ["pos"]).collect()] == [("http://h/x", 1)]
    rows = spark.createDataFrame([(1, None, ""), (2, None, "x"), (3, "t", "bad")], "id long, body_text string, body_sha256 string").withColumn("final_url", F.lit("u")).withColumn("job_id", F.lit(1))
    assert [r.outcome for r in store.verify(rows).orderBy("id").collect()] == ["missing body_sha256", "missing body_text", "mismatch"]


def test_redirects(spark):
    site = fixture_site(spark)
    urls = spark.createDataFrame([("http://site.test" + p,) for p in ("/redirect", "/redirect-loop", "/page", "/none", "/large")] + [("ftp://x/",), ("http://site.test/page#f",)], "url string")
    got = {r.url: r for r in fetch_from_table(urls, site).collect()}
    r = got["http://site.test/redirect"]
    assert (r.final_url, r.status_code, len(r.redirects)) == ("http://site.test/page2", 200, 1)
    assert (got["http://site.test/redirect-loop"].error_category, len(got["http://site.test/redirect-loop"].redirects)) == ("redirect_loop", 1)
    assert got["http://site.test/none"].status_code == 404 and got["ftp://x/"].error_category == "unsupported_scheme"
    assert got["http://site.test/large"].error_category == "response_too_large" and got["http://site.test/page#f"].status_code == 200


def test_golden_crawl(spark):
    out = crawl(spark, fixture_site(spark), "http://site.test/page", CrawlOptions(max_pages=10, retry_count=0))
    pages = {r.normalized_url: (r.url, r.depth) for r in out.pages.collect()}
    assert pages == {
        "http://site.test/page": ("http://site.test/page", 0),
        "http://site.test/page2": ("http://site.test/redirect", 1),
        "http://site.test/deep/page3?a=1&b=2": ("http://site.test/deep/page3?b=2&a=1", 2),
    }
    assert sorted(r.status for r in out.frontier.collect()) == ["fetched"] * 4 + ["skipped"]
    assert [r.category for r in out.failures.collect()] == ["robots_disallowed"] and out.status == "finished"


def test_options(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('max_pages = 7\n[crawl]\nallowed_domains = "a.test"\n')
    o = load_options(str(f), max_depth=5, max_pages=None)
    assert (o.max_pages, o.max_depth, o.allowed_domains, o.redirect_limit) == (7, 5, ("a.test",), 5)
    with pytest.raises(FileNotFoundError):
        load_options(str(tmp_path / "none.toml"))
    with pytest.raises(ValueError, match="unknown fetcher"):
        make_fetcher("nope")


def test_cli(spark, tmp_path, capsys):
    at = ["--store", str(tmp_path / "s")]
    assert main(["nope"]) == 2
    assert main([*at, "crawl", "http://site.test/page2", "--max-pages", "3"], spark) == 0
    assert main([*at, "verify"], spark) == 0
    assert main([*at, "stats"], spark) == 0
    assert main([*at, "export", "--output", str(tmp_path / "o.json")], spark) == 0
    assert main([*at, "scrape", "http://site.test/unavailable"], spark) == 1
    assert main([*at, "robots", "http://site.test/blocked"], spark) == 0
    assert '"allowed": false' in capsys.readouterr().out


def test_cli_resume_and_delete(spark, tmp_path, capsys):
    """A job of a budget of one page, resumed to its end; each save adds a delta; a job goes with its rows."""
    from webloom.cli import Job

    at = ["--store", str(tmp_path / "s")]
    assert main([*at, "resume"], spark) == 1
    assert main([*at, "crawl", "http://site.test/page", "--max-pages", "1"], spark) == 0
    job = Job(spark, str(tmp_path / "s"))
    assert job.read("pages").count() == 1 and job.read("crawl_jobs").first().status == "budget_reached"
    assert main([*at, "resume", "--max-pages", "9"], spark) == 0
    assert {r.normalized_url for r in job.read("pages").collect()} == {"http://site.test/page", "http://site.test/page2", "http://site.test/deep/page3?a=1&b=2"}
    assert sorted(r.status for r in job.read("frontier").collect()) == ["fetched"] * 4 + ["skipped"]
    assert [r.category for r in job.read("failures").collect()] == ["robots_disallowed"] and not store.has_pending_work(job.read("frontier"), 1)
    job.delete(1)
    assert all(job.read(n).count() == 0 for n in job.tables) and job.next_id() == 1


def test_older_stores_are_brought_up(spark, tmp_path):
    from webloom.cli import SCHEMA_VERSION, Job

    old = store.Snapshots(spark, str(tmp_path / "s"))
    old.write("version", spark.createDataFrame([(1,)], "version int"))
    old.write("pages", spark.createDataFrame([(3, 7, "http://a/", "http://a/")], "id long, job_id long, url string, normalized_url string"))
    old.write("crawl_jobs", spark.createDataFrame([(7, "http://a/", "finished")], "id long, seed_url string, status string"))
    for _ in range(2):
        job = Job(spark, str(tmp_path / "s"))
        assert job.version() == SCHEMA_VERSION and job.next_id() == 8
        assert [(r.id, r.normalized_url, r.title) for r in job.read("pages").collect()] == [(3, "http://a/", None)]
    job.files.put(f"{job.root}/_version", "2")  # as if cut short before the last step was noted
    assert Job(spark, str(tmp_path / "s")).read("pages").count() == 1
    job.files.put(f"{job.root}/_version", "99")
    with pytest.raises(ValueError, match="version 99"):
        Job(spark, str(tmp_path / "s"))


def test_as_of(spark):
    from webloom.operators.as_of import as_of

    rng = random.Random(4)
    versions = [(rng.choice("ab"), float(rng.randrange(400)), i) for i in range(60)] + [(None, 1.0, 99), ("a", None, 98)]
    asked = [(i, rng.choice(["a", "a", "a", "b", "c", None]), float(rng.randrange(420))) for i in range(300)] + [(300, "a", None)]
    got = as_of(spark.createDataFrame(asked, "id long, k string, at double"), spark.createDataFrame(versions, "k string, since double, body int"), "k", "at", "since", 25.0).collect()
    want = {}
    for i, k, at in asked:
        fit = [(s, b) for o, s, b in versions if o is not None and o == k and s is not None and at is not None and s <= at < s + 25]
        want[i] = max(fit) if fit else None
    assert {r.id: (r.held.since, r.held.body) if r.held else None for r in got} == want and len(got) == len(asked)


def test_due_queue_over_micro_batches(spark, tmp_path):
    """The schedule equals a simulation, and is the same however the rows are dealt over batches."""
    import datetime
    import heapq

    from webloom.streaming import due_queue as Q

    rng = random.Random(9)
    rows = [(rng.choice("ab"), i, datetime.datetime.fromtimestamp(d, datetime.UTC).replace(tzinfo=None), float(d), rng.choice([0, 0, 1, 2, 5]), rng.choice([0.0, 40.0])) for i, d in enumerate(sorted(rng.randrange(5000) for _ in range(120)))]
    want = set()
    for d in "ab":
        heap, free = [(r[3], r[1], 0, r[4], r[5]) for r in rows if r[0] == d], float("-inf")
        heapq.heapify(heap)
        while heap:
            due, i, n, fails, pause = heapq.heappop(heap)
            start, failed = max(due, free), n < fails
            free = start + max(3.0, pause if failed else 0.0)
            want.add((d, i, n, due, start, failed))
            if failed and n < 2:
                heapq.heappush(heap, (start + min(60.0, 20.0 * 2**n), i, n + 1, fails, pause))
    df = spark.createDataFrame(rows, Q.ITEMS)
    whole = Q.whole_schedule(df, str(tmp_path / "w"), delay=3.0, base=20.0)
    assert {tuple(r) for r in whole.collect()} == want
    parts = tmp_path / "parts"
    end = spark.createDataFrame([("", -1, datetime.datetime(2000, 1, 1), 0.0, 0, 0.0)], Q.ITEMS)
    for k in range(4):
        part = df.where(f"id >= {k * 30} and id < {k * 30 + 30}")
        (part.unionByName(end) if k == 3 else part).coalesce(1).write.mode("append").parquet(str(parts))
    stream = Q.due_schedule(spark.readStream.schema(Q.ITEMS).option("maxFilesPerTrigger", 1).parquet(str(parts)), delay=3.0, base=20.0).where("id >= 0")
    q = stream.writeStream.format("memory").queryName("starts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert {tuple(r) for r in spark.table("starts").collect()} == want


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT normalize_url('HTTP://A.test/?utm_x=1') n, domain_of('http://u@A.test:1/x') d, robots_allowed('User-agent: *\\nDisallow: /', 'b', 'http://h/') r").first()
    assert tuple(row) == ("http://a.test/", "a.test", False)
    assert spark.sql("SELECT * FROM parse_links('<a href=\"/x\">', 'http://h/')").first().link == "http://h/x"


def test_streams_equal_batch(spark, tmp_path):
    from webloom.streaming import crawl_stream as S

    rows = pd.DataFrame([(d, i, float(i // 3), 1.0, None) for d in "ab" for i in range(9)], columns=["domain", "seq", "arrive", "delay", "pause_until"])
    df = spark.createDataFrame(rows, "domain string, seq long, arrive double, delay double, pause_until double")
    df.write.parquet(str(tmp_path / "in"))
    stream = S.paced(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("paced").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.domain, r.seq): r.start for r in spark.table("paced").collect()}
    want = {(r.domain, r.seq): r.start for r in pacing.pacing_slots(df, pause_until="pause_until").collect()}
    assert got == want
    urls = spark.createDataFrame([(1, "http://h/x"), (1, "http://h/x#y"), (1, "bad")], "job_id long, url string")
    urls.write.parquet(str(tmp_path / "u"))
    q = S.new_urls(spark.readStream.schema(urls.schema).parquet(str(tmp_path / "u"))).writeStream.format("memory").queryName("urls").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("urls").count() == 1


def test_modules_import_without_a_session():
    """The entry module is read before a session is made."""
    import subprocess
    import sys
    from pathlib import Path

    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 50)"], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=120)
    assert got.stdout.strip() == "True", got.stderr[-500:]

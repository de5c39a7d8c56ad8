from pyspark.sql import functions as F

from webloom.functions import url as U
from webloom.sql import register

NORMAL = [
    ("HTTP://Example.COM:80/a/../b/?b=2&a=1#x", "http://example.com/b/?a=1&b=2"),
    ("https://example.com:443", "https://example.com/"),
    ("https://user:pw@example.com:8443/p", "https://example.com:8443/p"),
    ("https://example.com/?utm_source=x&UTM_Medium=y&gclid=1&q=z", "https://example.com/?q=z"),
    ("https://example.com/a//b/./c", "https://example.com/a/b/c"),
    ("https://example.com/a/.", "https://example.com/a"),
    ("https://example.com/../..", "https://example.com/"),
    ("https://example.com/a b?x=a b&x=a+b&y", "https://example.com/a%20b?x=a+b&x=a+b&y="),
    ("https://example.com/%7Eu/*~", "https://example.com/%7Eu/%2A~"),
    ("http://[2001:DB8::1]:8080/x", "http://[2001:db8::1]:8080/x"),
    ("https://example.com/?a-b=2&a=1", "https://example.com/?a=1&a-b=2"),
    ("https://example.com/?q=%zz&r=%41", "https://example.com/?q=%25zz&r=A"),
    ("  https://a_b.com/x  ", "https://a_b.com/x"),
    ("https://münchen.de/ü", "https://xn--mnchen-3ya.de/%C3%BC"),
    ("ftp://h/", "ftp://h/"),
    ("/relative", None),
    ("http://", None),
    ("https://example.com:99999/", None),
    ("https://example.com:port/", None),
    (None, None),
]


def test_normalize(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(NORMAL)], "i int, u string")
    got = {r.i: r.n for r in df.select("i", U.normalize_url("u").alias("n")).collect()}
    assert [got[i] for i in range(len(NORMAL))] == [w for _, w in NORMAL]


def test_sql_function_agrees(spark):
    register(spark)
    spark.createDataFrame([(i, u) for i, (u, _) in enumerate(NORMAL)], "i int, u string").createOrReplaceTempView("urls_of_test")
    got = {r.i: r.n for r in spark.sql("SELECT i, normalize_url(u) AS n FROM urls_of_test WHERE normalize_url(u) IS NOT NULL OR i >= 0").collect()}
    assert [got[i] for i in range(len(NORMAL))] == [w for _, w in NORMAL]


def test_scope_and_domains(spark):
    rows = [("https://www.example.com/x", True), ("http://example.com", True), ("https://other.org/", False), ("https://www.com/", False), ("https://sub.example.com", False), ("http://b.test:81/", True)]
    df = spark.createDataFrame(rows, "u string, w boolean").withColumn("g", U.in_scope("u", ["www.example.com", "b.test"]))
    assert all(r.g == r.w for r in df.collect())
    assert spark.range(1).select(U.canonical_domain(F.lit("www.com"))).first()[0] == "www.com"


def test_origins(spark):
    rows = [("http://a.test/x", "http://a.test:80/y", True), ("http://a.test/", "https://a.test/", False), ("http://a.test:81/", "http://a.test/", False), ("http://A.test", "http://a.test", True)]
    df = spark.createDataFrame(rows, "a string, b string, w boolean")
    assert all(r.g == r.w for r in df.withColumn("g", U.same_origin("a", "b")).collect())
    keys = [r[0] for r in df.select(U.robots_key("b")).collect()]
    assert keys[0] == "http://a.test:80"


RESOLVED = [
    ("http://a/b/c/d?q", "g", "http://a/b/c/g"),
    ("http://a/b/c/d?q", "./g/", "http://a/b/c/g/"),
    ("http://a/b/c/d?q", "/g", "http://a/g"),
    ("http://a/b/c/d?q", "//g/x", "http://g/x"),
    ("http://a/b/c/d?q", "?y", "http://a/b/c/d?y"),
    ("http://a/b/c/d?q", "../g#s", "http://a/b/g"),
    ("http://a/b/c/d?q", "../../../g", "http://a/g"),
    ("http://a/b/c/d?q", "https://x/y?z#f", "https://x/y?z"),
    ("http://a", "g", "http://a/g"),
    ("http://a/b", "ftp://x/y", "ftp://x/y"),
]


def test_resolve(spark):
    df = spark.createDataFrame(RESOLVED, "b string, h string, w string").withColumn("g", U.resolve("b", "h"))
    assert [(r.h, r.g) for r in df.collect() if r.g != r.w] == []


def test_errors_and_request_parts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(U.url_error(F.lit("ftp://x/"))) == "unsupported_scheme"
    assert one(U.url_error(F.lit("http:///x"))) == "malformed_url"
    assert one(U.url_error(F.lit("http://x/"))) is None
    assert one(U.origin_form(F.lit("http://x?q=1"))) == "/?q=1"
    assert one(U.origin_form(F.lit("http://x/a b"))) is None
    assert one(U.host_header(F.lit("https://x:443/"))) == "x"
    assert one(U.host_header(F.lit("https://x:444/"))) == "x:444"

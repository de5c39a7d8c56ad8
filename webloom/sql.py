"""The engine's functions under SQL names.

Scalar functions are the Column expressions of ``functions``: a call in SQL text is replaced by the
expression over its arguments when the query is analysed, so Catalyst sees it whole and there is no
second implementation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.java_gateway import ensure_callback_server_started
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .functions import robots as R
from .functions import url as U
from .functions.html import PAGE, _parse_series, parse_page
from .shipping import ship


class _Builder:
    """A Scala function from argument expressions to an expression, around a Python function of Columns."""

    def __init__(self, spark: SparkSession, f: Callable[..., Column]):
        self.session, self.utils, self.f = spark._jsparkSession, spark._jvm.org.apache.spark.sql.classic.ExpressionUtils, f

    def apply(self, arguments):
        given = [Column(self.utils.column(arguments.apply(i))) for i in range(arguments.size())]
        return self.session.expression(self.f(*given)._jc)

    class Java:
        implements = ["scala.Function1"]


def robots_allowed(text: Column, user_agent: Column, url: Column) -> Column:
    """Whether a robots.txt text lets an agent fetch a URL."""
    items = R.parse_robots(text)
    rules = R.rules_of(items, R.chosen_group(items, R.product_token(user_agent)))
    target = U.robots_target(url)

    def best(kind):
        hits = F.filter(rules, lambda r: (r["kind"] == kind) & F.regexp_like(target, R.rule_regex(r["pattern"])))
        return F.coalesce(F.array_max(F.transform(hits, lambda r: R.specificity(r["pattern"]))), F.lit(-1))

    return (best("disallow") < 0) | (best("allow") >= best("disallow"))


FUNCTIONS = {"normalize_url": U.normalize_url, "domain_of": U.domain, "canonical_domain": lambda url: U.canonical_domain(U.domain(url)), "robots_allowed": robots_allowed}


def register(spark: SparkSession) -> None:
    """normalize_url(url), domain_of(url), canonical_domain(url), robots_allowed(text, user_agent, url),
    parse_html(body, url, content_type) and the table function parse_links(html, url)."""
    ship(spark)
    gateway = spark.sparkContext._gateway
    ensure_callback_server_started(gateway)
    registry = spark._jsparkSession.sessionState().functionRegistry()
    for name, f in FUNCTIONS.items():
        registry.createOrReplaceTempFunction(name, _Builder(spark, f), "python_udf")
    spark.udf.register("parse_html", F.pandas_udf(_parse_series, PAGE))
    spark.udtf.register("parse_links", ParseLinks)


@udtf(returnType="pos int, link string")
class ParseLinks:
    def eval(self, html: str, url: str):
        yield from enumerate(parse_page(html, url)["links"] or [])

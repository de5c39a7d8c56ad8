"""robots.txt as Column expressions: parse, choose a group, compile and match rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .url import _c, robots_key, robots_target

_ITEM = "array<struct<g:int,k:string,v:string>>"


def parse_robots(text: Column | str) -> Column:
    """array<struct<g,k,v>>: the directives in order; g numbers the groups, sitemaps have g = -1.

    A user-agent line after a directive opens a new group; unknown keys vanish.
    """
    lines = F.split(_c(text), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "(?s)#.*$", "")))
    pairs = F.transform(
        F.filter(bare, lambda x: F.contains(x, F.lit(":"))),
        lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "(?s)^([^:]*)", 1))).alias("k"), F.trim(F.regexp_extract(x, "(?s)^[^:]*:(.*)$", 1)).alias("v")),
    )
    known = F.filter(pairs, lambda p: p["k"].isin("user-agent", "allow", "disallow", "crawl-delay") | ((p["k"] == "sitemap") & (p["v"] != "")))
    start = F.struct(F.lit(0).alias("g"), F.lit(False).alias("open"), F.array().cast(_ITEM).alias("out"))

    def step(a, p):
        agent, site = p["k"] == "user-agent", p["k"] == "sitemap"
        g = F.when(agent & a["open"], a["g"] + 1).otherwise(a["g"])
        value = F.when(agent, F.lower(p["v"])).otherwise(p["v"])
        item = F.struct(F.when(site, F.lit(-1)).otherwise(g).alias("g"), p["k"].alias("k"), value.alias("v"))
        is_open = F.when(site, a["open"]).otherwise(~agent)
        return F.struct(g.alias("g"), is_open.alias("open"), F.concat(a["out"], F.array(item)).alias("out"))

    return F.aggregate(known, start, step, lambda a: a["out"])


def product_token(user_agent: Column | str) -> Column:
    """First word before the slash, lower-case."""
    return F.regexp_extract(F.lower(_c(user_agent)), r"^\s*([^\s/]*)", 1)


def chosen_group(items: Column, token: Column) -> Column:
    """The group for a product token: longest agent that begins it, first among equals; else the
    last ``*`` group; else null."""
    agents = F.filter(items, lambda x: (x["k"] == "user-agent") & (x["v"] != ""))
    named = F.filter(agents, lambda x: (x["v"] != "*") & token.startswith(x["v"]))
    best = F.array_max(F.transform(named, lambda x: F.struct(F.char_length(x["v"]).alias("n"), (-x["g"]).alias("g"))))
    star = F.array_max(F.transform(F.filter(agents, lambda x: x["v"] == "*"), lambda x: x["g"]))
    return F.coalesce(-best["g"], star)


def crawl_delay(items: Column, group: Column) -> Column:
    """The last valid delay of the group."""
    numbers = F.transform(F.filter(items, lambda x: (x["g"] == group) & (x["k"] == "crawl-delay")), lambda x: x["v"].try_cast("double"))
    return F.try_element_at(F.filter(numbers, lambda d: d.isNotNull()), F.lit(-1))


def sitemaps(items: Column) -> Column:
    return F.transform(F.filter(items, lambda x: x["k"] == "sitemap"), lambda x: x["v"])


def rules_of(items: Column, group: Column) -> Column:
    """array<struct<kind,pattern>> of the group's rules; empty values add none."""
    kept = F.filter(items, lambda x: (x["g"] == group) & x["k"].isin("allow", "disallow") & (x["v"] != ""))
    return F.coalesce(F.transform(kept, lambda x: F.struct(x["k"].alias("kind"), x["v"].alias("pattern"))), F.array().cast("array<struct<kind:string,pattern:string>>"))


def rule_regex(pattern: Column | str) -> Column:
    """The pattern as a regular expression: ``*`` is anything, a final ``$`` anchors."""
    pattern = _c(pattern)
    body = F.regexp_replace(pattern, r"\$$", "")
    body = F.regexp_replace(body, r"([\\^$.|?+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), "$").otherwise(""))


def specificity(pattern: Column | str) -> Column:
    return F.char_length(F.regexp_replace(_c(pattern), r"\$+$", ""))


def fetched_rules(status: Column, body: Column) -> Column:
    """The text that a robots fetch counts as: 2xx its body, 4xx none, all else a full ban."""
    text = F.regexp_replace(F.make_valid_utf8(body.cast("string")), "^﻿", "")
    return F.when(status.between(200, 299), text).when(status.between(400, 499), "").otherwise("User-agent: *\nDisallow: /")


def rule_table(robots: DataFrame, user_agent: str, text_col: str = "body", origin_col: str = "origin") -> tuple[DataFrame, DataFrame]:
    """From one text per origin: (origin, kind, regex, specificity) and (origin, crawl_delay, sitemaps)."""
    items = robots.withColumn("items_", parse_robots(text_col)).withColumn("g_", chosen_group(F.col("items_"), product_token(F.lit(user_agent))))
    delays = items.select(origin_col, crawl_delay(F.col("items_"), F.col("g_")).alias("crawl_delay"), sitemaps(F.col("items_")).alias("sitemaps"))
    rules = items.select(origin_col, F.explode(rules_of(F.col("items_"), F.col("g_"))).alias("r"))
    return rules.select(origin_col, F.col("r.kind").alias("kind"), rule_regex("r.pattern").alias("regex"), specificity("r.pattern").alias("specificity")), delays


def robots_verdicts(urls: DataFrame, rules: DataFrame, url_col: str = "url", origin_col: str = "origin") -> DataFrame:
    """``urls`` with disallow_len, allow_len (-1: no match) and allowed.

    Equi-join on the origin; a URL's matches are reduced inside its row by packing an origin's rules
    in one array, so the URL side is neither exploded nor shuffled when the rule side is small.
    """
    return verdicts_by(urls.withColumn("o_", robots_key(url_col)), rules, "o_", url_col, origin_col).drop("o_")


def verdicts_by(urls: DataFrame, rules: DataFrame, by: str, url_col: str = "url", origin_col: str = "origin") -> DataFrame:
    """The same for URLs that name their set of rules in the column ``by``."""
    packed = rules.groupBy(F.col(origin_col).alias("p_")).agg(F.collect_list(F.struct("kind", "regex", "specificity")).alias("rules_"))
    out = urls.withColumn("t_", robots_target(url_col)).join(packed, F.col(by) == F.col("p_"), "left").drop("p_")

    def best(kind):
        hits = F.filter("rules_", lambda r: (r["kind"] == kind) & F.regexp_like(F.col("t_"), r["regex"]))
        return F.coalesce(F.array_max(F.transform(hits, lambda r: r["specificity"])), F.lit(-1))

    out = out.withColumn("disallow_len", best("disallow")).withColumn("allow_len", best("allow"))
    return out.withColumn("allowed", (F.col("disallow_len") < 0) | (F.col("allow_len") >= F.col("disallow_len"))).drop("t_", "rules_")

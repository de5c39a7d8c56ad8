"""Per-domain pacing as a blocked max-plus scan.

A request's start follows start_i = max(due_i, start_{i-1} + delay_{i-1}), where a pause seen before i
raises due_i. A request is so a map of the time at which its domain is free, x -> max(x + a, b), with
a = delay_i and b = due_i + delay_i. Such maps compose: (a, b) then (a', b') is (a + a', max(b + a', b')),
and composition is associative. A domain's requests are cut into blocks by order; each block is
composed to one map (and its greatest pause) by a scan of its own rows, the few block maps of a domain
are scanned, and each block then starts at the time and pause that the scan hands it. No task holds a
whole domain: a task holds a block.

Blocks are ranges of the order at boundaries that follow the data's quantiles, so a domain with half
of all requests is in many blocks of about ``block_rows`` rows. Only (domain, block) maps meet by domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block, about; and the ranges that quantiles cut the order into at the most, each of
#: which is cut evenly into as many blocks as its rows ask for.
BLOCK_ROWS = 100_000
MOST_RANGES = 512


def block_of(rows: DataFrame, order: str, block_rows: int, n: int) -> Column:
    """The number of the block that a row is in: it rises with ``order``, and equal orders share a block.

    The boundaries are approximate quantiles, and even cuts between them; where they lie changes the
    size of the blocks, and no result.
    """
    blocks = -(-n // block_rows)
    ranges = min(MOST_RANGES, blocks)
    if ranges <= 1:
        return F.lit(0).cast("long")
    at = F.col(order).cast("double")
    edges = rows.agg(F.percentile_approx(at, [i / ranges for i in range(ranges + 1)], 4 * ranges).alias("e")).first().e
    edges = sorted(set(edges or []))
    if len(edges) < 2:
        return F.lit(0).cast("long")
    table = F.array(*map(F.lit, edges))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(edges).bit_length()))])
    # the place among the edges, by halving them
    place = F.aggregate(steps, F.lit(0), lambda p, step: F.when((p + step <= len(edges)) & (F.try_element_at(table, p + step) <= at), p + step).otherwise(p))
    place, cuts = F.greatest(F.least(place, F.lit(len(edges) - 1)), F.lit(1)).cast("int"), -(-blocks // ranges)
    low, high = F.try_element_at(table, place), F.try_element_at(table, place + 1)
    part = F.floor((at - low) / (high - low) * cuts)
    return F.coalesce(place.cast("long") * (cuts + 2) + F.greatest(F.least(part, F.lit(cuts)), F.lit(-1)), F.lit(0).cast("long"))


def pacing_slots(requests: DataFrame, domain: str = "domain", order: str = "seq", arrive: str = "arrive", delay: str = "delay", pause_until: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``requests`` with start and waited. ``pause_until`` names a column that holds, on the rows
    of a pause, until when the domain rests; it binds the requests after that row.

    ``order`` tells the requests of a domain apart. A null domain is a domain of its own; null
    arrivals wait for nothing but the slot.
    """
    n = requests.count()
    rows = requests.withColumn("block_", block_of(requests, order, block_rows, n))
    inner = Window.partitionBy(domain, "block_").orderBy(order)
    past, now = inner.rowsBetween(Window.unboundedPreceding, -1), inner.rowsBetween(Window.unboundedPreceding, 0)
    low = F.lit(float("-inf"))
    pause = low if pause_until is None else F.coalesce(F.max(pause_until).over(past), low)
    # within a block: the sum of delays before a row, the pause seen before it, and the latest
    # due - sum up to it, so that start = sum + max(that, what the block begins with)
    rows = rows.withColumn("sum_", F.coalesce(F.sum(delay).over(past), F.lit(0.0))).withColumn("rest_", pause)
    rows = rows.withColumn("top_", F.max(F.greatest(F.coalesce(F.col(arrive), low), F.col("rest_")) - F.col("sum_")).over(now))
    if n <= block_rows:  # one block: nothing to hand on
        out = rows.withColumn("start", F.col("sum_") + F.col("top_"))
        return out.withColumn("waited", F.col("start") - F.col(arrive)).drop("block_", "sum_", "rest_", "top_")
    # the map of a block: free time after it is max(free before + sum, top + sum), and a pause that is
    # handed in binds its first request, as any earlier one would
    whole = rows.groupBy(domain, "block_").agg(F.sum(delay).alias("a_"), F.max("top_").alias("t_"), (F.max(pause_until) if pause_until else F.max(low)).alias("p_"))
    over = Window.partitionBy(domain).orderBy("block_")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("s_", F.coalesce(F.sum("a_").over(before), F.lit(0.0))).withColumn("rest_in", F.coalesce(F.max("p_").over(before), low))
    # what a block's first request is due at the least: the pause handed in; less the delays before the block
    whole = whole.withColumn("m_", F.greatest("rest_in", "t_") - F.col("s_"))
    whole = whole.withColumn("free_in", F.coalesce(F.max("m_").over(before), low) + F.col("s_"))
    hand = whole.select(F.col(domain).alias("d_"), F.col("block_").alias("k_"), F.greatest("free_in", "rest_in").alias("in_"))
    out = rows.join(hand, rows[domain].eqNullSafe(hand["d_"]) & (rows["block_"] == hand["k_"]))
    out = out.withColumn("start", F.col("sum_") + F.greatest("top_", "in_"))
    return out.withColumn("waited", F.col("start") - F.col(arrive)).drop("block_", "sum_", "rest_", "top_", "d_", "k_", "in_")


def retry_schedule(attempts: DataFrame, key: str, order: str, base: float = 1.0, most: float = 60.0) -> DataFrame:
    """Attempts numbered per key, with the back-off that follows each."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return attempts.withColumn("attempt", n).withColumn("backoff", F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.col("attempt") - 1)))

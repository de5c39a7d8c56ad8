"""Chains of a redirect table by pointer doubling.

A row knows where its URL leads after some hops; joined with the row of that URL it knows where it
leads after twice as many. A chain of n hops so takes about log2(n) joins instead of n, each on narrow
rows, and rows that have come to an end join no more. What still moves after more hops than there are
redirects is in a cycle, or leads into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chase(redirects: DataFrame, save: Callable[[DataFrame], DataFrame], limit: int | None = None) -> DataFrame:
    """Of redirects (src, dst), one row per src: (url, final_url, hops, error).

    A chain that ends has its last URL and number of hops. One that runs into a cycle has the error
    ``redirect_loop``, the least URL of that cycle, and no hops; one of more than ``limit`` hops has
    ``too_many_redirects`` beside its end. Null ends vanish; of rows that share a src the least dst counts.
    ``save`` writes a table and reads it back: lineage is cut every round.
    """
    one = redirects.where("src is not null and dst is not null").groupBy("src").agg(F.min("dst").alias("dst"))
    # least: the least URL among those passed so far, for the name of a cycle
    rows = save(one.select("src", F.col("dst").alias("at"), F.lit(1).cast("long").alias("hops"), F.least("src", "dst").alias("least"), F.lit(False).alias("ended")))
    n = rows.count()
    reach = 1
    while True:
        move, rest = rows.where("not ended"), rows.where("ended")
        on = rows.select(F.col("src").alias("src_"), F.col("at").alias("at_"), F.col("hops").alias("hops_"), F.col("least").alias("least_"), F.col("ended").alias("ended_"))
        met = move.join(on, F.col("at") == F.col("src_"), "left")
        more = F.col("src_").isNotNull()
        met = met.select(
            "src", F.coalesce("at_", "at").alias("at"), F.when(more, F.col("hops") + F.col("hops_")).otherwise(F.col("hops")).alias("hops"),
            F.least("least", F.coalesce("least_", "least")).alias("least"), F.when(more, F.col("ended_")).otherwise(True).alias("ended"),
        )
        rows = save(rest.unionByName(met))
        reach *= 2
        if reach > n or rows.where("not ended").isEmpty():
            break
    # a row that still moves stands inside its cycle now, where the row it stands on has passed the whole of it
    cycle = rows.where("not ended")
    name = cycle.select(F.col("src").alias("src_"), F.col("at").alias("at_"))
    inside = cycle.join(name.select("at_").distinct(), F.col("src") == F.col("at_"), "left_semi").select(F.col("src").alias("src_"), F.col("least").alias("name"))
    loops = cycle.join(inside, F.col("at") == F.col("src_")).select(F.col("src").alias("url"), F.col("name").alias("final_url"), F.lit(None).cast("long").alias("hops"), F.lit("redirect_loop").alias("error"))
    far = F.lit(None).cast("string") if limit is None else F.when(F.col("hops") > limit, "too_many_redirects")
    return rows.where("ended").select(F.col("src").alias("url"), F.col("at").alias("final_url"), "hops", far.alias("error")).unionByName(loops)

"""The version that held at a time: an as-of join with an end of validity.

Versions and requests of a key are laid out in one order of time and the last version is carried on.
A version holds for ``ttl`` seconds, so time is cut into slices of that length: a request needs the
versions of its own slice and the last one of the slice before. Rows are dealt by (key, slice), so that a key
with a large share of all requests is spread over its slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(requests: DataFrame, versions: DataFrame, key: str, at: str, since: str, ttl: float) -> DataFrame:
    """``requests`` with a column ``held``: a struct of the columns of the version of its key with the
    latest ``since`` that is not after ``at`` and less than ``ttl`` seconds old; null where there is none.

    ``at`` and ``since`` are seconds. Versions of equal key and time are one (the greatest row). Null
    keys and times meet nothing.
    """
    fields = [c for c in versions.columns if c != key]
    named = F.struct(*[F.col(c) for c in [since, *[c for c in fields if c != since]]])
    slice_ = lambda c: F.floor(F.col(c) / ttl).cast("long")
    v = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("k_"), F.col(since).cast("double").alias("t_"), slice_(since).alias("s_"), named.alias("v_"))
    v = v.groupBy("k_", "s_", "t_").agg(F.max("v_").alias("v_"))
    handed = v.groupBy("k_", "s_").agg(F.max_by("v_", "t_").alias("v_"), F.max("t_").alias("t_")).withColumn("s_", F.col("s_") + 1)
    v = v.unionByName(handed.select(*v.columns))
    row = F.struct(*[F.col(c) for c in requests.columns])
    none = F.lit(None).cast(dict(v.dtypes)["v_"])
    q = requests.select(F.col(key).alias("k_"), slice_(at).alias("s_"), F.col(at).cast("double").alias("t_"), none.alias("v_"), row.alias("r_"))
    both = q.unionByName(v.withColumn("r_", F.lit(None).cast(dict(q.dtypes)["r_"])))
    # at equal times the version comes first
    past = Window.partitionBy("k_", "s_").orderBy("t_", F.col("r_").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("v_", F.last("v_", ignorenulls=True).over(past)).where("r_ is not null")
    holds = F.col("k_").isNotNull() & (F.col("t_") - F.col(f"v_.{since}") < ttl)
    return both.select("r_.*", F.when(holds, F.col("v_")).alias("held"))

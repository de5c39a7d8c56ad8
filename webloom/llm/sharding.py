"""Two-pass external shuffle into shards.

Pass 1 scatters rows uniformly into memory-sized buckets by seeded hashes: the shard is the
winner of a rendezvous of (seed, shard, id), so the id and the number of shards alone decide it
and one more shard takes rows only into itself; the bucket within the shard is a hash of the id
and the text, so the same table gives the same shards however its files lie. (Only rows of an id and
text that more than one in a thousand rows share are also spread by their place in the scan: equal rows,
of which it does not matter which one lies where.) Pass 2 takes one bucket at a time, puts
it in canonical order, Fisher-Yates shuffles it by a generator seeded with (seed, shard, bucket)
and writes it. A row's slot is its bucket's offset in the shard plus its place in the bucket.

Memory: buckets are dealt to tasks by their number, so each task has one of them (several, one after
the other, beyond ``MOST_TASKS``); hashing would put many into some tasks. Their number grows with the
input and a bucket has about ``bucket_bytes``: more in a shard that one id makes larger than the others, as
the id alone decides the shard, but at most ``shards`` times that. Offsets come from a window over bucket
counts per shard, not from the driver.

Defined results: null text has size 1 and CRC 0; null ids are one key; repeated rows each get a
slot; an empty table gives an empty result. Extra columns are carried in the files, inside the
struct ``row``, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.window import Window

from . import common as C

SEED = 17
BUCKET_BYTES = 16 << 20
MOST_TASKS = 50_000


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard of greatest hash for the key."""
    if shards == 1:
        return F.lit(0)
    best = F.greatest(*[F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("h"), F.lit(i).alias("i")) for i in range(shards)])
    return best["i"]


def _shuffled(seed: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = pa.compute.sort_indices(table, sort_keys=[("mix", "ascending"), ("crc", "ascending"), ("size", "ascending")])
        rng = np.random.Generator(np.random.PCG64([seed, table["shard"][0].as_py(), table["bucket"][0].as_py()]))
        walk = rng.permutation(len(table))  # Fisher-Yates
        table = table.take(order.take(pa.array(walk)))
        return table.drop_columns(["mix", "place"]).append_column("pos", pa.array(np.arange(len(table)), pa.int64()))

    return run


def shuffle_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes the shards under the shared scratch folder and returns what was written.

    Columns: row (the whole input row), size long, crc long, shard int, grown_shard int, bucket
    int, slot long. Rows of a bucket lie together in a file, in slot order.
    """
    spark = docs.sparkSession
    C.ship(spark)
    key, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    name = F.xxhash64(F.lit(seed + 2), key, text)
    names = docs.select(name.alias("name"), size.alias("size")).groupBy("name").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    with C.Scratch(spark) as s:
        names = s.write(names)
        total, n = names.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        often = [r.name for r in names.where((F.col("n") > 1) & (F.col("n") * C.HOT_SHARE > n)).select("name").collect()]  # fewer than HOT_SHARE
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    place = F.when(name.isin(often), F.monotonically_increasing_id()).otherwise(0) if often else F.lit(0)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        size.alias("size"),
        F.crc32(text).alias("crc"),
        rendezvous(key, shards, seed).alias("shard"),
        rendezvous(key, shards + 1, seed).alias("grown_shard"),
        F.xxhash64(F.lit(seed + 1), key).alias("mix"),
        F.pmod(F.xxhash64(name, place), F.lit(buckets)).cast("int").alias("bucket"),
    )
    with C.Scratch(spark) as s:
        placed = rows.withColumn("place", (F.col("shard") * buckets + F.col("bucket")).cast("int"))
        out = placed.repartitionById(min(shards * buckets, MOST_TASKS), F.col("place")).groupBy("place").applyInArrow(_shuffled(seed), _ddl(rows))
        out = s.write(out, keep=True)
        counts = out.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = s.write(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), keep=True)
    return out.join(counts, ["shard", "bucket"]).withColumn("slot", F.col("base") + F.col("pos")).drop("base", "pos")


def _ddl(rows: DataFrame) -> StructType:
    kept = [f for f in rows.schema.fields if f.name != "mix"]
    return StructType(kept).add("pos", LongType())

"""Exact dedup: an extendible-hash index on shared files, with byte comparison of chains.

DataFrame functions only. Texts count as equal when identical after all blanks are deleted.

1. Index records (id, code points, 64-bit key, SHA-256) of all rows go to a shared file. They
   are narrow; texts are not shuffled.
2. The directory starts with one bucket. While a bucket holds more than ``capacity`` distinct
   keys, it splits by one more bit of the key; the directory doubles when that bucket was as
   deep as the directory. The driver sees only counts of at most 2**max_depth cells. At full
   depth a bucket overflows instead; its owner aggregates it externally, so no case is lost.
3. Each owner task takes a range of buckets (a key range), and the directory alone says which
   records go to it: those of keys that more than one row has, and their texts, read again.
4. Owners build a chain per key, one link per digest, and compare the bytes of all texts of a link.
   Records and texts of a hot key (more than a thousandth of all rows, so at most a thousand
   keys) are aggregated before they travel, by the same rule: a group of copies of any size is
   a few rows.

Defined results: null text is an empty text, and all empty texts are one group; the longest
original (code points), then smallest id stays; null ids come last; of repeated rows (same id
and length) exactly one stays; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 50_000
MAX_DEPTH = 16
SMALL_ROWS = 200_000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), C.BLANKS, "")


def directory(counts: dict[int, int], capacity: int, max_depth: int) -> tuple[int, list[int]]:
    """Global depth and, for each directory entry, its bucket; from counts by max_depth-bit prefix.

    Buckets are numbered in key order, so that a range of buckets is a range of keys.
    """
    depth, work, done = 0, [(0, 0, sorted(counts.items()))], []
    while work:
        local, prefix, cells = work.pop()
        if sum(n for _, n in cells) <= capacity or local == max_depth:
            done.append((local, prefix))
            continue
        depth = max(depth, local + 1)  # the directory doubles
        bit = max_depth - local - 1
        for side in (1, 0):
            work.append((local + 1, prefix * 2 + side, [c for c in cells if c[0] >> bit & 1 == side]))
    entries: list[int] = []
    for bucket, (local, _) in enumerate(done):
        entries += [bucket] * (1 << (depth - local))
    return depth, entries


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, small_rows: int = SMALL_ROWS, hot_share: int = C.HOT_SHARE) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size long, kept boolean, text_sha256, bucket."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    with C.Scratch(spark) as s:
        norm = normalised(F.col("text"))
        each = docs.select("id", F.char_length(F.coalesce("text", F.lit(""))).alias("cp"), norm.alias("norm"))
        records = s.write(each.select("id", "cp", F.xxhash64("norm").alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("uid")))
        keys = s.write(records.groupBy("key").agg(F.count("*").alias("n")))
        cell = F.shiftrightunsigned("key", 64 - max_depth).cast("int")
        cells = keys.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("n").alias("rows")).collect()  # at most 2**max_depth
        total = sum(r.rows for r in cells)
        depth, entries = directory({r.cell: r.n for r in cells}, capacity, max_depth)
        owners = min(max(entries) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        entry = F.shiftrightunsigned("key", 64 - depth).cast("int") if depth else F.lit(0)
        book = F.broadcast(spark.createDataFrame([(e, b, b * owners // (max(entries) + 1)) for e, b in enumerate(entries)], "entry int, bucket int, owner int"))

        def placed(rows):
            return rows.withColumn("entry", entry).join(book, "entry").drop("entry")

        # keys that more than one row has: their records and their texts, with the same columns
        shared, hot = keys.where("n > 1"), F.col("n") * hot_share > total
        order = F.struct((-F.col("cp")).alias("cp"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uid").alias("uid"))
        wanted = C.small_side(shared, small_rows)
        own = records.join(wanted, "key").select("key", "n", "sha", order.alias("head"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("string").alias("norm"), F.lit(0).cast("long").alias("texts"))
        text = docs.select(norm.alias("norm")).withColumn("key", F.xxhash64("norm")).join(wanted, "key")
        text = text.select("key", "n", F.unhex(F.sha2("norm", 256)).alias("sha"), F.lit(None).cast(own.schema["head"].dataType).alias("head"), F.lit(0).cast("long").alias("size"), "norm", F.lit(1).cast("long").alias("texts"))
        both = own.unionByName(text)
        link = [F.min("head").alias("head"), F.sum("size").alias("size"), F.min("norm").alias("low"), F.max("norm").alias("high"), F.sum("texts").alias("texts")]
        some = both.where(~hot).drop("n")
        if not shared.where(hot).isEmpty():
            few = both.where(hot).groupBy("key", "sha").agg(*link)
            bounds = F.explode(F.arrays_zip(F.array("low", "high").alias("norm"), F.array("texts", F.lit(0).cast("long")).alias("texts"), F.array("size", F.lit(0).cast("long")).alias("size"))).alias("x")
            some = some.unionByName(few.select("key", "sha", "head", bounds).select("key", "sha", "head", "x.size", "x.norm", "x.texts"))
        chains = placed(some).repartitionById(owners, F.col("owner")).groupBy("owner", "bucket", "key", "sha").agg(*link)
        bad = F.raise_error(F.lit("texts of one digest differ, or the input changed between two reads"))
        same = F.col("low").eqNullSafe(F.col("high")) & (F.col("size") == F.col("texts"))
        index = s.write(chains.select("key", "sha", "head", F.when(same, F.col("size")).otherwise(bad.cast("long")).alias("size")))
        alone = F.struct((-F.col("cp")).alias("cp"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uid").alias("uid"))
        out = C.split_join(records, index, ["key", "sha"], F.col("size") * hot_share > total, "left")
        out = placed(out.withColumn("head", F.coalesce("head", alone))).select(
            F.col("id").alias(id_col),
            F.col("head.id").alias("keep_id"),
            F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
            (F.col("uid") == F.col("head.uid")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
            "bucket",
        )
        return s.write(out, keep=True)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that ``exact_dedup`` keeps. Rows are named by (id, digest)."""
    verdict = exact_dedup(docs, id_col, text_col, **options)
    names = verdict.groupBy(F.col(id_col).alias("id"), F.col("text_sha256").alias("key")).agg(F.sum(F.col("kept").cast("long")).alias("stay"), F.count("*").alias("n"))
    text = F.col(f"`{text_col}`").cast("string")
    longest = F.struct(F.char_length(F.coalesce(text, F.lit(""))).alias("cp"), text.alias("text"))
    return C.keep_named(docs, names, F.col(f"`{id_col}`"), F.sha2(normalised(text), 256), longest)

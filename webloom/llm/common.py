"""What the operators of this folder share: scratch tables, code shipping, word hashing.

Scratch tables are Parquet in the folder that the cluster names in ``spark.checkpoint.dir``
(a folder of our own only where that is unset), so they survive a lost executor.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping

#: Rows of an Arrow batch where the session says nothing.
BATCH_ROWS = 2000
#: The six characters that part words in every operator here.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir``, or a temporary one where unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="webloom-"))
    return jsc.getCheckpointDir().get().rstrip("/")


class Scratch:
    """Tables written once and read back; all but the kept ones go when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        self.root = f"{shared_dir(spark)}/webloom-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def write(self, df: DataFrame, keep: bool = False, **options) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        writer = df.write.options(**options)
        writer.parquet(path)
        if keep:
            self._fs(path).deleteOnExit(self._path(path))
        else:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _path(self, path):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def __exit__(self, *_) -> None:
        for path in self.paths:
            self._fs(path).delete(self._path(path), True)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, and bound what a worker holds at a time:
    whole texts travel, so Arrow batches of 10,000 rows (the default) would be large."""
    shipping.ship(spark)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, str(BATCH_ROWS))


def give_back() -> None:
    """Return memory that is free to the system; Arrow and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """``run`` over Arrow batches, in worker processes that all operators of a session share: what a
    task has freed goes back to the system before the next one and at its end."""

    def all_(batches):
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return all_


#: A join side of fewer rows than this is broadcast; above it, the join shuffles.
SMALL_ROWS = 200_000


def small_side(df: DataFrame, small_rows: int = SMALL_ROWS) -> DataFrame:
    """The narrow table, marked for broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.limit(small_rows + 1).count() <= small_rows else df


#: A key of more than one in so many rows is hot; there can be no more hot keys than this.
HOT_SHARE = 1000


def split_join(left: DataFrame, right: DataFrame, keys: list[str], hot: Column, how: str = "inner") -> DataFrame:
    """left.join(right, keys, how), "inner" or "left", where right has one row per key.

    ``hot`` tells, by columns of right, the keys of more than one in HOT_SHARE rows of left. These are
    few by arithmetic, so their rows of right are broadcast and no task gets all rows of one key.
    """
    few = right.where(hot)
    if few.isEmpty():
        return left.join(right, keys, how)
    far = left.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(right.where(~hot), keys, how)
    return left.join(F.broadcast(few), keys).unionByName(far)


def text_key(text: Column) -> Column:
    """16 bytes that name a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def keep_named(docs: DataFrame, names: DataFrame, id_: Column, key: Column, order: Column | None = None, small_rows: int = SMALL_ROWS) -> DataFrame:
    """The rows of docs, all columns of whatever name, that stay by ``names``: (id, key, stay, n).

    Rows are named by (id, key), ids may be null or repeat. Of the n rows of a name all stay (``stay``
    is n), none (0) or one, the greatest by ``order``. Names that are not there stay.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_.alias("id"), key.alias("key"), (F.lit(0) if order is None else order).alias("order"))
    with Scratch(spark) as s:
        names = s.write(names.where("stay < n"), keep=True)
    apart = lambda t, how: rows.join(t, rows["id"].eqNullSafe(t["id_"]) & (rows["key"] == t["key_"]), how)
    told = names.select(F.col("id").alias("id_"), F.col("key").alias("key_"), "stay")
    out = apart(small_side(told, small_rows), "left_anti").select("row.*")
    one = told.where("stay > 0")
    if one.isEmpty():
        return out
    first = apart(small_side(one, small_rows), "left_semi").groupBy("id", "key").agg(F.max_by("row", "order").alias("row"))
    return out.unionByName(first.select("row.*"))


# ---------------------------------------------------------------- words as 64-bit hashes

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random value for each byte, and the powers of an odd number for the place in a word.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE_BASE = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[32, 9, 10, 11, 12, 13]] = True
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S30, S27, S31 = np.uint64(30), np.uint64(27), np.uint64(31)
CHUNK_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> S30)) * MIX1
    x = (x ^ (x >> S27)) * MIX2
    return x ^ (x >> S31)


def powers(n: int, base: np.uint64 = PLACE_BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def strings(raw: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The texts raw[off[i]:off[i+1]] as an Arrow column; nothing is copied."""
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int32)), pa.py_buffer(raw)])


def chunks(off: np.ndarray, most: int = CHUNK_BYTES):
    """Runs of documents of about ``most`` bytes; a longer document is a run of its own."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(raw: np.ndarray, off: np.ndarray, blank: np.ndarray = IS_BLANK):
    """Of the texts raw[off[i]:off[i+1]]: word starts, word ends (exclusive), words per text; ``blank``
    says of each byte whether it parts words."""
    solid = ~blank[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[off] = True
    before = np.zeros(len(raw), dtype=bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.zeros(len(raw), dtype=bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    at = np.searchsorted(starts, off)
    return starts, ends, np.diff(at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each word, after mapping its bytes by ``table``."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    within = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(at, lens)
    solid = raw[within + np.repeat(starts, lens)]
    val = BYTE_VALUE[table[solid]] * powers(int(lens.max()))[within]
    return mixed(np.add.reduceat(val, at) + lens.astype(np.uint64))


SHINGLE_BASE = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct ``width``-word shingles, A-Z lower-cased.

    A text of fewer words has one shingle, of all its words; one without words has none.
    """
    starts, ends, per = word_spans(raw, off)
    words = word_hashes(raw, starts, ends)
    top = np.cumsum(per)
    base = top - per
    mult = powers(width + 1, SHINGLE_BASE)
    n = len(words)
    full = np.zeros(max(n - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        full += words[k : n - width + 1 + k] * mult[k]
    full = mixed(full + np.array([width], np.uint64) * mult[width])
    out = []
    for a, m in zip(base.tolist(), per.tolist()):
        if m >= width:
            out.append(np.unique(full[a : a + m - width + 1]))
        elif m:
            h = (words[a : a + m] * mult[:m]).sum(dtype=np.uint64, keepdims=True)
            out.append(mixed(h + np.array([m], np.uint64) * mult[width]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def zip_bytes(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def unzip_array(b: bytes, n: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype=dtype)



"""Tables that change: base and delta files by bucket, merged when read.

A row belongs to the bucket of its key's hash. A save writes the new rows of the touched buckets only,
as one delta; a reader merges base and deltas of the buckets that have deltas and takes the others as
they are. Compaction rewrites the buckets with many deltas as new bases, and expiry removes files that
no kept version names. A version is a small JSON manifest (which folders hold which bucket); the name
of the current one is swapped by a rename, so a reader sees a whole version, and a save that fails
leaves the table as it was. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Deltas of a bucket from which on it is compacted, and versions that readers may still be at.
COMPACT_FROM, KEEP_VERSIONS = 8, 2


class Files:
    """Small files and folders through the file system of their path."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def at(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def exists(self, path: str) -> bool:
        fs, p = self.at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self.at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def get(self, path: str) -> str:
        fs, p = self.at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        """The whole text or none of it: written aside, then renamed over what is there."""
        fs, aside = self.at(f"{path}-{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(aside, self.at(path)[1], options)

    def drop(self, path: str) -> None:
        fs, p = self.at(path)
        fs.delete(p, True)


class DeltaTable:
    """Rows of ``schema`` under ``root``, the last save of a ``key`` wins; columns of ``oldest`` keep
    the least value that they had. Saved rows that share a key are told apart by ``order``."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: list[str], oldest: tuple[str, ...] = (), order: str | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.schema, self.key, self.oldest, self.order, self.buckets = spark.createDataFrame([], schema).schema, key, oldest, order, buckets

    def version(self) -> dict:
        """The current manifest: number, buckets, and for each bucket its folders, oldest first."""
        if not self.files.exists(f"{self.root}/_current"):
            return {"number": 0, "buckets": self.buckets, "parts": {}}
        return json.loads(self.files.get(f"{self.root}/{self.files.get(f'{self.root}/_current')}"))

    def _commit(self, number: int, buckets: int, parts: dict) -> None:
        name = f"_version-{number:012d}.json"
        self.files.put(f"{self.root}/{name}", json.dumps({"number": number, "buckets": buckets, "parts": parts}, sort_keys=True))
        self.files.put(f"{self.root}/_current", name)

    def _write(self, rows: DataFrame, number: int, buckets: int) -> tuple[str, list[str]]:
        """Writes the rows by bucket; the folder's name and the buckets that got rows."""
        folder = f"part-{number:012d}-{uuid.uuid4().hex[:8]}"
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int")
        # a bucket with many rows is dealt over several tasks by the session's advisory size
        rows.withColumn("bucket_", bucket).hint("rebalance", "bucket_").write.partitionBy("bucket_").parquet(f"{self.root}/{folder}")
        return folder, [n.removeprefix("bucket_=") for n in self.files.names(f"{self.root}/{folder}") if n.startswith("bucket_=")]

    def _part(self, folder: str, buckets: list[str]) -> DataFrame:
        paths = [f"{self.root}/{folder}/bucket_={b}" for b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths).withColumn("seq_", F.lit(int(folder.split("-")[1])).cast("long"))

    def _merged(self, rows: DataFrame) -> DataFrame:
        """The last row of each key, with the least of the oldest columns; partial aggregates."""
        rest = [c for c in self.schema.names if c not in (*self.key, *self.oldest)]
        when = F.struct("seq_", *([self.order] if self.order else []))
        last = F.max_by(F.struct(F.lit(0).alias("none_"), *rest), when).alias("r")
        out = rows.groupBy(*self.key).agg(last, *[F.min(c).alias(c) for c in self.oldest])
        return out.select(*[F.col(f"r.{c}").alias(c) if c in rest else F.col(c) for c in self.schema.names])

    def read(self) -> DataFrame:
        parts = self.version()["parts"]
        sets: dict[str, list[str]] = {}
        for b, folders in parts.items():
            for f in folders:
                sets.setdefault(f, []).append(b)
        alone = {f: [b for b in bs if len(parts[b]) == 1 and f.startswith("part") and self._is_base(f)] for f, bs in sets.items()}
        plain = [self._part(f, bs).drop("seq_") for f, bs in alone.items() if bs]
        mixed = [self._part(f, [b for b in bs if b not in set(alone[f])]) for f, bs in sets.items() if len(alone[f]) < len(bs)]
        out = plain + ([self._merged(reduce(DataFrame.unionByName, mixed))] if mixed else [])
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], self.schema)

    def _is_base(self, folder: str) -> bool:
        """Whether a folder holds one row a key: a compaction's does, a save's may not."""
        return folder.endswith("-base")

    def exists(self) -> bool:
        return self.version()["number"] > 0

    def save(self, rows: DataFrame, compact_from: int = COMPACT_FROM) -> dict:
        """Adds rows as one delta and compacts the buckets that have many; the new manifest."""
        v = self.version()
        number, parts = v["number"] + 1, dict(v["parts"])
        folder, touched = self._write(rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]), number, v["buckets"])
        for b in touched:
            parts[b] = [*parts.get(b, []), folder]
        self._commit(number, v["buckets"], parts)
        return self.compact(compact_from) if any(len(p) > compact_from for p in parts.values()) else self.version()

    def compact(self, more_than: int = 1) -> dict:
        """Rewrites the buckets of more than so many folders as one base each; no other bucket is read."""
        v = self.version()
        many = [b for b, p in v["parts"].items() if len(p) > more_than]
        if not many:
            return v
        sets: dict[str, list[str]] = {}
        for b in many:
            for f in v["parts"][b]:
                sets.setdefault(f, []).append(b)
        rows = self._merged(reduce(DataFrame.unionByName, [self._part(f, bs) for f, bs in sets.items()]))
        number = v["number"] + 1
        folder, touched = self._write(rows, number, v["buckets"])
        fs, path = self.files.at(f"{self.root}/{folder}")
        fs.rename(path, self.files.at(f"{self.root}/{folder}-base")[1])
        self._commit(number, v["buckets"], v["parts"] | {b: [f"{folder}-base"] for b in touched})
        return self.version()

    def replace(self, rows: DataFrame) -> dict:
        """The rows, one a key, instead of all that the table holds."""
        v = self.version()
        folder, touched = self._write(self._merged(rows.withColumn("seq_", F.lit(0).cast("long"))), v["number"] + 1, v["buckets"])
        fs, path = self.files.at(f"{self.root}/{folder}")
        fs.rename(path, self.files.at(f"{self.root}/{folder}-base")[1])
        self._commit(v["number"] + 1, v["buckets"], {b: [f"{folder}-base"] for b in touched})
        return self.version()

    def expire(self, keep: int = KEEP_VERSIONS) -> list[str]:
        """Removes older manifests than the last ``keep``, and the bucket folders that none of these names,
        those of saves that never ended included; what was removed."""
        names = self.files.names(self.root)
        versions = [n for n in names if n.startswith("_version-") and n.endswith(".json")]
        kept = versions[-keep:]
        used = {(f, b) for n in kept for b, p in json.loads(self.files.get(f"{self.root}/{n}"))["parts"].items() for f in p}
        gone = [n for n in versions if n not in kept]
        for folder in (n for n in names if n.startswith("part-")):
            held = [n for n in self.files.names(f"{self.root}/{folder}") if n.startswith("bucket_=")]
            dead = [n for n in held if (folder, n.removeprefix("bucket_=")) not in used]
            gone += [folder] if len(dead) == len(held) else [f"{folder}/{n}" for n in dead]
        for n in gone:
            self.files.drop(f"{self.root}/{n}")
        return gone

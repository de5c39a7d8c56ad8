"""A table as a data source of its own: pushed filters when read, a commit in two phases when written.

``spark.read.format("webloom_table").schema(...).load(path)`` and ``df.write.format("webloom_table")``
(append or overwrite), also ``writeStream``. Tasks write part files that nobody sees; the driver's commit
writes one manifest that names them and the least and greatest values of their columns. A job that fails, or a
task that runs twice, leaves only files without a name (``vacuum``). A micro-batch that is run again after
its commit finds its manifest and adds nothing, so a stream's rows arrive once.

Readers take the files that manifests name, leave out those whose values cannot meet the filters, and
filter the rest while they are scanned, batch by batch: one partition a file. Filters on whole numbers,
texts and booleans are pushed where ``spark.sql.python.filterPushdown.enabled`` is set; what is not stays
with Spark. The path is one that pyarrow's file systems open, in a folder that all executors share. One
writer at a time may overwrite; any number may append.
"""

from __future__ import annotations

import dataclasses
import json
import time
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import BooleanType, ByteType, IntegerType, LongType, ShortType, StringType, StructType

from ..shipping import ship

COMMITS, BATCH_ROWS = "_commits", 4096
#: Longer texts are no bounds of a file.
LONGEST_BOUND = 128
BOUNDED = (ByteType, ShortType, IntegerType, LongType, StringType)
PUSHED = (*BOUNDED, BooleanType)
COMPARED = {D.EqualTo: "==", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


class Folder:
    """The files of a table."""

    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")

    def names(self, below: str = "") -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{below}".rstrip("/"), allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == pafs.FileType.File)

    def commits(self) -> list[str]:
        return [n for n in self.names(COMMITS) if n.endswith(".json")]

    def put(self, name: str, value) -> None:
        """The whole file or none of it."""
        self.fs.create_dir(f"{self.root}/{COMMITS}", recursive=True)
        aside = f"{self.root}/{COMMITS}/{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(aside) as out:
            out.write(json.dumps(value).encode())
        self.fs.move(aside, f"{self.root}/{COMMITS}/{name}")

    def get(self, name: str):
        with self.fs.open_input_stream(f"{self.root}/{COMMITS}/{name}") as f:
            return json.loads(f.read())

    def files(self) -> list[dict]:
        """What the manifests name, from the last overwrite on."""
        out: list[dict] = []
        for manifest in map(self.get, self.commits()):
            out = manifest["files"] + ([] if manifest["overwrite"] else out)
        return out

    def next(self) -> int:
        return 1 + max((int(n.split("-")[0]) for n in self.commits()), default=0)

    def remove(self, files: Iterable[str]) -> None:
        for f in files:
            if self.fs.get_file_info(f"{self.root}/{f}").type == pafs.FileType.File:
                self.fs.delete_file(f"{self.root}/{f}")


def vacuum(path: str, older_than: float = 86400.0) -> list[str]:
    """Removes part files that no manifest names and that are ``older_than`` seconds old: their names."""
    folder = Folder(path)
    named, limit = {f["name"] for n in folder.commits() for f in folder.get(n)["files"]}, time.time() - older_than
    lost = [n for n in folder.names() if n.startswith("part-") and n not in named]
    lost = [n for n in lost if folder.fs.get_file_info(f"{folder.root}/{n}").mtime.timestamp() <= limit]
    folder.remove(lost)
    return lost


class CommittedTable(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "webloom_table"

    def schema(self):
        files = Folder(self.options["path"]).files()
        if not files:
            raise ValueError("a table without files needs a schema")
        return files[-1]["schema"]

    def reader(self, schema):
        return _Reader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], schema, overwrite)

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(self.options["path"], schema, overwrite, self.options.get("query", "stream"))


# ------------------------------------------------------------------ reading


def may_hold(bounds: dict, name: str, test: str, value) -> bool:
    """Whether a file with these bounds can hold a row that passes."""
    if name not in bounds:
        return True
    low, high = bounds[name]
    if low is None:  # nulls only, and no comparison holds for null
        return test == "null"
    if test == "in":
        return any(low <= v <= high for v in value if v is not None)
    if test in ("==", ">", ">="):
        below = value < high if test == ">" else value <= high
        return below and (test != "==" or low <= value)
    if test in ("<", "<="):
        return low < value if test == "<" else low <= value
    return True


def expression(name: str, test: str, value) -> pc.Expression:
    field = ds.field(name)
    if test == "in":
        return field.isin([v for v in value if v is not None])
    if test in ("null", "not null"):
        return field.is_null() if test == "null" else field.is_valid()
    return {"==": field.__eq__, ">": field.__gt__, ">=": field.__ge__, "<": field.__lt__, "<=": field.__le__}[test](value)


class _Reader(D.DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns, self.tests = path, schema.names, []
        self.pushable = {f.name for f in schema if isinstance(f.dataType, PUSHED)}

    def pushFilters(self, filters):
        for f in filters:
            test = self.test_of(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def test_of(self, f) -> tuple | None:
        """(column, test, value), or None where the filter stays with Spark."""
        column = getattr(f, "attribute", ())
        if len(column) != 1 or column[0] not in self.pushable:
            return None
        if isinstance(f, D.IsNull | D.IsNotNull):
            return column[0], "null" if isinstance(f, D.IsNull) else "not null", None
        if isinstance(f, D.In):
            return column[0], "in", list(f.value)
        if type(f) in COMPARED and f.value is not None:
            return column[0], COMPARED[type(f)], f.value
        return None

    def partitions(self):
        kept = [f["name"] for f in Folder(self.path).files() if all(may_hold(f["bounds"], *t) for t in self.tests)]
        return [D.InputPartition(n) for n in kept] or [D.InputPartition(None)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        folder, wanted = Folder(self.path), None
        for test in self.tests:
            wanted = expression(*test) if wanted is None else wanted & expression(*test)
        data = ds.dataset(f"{folder.root}/{partition.value}", filesystem=folder.fs, format="parquet")
        yield from data.scanner(columns=self.columns, filter=wanted, batch_size=BATCH_ROWS).to_batches()


# ------------------------------------------------------------------ writing


@dataclasses.dataclass
class Part(D.WriterCommitMessage):
    """A file that a task has written; without a name where it had no rows."""

    name: str | None
    rows: int = 0
    bounds: dict = dataclasses.field(default_factory=dict)


def _widen(bounds: dict, batch: pa.RecordBatch, columns: list[str]) -> None:
    for c in columns:
        least = pc.min_max(batch.column(c)).as_py()
        low, high = bounds.get(c, (None, None))
        here = [v for v in (low, high, least["min"], least["max"]) if v is not None]
        bounds[c] = (min(here), max(here)) if here else (None, None)


class _Writing:
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.overwrite, self.schema = path, overwrite, schema.simpleString()
        self.bounded = [f.name for f in schema if isinstance(f.dataType, BOUNDED)]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        folder, name, out, rows, bounds = Folder(self.path), f"part-{uuid.uuid4().hex}.parquet", None, 0, {}
        folder.fs.create_dir(folder.root, recursive=True)
        try:
            for batch in iterator:
                if out is None:
                    out = pq.ParquetWriter(f"{folder.root}/{name}", batch.schema, filesystem=folder.fs)
                out.write_batch(batch)
                rows += batch.num_rows
                _widen(bounds, batch, self.bounded)
        except BaseException:
            if out is not None:
                out.close()
                folder.remove([name])
            raise
        if out is None:
            return Part(None)
        out.close()
        short = {c: b for c, b in bounds.items() if not any(isinstance(v, str) and len(v) > LONGEST_BOUND for v in b)}
        return Part(name, rows, short)

    def manifest(self, messages) -> dict:
        parts = [m for m in messages if m is not None and m.name is not None]
        files = [{"name": m.name, "rows": m.rows, "bounds": m.bounds, "schema": self.schema} for m in parts]
        return {"overwrite": self.overwrite, "files": files}

    def drop(self, messages) -> None:
        Folder(self.path).remove(m.name for m in messages if m is not None and m.name is not None)


class _Writer(_Writing, D.DataSourceArrowWriter):
    def commit(self, messages) -> None:
        folder = Folder(self.path)
        folder.put(f"{folder.next():012d}-{uuid.uuid4().hex}.json", self.manifest(messages))

    def abort(self, messages) -> None:
        self.drop(messages)


class _StreamWriter(_Writing, D.DataSourceStreamArrowWriter):
    def __init__(self, path, schema, overwrite, query):
        super().__init__(path, schema, overwrite)
        self.query = query

    def commit(self, messages, batchId) -> None:
        folder, name = Folder(self.path), f"{self.query}-{batchId:012d}.json"
        if any(n.endswith(f"-{name}") for n in folder.commits()):  # this batch is there already
            self.drop(messages)
        else:
            folder.put(f"{folder.next():012d}-{name}", self.manifest(messages))

    def abort(self, messages, batchId) -> None:
        self.drop(messages)


def register(spark: SparkSession) -> None:
    """Name the source in a session, and let filters reach it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CommittedTable)

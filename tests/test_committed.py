"""The committed table: round trips, failures that leave no rows, pushed filters, streams that arrive once."""

import random

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from webloom.sources import committed as C

SCHEMA = "k long, t string, b boolean, x double, l array<string>, s struct<p:int,q:binary>"


@pytest.fixture(scope="module")
def table(spark):
    C.register(spark)
    return lambda path: spark.read.format("webloom_table").schema(SCHEMA).load(path)


def some_rows(n, seed=1):
    rng = random.Random(seed)
    nul = lambda v: v if rng.random() < 0.8 else None
    return [(nul(i - n // 2), nul(rng.choice(["", "a", "é", "z" * 200])), nul(rng.random() < 0.5), nul(rng.choice([0.5, float("nan")])), nul(["a", None]), nul((i, bytearray(b"\0\xff")))) for i in range(n)]


def test_round_trip_append_overwrite(spark, table, tmp_path):
    path = str(tmp_path / "t")
    assert table(path).collect() == []
    df = spark.createDataFrame(some_rows(50), SCHEMA).repartition(4)
    df.write.format("webloom_table").mode("append").save(path)
    df.where("k = 3").write.format("webloom_table").mode("append").save(path)
    show = lambda d: sorted(map(str, d.collect()))
    assert show(table(path)) == show(df.unionByName(df.where("k = 3")))
    assert show(spark.read.format("webloom_table").load(path)) == show(table(path))
    df.limit(5).write.format("webloom_table").mode("overwrite").save(f"file://{path}")
    assert table(path).count() == 5
    df.where("false").write.format("webloom_table").mode("overwrite").save(path)
    assert table(path).count() == 0


def test_failed_task_leaves_no_rows(spark, table, tmp_path):
    path = str(tmp_path / "t")
    good = spark.createDataFrame(some_rows(20), SCHEMA)
    good.write.format("webloom_table").mode("append").save(path)
    bad = good.repartition(4).withColumn("k", F.when(F.col("k") > 5, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("k")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="stop"):
            bad.write.format("webloom_table").mode(mode).save(path)
        assert table(path).count() == 20
    lost = C.vacuum(path, older_than=0.0)
    assert table(path).count() == 20 and C.vacuum(path, older_than=0.0) == [] and all(n.startswith("part-") for n in lost)


def test_pushed_filters(spark, table, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame(some_rows(200), SCHEMA)
    df.repartitionByRange(5, "k").write.format("webloom_table").mode("append").save(path)
    for test in ("k > 40", "k >= 40 and b", "k < -90 or k is null", "k <= -99", "k in (1, 2, 77)", "t = ''", "t > 'a'", "t is null", "not b", "k <=> null", "x > 0.1", "t = 'é' and k = 500", "k is not null and t like 'z%'"):
        assert sorted(map(str, table(path).where(test).collect())) == sorted(map(str, df.where(test).collect())), test
    reader = C._Reader(path, StructType.fromDDL(SCHEMA))
    left = [D.GreaterThan(("x",), 0.1), D.EqualNullSafe(("k",), None), D.StringStartsWith(("t",), "z"), D.EqualTo(("s", "p"), 1)]
    assert list(reader.pushFilters([*left, D.GreaterThan(("k",), 90)])) == left and len(reader.partitions()) == 1 < len(C.Folder(path).files())


def test_stream_arrives_once(spark, table, tmp_path):
    C.register(spark)
    path, into = str(tmp_path / "t"), str(tmp_path / "in")
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(into)
    source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(into)
    run = lambda at: source.writeStream.format("webloom_table").option("path", path).option("checkpointLocation", str(tmp_path / at)).trigger(availableNow=True).start().awaitTermination(120)
    run("c1")
    ids = lambda: sorted(r.id for r in spark.read.format("webloom_table").schema("id long").load(path).collect())
    assert ids() == list(range(30)) and len(C.Folder(path).commits()) == 3
    run("c2")  # as after a checkpoint that was lost: the same batches again
    assert ids() == list(range(30)) and len(C.Folder(path).commits()) == 3 and C.vacuum(path, older_than=0.0) == []

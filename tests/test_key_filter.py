"""The filtered anti-join against the plain one, and what the filter lets by."""

import random

from pyspark.sql import functions as F

from webloom.operators import key_filter as K
from webloom.operators import store


def keep(spark):
    return lambda t: spark.createDataFrame(t.collect(), t.schema)


def test_filtered_anti_join_equals_the_plain_one(spark):
    rng = random.Random(3)
    key = lambda: (rng.choice([1, 2, None]), rng.choice([None, *"abcdefgh"]))
    for n_rows, n_known in ((40, 30), (0, 30), (40, 0)):
        rows = spark.createDataFrame([(*key(), i) for i in range(n_rows)], "j int, u string, maybe int")
        rows = rows.withColumnRenamed("maybe", "block")  # a column of the filter's own name
        known = spark.createDataFrame([key() for _ in range(n_known)], "j int, u string")
        want = sorted(rows.join(known, ["j", "u"], "left_anti").select(*rows.columns).collect(), key=str)
        for f in (None, K.key_filter(known, ["j", "u"], 30), K.key_filter(known, ["j", "u"], 1)):  # none, roomy, crowded
            assert sorted(K.anti_join(rows, known, ["j", "u"], keep(spark), f).collect(), key=str) == want


def test_filter_refuses_no_key_and_few_others_pass(spark, monkeypatch):
    keys, others = spark.range(20000).select(F.col("id").alias("k")), spark.range(20000, 60000).select(F.col("id").alias("k"))
    first, second = keys.where("k < 5000"), keys.where("k >= 5000")
    grown, whole = K.key_filter(first, ["k"], 20000).add(second), K.key_filter(keys, ["k"], 20000)
    assert sorted(grown.table.collect()) == sorted(whole.table.collect()) and whole.has_room(20000) and not whole.has_room(40000)
    assert whole.mark(keys).where("not maybe").count() == 0
    passed = whole.mark(others).where("maybe").count()
    assert passed < 0.01 * 40000
    monkeypatch.setattr(K, "SMALL_BLOCKS", 0)  # as a large filter: joined by block
    assert whole.mark(others).where("maybe").count() == passed and grown.mark(keys).where("maybe").count() == 20000


def test_enqueue_by_filter(spark):
    frontier = spark.createDataFrame([(1, "http://h/y"), (2, "http://h/x")], "job_id long, normalized_url string")
    found = spark.createDataFrame([(1, "http://h/x", 2), (1, "http://h/x#f", 1), (1, "nope", 3), (1, "http://h/y", 4), (2, "http://h/x", 5)], "job_id long, url string, pos int")
    for known in (None, K.key_filter(frontier, ["job_id", "normalized_url"], 2)):
        assert [(r.job_id, r.url, r.pos) for r in store.enqueue(frontier, found, ["pos"], keep(spark), known).collect()] == [(1, "http://h/x#f", 1)]

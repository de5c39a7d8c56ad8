"""Delta tables, redirect chains and addresses against plain Python."""

import ipaddress
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.operators import policy
from webloom.operators.chains import chase
from webloom.operators.deltas import DeltaTable


def test_delta_table_equals_a_dictionary(spark, tmp_path):
    rng, want = random.Random(2), {}
    t = DeltaTable(spark, str(tmp_path / "t"), "k long, id long, v string, n int", ["k"], oldest=("id",), order="n", buckets=4)
    assert t.read().count() == 0 and not t.exists()
    for save in range(6):
        rows = [(rng.randrange(30) if rng.random() < 0.9 else None, save * 100 + i, rng.choice("abc"), i) for i in range(rng.choice([0, 1, 12]))]
        for k, i, v, n in rows:
            want[k] = (min(i, want[k][0]) if k in want else i, v, n)
        t.save(spark.createDataFrame(rows, "k long, id long, v string, n int"), compact_from=2)
        assert {r.k: (r.id, r.v, r.n) for r in t.read().collect()} == want
        assert t.read().count() == len(want)
    t.compact()
    before = t.version()
    assert all(len(p) == 1 for p in before["parts"].values()) and {r.k: (r.id, r.v, r.n) for r in t.read().collect()} == want
    t.expire(keep=1)
    assert {r.k: (r.id, r.v, r.n) for r in t.read().collect()} == want
    assert len([n for n in t.files.names(t.root) if n.startswith("_version")]) == 1


def test_save_touches_few_buckets_and_fails_whole(spark, tmp_path):
    t = DeltaTable(spark, str(tmp_path / "t"), "k long, v string", ["k"], buckets=8)
    t.save(spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v")))
    first = t.version()["parts"]
    t.save(spark.createDataFrame([(7, "b")], "k long, v string"))
    second = t.version()["parts"]
    assert sum(second[b] != first[b] for b in first) == 1 and {r.v for r in t.read().where("k = 7").collect()} == {"b"}
    bad = spark.range(50).select(F.col("id").alias("k"), F.when(F.col("id") == 49, F.raise_error(F.lit("stop"))).otherwise(F.lit("c")).alias("v"))
    with pytest.raises(Exception, match="stop"):
        t.save(bad)
    assert t.version()["parts"] == second and t.read().where("v = 'c'").count() == 0
    t._write(spark.createDataFrame([(1, "lost")], "k long, v string"), 99, 8)  # as a save that ended before its manifest
    assert any(n.startswith("part-000000000099") for n in t.expire(keep=5))
    assert t.read().count() == 100


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_chase_equals_walking(spark, edges):
    at = {}
    for a, b in edges:
        at[a] = min(b, at.get(a, b))
    want = {}
    for a in at:
        seen, x = [a], a
        while x in at and at[x] not in seen:
            x = at[x]
            seen.append(x)
        if x in at:
            want[a] = (min(seen[seen.index(at[x]) :]), None, "redirect_loop")
        else:
            want[a] = (x, len(seen) - 1, "too_many_redirects" if len(seen) > 4 else None)
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "src long, dst long")
    got = chase(df, lambda t: t.checkpoint() if t.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else spark.createDataFrame(t.collect(), t.schema), limit=3).collect()
    assert {r.url: (r.final_url, r.hops, r.error) for r in got} == want and len(got) == len(want)


def test_addresses_equal_the_library(spark):
    rng = random.Random(1)
    blocks = [ipaddress.ip_network(b) for b in policy.PRIVATE_BLOCKS_V6 + policy.PUBLIC_BLOCKS_V6]
    numbers = [n for b in blocks for a in (int(b.network_address), int(b.broadcast_address)) for n in (a - 1, a, a + 1) if 0 <= n < 1 << 128]
    numbers += [rng.getrandbits(128) >> rng.choice([0, 1, 3, 60, 100]) for _ in range(300)] + [0xFFFF << 32 | rng.getrandbits(32) for _ in range(40)]
    texts = [f(ipaddress.IPv6Address(n)) for n in numbers for f in (str, lambda a: a.exploded.upper())]
    texts += ["::ffff:10.0.0.1", "::ffff:8.8.8.8", "2001:db8::8.8.8.8", "2606:4700::1111%eth0", "64:ff9b::808:808", "1::2::3", "1:2:3", "::1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", ":1::", "12345::", "g::", ":::", "1::256.1.1.1", "1:2:3:4:5:6:7:8:9", "::", "", "x", "10.1.2.3", "8.8.8.8"]
    got = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", policy.is_blocked_address("ip").alias("b"), policy.ipv6_halves("ip").alias("h")).collect()
    for r in got:
        assert r.b == (not policy.public_address(r.ip)), r.ip
        if ":" in r.ip and r.h is not None:
            assert (r.h.hi % 2**64) << 64 | r.h.lo % 2**64 == int(ipaddress.IPv6Address(r.ip.split("%")[0])), r.ip

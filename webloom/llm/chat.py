"""Chat formatting by cumulative-snapshot collapse. DataFrame functions only.

A log that stores a conversation after every turn holds many prefixes of the final one. Each
turn gets a 128-bit hash of its place, role and text; their running XOR along a conversation is
the hash of that turn prefix. A conversation whose full hash is the hash of a proper prefix of
another goes (anti-join); of equal conversations the one of least id stays; the rest is rendered.

Skew: full hashes are plain aggregates. Running hashes are made in blocks of ``block`` turn
numbers and the blocks' totals are chained, so a conversation that holds a third of all rows is
spread over tasks. Prefix hashes and equal conversations are pre-aggregated before exchanges.
A rendered row covers at most one block of turns (``part`` counts them from 0).

Defined results: turns go by (turn, role, text), null turns first; null roles and texts are
empty; rows of a null conversation id are one conversation; repeated turn numbers stay separate
turns; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

BLOCK = 4096


def chat_format(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per block of a maximal conversation: id_col, part, n_turns, n_copies, rendered."""
    spark = turns.sparkSession
    get = lambda c: F.col(f"`{c}`")
    empty = F.lit("")
    rows = turns.select(get(id_col).alias("c"), get(turn_col).alias("t"), F.coalesce(get(role_col), empty).alias("r"), F.coalesce(get(text_col), empty).alias("x"))
    rows = rows.withColumn("b", F.coalesce(F.floor(F.col("t") / block), F.lit(-(2**40))).cast("long"))
    inside = Window.partitionBy("c", "b").orderBy("t", "r", "x")
    along = Window.partitionBy("c").orderBy("b")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    with C.Scratch(spark) as s:
        counts = rows.groupBy("c", "b").agg(F.count("*").alias("k"))
        places = counts.select("c", "b", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"), F.sum("k").over(Window.partitionBy("c")).alias("n"))
        local = rows.withColumn("i", F.row_number().over(inside))
        placed = local.alias("l").join(places.alias("p"), F.expr("l.c <=> p.c and l.b = p.b")).select("l.*", "base", "n").withColumn("pos", F.col("base") + F.col("i"))
        placed = placed.withColumn("h1", F.xxhash64("pos", "r", "x")).withColumn("h2", F.xxhash64(F.lit(1), "x", "pos", "r"))
        placed = s.write(placed.select("c", "b", "pos", "n", "r", "x", "h1", "h2"))
        totals = placed.groupBy("c", "b").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
        carried = totals.select("c", "b", *[F.coalesce(F.bit_xor(h).over(before), F.lit(0)).alias(f"c{h[1]}") for h in ("h1", "h2")])
        run = Window.partitionBy("c", "b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        running = placed.select("c", "b", "pos", "n", *[F.bit_xor(h).over(run).alias(h) for h in ("h1", "h2")])
        running = running.alias("l").join(carried.alias("p"), F.expr("l.c <=> p.c and l.b = p.b"))
        running = running.select("l.c", "pos", "n", F.col("h1").bitwiseXOR(F.col("c1")).alias("h1"), F.col("h2").bitwiseXOR(F.col("c2")).alias("h2"))
        running = s.write(running)
        prefixes = running.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
        full = running.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("c").alias("c"), F.count("*").alias("n_copies"))
        maximal = full.join(prefixes, ["n", "h1", "h2"], "left_anti").select("c", "n_copies")
        kept = placed.alias("l").join(maximal.alias("m"), F.expr("l.c <=> m.c")).select("l.*", "n_copies")
        one = F.concat(F.lit("<|im_start|>"), F.col("r"), F.lit("\n"), F.col("x"), F.lit("<|im_end|>"))
        part = F.floor((F.col("pos") - 1) / block)
        said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("s")))), lambda y: y["s"]), "\n")
        out = kept.groupBy("c", part.cast("long").alias("part"), "n", "n_copies").agg(said.alias("rendered"))
        out = out.select(F.col("c").alias(id_col), "part", F.col("n").alias("n_turns"), "n_copies", "rendered")
        return s.write(out, keep=True)


ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations),
p AS (
  SELECT conv_id, pos, r, x, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(r || chr(31) || x, chr(30)) OVER (PARTITION BY conv_id ORDER BY pos) AS pre
  FROM t),
f AS (SELECT pre, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n GROUP BY pre),
k AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pre = f.pre))
SELECT p.conv_id, (p.pos - 1) // 4096 AS part, p.n AS n_turns, k.n_copies,
       string_agg('<|im_start|>' || r || chr(10) || x || '<|im_end|>', chr(10) ORDER BY p.pos) AS rendered
FROM p JOIN k ON p.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY ALL
"""

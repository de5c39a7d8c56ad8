"""A Bloom filter of keys as a table: what surely is not among many keys need not be joined with them.

The filter is a table of blocks (block, w0..w3) of 256 bits. A key's hash names one block and one bit
in each of its four words, so a probe meets one narrow row. Blocks are bit_or aggregates: they combine on
the map side, and two filters of one size are united by the same aggregate, so that a growing set of keys
adds only its new ones. At ``BITS`` bits a key under a hundredth of the other keys pass by mistake; none
of the keys themselves is ever refused. The number of blocks follows the number of keys. Probing
broadcasts the filter while it has at most ``SMALL_BLOCKS`` blocks and joins by block above that.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, BLOCK_BITS = 12, 256
#: 40 bytes each: 10 MB.
SMALL_BLOCKS = 1 << 18
WORDS = ["w0", "w1", "w2", "w3"]


def _hash(key: list[str]) -> Column:
    return F.xxhash64(*key)


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks).cast("long"))


def _bits(h: Column) -> list[Column]:
    """One bit for each word, from a hash of the hash: the block says nothing of them."""
    again = F.xxhash64(h)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(again, 6 * i).bitwiseAND(63).cast("int")) for i in range(len(WORDS))]


@dataclasses.dataclass(frozen=True)
class KeyFilter:
    """Blocks of the keys that were added, and for how many keys there is room."""

    table: DataFrame
    blocks: int
    key: tuple[str, ...]

    def add(self, rows: DataFrame) -> KeyFilter:
        """With the keys of ``rows`` too: only these are hashed."""
        both = self.table.unionByName(_table(rows, list(self.key), self.blocks))
        return dataclasses.replace(self, table=both.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS]))

    def saved(self, save: Callable[[DataFrame], DataFrame]) -> KeyFilter:
        return dataclasses.replace(self, table=save(self.table))

    def has_room(self, keys: int) -> bool:
        return keys <= self.blocks * BLOCK_BITS // BITS

    def mark(self, rows: DataFrame, name: str = "maybe") -> DataFrame:
        """``rows`` with a boolean: false for keys that surely were not added. Rows whose key is null
        in part are hashed like others."""
        h = _hash(list(self.key))
        table = F.broadcast(self.table) if self.blocks <= SMALL_BLOCKS else self.table
        met = rows.withColumn("block_", _block(h, self.blocks)).join(table.select(F.col("block").alias("b_"), *[F.col(w).alias(f"{w}_") for w in WORDS]), F.col("block_") == F.col("b_"), "left")
        held = F.lit(True)
        for w, bit in zip(WORDS, _bits(h)):
            held = held & (F.col(f"{w}_").bitwiseAND(bit) != 0)
        return met.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(held, F.lit(False)).alias(name))


def _table(rows: DataFrame, key: list[str], blocks: int) -> DataFrame:
    h = F.col("h_")
    hashed = rows.select(_hash(key).alias("h_")).select(_block(h, blocks).alias("block"), *[b.alias(w) for w, b in zip(WORDS, _bits(h))])
    return hashed.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def key_filter(rows: DataFrame, key: list[str], n_keys: int) -> KeyFilter:
    """The filter of the keys of ``rows``, with room for ``n_keys`` distinct ones; more cost only mistakes."""
    blocks = max(1, -(-n_keys * BITS // BLOCK_BITS))
    return KeyFilter(_table(rows, key, blocks), blocks, tuple(key))


def anti_join(rows: DataFrame, known: DataFrame, key: list[str], save: Callable[[DataFrame], DataFrame], of_known: KeyFilter | None = None) -> DataFrame:
    """``rows`` whose key is not in ``known``: a left anti-join by way of two filters.

    Rows that the filter of ``known`` refuses are new and meet nothing (without one, all rows go on). The
    rest are candidates, and a filter of these leaves out nearly all other rows of ``known`` before the
    join shuffles them: what travels follows the candidates, not all that is known. Keys that are null in
    part equal nothing and stay, as in the plain join. ``save`` writes a table and reads it back.
    """
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    marked = save((rows.withColumn("maybe", F.lit(True)) if of_known is None else of_known.mark(rows)).withColumn("maybe", F.col("maybe") & whole))
    candidates = marked.where("maybe").drop("maybe")
    n = candidates.count()
    new = marked.where("not maybe").drop("maybe")
    if n == 0:
        return new
    wanted = key_filter(candidates, key, n).saved(save)
    near = wanted.mark(known.select(*key), "maybe").where("maybe").drop("maybe")
    return new.unionByName(candidates.join(near, key, "left_anti").select(*rows.columns))

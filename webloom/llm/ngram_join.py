"""N-gram Jaccard join: an exact metric-space join of documents on word shingles.

The Jaccard distance d = 1 - |x & y| / |x | y| is a metric; two documents link when d <= r = 0.2.

1. Every text becomes the set of its distinct shingles (64-bit hashes) and a 128-bit identity of
   that set. Its first half names the set; where sets share a half, the whole identity is hashed
   into a new name. Copies share the name, so from here on each set is handled once. The same scan
   counts shingles in a sketch of 2**20 cells (fixed size, whatever the corpus).
2. Shingles are ordered by (sketch count, hash), one order for all sets. A set shows its first
   n - ceil(0.8 n) + 1 shingles; linked sets share a shown one. Of all sets that show a shingle,
   the one of least hash is its *pivot*; a set belongs to the Voronoi region of every pivot it
   meets this way, so linked sets meet in a region. A size window (|d(x,0) - d(y,0)| for the
   empty set in the symmetric-difference metric) drops members without a possible partner.
3. Regions of at most ``leaf_shingles`` are joined by a task each. Inside, the rarest local
   shingles propose partners, and triangle-inequality windows around the pivot of each class
   rule them out before sets are compared.
4. A larger region is split again: up to ``FANOUT`` pivots, each member goes to the nearest one,
   and also to every pivot q with d(x,q) <= d(x,home) + 2r (the boundary replicas). Members
   within r of a pivot link to it there and then; those of the largest such class stay at home,
   since pairs inside a class need no look. Sub-regions recurse; where one does not shrink, its
   parent is cut into blocks once, and each pair of blocks is joined. Members travel in salted parts
   of a region, each part with the region's pivots once.
5. Links (a spanning set of them, never all pairs of a group) go through distributed
   min-label components with pointer jumping.

Results are whole: no cap on regions, members or partners. Rows are named by id and a 128-bit hash of
the text, so repeated and null ids are as good as others. Joins on keys that one in a thousand rows
may share go through ``split_join``. Inexact are only collisions: of 128-bit hashes, and of 64-bit
shingles inside one pair of sets (about 10^-11 for two texts of 20,000 words).

Defined results: a null text or one without words has an empty set, n_shingles 0, and is alone
(component_id its own id); fewer than ``width`` words make one shingle; repeated rows and equal
texts share a component; rows whose id is null take part, and their component_id is the least
non-null id of the component, or null. Extra columns, of whatever name, are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

CELLS = 1 << 20
PARTS = 16
FANOUT = 8
#: A shingle counted this much more often than the mean cell has its rows pre-aggregated.
HOT_EXCESS = 50_000
LEAF_SHINGLES = 2_000_000
#: A member of a region weighs its shingles and this.
MEMBER_WEIGHT = 400
RING = 1.26


def _min_overlap(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def _linked(inter, nx, ny, num, den):
    return den * inter >= num * (nx + ny - inter)


# ------------------------------------------------------------------ passes over the texts


class Names:
    """Set names: the first half of the identity (its first ``bits``), or for the halves in
    ``clash`` a hash of both."""

    def __init__(self, clash=(), bits: int = 64):
        self.clash, self.bits = frozenset(clash), bits

    def both(self, s: np.ndarray) -> tuple[int, int]:
        """(name, second half), signed 64-bit numbers."""
        if len(s) == 0:
            return 0, 0
        n = np.array([len(s)], np.uint64) * C.PLACE_BASE
        f = C.mixed(C.mixed(s + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True) + n)
        g = C.mixed(C.mixed(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64, keepdims=True) + n)
        short = f >> np.uint64(64 - self.bits)
        if int(short.view(np.int64)[0]) in self.clash:
            short = C.mixed(f ^ C.mixed(g))
        return int(short.view(np.int64)[0]), int(g.view(np.int64)[0])

    def __call__(self, s: np.ndarray) -> int:
        return self.both(s)[0]


def _folded(s: np.ndarray) -> bytes:
    """Counts of a set's hashes by their top bits, one byte each, saturated at 255.

    About n/8 counts, a power of two of them. The L1 distance of two such vectors, brought to the
    same length by adding neighbours before saturation, bounds the symmetric difference from below.
    """
    cells = 1 << max(5, min(16, (len(s) >> 3).bit_length()))
    shift = np.uint64(64 - cells.bit_length() + 1)
    return np.minimum(np.bincount((s >> shift).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def _signatures(width: int, name: Names):
    def run(batches):
        total = np.zeros(CELLS, dtype=np.int64)
        kinds = None
        for batch in batches:
            ids, texts, keys = batch.columns
            kinds = ids.type, keys.type
            raw, off = C.text_buffers(texts)
            n, f, g, v = (np.zeros(len(ids), np.int64) for _ in range(4))
            v = [b""] * len(ids)
            for a, b in C.chunks(off):
                sets = C.shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], width)
                for i, s in enumerate(sets, a):
                    n[i], (f[i], g[i]), v[i] = len(s), name.both(s), _folded(s)
                cells = (np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64)
                total += np.bincount(cells, minlength=CELLS)
            weight = np.maximum(n, np.diff(off) // 8) + MEMBER_WEIGHT
            yield _signature_batch(ids, keys, n, f, g, weight, v, [-1] * len(ids))
        if kinds is not None:
            step = CELLS // PARTS
            cells = [C.zip_bytes(total[p * step : (p + 1) * step].astype(np.int64)) for p in range(PARTS)]
            none = [0] * PARTS
            yield _signature_batch(pa.nulls(PARTS, kinds[0]), pa.nulls(PARTS, kinds[1]), none, none, none, none, cells, range(PARTS))

    return run


def _signature_batch(ids, keys, n, f, g, w, cells, part):
    longs = [pa.array(x, pa.int64()) for x in (n, f, g, w)]
    return pa.RecordBatch.from_arrays([ids, keys, *longs, pa.array(cells, pa.binary()), pa.array(list(part), pa.int32())], names=["id", "key", "n", "f", "g", "w", "cells", "part"])


def _sum_cells(table: pa.Table) -> pa.Table:
    step = CELLS // PARTS
    out = np.zeros(step, dtype=np.int64)
    for b in table["cells"].to_pylist():
        out += C.unzip_array(b, step, np.int64)
    return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "lot": pa.array([table["to"][0].as_py()], pa.int64()), "cells": pa.array([C.zip_bytes(out)], pa.binary())})


def _sketch(parts: DataFrame) -> np.ndarray:
    """The summed sketch: 2**20 numbers, added in a tree of fan-in 64."""
    rows = parts.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    level = parts.select("part", "cells", F.monotonically_increasing_id().alias("lot"))
    lots = rows
    while lots > 1 or level is parts:
        lots = math.ceil(lots / 64)
        level = level.withColumn("to", F.pmod(F.xxhash64("lot"), F.lit(lots))).groupBy("part", "to").applyInArrow(_sum_cells, "part int, lot long, cells binary")
    out = np.zeros(CELLS, dtype=np.int64)
    step = CELLS // PARTS
    for r in level.select("part", "cells").collect():
        out[r.part * step : (r.part + 1) * step] += C.unzip_array(bytes(r.cells), step, np.int64)
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def _shown(width: int, num: int, den: int, sketch, hot: int, name: Names):
    """(shingle, set, size, hot) for the shown shingles of each set; once per set and task (whose input is bounded)."""

    def run(batches):
        count, done = sketch.value, set()
        for batch in batches:
            raw, off = C.text_buffers(batch.column(0))
            for a, b in C.chunks(off):
                hs, fs, ns = [], [], []
                for s in C.shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], width):
                    if len(s) == 0 or (f := name(s)) in done:
                        continue
                    done.add(f)
                    c = count[(s & np.uint64(CELLS - 1)).astype(np.int64)]
                    p = len(s) - _min_overlap(len(s), num, den) + 1
                    if p < len(s):  # s is sorted by hash: a stable sort by count orders by both
                        s = s[np.argsort(c, kind="stable")[:p]]
                    hs.append(s)
                    fs.append(f)
                    ns.append(len(c))
                if hs:
                    per = [len(h) for h in hs]
                    h = np.concatenate(hs)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(h.view(np.int64)),
                            pa.array(np.repeat(np.array(fs, np.int64), per)),
                            pa.array(np.repeat(np.array(ns, np.int32), per)),
                            pa.array(count[(h & np.uint64(CELLS - 1)).astype(np.int64)] > hot),
                        ],
                        names=["s", "f", "n", "hot"],
                    )

    return run


# ------------------------------------------------------------------ inside one region


def _distance(a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    i = int((b[at] == a).sum()) if len(b) else 0
    return i, 1 - i / max(len(a) + len(b) - i, 1)


def join_sets(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Spanning links (i, j) of the classes that the links among ``sets`` form; exact."""
    k = len(sets)
    if k < 2:
        return []
    order = sorted(range(k), key=lambda i: (len(sets[i]), i))
    size = np.array([len(sets[i]) for i in order])
    flat = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(k), size)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    shown = size - np.array([_min_overlap(int(n), num, den) for n in size]) + 1
    o = np.lexsort((token, count[token], owner))
    rank = np.arange(len(o)) - np.repeat(np.cumsum(size) - size, size)
    keep = (rank < np.repeat(shown, size)) & (count[token[o]] > 1)
    tok, own = token[o][keep], owner[o][keep]
    of = np.split(tok, np.searchsorted(own, np.arange(1, k)))
    by = np.lexsort((own, tok))
    tok, own = tok[by], own[by]
    first = dict(zip(*(x.tolist() for x in np.unique(tok, return_index=True))))
    ends = np.append(np.flatnonzero(np.diff(tok)) + 1, len(tok))
    end = {t: int(ends[j]) for j, t in enumerate(first)}
    label, links, r = np.arange(k), [], 1 - num / den
    near: dict[int, dict[int, float]] = {}  # of a class's pivot: the distances known to it
    for x in range(k):
        if not len(of[x]):
            continue
        near_x = np.unique(np.concatenate([own[first[t] : end[t]] for t in of[x].tolist()]))
        near_x = near_x[near_x < x]
        near_x = near_x[size[near_x] * den >= num * size[x]]  # the size window
        for c in np.unique(label[near_x]).tolist():
            if c == label[x]:
                continue
            known = near.setdefault(c, {c: 0.0})
            i, d = _distance(sets[order[x]], sets[order[c]])
            hit = c if _linked(i, size[x], size[c], num, den) else -1
            dx = d
            if hit < 0:
                for y in near_x[label[near_x] == c].tolist():
                    if y == c or y in known and abs(known[y] - d) > r + 1e-9:  # the window
                        continue
                    i, d2 = _distance(sets[order[x]], sets[order[y]])
                    if _linked(i, size[x], size[y], num, den):
                        hit = y
                        break
            if hit >= 0:
                links.append((order[x], order[hit]))
                old = label[x]
                label[label == old] = c
                merged = near.pop(int(old), None)
                if merged is None or len(merged) == 1:
                    known[x] = dx
    return links


def _groups(batches, key: str):
    """Whole groups of rows, as tables, from batches that are sorted by the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.asarray(batch.column(batch.schema.get_field_index(key)))
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:]):
            if held and a == 0 and held[-1].column(held[-1].schema.get_field_index(key))[0].as_py() != k[0] or held and a > 0:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _by_group(key: str, one, schema: pa.Schema):
    """mapInArrow function that applies ``one`` to each group of a sorted partition."""

    def run(batches):
        for table in _groups(batches, key):
            out = one(table)
            if len(out):
                yield from out.cast(schema).to_batches()

    return run


def possible(n: np.ndarray, vectors: list[np.ndarray], num: int, den: int, block: int = 256) -> np.ndarray:
    """Which sets have a possible partner among the others, by size and folded counts.

    |x & y| <= (|x| + |y| - L1) / 2, with the L1 distance of the counts brought to one length. A
    look for a set ends at the first partner found, so tight groups cost little.
    """
    order = np.argsort(n, kind="stable")
    size, v = n[order], [vectors[i].astype(np.int32) for i in order]
    length = np.array([len(x) for x in v])
    half = [x.reshape(-1, 2).sum(axis=1) for x in v]
    unsure = np.array([x.max(initial=0) >= 255 for x in v])
    of = {int(k): np.flatnonzero(length == k) for k in np.unique(length)}
    full = {k: np.stack([v[i] for i in ids]) for k, ids in of.items()}
    less = {k: np.stack([half[i] for i in ids]) for k, ids in of.items()}
    keep = np.zeros(len(n), dtype=bool)
    low = np.searchsorted(size, -(-num * size // den))
    high = np.searchsorted(size, size * den // num, side="right")
    for i in range(len(n)):
        for k in (int(length[i]), int(length[i]) * 2, int(length[i]) // 2):
            if keep[i] or k not in of:
                continue
            ids = of[k]
            a, b = np.searchsorted(ids, (low[i], high[i]))
            for at in range(a, b, block):
                js = ids[at : min(at + block, b)]
                if k == length[i]:
                    d = np.abs(full[k][at : at + len(js)] - v[i]).sum(axis=1)
                elif k > length[i]:
                    d = np.abs(less[k][at : at + len(js)] - v[i]).sum(axis=1)
                else:
                    d = np.abs(full[k][at : at + len(js)] - half[i]).sum(axis=1)
                if k != length[i]:
                    d = np.where(unsure[js] | unsure[i], 0, d)
                ok = _linked((size[i] + size[js] - d) // 2, size[i], size[js], num, den) & (js != i)
                if ok.any():
                    keep[i] = keep[js[np.argmax(ok)]] = True
                    break
    out = np.zeros(len(n), dtype=bool)
    out[order] = keep
    return out


def _possible(num: int, den: int):
    def one(table: pa.Table) -> pa.Table:
        n = np.asarray(table["n"].combine_chunks()).astype(np.int64)
        v = [np.frombuffer(x, dtype=np.uint8) for x in table["v"].to_pylist()]
        return table.filter(pa.array(possible(n, v, num, den))).drop_columns(["v"])

    return one


def _region_links(width: int, num: int, den: int, name: Names):
    def run(table: pa.Table) -> pa.Table:
        want = np.asarray(table["f"].combine_chunks())
        raw, off = C.text_buffers(table["text"])
        sets, names = [], []
        for a, b in C.chunks(off):
            for i, s in enumerate(C.shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], width), a):
                if name(s) == want[i]:
                    sets.append(s)
                    names.append(int(want[i]))
        seen = dict(zip(names, sets))
        names, sets = list(seen), list(seen.values())
        links = join_sets(sets, num, den)
        return pa.table({"a": pa.array([names[i] for i, _ in links], pa.int64()), "b": pa.array([names[j] for _, j in links], pa.int64())})

    return run


# ------------------------------------------------------------------ regions too large for a task


def _pivot_distances(width: int, name: Names):
    """Of rows sorted by region part, the pivots before the members: the members' distances to them."""

    def run(batches):
        region, known = None, []
        for batch in batches:
            names = batch.schema.names
            raw, off = C.text_buffers(batch.column(names.index("text")))
            want, is_pivot = batch.column(names.index("f")).to_pylist(), batch.column(names.index("pivot")).to_pylist()
            part = list(zip(batch.column(names.index("p")).to_pylist(), batch.column(names.index("salt")).to_pylist()))
            rows, at = [], []
            for a, b in C.chunks(off):
                for i, s in enumerate(C.shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], width), a):
                    if part[i] != region:
                        region, known = part[i], []
                    if name(s) != want[i]:
                        continue
                    if is_pivot[i]:
                        known.append((want[i], s))
                        continue
                    at.append(i)
                    rows.append([{"f": f, "inter": _distance(s, q)[0], "n": len(q)} for f, q in known])
            kind = pa.list_(pa.struct([("f", pa.int64()), ("inter", pa.int64()), ("n", pa.int64())]))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(names.index(c)).take(take) for c in MEMBER] + [pa.array(rows, kind)], names=[*MEMBER, "to"])

    return run


def _split(s: C.Scratch, members: DataFrame, large: DataFrame, texts, width, num, den, leaf, name):
    """One round of Voronoi splitting: (links, sub-region members, blocks that did not shrink).

    ``large`` gives the regions (p) and their weight (whole).
    """
    r2 = 2 * (1 - num / den)
    large = s.write(large.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("whole") / leaf)).cast("int")))
    small = C.small_side(large, texts.small_rows)
    members = s.write(members.join(small, "p"))
    pivots = members.groupBy("p", F.pmod(F.xxhash64("f"), F.lit(FANOUT)).alias("lot")).agg(F.min(F.struct("f", "n", "w", "id", "key", "c")).alias("v"), F.first("parts").alias("parts"))
    spread = pivots.select("p", "v.*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(True).alias("pivot"))
    parted = members.select(*MEMBER, F.pmod(F.xxhash64("f", F.lit(3)), F.col("parts")).cast("int").alias("salt"), F.lit(False).alias("pivot"))
    rows = texts.of(parted.unionByName(spread)).select(*MEMBER, "salt", "pivot", "text")
    rows = rows.repartition("p", "salt").sortWithinPartitions("p", "salt", F.desc("pivot"))
    far = rows.mapInArrow(C.tidy(_pivot_distances(width, name)), f"{_ddl(members)}, to array<struct<f:long,inter:long,n:long>>")
    far = s.write(far)
    far = far.withColumn("to", F.transform("to", lambda t: F.struct((1 - t["inter"] / (F.col("n") + t["n"] - t["inter"])).alias("d"), (den * t["inter"] >= num * (F.col("n") + t["n"] - t["inter"])).alias("ok"), t["f"].alias("f"))))
    links = far.select(F.col("f").alias("a"), F.explode(F.filter("to", lambda t: t["ok"])).alias("t")).select("a", F.col("t.f").alias("b")).where("a <> b")
    near = F.transform(F.filter("to", lambda t: t["ok"]), lambda t: t["f"])
    # pivots that share a member within r are of one class; the largest class is the core
    combos = far.withColumn("near", near).where(F.size("near") > 0).groupBy("p", "near").count()
    core = combos.groupBy("p").agg(F.collect_list(F.struct("near", "count")).alias("c")).select("p", F.udf(_largest_class, "array<long>")("c").alias("core"))
    far = far.join(C.small_side(s.write(core), texts.small_rows), "p", "left").withColumn("in_core", F.coalesce(F.arrays_overlap(near, "core"), F.lit(False)))
    far = far.withColumn("home", F.array_min(F.transform("to", lambda t: F.struct(t["d"].alias("d"), t["f"].alias("f")))))
    goes = F.when(F.col("in_core"), F.array(F.col("home.f"))).otherwise(F.transform(F.filter("to", lambda t: t["d"] <= F.col("home.d") + r2 + 1e-9), lambda t: t["f"]))
    sub = s.write(far.select(*MEMBER, F.explode(goes).alias("q"), "in_core"))
    weigh = sub.groupBy("p", "q").agg(F.sum("w").alias("ws"), F.min("in_core").alias("all_core")).where("not all_core")
    weigh = weigh.join(large.select("p", "whole"), "p")
    weigh = weigh.withColumn("stuck", F.col("ws") > F.greatest(F.lit(leaf), F.col("whole") * 0.8))
    weigh = s.write(weigh)
    stuck = weigh.where("stuck").select("p").distinct()
    going = weigh.select("p", "q").join(stuck, "p", "left_anti")
    smaller = sub.join(C.small_side(s.write(going), texts.small_rows), ["p", "q"]).withColumn("p", F.xxhash64("p", "q")).select(*MEMBER)
    blocks = F.greatest(F.lit(1), F.ceil(2 * F.col("whole") / leaf)).cast("int")
    cut = members.join(C.small_side(s.write(stuck), texts.small_rows), "p", "left_semi").withColumn("blocks", blocks)
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("f", F.lit(7)), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumn("p", F.xxhash64("p", F.least("mine", "o"), F.greatest("mine", "o"))).select(*MEMBER)
    return links, smaller, cut


def _largest_class(combos):
    """Of pivot combinations (at most 2**FANOUT) with counts: the class of most members."""
    group: list[list] = []
    for c in combos or []:
        names, count = set(c["near"]), c["count"]
        for g in [g for g in group if g[0] & names]:
            names, count = names | g[0], count + g[1]
            group.remove(g)
        group.append([names, count])
    return sorted(max(group, key=lambda g: g[1])[0]) if group else None


# ------------------------------------------------------------------ components


def components(s: C.Scratch, links: DataFrame, hot_share: int = C.HOT_SHARE) -> DataFrame:
    """(v, label) with the least vertex of each component of the links (a, b)."""
    both = s.write(links.select("a", "b").union(links.select("b", "a")).dropDuplicates(["a", "b"]).select(F.col("a"), F.col("b").alias("v")))
    label = both.groupBy("a").agg(F.min("v").alias("least"), F.count("*").alias("degree"))
    label = s.write(label.select(F.col("a").alias("v"), F.least("a", "least").alias("label"), "degree"))
    n_links, n = both.count(), label.count()
    while True:
        told = C.split_join(both, label, ["v"], F.col("degree") * hot_share > n_links).groupBy("a").agg(F.min("label").alias("told"))
        step = s.write(label.join(told, label.v == told.a).select("v", "label", "degree", F.least("label", "told").alias("low")))
        crowd = step.groupBy("low").agg(F.count("*").alias("crowd"))
        over = s.write(label.select(F.col("v").alias("low"), F.col("label").alias("jump")).join(crowd, "low"))
        step = C.split_join(step, over, ["low"], F.col("crowd") * hot_share > n)
        step = s.write(step.select("v", "label", "degree", F.least("low", "jump").alias("new")))
        label = step.select("v", F.col("new").alias("label"), "degree")
        if step.where("new <> label").isEmpty():
            return label.select("v", "label")


# ------------------------------------------------------------------ the operator

#: A set in a region: its name, size, weight, the row that stands for it (and how often that is there).
MEMBER = ["p", "f", "n", "w", "id", "key", "c"]


def _ddl(members: DataFrame) -> str:
    kinds = dict(members.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in MEMBER)


class Texts:
    """The texts of sets, read again for the rows that stand for them."""

    def __init__(self, docs: DataFrame, repeated: bool, small_rows: int):
        self.docs, self.repeated, self.small_rows = docs, repeated, small_rows

    def of(self, member: DataFrame) -> DataFrame:
        """The columns of member (id and key among them) and text."""
        docs = self.docs.select(F.col("id").alias("tid"), F.col("key").alias("tkey"), "text")
        met = lambda t: docs["tid"].eqNullSafe(t["wid"]) & (docs["tkey"] == t["wkey"])
        wanted = member.groupBy(F.col("id").alias("wid"), F.col("key").alias("wkey")).agg(F.max("c").alias("wc"))
        wanted = C.small_side(wanted, self.small_rows)
        text = docs.join(wanted, met(wanted), "left_semi")
        if self.repeated:  # of repeated rows one travels
            often = wanted.where("wc > 1")
            once = docs.join(often, met(often), "left_semi").groupBy("tid", "tkey").agg(F.min("text").alias("text"))
            rare = wanted.where("wc = 1")
            text = docs.join(rare, met(rare), "left_semi").unionByName(once)
        return text.join(member, F.col("tid").eqNullSafe(member["id"]) & (F.col("tkey") == member["key"])).drop("tid", "tkey")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: tuple[int, int] = (80, 100), leaf_shingles: int = LEAF_SHINGLES, small_rows: int = C.SMALL_ROWS, hot_excess: int = HOT_EXCESS, hot_share: int = C.HOT_SHARE, name_bits: int = 64) -> DataFrame:
    """One row per input row: id_col, n_shingles long, component_id, set_id long, text_key binary,
    and class_id long (null where the set is empty), equal for rows of one component.

    ``threshold`` is a fraction (numerator, denominator) of the union; see the module's text.
    """
    spark: SparkSession = docs.sparkSession
    C.ship(spark)
    num, den = threshold
    text = F.col(f"`{text_col}`").cast("string")
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), C.text_key(text).alias("key"))
    id_type, id_field = dict(docs.dtypes)["id"], docs.schema["id"].dataType
    kinds = f"id {id_type}, key binary, n long, f long, g long, w long, cells binary, part int"
    with C.Scratch(spark) as s:
        name = Names((), name_bits)
        while True:
            sig = s.write(docs.mapInArrow(C.tidy(_signatures(width, name)), kinds))
            rows = sig.where("part < 0").drop("part")
            # sets that share a name by chance: about (sets)^2 / 2^65, so none or a few
            halves = rows.where("n > 0").groupBy("f").agg(F.min("g").alias("low"), F.max("g").alias("high"))
            clash = {r.f for r in halves.where("low <> high").select("f").collect()}
            if not clash:
                break
            name = Names(name.clash | clash, name_bits)
        sketch = _sketch(sig.where("part >= 0"))
        total = rows.count()
        stand = rows.where("n > 0").groupBy("f", "id", "key").agg(F.count("*").alias("c"), F.min(F.struct("n", "w", "cells")).alias("x"))
        one = stand.groupBy("f").agg(F.min(F.struct("id", "key", "c")).alias("row"), F.min("x").alias("x"), F.min("id").alias("least"), F.sum("c").alias("rows"))
        one = s.write(one.select("f", "row.*", "x.*", "least", "rows"))
        texts = Texts(docs, not one.where("c > 1").isEmpty(), small_rows)
        hot = int(sketch.mean()) + hot_excess
        shared = spark.sparkContext.broadcast(sketch)  # 4 MB, whatever the corpus
        shown = docs.select("text").mapInArrow(C.tidy(_shown(width, num, den, shared, hot, name)), "s long, f long, n int, hot boolean")
        prio = [F.xxhash64("f"), F.col("f")]
        first = Window.partitionBy("s").orderBy("x", "f").rowsBetween(Window.unboundedPreceding, 0)
        # a pivot and a set show the same shingle: the running first row needs no buffered group
        usual = shown.where("not hot").select("s", "f", "n", prio[0].alias("x"))
        pairs = usual.select("f", "n", F.first("f").over(first).alias("p"), F.first("n").over(first).alias("pn")).where("p <> f")
        if int(sketch.max()) > hot:
            often = s.write(shown.where("hot").select("s", "f", "n").dropDuplicates(["s", "f"]))
            pivot = often.groupBy("s").agg(F.min(F.struct(prio[0].alias("x"), "f", "n")).alias("v"))
            pivot = C.small_side(s.write(pivot.select("s", F.col("v.f").alias("p"), F.col("v.n").alias("pn"))), small_rows)
            pairs = pairs.union(often.join(pivot, "s").select("f", "n", "p", "pn").where("p <> f"))
        pairs = s.write(pairs.dropDuplicates(["p", "f"]))
        member = pairs.select("p", "f", "n").union(pairs.select("p", F.col("p").alias("f"), F.col("pn").alias("n")).distinct())
        ring = F.floor(F.log(RING, F.col("n"))).cast("int")
        rings = member.groupBy("p", ring.alias("ring")).agg(F.count("*").alias("c")).groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct("ring", "c"))).alias("c"), F.sum("c").alias("in_p"))
        rings, n_pairs = s.write(rings), pairs.count()
        has = lambda k: F.coalesce(F.try_element_at("c", k), F.lit(0))
        member = C.split_join(member, rings, ["p"], F.col("in_p") * hot_share > n_pairs).withColumn("ring", ring)
        member = member.where((has(F.col("ring")) > 1) | (has(F.col("ring") - 1) > 0) | (has(F.col("ring") + 1) > 0)).select("p", "f", "n")
        member = s.write(member.join(one.select("f", "w", "id", "key", "c", F.col("cells").alias("v")), "f").select(*MEMBER, "v"))
        links, whole, first = [], member, True
        while True:
            large = s.write(whole.groupBy("p").agg(F.sum("w").alias("whole")).where(F.col("whole") > leaf_shingles))
            some = not large.isEmpty()
            leaf = whole.join(C.small_side(large.select("p"), small_rows), "p", "left_anti") if some else whole
            if first:  # a cheap look at narrow rows, before texts travel
                kinds = leaf.drop("v").schema
                sieve = _by_group("p", _possible(num, den), pa.schema([("p", pa.int64()), ("f", pa.int64()), ("n", pa.int32()), ("w", pa.int64()), ("id", _arrow_type(id_field)), ("key", pa.binary()), ("c", pa.int64())]))
                leaf = s.write(leaf.repartition("p").sortWithinPartitions("p").mapInArrow(C.tidy(sieve), kinds))
                whole, first = whole.drop("v"), False
            links.append(s.write(_leaf_links(leaf, texts, width, num, den, name)))
            if not some:
                break
            near, whole, stuck = _split(s, whole, large, texts, width, num, den, leaf_shingles, name)
            links += [s.write(near), s.write(_leaf_links(stuck, texts, width, num, den, name))]
            whole = s.write(whole)
        every = links[0]
        for x in links[1:]:
            every = every.union(x)
        label = components(s, every, hot_share)
        named = s.write(one.select("f", "least", "rows").join(label, one.f == label.v, "left").select("f", "least", "rows", F.coalesce("label", "f").alias("label")))
        found = s.write(named.groupBy("label").agg(F.min("least").alias("component"), F.count("*").alias("sets")))
        named = C.split_join(named.drop("least"), found, ["label"], F.col("sets") * hot_share > named.count()).drop("sets")
        told = C.split_join(rows.where("n > 0").select("id", "key", "n", "f"), s.write(named), ["f"], F.col("rows") * hot_share > total)
        out = told.select("id", "n", "component", "f", "key", "label")
        out = out.union(rows.where("n = 0").select("id", "n", "id", "f", "key", F.lit(None).cast("long")))
        out = s.write(out, keep=True)
    shared.unpersist()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("f").alias("set_id"), F.col("key").alias("text_key"), F.col("label").alias("class_id"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, but for those that are linked with a row that stays: of each
    component the row of least id (null ids last), then of least text hash, stays."""
    classes = ngram_jaccard_join(docs, id_col, text_col, **options).select(F.col(f"`{id_col}`").alias("id"), F.col("text_key").alias("key"), "class_id")
    with C.Scratch(docs.sparkSession) as s:
        names = s.write(classes.where("class_id is not null").groupBy("id", "key", "class_id").agg(F.count("*").alias("n")), keep=True)
        order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
        head = s.write(names.groupBy("class_id").agg(F.min(order).alias("head"), F.count("*").alias("names")), keep=True)
        told = C.split_join(names, head, ["class_id"], F.col("names") * C.HOT_SHARE > names.count())
        names = told.select("id", "key", F.when(order == F.col("head"), 1).otherwise(0).cast("long").alias("stay"), "n")
        return C.keep_named(docs, names, F.col(f"`{id_col}`"), C.text_key(F.col(f"`{text_col}`")))


def _arrow_type(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _leaf_links(member: DataFrame, texts: Texts, width, num, den, name) -> DataFrame:
    """Links inside regions that fit a task. Texts travel, sets are made again where they meet."""
    rows = texts.of(member.select("p", "f", "id", "key", "c")).select("p", "f", "text")
    return rows.repartition("p").sortWithinPartitions("p").mapInArrow(C.tidy(_by_group("p", _region_links(width, num, den, name), pa.schema([("a", pa.int64()), ("b", pa.int64())]))), "a long, b long")

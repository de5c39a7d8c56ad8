"""Hard negatives by inverted lists with stored radii: an exact search that skips lists by bounds.

Components become whole numbers floor(256 x), so inner products are exact. K-means (Lloyd's steps on
at most ``sample_rows`` rows, those of least hash: a documented bound of the fit alone) gives the
centroids; every row joins the list of its nearest one, and each list stores its radius, the
greatest distance of a member. Lists are cut into blocks of about BLOCK_ROWS rows, and following blocks
make up cells of at most CELL_BYTES, one task each: a list that holds a third of all rows is many tasks.

For a query a, list j holds scores between a.c - |a| r and a.c + |a| r (Cauchy-Schwarz). A list outside
all windows of the query is skipped, and so is one whose bound is strictly below the query's k-th score
so far (a tie at the k-th could still win by its smaller id). The first rounds visit the few lists of
highest bounds and leave the query's k-th scores; the last one visits all lists that can still hold
better ones, so its result is whole by itself. A query is sent once to each cell that holds one of its
lists, never to each row or block; a task holds the members of its cell and reads the queries as a
stream, by matrix products. The driver sees the centroids (at most MOST_LISTS) and counts per list.

Defined results: rows with a null id, label or vector, a null or non-finite component, or a vector of
another size than most rows (of equals the greater) take no part; floors beyond +-2**26 are put
there; rows that share an id are rows of their own, each an anchor and a candidate; an empty table
gives no rows; an anchor without positives, or a positive without negatives in its window (as where
its score is below zero), gives none; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from . import vectors as V

SCALE, MOST = 256.0, 1 << 26
MOST_LISTS = 4096
SAMPLE_ROWS = 20_000
STEPS = 8
BLOCK_ROWS = 256
#: Packed vectors of a cell.
CELL_BYTES = 1 << 25
#: Entries of a table of distances or scores that is made at a time.
TABLE = 1 << 20
#: Members of small lists that are met together.
TOGETHER = 1024
#: Lists that the first round visits, and by how much the next one visits more.
FIRST, GROWTH = 8, 16
POSITIVES, NEGATIVES = 5, 10


def _packed(column: pa.Array, d: int) -> np.ndarray:
    """A binary column of d integers a row, of 16 or 32 bits, as an array of (rows, d)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return raw.view("<i2" if len(raw) == 2 * d * len(column) else "<i4").reshape(len(column), d)


def _integers(d: int):
    def run(batches):
        for b in batches:
            x = V.whole(V.matrix(b.column(2), d), SCALE, 0, MOST).astype("<i4")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "label", "x"])

    return run


def k_means(x: np.ndarray, k: int, steps: int = STEPS, seed: int = 11) -> np.ndarray:
    """Centroids of at most k clusters by Lloyd's steps from k distinct rows."""
    x = np.unique(x.astype(np.float64), axis=0)
    c = x[np.sort(np.random.Generator(np.random.PCG64(seed)).permutation(len(x))[:k])].copy()
    for _ in range(steps if len(c) > 1 else 0):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    step = max(1, TABLE // max(1, len(c)))
    return np.concatenate([np.argmax(x[a : a + step] @ c.T - half, axis=1) for a in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def _assigned(model, d: int, packed: str):
    def run(batches):
        c = model.value
        for b in batches:
            x = _packed(b.column("x"), d)
            near = nearest(x.astype(np.float64), c)
            far = np.sqrt(((x - c[near]) ** 2).sum(axis=1))
            small = pa.array([r.tobytes() for r in x.astype(packed)], pa.binary())
            columns = [small if n == "x" else b.column(n) for n in b.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(near.astype(np.int32)), pa.array(far)], names=[*b.schema.names, "list", "distance"])

    return run


class Index:
    """Members with their lists and cells (a table), with centroids, radii, blocks and first block per
    list, blocks per cell, and the number type in which all scores are exact."""

    def __init__(self, members: DataFrame, d: int, centroids: np.ndarray, radii: np.ndarray, n_blocks: np.ndarray, per_cell: int, kind: str):
        self.members, self.d, self.centroids, self.radii, self.n_blocks, self.kind = members, d, centroids, radii, n_blocks, kind
        start = np.cumsum(n_blocks) - n_blocks
        self.cells = max(1, -(-int(n_blocks.sum()) // per_cell))
        # the lists of which a cell can hold members are neighbours: from .. to - 1
        edge = np.arange(self.cells) * per_cell
        self.froms, self.tos = np.searchsorted(start + n_blocks, edge, side="right"), np.searchsorted(start, edge + per_cell, side="left")

    def bare(self) -> tuple:
        return self.centroids, self.radii, self.froms, self.tos


def _least(rows: DataFrame, n: int, sample_rows: int) -> DataFrame:
    """The ``sample_rows`` rows of least hash; all others are left out before anything is sorted."""
    hashed = rows.withColumn("hash", F.xxhash64("vec_id", "x"))
    if n > 4 * sample_rows:
        few = hashed.where(F.col("hash") < -(1 << 63) + (2 * sample_rows << 64) // n)
        if few.count() >= sample_rows:
            hashed = few
    return hashed.orderBy("hash", "row").limit(sample_rows)


def build(rows: DataFrame, d: int, scratch: C.Scratch, lists: int | None = None, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS, cell_bytes: int = CELL_BYTES) -> Index:
    """The index of ``rows`` (row, vec_id, label, x): about the square root of their number of lists."""
    spark = rows.sparkSession
    sizes = rows.select("x").mapInArrow(_sizes(d), "n long, most long, norm double").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.max("norm").alias("norm")).first()
    # a sum of some products of two rows is at most the greatest squared norm, whatever their order
    kind = "<f4" if sizes.norm < 1 << 24 else "<f8" if sizes.norm < 1 << 52 else "<i8"
    packed = "<i2" if sizes.most < 1 << 15 else "<i4"
    sample = _least(rows, sizes.n, sample_rows).select("x").toArrow()
    centroids = k_means(_packed(sample.column("x"), d), min(MOST_LISTS, lists or max(1, round(sizes.n**0.5))))
    # lists that are near each other stand side by side, so that few cells hold those of a query
    centroids = centroids[np.argsort(nearest(centroids, k_means(centroids, round(len(centroids) ** 0.5))), kind="stable")]
    model = spark.sparkContext.broadcast(centroids)
    near = scratch.write(rows.mapInArrow(_assigned(model, d, packed), "row long, vec_id long, label int, x binary, list int, distance double"))
    stats = near.groupBy("list").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()
    radii, n_blocks = np.full(len(centroids), -1.0), np.zeros(len(centroids), np.int64)
    for s in stats:
        radii[s.list], n_blocks[s.list] = s.radius, -(-s.n // block_rows)
    start, all_ = np.cumsum(n_blocks) - n_blocks, int(n_blocks.sum())
    per_cell = max(1, min(cell_bytes // (int(packed[2]) * d * block_rows), all_ // (2 * spark.sparkContext.defaultParallelism)))
    per = F.broadcast(spark.createDataFrame([(s.list, int(n_blocks[s.list]), int(start[s.list])) for s in stats], "list int, n int, start long"))
    block = F.col("start") + F.pmod(F.xxhash64("row"), "n")
    members = near.join(per, "list").withColumn("cell", F.call_function("div", block, F.lit(per_cell)).cast("int"))
    return Index(members.select("cell", "row", "vec_id", "label", "list", "x"), d, centroids, radii, n_blocks, per_cell, kind)


def _sizes(d: int):
    def run(batches):
        for b in batches:
            x = _packed(b.column("x"), d).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([int(np.abs(x).max(initial=0))]), pa.array([float((x * x).sum(axis=1).max(initial=0))])], names=["n", "most", "norm"])

    return run


LOWEST, HIGHEST = -(1 << 62), 1 << 62


def bounds(a: np.ndarray, centroids: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that the members of each list can have with a (or with each row of a),
    rounding allowed for."""
    middle, norm = a @ centroids.T, np.sqrt((a * a).sum(axis=-1, keepdims=True))
    slack = norm * radii
    room = 1e-9 * (np.abs(middle) + slack + norm * np.sqrt((centroids**2).sum(axis=1)) + 1)
    return middle - slack - room, middle + slack + room


def _ends(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, lower and upper ends of each row's windows, as arrays of (rows, most windows of a row)."""
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    flat = column.flatten()
    out = []
    for name, none in (("w", 0), ("least", HIGHEST), ("most", LOWEST)):
        out.append(np.full((len(n), int(n.max(initial=1))), none, np.int64))
        out[-1][at] = flat.field(name).to_numpy(zero_copy_only=False)
    return tuple(out)


def _open(low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether scores from low to high (rows, lists) meet any window of the row."""
    use = np.zeros(high.shape, bool)
    for w in range(least.shape[1]):
        use |= (high >= least[:, w : w + 1]) & (low <= most[:, w : w + 1])
    return use


def _visits(model, d: int, width: int):
    """Of queries with their windows: one row for each cell that holds one of the ``width`` lists of
    highest bounds that meet a window, with the lowest of these bounds and the query's nearest list."""

    def run(batches):
        centroids, radii, froms, tos = model.value
        step = max(1, TABLE // len(centroids))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                low, high = bounds(_packed(part.column("x"), d).astype(np.float64), centroids, radii)
                _, least, most = _ends(part.column("windows"))
                use = _open(low, high, least, most) & (radii >= 0)
                edge = np.full(len(use), -np.inf)
                if width < len(centroids):
                    top = np.where(use, high, -np.inf)
                    edge = -np.partition(-top, width - 1, axis=1)[:, width - 1]
                    use &= high >= edge[:, None]
                seen = np.pad(np.cumsum(use, axis=1), ((0, 0), (1, 0)))
                at, cell = np.nonzero(seen[:, tos] > seen[:, froms])
                take = part.take(pa.array(at))
                near = np.argmax(high, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *take.columns, pa.array(edge[at]), pa.array(near[at])], names=["cell", *take.schema.names, "edge", "list"])

    return run


def _best(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best of each group, in order, and their ranks from 0."""
    order = np.lexsort((row, vec_id, -score, group))
    g = group[order]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < k], rank[rank < k]


class _Cell:
    """The members of a cell, by list (for ``same_label``, by label and list), and what queries find
    among them. Small lists that follow each other are met together, by the widest of their bounds."""

    def __init__(self, parts: list, model, d: int, kind: str, same_label: bool):
        self.d, self.kind, self.same_label = d, kind, same_label
        self.row, self.vec_id, self.label, list_, self.x = (np.concatenate(c) for c in zip(*parts))
        n = len(list_)
        label = self.label if same_label else np.zeros(n, np.int32)
        at = lambda *keys: np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
        runs = at(label, list_)
        self.first = at(label[runs], runs // TOGETHER)
        self.from_ = runs[self.first]
        self.to = np.append(self.from_[1:], n)
        self.centroids, self.radii = model[0][list_[runs]], model[1][list_[runs]]

    def found(self, asked: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """The k best members of each query and window: (q, w, score, vec_id, row)."""
        x = _packed(asked.column("x"), self.d)
        q, label = (asked.column(n).to_numpy() for n in ("q", "label"))
        edge = asked.column("edge").to_numpy()
        names, least, most = _ends(asked.column("windows"))
        n_w = least.shape[1]
        low, high = bounds(x.astype(np.float64), self.centroids, self.radii)
        low, high = np.minimum.reduceat(low, self.first, axis=1), np.maximum.reduceat(high, self.first, axis=1)
        x = x.astype(self.kind)
        group, score, member = (np.zeros(0, np.int64) for _ in range(3))
        more: list[tuple] = []
        waiting = 0

        def settle():
            """Keep the best so far and let the windows' lower ends rise to the k-th."""
            nonlocal group, score, member, waiting
            group, score, member = (np.concatenate(c) for c in zip((group, score, member), *more))
            keep, rank = _best(group, score, self.vec_id[member], self.row[member], k)
            group, score, member = group[keep], score[keep], member[keep]
            full = rank == k - 1
            least.reshape(-1)[group[full]] = score[full]
            more.clear()
            waiting = 0

        for j in np.argsort(-high.sum(axis=0), kind="stable"):
            one = slice(j, j + 1)
            use = _open(low[:, one], high[:, one], least, most)[:, 0] & (high[:, j] >= edge)
            a, b = self.from_[j], self.to[j]
            who = np.flatnonzero(use & (label == self.label[a]) if self.same_label else use)
            for m in range(a, b if len(who) else a, 4096):
                there = self.x[m : min(b, m + 4096)].astype(self.kind).T
                step = max(1, TABLE // there.shape[1])
                for i in range(0, len(who), step):
                    w = who[i : i + step]
                    s = x[w] @ there
                    hit = s >= least[w].min(axis=1, keepdims=True).astype(self.kind)
                    hit &= s <= most[w].max(axis=1, keepdims=True).astype(self.kind)
                    r, c = np.nonzero(hit)
                    v, r, c = s[r, c].astype(np.int64), w[r], c + m
                    right = self.row[c] != q[r] if self.same_label else self.label[c] != label[r]
                    v, r, c = v[right], r[right], c[right]
                    for z in range(n_w):
                        inside = (v >= least[r, z]) & (v <= most[r, z])
                        more.append((r[inside] * n_w + z, v[inside], c[inside]))
                        waiting += len(more[-1][0])
                    if waiting >= TABLE // 4:
                        settle()
        settle()
        out = [q[group // n_w], names.reshape(-1)[group].astype(np.int32), score, self.vec_id[member], self.row[member]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["q", "w", "score", "vec_id", "row"])


def _found(model, d: int, k: int, same_label: bool, kind: str):
    """Of partitions sorted by cell, members before queries: what the queries find in their cells."""

    def run(batches):
        cell, parts, held = -1, [], None
        for batch in batches:
            at, asks = batch.column("cell").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(at)]
            for a, b in zip(cut, cut[1:]):
                part = batch.slice(a, b - a)
                if b > a and at[a] != cell:
                    cell, parts, held = at[a], [], None
                if b > a and not asks[a]:
                    # copies, so that the batch can go
                    parts.append([part.column(n).to_numpy().copy() for n in ("q", "vec_id", "label", "list")] + [_packed(part.column("x"), d).copy()])
                elif b > a and (parts or held):
                    if held is None:
                        held, parts = _Cell(parts, model.value, d, kind, same_label), []
                    yield held.found(part, k)

    return run


WINDOWS = "array<struct<w:int,least:long,most:long>>"
_TOP = "q long, w int, score long, vec_id long, row long"


def search(queries: DataFrame, index: Index, k: int, same_label: bool, scratch: C.Scratch, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """The k best members of each window of ``queries`` (q, label, x, windows): (q, w, score, vec_id, row, rank).

    Members have the query's label, itself left out, or another label. The windows' lower ends rise
    to the k-th scores that a round found; the last round visits all lists that meet a window then.
    """
    model = queries.sparkSession.sparkContext.broadcast(index.bare())
    by = Window.partitionBy("q", "w").orderBy(F.desc("score"), "vec_id", "row")
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    members = index.members.select("cell", F.lit(False).alias("asks"), "list", "label", F.col("row").alias("q"), "vec_id", "x", none("edge", "double"), none("windows", WINDOWS))
    widths = []
    while first * 4 <= len(index.centroids):
        widths.append(first)
        first *= growth
    now, best = queries.select("q", "label", "x", "windows"), None
    for width in [*widths, len(index.centroids)]:
        if best is not None:
            ends = best.where(F.col("rank") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("ends"))
            rise = F.transform("windows", lambda w: F.struct(w["w"].alias("w"), F.greatest(w["least"], F.coalesce(F.try_element_at("ends", w["w"]), F.lit(LOWEST))).alias("least"), w["most"].alias("most")))
            now = now.join(ends, "q", "left").select("q", "label", "x", rise.alias("windows"))
        asked = now.mapInArrow(_visits(model, index.d, width), f"cell int, q long, label int, x binary, windows {WINDOWS}, edge double, list int")
        asked = asked.withColumn("asks", F.lit(True)).withColumn("vec_id", F.lit(None).cast("long")).select(*members.columns)
        both = members.unionByName(asked).repartitionById(index.cells, F.col("cell")).sortWithinPartitions("cell", "asks", *(["label", "list"] if same_label else ["list"]))
        found = both.mapInArrow(_found(model, index.d, k, same_label, index.kind), _TOP)
        best = scratch.write(found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k))
    return best


def _hundredths(c: Column) -> Column:
    """floor(c / 100) in whole numbers."""
    return F.call_function("div", c - F.pmod(c, F.lit(100)), F.lit(100))


def mine(rows: DataFrame, anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (30, 90), lists: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of
    ``anchor``: of each positive's window, ``window`` hundredths of its score, the best negatives."""
    spark = rows.sparkSession
    C.ship(spark)
    label = F.col(f"`{label_col}`") if label is None else label
    own = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("int").alias("label"), F.col(f"`{vector_col}`").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & V.usable(F.col("v")))
    own, d = V.of_one_size(own, "v")
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not d:
        return none
    with C.Scratch(spark) as s:
        with C.Scratch(spark) as wide:
            kept = own.select(F.struct("vec_id", "anchor").alias("vec_id"), "label", "v").mapInArrow(_integers(d), "vec_id struct<vec_id:long,anchor:boolean>, label int, x binary")
            kept = wide.write(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id.vec_id", "vec_id.anchor", "label", "x"))
            asked = s.write(kept.where("anchor").select(F.col("row").alias("q"), "label", "x", "vec_id"))
            index = build(kept.drop("anchor"), d, s, lists)
        whole = F.array(F.struct(F.lit(0).alias("w"), F.lit(LOWEST).alias("least"), F.lit(HIGHEST).alias("most")))
        near = search(asked.select("q", "label", "x", whole.alias("windows")), index, positives, True, s)
        pairs = near.select("q", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        p = F.col("positive_score")
        low, high = -_hundredths(p * -window[0]), _hundredths(p * window[1])
        windows = pairs.withColumn("least", low).withColumn("most", high).where("least <= most").groupBy("q").agg(F.collect_list(F.struct("w", "least", "most")).alias("windows"))
        found = search(s.write(asked.join(windows, "q").select("q", "label", "x", "windows")), index, negatives, False, s)
        out = found.select("q", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["q", "w"])
        out = out.join(asked.select("q", F.col("vec_id").alias("anchor_id")), "q")
        return s.write(out.select(*none.columns), keep=True)

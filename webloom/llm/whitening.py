"""Embedding whitening from an exact scatter in residue numbers.

Entries become whole numbers x = floor(1024 c) + 100000. The scatter of all vectors with a one put
behind them, so that sums and the count come along, is never formed in floating point: a task
reduces its blocks of rows modulo several primes below 2**20 and multiplies the residues in doubles,
where a block of 2**13 rows stays below 2**53 and so is exact. Residues add up over tasks by one
partial aggregate; Chinese remaindering of the sums, a table of d * d numbers whatever the corpus,
gives the exact scatter. As many primes are taken as the greatest entry and the number of rows ask
for. Covariance entries are quotients of whole numbers, rounded once; ``eigh`` then works in doubles.
A last pass measures how far the whitened rows' covariance is from the identity.

Defined results: rows whose vector is null, holds a null or a non-finite entry, or has another size
than most rows (of equals the greater) are left out; floors beyond +-2**52 are put there; components
of no variance (below 1e-12 of the trace) are left out, so equal vectors, and an empty table, give no
rows; repeated rows count and come back each; ids may be null or repeat; a deviation that does not
fit a long is null; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import vectors as V

SCALE, SHIFT, MOST = 1024.0, 100_000, 1 << 52
COMPONENTS = 8
#: Rows that a product of residues below 2**20 may sum up in a double: 2**(53 - 40).
BLOCK_ROWS = 1 << 13
PRIME_TOP = 1 << 20
FLAT = 1e-12


def primes(bound: int) -> list[int]:
    """The greatest primes below PRIME_TOP whose product is more than twice the bound."""
    out, product, p = [], 1, PRIME_TOP - 1
    while product <= 2 * bound:
        if all(p % q for q in range(3, 1 + int(p**0.5), 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def remaindered(residues: list[list[int]], moduli: list[int]) -> list[int]:
    """The whole numbers of least absolute value with these residues, one list of them per modulus."""
    product = 1
    for p in moduli:
        product *= p
    weights = [product // p * pow(product // p, -1, p) for p in moduli]
    out = []
    for each in zip(*residues):
        x = sum(r * w for r, w in zip(each, weights)) % product
        out.append(x - product if 2 * x > product else x)
    return out


def _residues(d: int, moduli: list[int]):
    """Of a task's rows: (prime, cell, residue) of the upper triangle of the scatter, ones behind."""
    upper = np.triu_indices(d + 1)

    def run(batches):
        sums = np.zeros((len(moduli), d + 1, d + 1), np.int64)
        for batch in batches:
            x = V.whole(V.matrix(batch.column(0), d), SCALE, SHIFT, MOST)
            for a in range(0, len(x), BLOCK_ROWS):
                for i, p in enumerate(moduli):
                    r = np.concatenate([np.mod(x[a : a + BLOCK_ROWS], p), np.ones((len(x[a : a + BLOCK_ROWS]), 1), np.int64)], axis=1).astype(np.float64)
                    sums[i] = (sums[i] + (r.T @ r).astype(np.int64)) % p
        for i in range(len(moduli)):
            cells = sums[i][upper]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), i, np.int32)), pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], names=["prime", "cell", "residue"])

    return run


class Fit:
    """n, sums S, exact scatter (d x d whole numbers), trace, eigenvalues and components by falling eigenvalue."""

    def __init__(self, n: int, sums: list[int], scatter: list[list[int]], components: int):
        self.n, self.sums, self.scatter, self.d = n, sums, scatter, len(sums)
        # n * n * V in whole numbers; a quotient of whole numbers is rounded once
        cov = np.array([[(n * scatter[i][j] - sums[i] * sums[j]) / (n * n) for j in range(self.d)] for i in range(self.d)]).reshape(self.d, self.d)
        self.trace = float(sum(n * scatter[i][i] - sums[i] ** 2 for i in range(self.d)) / (n * n)) if n else 0.0
        values, parts = np.linalg.eigh(cov) if self.d else (np.zeros(0), np.zeros((0, 0)))
        order = np.argsort(-values, kind="stable")[:components]
        order = order[values[order] > FLAT * self.trace]
        self.values, self.parts = values[order], parts[:, order]


def fit(rows: DataFrame, vector: str, components: int = COMPONENTS) -> Fit | None:
    """The exact fit over usable rows of one size; None where there are none."""
    rows, d = V.of_one_size(rows, vector)
    most = rows.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))).alias("m")).first()
    if not most.n or not d:
        return None
    entry = min(int(most.m * SCALE) + 1, MOST) + SHIFT
    moduli = primes(most.n * entry * entry)
    C.ship(rows.sparkSession)
    parts = rows.select(vector).mapInArrow(_residues(d, moduli), "prime int, cell int, residue long")
    got = parts.groupBy("prime", "cell").agg(F.sum("residue").alias("s")).collect()
    cells = (d + 1) * (d + 2) // 2
    table = [[0] * cells for _ in moduli]
    for r in got:
        table[r.prime][r.cell] = r.s % moduli[r.prime]
    upper = dict(zip(zip(*(k.tolist() for k in np.triu_indices(d + 1))), remaindered(table, moduli)))
    scatter = [[upper[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]
    return Fit(upper[d, d], [upper[i, d] for i in range(d)], scatter, components)


def _centred(x: np.ndarray, f: Fit) -> np.ndarray:
    """n x - S, in 64-bit integers where that is sure to fit, else as Python's."""
    most = max(int(np.abs(x).max(initial=0)), 1) * f.n + max(map(abs, f.sums), default=0)
    if most < 1 << 62:
        return f.n * x - np.array(f.sums, np.int64)
    return f.n * x.astype(object) - np.array(f.sums, object)


def _deviations(c: np.ndarray) -> list[int | None]:
    rough = (c.astype(np.float64) ** 2).sum(axis=1)
    if len(rough) == 0 or (c.dtype != object and rough.max() < 2.0**62):
        return (c * c).sum(axis=1).tolist()
    exact = (sum(int(v) ** 2 for v in row) for row in c)
    return [v if v < 1 << 63 else None for v in exact]


def _whitened(c: np.ndarray, f: Fit) -> np.ndarray:
    return (c.astype(np.float64) @ f.parts) / (f.n * np.sqrt(f.values))


def _products(model):
    """Of a task's whitened rows: (cell, value) of the sums and the scatter."""

    def run(batches):
        f = model.value
        k = len(f.values)
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = _whitened(_centred(V.whole(V.matrix(batch.column(0), f.d), SCALE, SHIFT, MOST), f), f)
            w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "value"])

    return run


def _rows(model, error: float):
    def run(batches):
        f = model.value
        k = len(f.values)
        for batch in batches:
            c = _centred(V.whole(V.matrix(batch.column(1), f.d), SCALE, SHIFT, MOST), f)
            w, n = _whitened(c, f), len(c)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(n), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, f.n, np.int64)), pa.array(_deviations(c), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                    pa.array(w.ravel()), pa.array(np.tile(f.values / f.trace, n)), pa.array(np.full(n * k, error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: id_col, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[id_col]
    own = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).where(V.usable(F.col("v")))
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    f = fit(own, "v", components)
    if f is None or len(f.values) == 0:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    own = own.where(F.size("v") == f.d)
    model = spark.sparkContext.broadcast(f)
    k = len(f.values)
    got = own.select("v").mapInArrow(_products(model), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((k + 1) ** 2)
    for r in got:
        total[r.cell] = r.value
    total = total.reshape(k + 1, k + 1) / f.n
    error = float(np.abs(total[:k, :k] - np.outer(total[:k, k], total[:k, k]) - np.eye(k)).max())
    return own.mapInArrow(_rows(model, error), schema).withColumnRenamed("id", id_col)

"""Quality classifier: naive Bayes support vectors on n-gram indicators.

Learns from at most ``most_rows`` labelled rows (those of least hash of the id, a documented
bound), never from held-out ones; indicators are scaled by class log-count ratios and a linear
hinge-loss model is fitted on the driver by dual coordinate descent. Every row is then scored
over its whole text. The model has a fixed size (two tables of 2**18 numbers).

Defined results: a null or empty text gets the score of no features; labels that are null are
not learnt from; with no labels, or one class only, the score is the smoothed share of label 1;
repeated rows each get a row (and repeated labels each count); null ids are not held out; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import linear as L

MOST_ROWS = 4000
THRESHOLD = 0.7


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def _features(pairs: bool):
    def run(batches):
        for batch in batches:
            raw, off = C.text_buffers(batch.column(1))
            for a, b in C.chunks(off):
                lists, _ = L.cell_lists(raw[off[a] : off[b]], off[a : b + 1] - off[a], pairs)
                cells = pa.array([c.astype("<i4").tobytes() for c in lists], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), cells], names=["y", "cells"])

    return run


def labelled_features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: Column, most_rows: int, pairs: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
    """Cells and labels of at most most_rows labelled documents, on the driver: those of least hash of
    the id, and of rows that share an id those of least label and cells."""
    rows = labels.where(label.isNotNull()).select(F.col(f"`{id_col}`").alias("key"), label.cast("int").alias("y"))
    rows = F.broadcast(rows.where(~held_out(F.col("key"))).orderBy(F.xxhash64("key"), "key", "y").limit(most_rows))
    docs = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    got = docs.join(rows, "key").select(F.struct(F.xxhash64("key").alias("h"), "y").alias("hy"), F.coalesce("text", F.lit("")).alias("text"))
    got = got.mapInArrow(C.tidy(_features(pairs)), "y struct<h:long,y:int>, cells binary").orderBy("y", "cells").limit(most_rows)
    got = sorted((r.y.y, bytes(r.cells)) for r in got.collect())
    order = np.random.Generator(np.random.PCG64(3)).permutation(len(got))
    return [np.frombuffer(got[i][1], dtype="<i4") for i in order], np.array([got[i][0] for i in order])


def _scores(model):
    def run(batches):
        m = model.value
        for batch in batches:
            raw, off = C.text_buffers(batch.column(1))
            for a, b in C.chunks(off):
                lists, _ = L.cell_lists(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                scores = pa.array([m.score(c) for c in lists], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), scores], names=["id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> L.Model:
    C.ship(docs.sparkSession)
    return L.train(*labelled_features(docs, labels, id_col, text_col, F.col(f"`{label_col}`"), most_rows))


def classify(docs: DataFrame, model: L.Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id_col, held_out boolean, score double, predicted int."""
    spark = docs.sparkSession
    C.ship(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = rows.mapInArrow(C.tidy(_scores(spark.sparkContext.broadcast(model))), f"id {dict(rows.dtypes)['id']}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _verdicts(model, threshold, at, names):
    def run(batches):
        m = model.value
        for batch in batches:
            raw, off = C.text_buffers(batch.column(at))
            keep = []
            for a, b in C.chunks(off):
                lists, _ = L.cell_lists(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                keep += [m.score(c) >= threshold for c in lists]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_good(docs: DataFrame, model: L.Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that the model accepts."""
    spark = docs.sparkSession
    C.ship(spark)
    at = docs.columns.index(text_col)
    return docs.mapInArrow(C.tidy(_verdicts(spark.sparkContext.broadcast(model), threshold, at, docs.columns)), docs.schema)

"""Whitening and hard negatives against brute force; toxicity against a dictionary's counts."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.llm import common, hard_negatives, toxicity, vectors, whitening

VECTORS = "vec_id long, embedding array<float>, label int, component int, x string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 7, "clash") for i, v, y in rows], VECTORS)


@pytest.fixture(scope="module")
def rows():
    """Vectors with copies (a third of all), ties, a repeated row, and rows that take no part."""
    rng = np.random.Generator(np.random.PCG64(4))
    out = [(i, [float(np.float32(v)) for v in rng.normal(size=6) * (1 + np.arange(6) / 3) / 4], int(rng.integers(0, 4))) for i in range(260)]
    out += [(260 + i, out[7][1], 2) for i in range(130)]
    out.append(out[100])
    odd = [(900, None, 1), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (902, [math.nan] * 6, 1), (903, [math.inf] * 6, 1), (904, [], 1), (905, [1.0, 2.0], 0)]
    return out, odd


# ------------------------------------------------------------------ 11


def test_whitening_equals_brute_force(spark, rows):
    good, odd = rows
    got = whitening.whiten(table(spark, good + odd).repartition(5)).toPandas()
    x = np.floor(1024 * np.array([v for _, v, _ in good])).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    values, parts = np.linalg.eigh(np.cov(x.T, bias=True))
    values, parts = values[::-1], parts[:, ::-1]
    assert sorted(got.vec_id) == sorted(i for i, _, _ in good for _ in range(6))
    want = {i: int(((n * x[k] - s) ** 2).sum()) for k, (i, _, _) in enumerate(good)}
    assert all(r.deviation == want[r.vec_id] and r.n == n for r in got.itertuples())
    at = {i: k for k, (i, _, _) in enumerate(good)}
    for c in range(6):
        mine = got[got.component == c + 1]
        p = np.array([(x[at[i]] - s / n) @ parts[:, c] / math.sqrt(values[c]) for i in mine.vec_id])
        assert min(np.abs(p - mine.whitened).max(), np.abs(p + mine.whitened).max()) < 1e-6
        assert np.allclose(mine.explained, values[c] / values.sum(), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


@given(st.lists(st.lists(st.integers(-(2**52), 2**52), min_size=3, max_size=3), min_size=1, max_size=20))
@settings(max_examples=40, deadline=None)
def test_residue_scatter_is_exact(x):
    x = np.array(x, np.int64)
    bound = len(x) * (int(np.abs(x).max()) + 1) ** 2
    moduli = whitening.primes(bound)
    parts = [[int(v) for v in (np.mod(x, p).astype(object).T @ np.mod(x, p).astype(object)).ravel() % p] for p in moduli]
    assert whitening.remaindered(parts, moduli) == [int(v) for v in (x.astype(object).T @ x.astype(object)).ravel()]


def test_whitening_of_large_entries(spark):
    """Entries whose products leave 64 bits: the scatter stays exact, a deviation beyond a long is null."""
    big = [(i, [float(2**30 * (i + 1)), float(3 - i)], 0) for i in range(5)]
    f = whitening.fit(table(spark, big).select("embedding"), "embedding")
    x = [[1024 * 2**30 * (i + 1) + 100_000, 1024 * (3 - i) + 100_000] for i in range(5)]
    assert f.scatter == [[sum(r[i] * r[j] for r in x) for j in range(2)] for i in range(2)] and f.sums == [sum(r[i] for r in x) for i in range(2)]
    assert f.trace == float(sum(Fraction(5 * f.scatter[i][i] - f.sums[i] ** 2, 25) for i in range(2)))
    got = whitening.whiten(table(spark, big)).where("component = 1").orderBy("vec_id").collect()
    s = f.sums
    want = [sum((5 * v - t) ** 2 for v, t in zip(r, s)) for r in x]
    assert [r.deviation for r in got] == [v if v < 2**63 else None for v in want] and got[2].deviation is not None


def test_whitening_edges(spark, rows):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, rows[1][:5])).count() == 0
    assert whitening.whiten(table(spark, [(i, [1.0, 2.0], 0) for i in range(9)])).count() == 0
    flat = whitening.whiten(table(spark, [(None, [float(i), 1.0], None) for i in range(9)])).collect()
    assert len(flat) == 9 and {r.component for r in flat} == {1} and all(r.vec_id is None for r in flat)
    assert abs(flat[0].explained - 1) < 1e-12


# ------------------------------------------------------------------ 12


def brute(rows, anchor, positives=5, negatives=10, label=lambda i, y: y):
    x = {k: np.floor(256 * np.array(v)).astype(int) for k, (_, v, _) in enumerate(rows)}
    y = {k: label(i, c) for k, (i, _, c) in enumerate(rows)}
    out = []
    for a, (i, _, _) in enumerate(rows):
        if not anchor(i):
            continue
        near = sorted((-int(x[a] @ x[k]), rows[k][0], k) for k in x if k != a)
        for s, p, _ in [t for t in near if y[t[2]] == y[a]][:positives]:
            fit = [t for t in near if y[t[2]] != y[a] and 30 * -s <= 100 * -t[0] <= 90 * -s][:negatives]
            out += [(i, p, r + 1, t[1], -s, -t[0]) for r, t in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"lists": 1}, {"lists": 40, "positives": 3, "negatives": 4}])
def test_hard_negatives_equal_brute_force(spark, rows, options):
    good, odd = rows
    df = table(spark, [*good, *odd, (None, [1.0] * 6, 1), (910, [1.0] * 6, None)]).repartition(4)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(df, F.col("vec_id") % 20 == 0, label, **options)
    want = brute(good, lambda i: i % 20 == 0, *(options.get(k, d) for k, d in (("positives", 5), ("negatives", 10))), label=lambda i, y: (y + 1) % 10 if i % 7 == 0 else y)
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == want


def test_hard_negatives_visit_few_lists(spark):
    """Tight clusters: bounds leave out most lists, and the result is still whole."""
    rng = np.random.Generator(np.random.PCG64(8))
    centres = rng.normal(size=(30, 5))
    good = [(i, [float(np.float32(v)) for v in centres[i % 30] + rng.normal(size=5) / 100], i % 3) for i in range(900)]
    with common.Scratch(spark) as s:
        own = table(spark, good).select("vec_id", "label", F.col("embedding").alias("v"))
        rows_ = s.write(own.select(F.struct("vec_id", F.lit(False).alias("anchor")).alias("vec_id"), "label", "v").mapInArrow(hard_negatives._integers(5), "vec_id struct<vec_id:long,anchor:boolean>, label int, x binary").select(F.col("vec_id.vec_id").alias("row"), "vec_id.vec_id", "label", "x"))
        index = hard_negatives.build(rows_, 5, s, lists=60)
        x = np.floor(256 * np.array([v for _, v, _ in good]))
        low, high = hard_negatives.bounds(x[0], index.centroids, index.radii)
        near = hard_negatives.nearest(x, index.centroids)
        assert (low[near] <= x @ x[0]).all() and (x @ x[0] <= high[near]).all()
        tenth = np.sort(x @ x[0])[-10]
        assert (high[index.n_blocks > 0] >= tenth).sum() < 0.5 * (index.n_blocks > 0).sum()
    got = hard_negatives.mine(table(spark, good), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute(good, lambda i: i % 100 == 0)


def test_hard_negatives_edges(spark, rows):
    assert hard_negatives.mine(table(spark, []), F.lit(True)).count() == 0
    assert hard_negatives.mine(table(spark, rows[1][:4]), F.lit(True)).count() == 0
    alone = [(0, [1.0, 1.0], 1), (1, [1.0, 0.5], 2)]
    assert hard_negatives.mine(table(spark, alone), F.lit(True)).count() == 0  # no positives
    below = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2)]
    assert hard_negatives.mine(table(spark, below), F.col("vec_id") == 0).count() == 0  # a positive's score below zero
    wide = [(0, [2.0**18, 2.0**18], 1), (1, [2.0**18, 2.0**18 - 1], 1), (2, [2.0**17, 2.0**17], 2)]
    assert sorted(map(tuple, hard_negatives.mine(table(spark, wide), F.lit(True)).collect())) == brute(wide, lambda i: True)


def test_k_means_keeps_small_tables():
    """A whole sample against MOST_LISTS centroids: the table of distances is made in parts."""
    import tracemalloc

    rng = np.random.Generator(np.random.PCG64(2))
    x, c = rng.normal(size=(hard_negatives.SAMPLE_ROWS, 16)), rng.normal(size=(hard_negatives.MOST_LISTS, 16))
    tracemalloc.start()
    near = hard_negatives.nearest(x, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    assert (near[:50] == ((x[:50, None] - c) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_queries_are_sent_once_to_a_cell(spark, rows):
    """However many lists and blocks meet a query's windows, it goes once to each cell; many cells, rounds and
    blocks give what brute force gives."""
    good = [r for r in rows[0] if r[0] != 7]
    with common.Scratch(spark) as s:
        own = table(spark, good).select(F.struct("vec_id", F.lit(False).alias("anchor")).alias("vec_id"), "label", F.col("embedding").alias("v"))
        own = own.mapInArrow(hard_negatives._integers(6), "vec_id struct<vec_id:long,anchor:boolean>, label int, x binary")
        kept = s.write(own.select(F.monotonically_increasing_id().alias("row"), "vec_id.vec_id", "label", "x"))
        index = hard_negatives.build(kept, 6, s, lists=70, block_rows=4, cell_bytes=100)
        assert index.cells > 20 and index.kind == "<f4"
        wide = F.array(F.struct(F.lit(0).alias("w"), F.lit(hard_negatives.LOWEST).alias("least"), F.lit(hard_negatives.HIGHEST).alias("most")))
        asked = kept.where("vec_id % 20 = 0").select(F.col("row").alias("q"), "label", "x", wide.alias("windows"))
        model = spark.sparkContext.broadcast(index.bare())
        sent = asked.mapInArrow(hard_negatives._visits(model, 6, 70), f"cell int, q long, label int, x binary, windows {hard_negatives.WINDOWS}, edge double, list int")
        assert sent.groupBy("q", "cell").count().where("count > 1").isEmpty()
        assert sent.count() == asked.count() * index.cells
        got = sorted(map(tuple, hard_negatives.search(asked, index, 3, False, s, first=2, growth=4).select("q", "rank", "score", "vec_id").collect()))
        all_ = kept.collect()
        x = {r.row: np.frombuffer(r.x, "<i4").astype(int) for r in all_}
        want = []
        for q in asked.collect():
            best = sorted((-int(x[q.q] @ x[r.row]), r.vec_id, r.row) for r in all_ if r.label != q.label)[:3]
            want += [(q.q, i + 1, -b[0], b[1]) for i, b in enumerate(best)]
        assert got == sorted(want)


def test_rows_of_one_size(spark):
    df = table(spark, [(0, [1.0], 0), (1, [1.0, 2.0], 0), (2, [1.0, 3.0], 0), (3, [2.0], 0)])
    kept, d = vectors.of_one_size(df, "embedding")
    assert d == 2 and sorted(r.vec_id for r in kept.collect()) == [1, 2]


# ------------------------------------------------------------------ 13

DOCS = "doc_id long, text string, toxic int, score double, h long"


def talk(seed=3, n=900):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3))) for _ in range(150)]
    foul = ["ugly", "rotten", "vile"]
    docs, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(foul))
        docs.append((i, " ".join(t).capitalize() + ".", None, 0.5, 1))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = talk()
    texts, marks = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(texts, marks)
    got = toxicity.toxicity(texts, model).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and 100 < len(held) < 300
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    flipped = spark.createDataFrame([(i, 1 - y if i in {r.doc_id for r in held} else y) for i, y in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.toxicity(texts, toxicity.fit(texts, flipped)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in got)  # held-out labels say nothing


def counted(docs, labels):
    """Continuation counts of words and pairs by class, from dictionaries of sets."""
    import re

    w_, p_ = ({}, {}), ({}, {})
    for i, t, *_ in docs:
        if i not in labels:
            continue
        seq = ["<"] + [x.lower() for x in re.findall(r"[A-Za-z0-9']+", t or "")] + [">"]
        for k in range(1, len(seq)):
            w_[labels[i]].setdefault(seq[k], set()).add(seq[k - 1])
            p_[labels[i]].setdefault((seq[k - 1], seq[k]), set()).add(seq[k - 2] if k > 1 else "<")
    return w_, p_


def test_toxicity_counts_are_continuation_counts(spark):
    """The words that stay, and their ratios, equal those from a dictionary's counts; copies count once."""
    docs, labels = talk(5, 400)
    kept = {r.doc_id for r in spark.createDataFrame(docs, DOCS).where(~toxicity.held_out(F.col("doc_id"))).collect()}
    copies = [(10_000 + k, docs[1][1], None, 0.5, 1) for k in range(60)]
    marks = [*labels, *((i, 1) for i, *_ in copies)]
    held = F.col("key") < 0
    model = toxicity.fit(spark.createDataFrame(docs + copies, DOCS), spark.createDataFrame(marks, "doc_id long, toxic int"), held=held)
    w_, p_ = counted(docs + copies, dict(marks))
    k = [{w: len(s) for w, s in w_[c].items()} for c in (1, 0)]
    shared = {w: len(w_[0].get(w, set()) | w_[1].get(w, set())) for w in {*w_[0], *w_[1]}}
    n, all_ = [sum(c.values()) for c in k], sum(shared.values())
    stay = []
    for w in shared:
        a, b = k[0].get(w, 0), k[1].get(w, 0)
        part = n[0] / sum(n)
        g = 2 * sum(x * math.log(x / ((a + b) * q)) for x, q in ((a, part), (b, 1 - part)) if x)
        times = ((a + 0.5) / (n[0] + 1)) / ((b + 0.5) / (n[1] + 1))
        if g >= toxicity.EVIDENCE and (times >= 4 or times <= 0.25):
            stay.append(w)
    assert {"ugly", "rotten", "vile"} <= set(stay)
    d = [(sum(v == 1 for v in c.values()) + 1) / (sum(v == 1 for v in c.values()) + 2 * sum(v == 2 for v in c.values()) + 2) for c in k]
    own = {w: [max(k[c].get(w, 0) - d[c], 0) / n[c] + d[c] * len(k[c]) / n[c] * shared[w] / all_ for c in (0, 1)] for w in stay}
    left = [(1 - sum(p[c] for p in own.values())) / (1 - sum(shared[w] for w in stay) / all_) for c in (0, 1)]
    for c in (0, 1):  # a distribution
        assert abs(sum(p[c] for p in own.values()) + left[c] * sum(shared[w] for w in shared if w not in stay) / all_ - 1) < 1e-9
    keys = np.concatenate([toxicity.sequences(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][1:2] for w in stay])
    got, there = model.ratio(0, keys, 0.0)
    assert there.all() and len(model.tables[0][0]) == len(stay)
    assert np.allclose(got, [math.log(own[w][0] / own[w][1]) for w in stay], rtol=1e-9)
    assert abs(model.rest - math.log(left[0] / left[1])) < 1e-12
    assert kept  # the rows outside the held-out fifth


def test_toxicity_whole_texts_and_edges(spark):
    docs, labels = talk()
    model = toxicity.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    plain = docs[next(i for i, y in labels if y == 0)][1]
    long = (plain + " ") * 6000
    odd = [(0, None, 0, 0.1, 2), (1, "", 0, 0.1, 2), (2, " ,.\n", 0, 0.1, 2), (3, long, 0, 0.1, 2), (4, long + "ugly rotten vile " * 2000, 0, 0.1, 2), (None, "vile ugly", 0, 0.1, 2), (0, None, 0, 0.1, 2)]
    got = toxicity.toxicity(spark.createDataFrame(odd, DOCS), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[0].score == by[1].score == by[2].score < 0.5
    assert by[3].predicted == 0 and by[4].predicted == 1 and by[None].predicted == 1 and not by[None].held_out
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.toxicity(empty, model).count() == 0
    for marks, p in (([], 0.5), ([(i, 1) for i, _ in labels], 0.99), ([(i, None) for i, _ in labels], 0.5)):
        one = toxicity.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(marks, "doc_id long, toxic int"))
        scores = {round(r.score, 2) for r in toxicity.toxicity(spark.createDataFrame(odd[:4], DOCS), one).collect()}
        assert len(scores) == 1 and abs(scores.pop() - p) < 0.02
    assert toxicity.toxicity(empty, toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_toxicity_of_tables_in_parts(spark):
    """Tables that are more than a task may hold are met in parts: same model, same scores, no word is left out."""
    docs, labels = talk(7, 300)
    docs = [*docs, (5, None, 0, 0.1, 2), docs[3], docs[3]]
    texts, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole, parted = toxicity.fit(texts, marks), toxicity.fit(texts, marks, most=2)
    assert whole.parts is None and parted.n_parts > 1 and parted.parts.count() == sum(len(t[0]) for t in whole.tables) > 2
    key = lambda r: (r.doc_id, round(r.difference, 9), r.predicted, r.score)
    one, two = (sorted(map(key, toxicity.toxicity(texts, m).collect())) for m in (whole, parted))
    assert len(one) == len(docs) and [r[:3] for r in one] == [r[:3] for r in two]
    # a text of shared words only stands at a cell's edge of the histogram, so rounding may move it by a cell
    assert all(abs(a[3] - b[3]) < 0.01 for a, b in zip(one, two))


def test_toxicity_keeps_rare_words(spark):
    """What tells the classes apart stays, however small its share of all counts."""
    a, b = F.col("a"), F.col("b")
    stays = spark.createDataFrame([(40.0, 0.0), (2.0, 2.0)], "a double, b double").select(toxicity.differs(a, b, 1e9, 1e9)).collect()
    assert [r[0] for r in stays] == [True, False]

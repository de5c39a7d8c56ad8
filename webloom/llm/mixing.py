"""Mixing sources to target weights by soft membership.

A labelled table teaches a classifier the domains (at most ``most_rows`` rows of it, a documented
bound; one naive-Bayes-scaled linear model per domain). Every document gets domain posteriors
from its whole text. Then nonnegative document rates r are fitted so that the expected tokens of
each domain, sum of r * tokens * p(domain), match the targets: weighted least squares by
projected gradient from r = 1, r <- clip(r - sum_d p_d g_d, 0, max_rate), where g is the gradient
(excess tokens per domain) scaled by the moments of the documents whose rates are free to move; a
step that does not lower the loss is shortened. A round is one aggregate over a narrow table; the
driver sees some numbers per domain, and a rate is an expression over the document's posteriors.

With a ``max_rate`` a domain may have too few tokens for its target. By default the lead (the most
wished-for domain) keeps its tokens and such a domain stays short; with ``whole`` all goals shrink
until each can be met, at the price of the lead's tokens. What is left is logged, and ``shares``
gives it per domain.

Defined results: null texts have 0 tokens, the posteriors of no features, and rate 1 moves
nothing; a target for a domain that has no tokens is met at 0; targets are scaled to sum to 1;
repeated rows each get a row; an empty table gives an empty result; the columns named in ``keep`` are
kept (a name that the result has itself is refused), others ignored.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import linear as L
from .quality_classifier import labelled_features

log = logging.getLogger("webloom")

MOST_ROWS = 4000
ROUNDS = 20
TOLERANCE = 1e-4
#: Domains of the labelled table, in order, and the wished shares of tokens.
DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.90, "low": 0.06, "toxic": 0.04}


def domain_of(quality: Column, toxic: Column) -> Column:
    """The index in DOMAINS of a row of the labelled table."""
    return F.when(toxic == 1, 2).when(quality == 0, 1).when(quality == 1, 0)


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, n: int, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> list[L.Model]:
    C.ship(docs.sparkSession)
    rows, y = labelled_features(docs, labels, id_col, text_col, domain, most_rows, pairs=False)
    return [L.train(rows, np.where(y == d, 1, 0)) for d in range(n)]


def _posteriors(models, at: int):
    def run(batches):
        ms = models.value
        for batch in batches:
            raw, off = C.text_buffers(batch.column(at))
            got, tokens = [], []
            for a, b in C.chunks(off):
                lists, per = L.cell_lists(raw[off[a] : off[b]], off[a : b + 1] - off[a], pairs=False)
                p = np.array([[m.score(c) for m in ms] for c in lists]).reshape(-1, len(ms))
                got.append(p / p.sum(axis=1, keepdims=True))
                tokens.append(per)
            p, t = np.concatenate(got or [np.zeros((0, len(ms)))]), np.concatenate(tokens or [np.zeros(0, np.int64)])
            cols = [pa.array(t.astype(np.int64))] + [pa.array(p[:, d]) for d in range(len(ms))]
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at] + cols, names=[n for i, n in enumerate(batch.schema.names) if i != at] + ["tokens"] + [f"p{d}" for d in range(len(ms))])

    return run


def _rate(steps: list[list[float]], n: int, max_rate: float | None) -> Column:
    """From 1 the projected steps. They come as one array, so that rounds share compiled code."""
    if not steps:
        return F.lit(1.0)
    most = F.lit(float("inf") if max_rate is None else float(max_rate))

    def move(rate, g):
        dot = sum((F.col(f"p{d}") * g[d] for d in range(1, n)), F.col("p0") * g[0])
        return F.greatest(F.lit(0.0), F.least(most, rate - dot))

    return F.aggregate(F.array(*[F.array(*map(F.lit, map(float, g))) for g in steps]), F.lit(1.0), move)


def fit_rates(scored: DataFrame, targets: list[float], max_rate: float | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE, whole: bool = False) -> tuple[Column, np.ndarray]:
    """The rate as an expression over tokens, p0, p1, ...; and the excess left in each domain, in
    shares of all tokens (negative: short of its goal)."""
    n = len(targets)
    p = [F.col(f"p{d}") for d in range(n)]
    first = scored.agg(F.sum("tokens").alias("t"), *[F.sum(F.col("tokens") * p[d]).alias(f"s{d}") for d in range(n)]).first()
    total = float(first.t or 0)
    if total == 0:
        return F.lit(1.0), np.zeros(n)
    share = np.array([max((first[f"s{d}"] or 0) / total, 1e-9) for d in range(n)])
    wished = np.array(targets, dtype=float) / sum(targets)
    # as many tokens as leave the most wished-for domain at the rate it has
    lead = int(np.argmax(wished))
    goal = wished * share[lead] / wished[lead]
    if whole and max_rate is not None:  # as many as the scarcest domain allows
        goal = wished * min(share[d] * max_rate / wished[d] for d in range(n) if wished[d] > 0)

    def measured(steps):
        """Excess per domain, and the moments of documents whose rate is free to move."""
        rate = _rate(steps, n, max_rate)
        free = (rate > 0) if max_rate is None else (rate > 0) & (rate < float(max_rate)) | F.lit(not steps)
        sums = [F.sum(rate * F.col("tokens") * p[d]) for d in range(n)]
        moments = [F.sum(F.when(free, F.col("tokens") * p[i] * p[j]).otherwise(0.0)) for i in range(n) for j in range(n)]
        row = scored.agg(*[c.alias(f"c{i}") for i, c in enumerate(sums + moments)]).first()
        v = np.array([x or 0.0 for x in row]) / total
        return v[:n] - goal, v[n:].reshape(n, n)

    steps: list[list[float]] = []
    excess, moment = measured(steps)
    size, plain = 1.0, False
    for _ in range(rounds):
        loss = float((excess**2 / share).sum())
        if np.abs(excess).max() <= tolerance:
            break
        # scaled by the moments of free documents; plain where that no longer helps (many at a bound)
        direction = excess / share if plain else np.linalg.solve(moment + 1e-6 * np.diag(share), excess)
        tried = steps + [list(size * direction)]
        new_excess, new_moment = measured(tried)
        if float((new_excess**2 / share).sum()) < loss * (1 - 1e-3):
            steps, excess, moment, size, plain = tried, new_excess, new_moment, 1.0, plain
        elif size >= 1e-2:
            size /= 4
        elif not plain:
            size, plain = 1.0, True
        else:
            break
    return _rate(steps, n, max_rate), excess


def mix(docs: DataFrame, models: list[L.Model], targets: list[float], text_col: str = "text", keep: list[str] = (), max_rate: float | None = None, seed: int = 29, whole: bool = False) -> DataFrame:
    """One row per input row: the columns ``keep``, tokens long, p0.. double, rate double, copies long.

    ``copies`` realises the rate: its whole part, and one more with the chance of the rest, by a
    seeded hash of the kept columns.
    """
    spark = docs.sparkSession
    C.ship(spark)
    clash = {"tokens", "rate", "copies", *(f"p{d}" for d in range(len(models)))} & set(keep)
    if clash:
        raise ValueError(f"names of the result: {sorted(clash)}")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = ", ".join([f"{c} {t}" for c, t in rows.dtypes if c != "text"] + ["tokens long"] + [f"p{d} double" for d in range(len(models))])
    with C.Scratch(spark) as s:
        scored = s.write(rows.mapInArrow(C.tidy(_posteriors(spark.sparkContext.broadcast(models), len(keep))), kinds), keep=True)
    rate, excess = fit_rates(scored, targets, max_rate, whole=whole)
    if np.abs(excess).max() > TOLERANCE:
        log.warning("targets not met: excess by domain, in shares of all tokens, %s", np.round(excess, 5).tolist())
    kept = [F.col(f"k{i}") for i in range(len(keep))]
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *kept), 11) / float(1 << 53)
    out = scored.withColumn("rate", rate)
    return out.select(*[c.alias(n) for c, n in zip(kept, keep)], "tokens", *[f"p{d}" for d in range(len(models))], "rate", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"))


def shares(mixed: DataFrame, targets: list[float]) -> DataFrame:
    """(domain, target, share): the wished and the expected share of tokens after mixing."""
    n = len(targets)
    weight = F.col("rate") * F.col("tokens")
    sums = mixed.agg(F.array(*[F.sum(weight * F.col(f"p{d}")) for d in range(n)]).alias("got"), F.sum(weight).alias("all"))
    wished = F.array(*[F.lit(float(t) / sum(targets)) for t in targets])
    return sums.select(F.posexplode("got").alias("domain", "tokens"), "all").select("domain", F.element_at(wished, F.col("domain") + 1).alias("target"), (F.col("tokens") / F.col("all")).alias("share"))

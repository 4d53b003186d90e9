"""Quality classifier: random Fourier features over document statistics, ridge scores from partition-summed normal
equations, isotonic calibration on out-of-fold scores."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _util as U

#: Cosine features, kernel width in units of the median distance, ridge strength per row, folds, seed.
FEATURES, WIDTH, RIDGE, FOLDS, SEED = 192, 1.0, 1e-4, 3, 7
N_STATS = 18
PARTS = 16  # first sums of the partitions' matrices, 180 kB each
ACCEPT = 0.7
_UPPER, _LOWER, _DIGIT = (bytes(range(*r)) for r in ((65, 91), (97, 123), (48, 58)))
_SPACE, _STOP, _HIGH = b" \t\n\r\x0b\x0c", b".,;:?'\"-", bytes(range(128, 256))
_SYMBOL = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _STOP)


def doc_stats(text: str | None) -> list[float]:
    """18 statistics of the whole text; a null text counts as empty, and an empty one has zeros."""
    b = (text or "").encode("utf-8", "replace")
    words = b.split()
    n, m = len(b), len(words)
    if not m:
        return [0.0] * N_STATS
    of = lambda chars: (n - len(b.translate(None, chars))) / n
    counts = Counter(words)
    top = counts.most_common(3)
    lines = [x for x in b.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:]))) / max(1, m - 1)
    packed = len(zlib.compress(b, 1)) / n
    return [
        np.log1p(m),
        np.log1p((n - b.count(b" ")) / m),
        of(_UPPER),
        of(_LOWER),
        of(_DIGIT),
        of(_SYMBOL),
        of(_STOP),
        of(_HIGH),
        of(_SPACE),
        len(counts) / m,
        np.log(len(counts)) / np.log(m + 1),
        top[0][1] / m,
        sum(c for _, c in top) / m,
        pairs,
        len(set(lines)) / len(lines),
        np.log1p(m / len(lines)),
        min(packed, 2.0),
        sum(1 for w in counts if not w.translate(None, _SYMBOL)) / len(counts),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def stats_of(text: pd.Series) -> pd.Series:
    return pd.Series([doc_stats(t) for t in text], dtype=object)


@dataclass
class Model:
    """Plain arrays, a few hundred kB at most. ``knots`` None: nothing to learn from, every score is ``prior``."""

    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w: np.ndarray | None = None
    knots: tuple | None = None
    prior: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return features(x, self.mean, self.scale) @ self.w

    def score(self, stats: pd.Series) -> np.ndarray:
        if self.knots is None or not len(stats):
            return np.full(len(stats), self.prior)
        return U.apply_isotonic(self.knots, self.raw(np.vstack(stats.to_numpy())))


def features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """1, the standardised statistics, and random cosines whose products approximate a Gaussian kernel of them."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(N_STATS, FEATURES)) / (WIDTH * np.sqrt(N_STATS))
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([np.ones((len(x), 1)), z / 8, np.sqrt(2.0 / FEATURES) * np.cos(z @ w + phase)])


def fit(stats: DataFrame, labels: DataFrame, holdout: tuple[int, int] = (4, 2)) -> Model:
    """Learn from ``stats`` (doc_id, stats) and ``labels`` (doc_id, quality), without the rows of the held-out fold.

    Every labelled row counts; each partition sums its own normal equations by fold, and a second, distributed step
    adds these to PARTS sums of each fold, which the driver adds up.
    """
    U.small_batches(stats)
    y = U.single_label(labels, "quality").where(U.fold(F.col("doc_id"), holdout[0]) != holdout[1])
    rows = U.checkpoint(stats.where(F.col("doc_id").isNotNull()).join(y, "doc_id").select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")))
    aggs = [f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(N_STATS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    got = rows.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    if not got["n"]:
        return Model()
    mean, scale = (np.array([got[f"{k}{i}"] for i in range(N_STATS)]) for k in "ms")
    scale = np.where(scale > 1e-9, scale, 1.0)
    d = 1 + N_STATS + FEATURES
    upper = np.triu_indices(d)  # the matrices are symmetric

    def partial(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % PARTS  # the same if the task runs again
        sums = np.zeros((FOLDS, d, d + 1))
        for pdf in batches:
            if len(pdf):
                z, t, f = features(np.vstack(pdf.stats.to_numpy()), mean, scale), pdf.y.to_numpy(), pdf.fold.to_numpy()
                for k in range(FOLDS):
                    zk = z[f == k]
                    sums[k] += np.hstack([zk.T @ zk, (zk.T @ t[f == k])[:, None]])
        if sums.any():
            yield pd.DataFrame({"fold": range(FOLDS), "part": part, "m": [np.concatenate([s[:, :d][upper], s[:, d]]).tobytes() for s in sums]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": [int(pdf.fold.iloc[0])], "m": [sum(np.frombuffer(x) for x in pdf.m).tobytes()]})

    # PARTS sums of each fold reach the driver, 9 MB in all whatever the input.
    sums = rows.mapInPandas(partial, "fold int, part int, m binary").groupBy("fold", "part").applyInPandas(add, "fold int, m binary")
    by = {k: np.zeros((d, d + 1)) for k in range(FOLDS)}
    for r in sums.collect():
        v, full = np.frombuffer(r["m"]), np.zeros((d, d + 1))
        full[:, :d][upper] = v[:-d]
        full[:, :d] += np.triu(full[:, :d], 1).T
        full[:, d] = v[-d:]
        by[r["fold"]] += full
    total = sum(by.values())

    def solve(s: np.ndarray) -> np.ndarray:
        return np.linalg.solve(s[:, :d] + RIDGE * max(s[0, 0], 1.0) * np.eye(d), s[:, d])

    out = [solve(total - by[k]) if (total - by[k])[0, 0] > 0 else solve(total) for k in range(FOLDS)]
    weights = np.vstack(out)

    @F.pandas_udf("double")
    def unseen(stats: pd.Series, fold: pd.Series) -> pd.Series:
        z = features(np.vstack(stats.to_numpy()), mean, scale) if len(stats) else np.zeros((0, d))
        return pd.Series((z * weights[fold.to_numpy(dtype=int)]).sum(axis=1))

    knots = U.fit_isotonic(rows.select(unseen("stats", "fold").alias("raw"), "y"), "raw", "y", 0.002)
    return Model(mean, scale, solve(total), knots)


def scored(df: DataFrame, model: Model, stats) -> DataFrame:
    """``df`` with ``score`` from the statistics column ``stats``; the function runs once a row even under filters."""

    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(stats))

    return df.withColumn("score", score.asNondeterministic()(stats))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text), one pass over the texts.

    Null and empty texts get the score of an empty document; repeated rows each get theirs; without any labelled
    row every score is 1. Labels, lang, source and doc_id never enter a score.
    """
    U.small_batches(docs)
    stats = U.checkpoint(docs.select(F.col("doc_id"), stats_of("text").alias("stats")))
    out = scored(stats, fit(stats, labels), F.col("stats"))
    return out.select("doc_id", (U.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns; texts are never shuffled."""
    U.small_batches(docs)
    model = fit(docs.select("doc_id", stats_of("text").alias("stats")), labels)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("stats", stats_of.asNondeterministic()("row.text"))
    return scored(rows, model, F.col("stats")).where(F.col("score") >= ACCEPT).select("row.*")

"""Mutual information of a continuous feature and a binary label by nearest neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats

#: Rows of a feature that one estimate holds in memory; larger features are estimated in parts, by a hash of the row,
#: and the parts' estimates are averaged by their sizes. Neighbours.
PART_ROWS, NEIGHBOURS = 200_000, 3


def digamma(x: np.ndarray) -> np.ndarray:
    """Digamma at positive integers: harmonic numbers less Euler's constant."""
    x = np.asarray(x, dtype=np.int64)
    h = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, max(int(x.max(initial=1)), 2)))])
    return h[x - 1] - 0.5772156649015329


def mutual_information(v: np.ndarray, y: np.ndarray, k: int = NEIGHBOURS) -> float:
    """psi(n) + psi(k) - mean psi(class size) - mean psi(neighbours within the class's k-th distance), nats, 0 at
    least; classes of one row are left out."""
    use = np.isin(y, [c for c in np.unique(y) if (y == c).sum() > 1])
    v, y = v[use].astype(float), y[use]
    n = len(v)
    if n < 2:
        return 0.0
    v = v / (v.std(ddof=1) or 1.0)
    radius, ks, sizes = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for c in np.unique(y):
        at = np.flatnonzero(y == c)
        at = at[np.argsort(v[at], kind="stable")]
        s, m = v[at], len(at)
        kk = min(k, m - 1)
        best = np.full(m, np.inf)
        # The k nearest of sorted values are a run around each: try every split of k between left and right.
        for left in range(kk + 1):
            lo, hi = np.arange(m) - left, np.arange(m) + kk - left
            ok = (lo >= 0) & (hi < m)
            d = np.full(m, np.inf)
            i = np.flatnonzero(ok)
            d[i] = np.maximum(s[i] - s[lo[i]], s[hi[i]] - s[i])
            best = np.minimum(best, d)
        # Strictly nearer than the k-th, whatever rounding does to the sums below.
        radius[at], ks[at], sizes[at] = np.maximum(best - 8 * np.finfo(float).eps * np.abs(s).max(), 0.0), kk, m
    s = np.sort(v)
    inside = np.searchsorted(s, v + radius, side="right") - np.searchsorted(s, v - radius, side="left")
    mi = digamma(np.array([n]))[0] + digamma(ks).mean() - digamma(sizes).mean() - digamma(np.maximum(inside, 1)).mean()
    return max(0.0, float(mi))


def mutual_information_of(long: DataFrame, id_col: str, label: str = "label_a") -> DataFrame:
    """(feature, n, mi): non-finite values count as the feature's median."""
    v = F.col("value")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    mid = long.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"))
    mid = stats.same_keys(mid, stats.quantiles(long, ["feature"], (0.5,)), ["feature"]).select("feature", "rows", F.coalesce(F.col("q")[0], F.lit(0.0)).alias("mid"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rows") / PART_ROWS))
    x = long.join(F.broadcast(mid), "feature").select("feature", F.pmod(F.xxhash64(id_col), parts).alias("part"), F.when(bad, F.col("mid")).otherwise(v).alias("value"), F.col(label).alias("y"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"feature": [pdf.feature.iloc[0]], "n": [len(pdf)], "mi": [mutual_information(pdf.value.to_numpy(), pdf.y.to_numpy())]})

    kind = long.schema["feature"].dataType.simpleString()
    got = x.groupBy("feature", "part").applyInPandas(one, f"feature {kind}, n long, mi double")
    return got.groupBy("feature").agg(F.sum("n").alias("n"), (F.sum(F.col("mi") * F.col("n")) / F.sum("n")).alias("mi"))

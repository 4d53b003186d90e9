"""Models on feature columns, and p-values of one row a feature."""

from __future__ import annotations

import math
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import selection, stats

#: Trees of a fit, and fits that share the cluster.
TREES, FITS = 100, 4


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d or 1e-300)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + num * d) or 1e-300)
            c = (1.0 + num / c) or 1e-300
            f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * f


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def normal_p(z: float) -> float:
    """Two-sided p of a standard normal score."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def sign_flip_p(deltas: list[float], exact: int = 18) -> float:
    """Two-sided p of the mean of paired differences when each sign is a coin: all flips up to ``exact`` differences,
    beyond that the normal approximation."""
    d = [x for x in deltas if x]
    if not d:
        return 1.0
    seen = abs(sum(d))
    if len(d) > exact:
        return normal_p(seen / math.sqrt(sum(x * x for x in d)))
    sums = [0.0]
    for x in d:
        sums = [s + x for s in sums] + [s - x for s in sums]
    return sum(abs(s) >= seen - 1e-12 for s in sums) / len(sums)


def with_welch_p(table: DataFrame) -> DataFrame:
    """(feature, t, df, p) of a class_statistics() result, one row a feature."""
    kind = table.schema["feature"].dataType.simpleString()
    rows = [(r["feature"], r["t"], r["df"], None if r["t"] is None else student_p(r["t"], r["df"])) for r in table.collect()]
    return table.sparkSession.createDataFrame(rows, f"feature {kind}, t double, df double, p double")


def with_rank_p(table: DataFrame) -> DataFrame:
    """(feature, u, cliffs_delta, z, p) of a mann_whitney() result, one row a feature."""
    kind = table.schema["feature"].dataType.simpleString()
    rows = [(r["feature"], r["u"], r["cliffs_delta"], r["z"], normal_p(r["z"])) for r in table.collect()]
    return table.sparkSession.createDataFrame(rows, f"feature {kind}, u double, cliffs_delta double, z double, p double")


def boosted(train: DataFrame, valid: DataFrame, features: list[int], array_col: str, label: str = "label_a", trees: int = TREES) -> dict:
    """Fit gradient-boosted trees on some elements of an array column and score the validation rows."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = array_to_vector(F.array(*[F.col(array_col)[i].cast("double") for i in features])).alias("x")
    began = time.time()
    model = GBTClassifier(featuresCol="x", labelCol=label, maxIter=trees, stepSize=0.05, maxDepth=5, seed=42).fit(train.select(vec, label))
    fit_s, began = time.time() - began, time.time()
    out = model.transform(valid.select(vec, label)).select(F.lit(0).alias("feature"), F.col(label).alias("label_a"), vector_to_array("probability")[1].alias("value")).persist()
    n = out.count()
    took = time.time() - began
    scores = stats.threshold_scores(out, "value", "label_a").first().asDict()
    got = {
        "n_features": len(features),
        "roc_auc": stats.auc(out, ["feature"]).first()["auc"],
        "pr_auc": stats.average_precision(out, ["feature"]).first()["average_precision"],
        "tpr_at_1pct": stats.tpr_at_fpr(out, ["feature"]).first()["tpr"],
        "f1": scores["f1"],
        "accuracy": scores["accuracy"],
        "fit_s": fit_s,
        "ms_per_1000": took / max(n, 1) * 1e6,
    }
    out.unpersist()
    return got


def validation_configs(order: list[int], budgets: tuple[int, ...], branch_of: dict[int, str]) -> list[tuple[str, list[int]]]:
    """(config, features): the first features of ``order`` for each budget, largest first, then the ablations of the
    branches, features in table order. Everything is left out where a budget holds it already."""
    out = [(f"mRMR_Budget_{b}", order[:b]) for b in sorted(budgets, reverse=True)]
    for name, used in selection.ablation_branches(list(dict.fromkeys(branch_of[f] for f in sorted(branch_of)))):
        features = [f for f in sorted(branch_of) if branch_of[f] in used]
        if features and not (name.startswith("FULL_") and max(budgets, default=0) >= len(order)):
            out.append((name, features))
    return out


def budget_validation(df: DataFrame, array_col: str, ranking: DataFrame, budgets: tuple[int, ...], branch_of: dict[int, str], trees: int = TREES) -> DataFrame:
    """(config, n_features, roc_auc, pr_auc, tpr_at_1pct, f1, accuracy, fit_s, ms_per_1000) for each budget of a
    ranking, largest first, and each ablation of the branches (feature -> branch). Rows with vec_id % 10 < 7 train.
    Up to FITS configurations run at a time, so fit_s and ms_per_1000 are times on a shared cluster."""
    order = [r["feature"] for r in ranking.orderBy("rank").collect()]
    train, valid = df.where(F.col("vec_id") % 10 < 7).persist(), df.where(F.col("vec_id") % 10 >= 7).persist()
    train.count(), valid.count()
    configs = validation_configs(order, budgets, branch_of)
    fit = inheritable_thread_target(df.sparkSession)(lambda features: boosted(train, valid, features, array_col, trees=trees))
    with ThreadPoolExecutor(FITS) as pool:
        rows = [(name, *got.values()) for (name, _), got in zip(configs, pool.map(fit, [f for _, f in configs]), strict=True)]
    for x in (train, valid):
        x.unpersist()
    return df.sparkSession.createDataFrame(rows, "config string, n_features int, roc_auc double, pr_auc double, tpr_at_1pct double, f1 double, accuracy double, fit_s double, ms_per_1000 double")


def pca_2d(df: DataFrame, array_col: str, dims: int) -> DataFrame:
    """(vec_id, pc1, pc2): non-finite elements become their median, columns are standardised, two components follow."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = F.col(array_col)
    got = {r["feature"]: r["q"][0] for r in stats.quantiles(stats.to_long(df, array_col, []), ["feature"], (0.5,)).collect()}
    mid = [got.get(i, 0.0) for i in range(dims)]
    filled = F.array(*[F.when(stats.finite(x[i].cast("double")), x[i].cast("double")).otherwise(F.lit(m)) for i, m in enumerate(mid)])
    v = df.select("vec_id", array_to_vector(filled).alias("x"))
    v = StandardScaler(withMean=True, inputCol="x", outputCol="z").fit(v).transform(v)
    out = PCA(k=2, inputCol="z", outputCol="pc").fit(v).transform(v).select("vec_id", vector_to_array("pc").alias("pc"))
    return out.select("vec_id", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))

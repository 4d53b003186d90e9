import math

import numpy as np
import pytest

from pixelmill.operators import audit, information, models, selection, stats


def long(spark, rows):
    return spark.createDataFrame(rows, "feature int, label_a int, value double")


def brute_auc(v, y):
    a, b = [x for x, t in zip(v, y) if t], [x for x, t in zip(v, y) if not t]
    return sum((p > n) + (p == n) / 2 for p in a for n in b) / (len(a) * len(b))


def test_auc_perfect_inverse_constant_one_class_and_ties(spark):
    rng = np.random.default_rng(0)
    v, y = rng.integers(0, 30, 300) / 7.0, rng.integers(0, 2, 300)
    rows = [(0, int(i > 4), float(i)) for i in range(10)] + [(1, int(i < 5), float(i)) for i in range(10)] + [(2, i % 2, 3.0) for i in range(10)] + [(3, 1, float(i)) for i in range(4)]
    rows += [(4, int(b), float(a)) for a, b in zip(v, y)] + [(4, 1, float("nan")), (4, 0, None), (4, 1, float("inf"))]
    got = {r["feature"]: r for r in stats.auc(long(spark, rows), ["feature"]).collect()}
    assert got[0]["auc"] == 1 and got[1]["auc"] == 0 and got[1]["effective_auc"] == 1 and got[1]["direction"] == -1
    assert got[2]["auc"] == got[3]["auc"] == 0.5 and got[2]["direction"] == 1
    assert abs(got[4]["auc"] - brute_auc(v, y)) < 1e-12


def test_validity_of_missing_and_constant(spark):
    rows = [(0, 0, float("nan")), (0, 0, None), (1, 0, 2.0), (1, 0, 2.0), (2, 0, 1.0), (2, 1, float("inf")), (2, 1, 3.0)]
    got = {r["feature"]: r for r in stats.validity(long(spark, rows), ["feature"]).collect()}
    assert got[0]["is_constant"] and got[0]["near_zero_variance"] and np.isnan(got[0]["mean"])
    assert got[1]["is_constant"] and got[2]["infinite"] == 1 and got[2]["finite"] == 2 and got[2]["median"] == 2.0


def test_welch_p_of_known_values(spark):
    assert abs(models.student_p(2.228138852, 10) - 0.05) < 1e-8
    assert abs(models.student_p(0.0, 5) - 1) < 1e-12
    assert abs(models.normal_p(1.959963985) - 0.05) < 1e-8


def test_tpr_at_fpr_uses_corners(spark):
    rows = [(0, y, s) for s, y in ((9.0, 1), (8.0, 1), (7.0, 0), (6.0, 1), (5.0, 0), (4.0, 0))]
    t = lambda m: stats.tpr_at_fpr(long(spark, rows), ["feature"], m).first()["tpr"]
    assert t(0.01) == pytest.approx(2 / 3) and t(0.4) == 1.0


def test_average_precision_against_steps(spark):
    rng = np.random.default_rng(4)
    s, y = rng.random(50), rng.integers(0, 2, 50)
    order = np.argsort(-s)
    hit = np.cumsum(y[order])
    want = (y[order] * hit / np.arange(1, 51)).sum() / y.sum()
    got = stats.average_precision(long(spark, [(0, int(b), float(a)) for a, b in zip(s, y)]), ["feature"]).first()
    assert got["average_precision"] == pytest.approx(want)


def test_mrmr_prefers_what_is_independent():
    rel = np.array([0.9, 0.85, 0.8])
    red = np.array([[1, 0.99, 0.0], [0.99, 1, 0.0], [0.0, 0.0, 1]])
    assert [k for k, *_ in selection.greedy_ranking(rel, red)] == [0, 2, 1]
    assert [k for k, *_ in selection.greedy_ranking(np.zeros(3), np.zeros((3, 3)))] == [0, 1, 2]


def test_mutual_information():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 2000)
    assert information.mutual_information(rng.random(2000), y) < 0.03
    assert information.mutual_information(y + 1e-3 * rng.random(2000), y) == pytest.approx(np.log(2), abs=0.03)
    assert information.mutual_information(np.ones(1), np.ones(1)) == 0


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([([1.0, float(i), 2.0 * i],) for i in range(5)], "v array<double>")
    for kind in ("pearson", "spearman"):
        got = {(r["f1"], r["f2"]): r["r"] for r in stats.pearson(df, "v", 3, kind).collect()}
        assert got[(0, 1)] == 0 and got[(1, 2)] == pytest.approx(1)


def test_duplicate_groups_across_splits(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", 0, 0, 1), ("a", 1, 1, 1), ("b", 0, 0, 0), ("c", 2, 0, 1), ("c", 2, 0, 2)], "t string, s int, y int, g int")
    groups = audit.duplicate_groups(df, F.sha2("t", 256), F.col("s"), F.col("y"), F.col("g"))
    got = audit.duplicate_summary(groups).first()
    assert (got["groups"], got["rows_in_groups"], got["cross_01"], got["cross_label"], got["cross_generator"]) == (2, 4, 1, 1, 1)


def test_signature(spark):
    import hashlib

    from pyspark.sql import functions as F

    table = [16, 11, *range(62)]
    df = spark.createDataFrame([([], []), ([table, [1]], [0, 2])], "t array<array<int>>, i array<int>")
    got = [r[0] for r in df.select(audit.signature(F.col("t"), F.col("i"))).collect()]
    first, second = (hashlib.md5(x.encode()).hexdigest()[:8] for x in (str(tuple(table)), "(1)"))
    assert got == ["NO_Q_TABLE", f"T0:{first};T2:{second}"]


def test_quantiles_and_ranks_of_heavy_tails(spark):
    """A tail of 1e300 and a third of all rows tied leave exact quantiles and ranks; null keys and bad values as well."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.concatenate([np.exp(rng.normal(size=2000) * 8), np.full(1000, 3.0), [1e300, -1e300, 0.0]])
    y = rng.integers(0, 2, len(x))
    rows = [(k, float(v), int(c)) for k in ("a", None) for v, c in zip(x, y)] + [("a", float("nan"), 0), ("a", None, 1), ("b", float("inf"), 1), ("c", 7.0, 1)]
    long = spark.createDataFrame(rows, "k string, value double, label_a int")
    got = {r["k"]: r["q"] for r in stats.quantiles(long, ["k"], (0.0, 0.01, 0.25, 0.5, 0.95, 1.0)).collect()}
    assert set(got) == {"a", None, "c"} and got["c"] == [7.0] * 6
    want = np.quantile(x, (0.0, 0.01, 0.25, 0.5, 0.95, 1.0))
    assert np.allclose(got["a"], want) and np.allclose(got[None], want)
    counts = stats.value_counts(long.where("k = 'a'"), ["k"], "label_a").toPandas().sort_values("value")
    assert counts.below0.tolist() == (counts.n0.cumsum() - counts.n0).tolist() and counts.below1.tolist() == (counts.n1.cumsum() - counts.n1).tolist()
    assert counts.next1.tolist()[1:] == counts.n1.tolist()[:-1] and counts.next0.isna().sum() == 1
    assert {(r["all0"], r["all1"]) for r in counts.to_dict("records")} == {(int((y == 0).sum()), int((y == 1).sum()))}
    v = {r["k"]: r for r in stats.validity(long, ["k"]).collect()}
    assert v[None]["median"] == v["a"]["median"] == np.median(x) and math.isnan(v["b"]["median"])


def test_sign_flips():
    assert models.sign_flip_p([1.0, 2.0, 3.0]) == 2 / 8
    assert models.sign_flip_p([]) == models.sign_flip_p([0.0]) == 1.0
    assert models.sign_flip_p([1.0] * 30) < 1e-6


def test_validation_trains_every_budget_and_ablation(spark, sf_dir, monkeypatch):
    from pixelmill import catalog

    seen = []

    def fit(train, valid, features, array_col, label="label_a", trees=None):
        seen.append((len(features), trees))
        return dict(n_features=len(features), roc_auc=0.5, pr_auc=0.5, tpr_at_1pct=0.0, f1=0.0, accuracy=0.5, fit_s=0.0, ms_per_1000=0.0)

    monkeypatch.setattr(models, "boosted", fit)
    got = [(r["config"], r["n_features"]) for r in catalog.QUERIES["gbt_validation"](spark, sf_dir).collect()]
    b = [f"B{i}" for i in range(4)]
    want = [(f"mRMR_Budget_{n}", n) for n in (64, 32, 16, 8)] + [(f"BRANCH_{x}", 16) for x in b]
    want += [("ADD_B0+B1", 32), ("ADD_B0+B1+B2", 48)] + [(f"WITHOUT_{x}", 48) for x in b]
    assert got == want and sorted(seen) == sorted((n, 100) for _, n in want)
    assert [n for n, _ in models.validation_configs([1, 0, 2], (2,), {0: "A", 1: "A", 2: "B"})] == ["mRMR_Budget_2", "FULL_2", "BRANCH_A", "BRANCH_B", "WITHOUT_A", "WITHOUT_B"]

"""Statistics of feature columns in long form: one row for each (row, feature) pair.

Every function takes and returns DataFrames and leaves planning to Catalyst. Ranks are taken in two levels, so that no
task holds all values of a feature: values fall into buckets that keep their order, counts before a bucket come from a
table of bucket sums, and ranks within a bucket from a window over it. Buckets end at approximate quantiles, so a heavy
tail or an outlier does not crowd them; quantiles are read off the same counts and are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that a feature's values are cut into for ranking (a power of two), and the relative accuracy of their ends.
BUCKETS, ACCURACY = 128, 2000


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def to_long(df: DataFrame, array_col: str, keep: list[str]) -> DataFrame:
    """(keep..., feature, value double) for each element of an array column; elements keep their position."""
    return df.select(*keep, F.posexplode(array_col).alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


def columns_to_long(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(keep..., feature string, value double) by unpivoting named columns."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keep, columns, "feature", "value")


def validity(long: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates of finite, missing and infinite values, population moments and linear quantiles of the finite
    ones, and flags: constant (no spread) and near zero variance (under 1e-6). Without finite values statistics are
    NaN and both flags true."""
    v = F.col("value")
    ok = finite(v)
    x = F.when(ok, v)
    nan = F.lit(float("nan"))
    out = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("finite"),
        F.count_if(v.isNull() | F.isnan(v)).alias("missing"),
        F.count_if(F.abs(v) == float("inf")).alias("infinite"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.var_pop(x).alias("variance"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
    )
    out = same_keys(out, quantiles(long, keys, (0.25, 0.5, 0.75)), keys)
    none = F.col("finite") == 0
    return out.select(
        *keys,
        "total",
        "finite",
        "missing",
        "infinite",
        (F.col("finite") / F.col("total")).alias("finite_rate"),
        *[F.coalesce(c, nan).alias(n) for n, c in (("mean", F.col("mean")), ("std", F.col("std")), ("variance", F.col("variance")), ("low", F.col("low")), ("p25", F.col("q")[0]), ("median", F.col("q")[1]), ("p75", F.col("q")[2]), ("high", F.col("high")))],
        (none | (F.col("low") == F.col("high")) | (F.col("variance") == 0)).alias("is_constant"),
        (none | (F.col("variance") < 1e-6)).alias("near_zero_variance"),
    )


def class_statistics(long: DataFrame, keys: list[str], label: str = "label_a") -> DataFrame:
    """Mean, population deviation and median by class (1 against 0), their difference, and Welch's t and degrees of
    freedom, which are null unless both classes have two values and some spread."""
    v = F.when(finite(F.col("value")), F.col("value"))
    aggs = []
    for k in (0, 1):
        x = F.when(F.col(label) == k, v)
        aggs += [F.count(x).alias(f"n{k}"), F.avg(x).alias(f"mean{k}"), F.stddev_pop(x).alias(f"std{k}"), F.var_samp(x).alias(f"var{k}")]
    out = long.groupBy(*keys).agg(*aggs)
    mid = quantiles(long.where(F.col(label).isin(0, 1)), [*keys, label], (0.5,))
    mid = mid.groupBy(*keys).agg(*[F.max(F.when(F.col(label) == k, F.col("q")[0])).alias(f"median{k}") for k in (0, 1)])
    out = same_keys(out, mid, keys)
    ok = (F.col("n0") >= 2) & (F.col("n1") >= 2) & (F.col("std0") > 0) & (F.col("std1") > 0)
    e0, e1 = F.col("var0") / F.col("n0"), F.col("var1") / F.col("n1")
    diff = F.col("mean1") - F.col("mean0")
    return out.select(
        *keys,
        *[f"{c}{k}" for k in (0, 1) for c in ("n", "mean", "std", "median")],
        diff.alias("mean_difference"),
        F.when(ok, diff / F.sqrt(e0 + e1)).alias("t"),
        F.when(ok, (e0 + e1) * (e0 + e1) / (e0 * e0 / (F.col("n0") - 1) + e1 * e1 / (F.col("n1") - 1))).alias("df"),
    )


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys``, null keys matching each other."""
    r = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(r, on, "left").drop(*[f"_{k}" for k in keys])


def bucket_ends(ok: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., _ends): approximate quantiles of each key that cut its values into buckets, one row a key. They pass
    through the driver: estimated anew after a lost executor they might differ, and ranks would not add up."""
    at = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    rows = ok.groupBy(*keys).agg(F.percentile_approx("value", at, F.lit(ACCURACY)).alias("_ends"))
    return ok.sparkSession.createDataFrame(rows.collect(), rows.schema)


def value_counts(long: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys..., value, n0, n1, below0, below1, next0, next1, all0, all1) for each distinct finite value: rows of each
    class at it, strictly below it, at the next lower value (null at the least), and in all."""
    # One key that is never null: its fields may be, and then equal each other in joins, too.
    ok = long.where(finite(F.col("value"))).select(F.struct(*keys).alias("_key"), F.col(label).alias("_label"), "value")
    x = ok.join(bucket_ends(ok, ["_key"]), "_key").withColumn("bucket", F.lit(0))
    step = BUCKETS // 2
    while step:
        # Binary search, one projection a step: ends up to the value lie before its bucket.
        x = x.withColumn("bucket", F.col("bucket") + F.when(F.get("_ends", F.col("bucket") + F.lit(step - 1)) <= F.col("value"), step).otherwise(0))
        step //= 2
    one, zero = F.sum(F.when(F.col("_label") == 1, 1).otherwise(0)), F.sum(F.when(F.col("_label") == 0, 1).otherwise(0))
    n = x.groupBy("_key", "bucket", "value").agg(zero.alias("n0"), one.alias("n1"))
    order = Window.partitionBy("_key", "bucket").orderBy("value")
    inside = order.rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("_key").orderBy("bucket")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_key")
    sums = n.groupBy("_key", "bucket").agg(*[f(c).alias(c_) for k in (0, 1) for f, c, c_ in ((F.sum, f"n{k}", f"s{k}"), (lambda c: F.max_by(c, "value"), f"n{k}", f"t{k}"))])
    sums = sums.select("_key", "bucket", *[c for k in (0, 1) for c in (F.coalesce(F.sum(f"s{k}").over(before), F.lit(0)).alias(f"b{k}"), F.sum(f"s{k}").over(whole).alias(f"all{k}"), F.lag(f"t{k}").over(across).alias(f"l{k}"))])
    n = n.select("_key", "bucket", "value", "n0", "n1", *[c for k in (0, 1) for c in (F.coalesce(F.sum(f"n{k}").over(inside), F.lit(0)).alias(f"w{k}"), F.lag(f"n{k}").over(order).alias(f"p{k}"))])
    out = n.join(sums, ["_key", "bucket"])
    return out.select(*[F.col("_key").getField(k).alias(k) for k in keys], "value", "n0", "n1", *[(F.col(f"w{k}") + F.col(f"b{k}")).alias(f"below{k}") for k in (0, 1)], *[F.coalesce(f"p{k}", f"l{k}").alias(f"next{k}") for k in (0, 1)], "all0", "all1")


def quantiles(long: DataFrame, keys: list[str], at: tuple[float, ...]) -> DataFrame:
    """(keys..., q array): exact quantiles of the finite values, linear between neighbours; keys without any are left
    out. Read off cumulative counts, so no task holds all values of a key."""
    c = value_counts(long.select(*keys, "value", F.lit(0).alias("_class")), keys, "_class")

    def ranked(p: float, f) -> Column:
        r = f((F.col("all0") - 1) * F.lit(float(p)))
        return F.max(F.when((F.col("below0") <= r) & (r < F.col("below0") + F.col("n0")), F.col("value")))

    got = c.groupBy(*keys).agg(F.max("all0").alias("_n"), *[ranked(p, f).alias(f"_{n}{i}") for i, p in enumerate(at) for n, f in (("f", F.floor), ("c", F.ceil))])
    part = [(F.col("_n") - 1) * F.lit(float(p)) - F.floor((F.col("_n") - 1) * F.lit(float(p))) for p in at]
    return got.select(*keys, F.array(*[F.col(f"_f{i}") * (1 - d) + F.col(f"_c{i}") * d for i, d in enumerate(part)]).alias("q"))


def auc(long: DataFrame, keys: list[str], label: str = "label_a") -> DataFrame:
    """(keys..., n0, n1, auc, effective_auc, direction): ROC AUC with ties counted half. Under two finite rows, one
    class or a constant give 0.5, 0.5, 1."""
    c = value_counts(long, keys, label)
    out = c.groupBy(*keys).agg(
        F.sum("n0").alias("n0"),
        F.sum("n1").alias("n1"),
        F.count(F.lit(1)).alias("_values"),
        F.sum(F.col("n1").cast("double") * (F.col("below0") + F.col("n0") / 2.0)).alias("_u"),
    )
    ok = (F.col("n0") > 0) & (F.col("n1") > 0) & (F.col("_values") > 1)
    out = out.withColumn("auc", F.when(ok, F.col("_u") / (F.col("n0").cast("double") * F.col("n1"))).otherwise(0.5))
    return out.select(*keys, "n0", "n1", "auc", F.greatest("auc", 1 - F.col("auc")).alias("effective_auc"), F.when(F.col("auc") >= 0.5, 1).otherwise(-1).alias("direction"))


def roc_points(long: DataFrame, keys: list[str], label: str = "label_a") -> DataFrame:
    """(keys..., threshold, tp, fp, tpr, fpr) for each distinct score, rows at or above it counted as positive."""
    c = value_counts(long, keys, label).withColumnsRenamed({"all0": "_p0", "all1": "_p1"})
    tp, fp = F.col("_p1") - F.col("below1"), F.col("_p0") - F.col("below0")
    return c.select(*keys, F.col("value").alias("threshold"), tp.alias("tp"), fp.alias("fp"), F.when(F.col("_p1") > 0, tp / F.col("_p1")).otherwise(0.0).alias("tpr"), F.when(F.col("_p0") > 0, fp / F.col("_p0")).otherwise(0.0).alias("fpr"), "n0", "n1", "next0", "next1", "_p0", "_p1")


def average_precision(long: DataFrame, keys: list[str], label: str = "label_a") -> DataFrame:
    """(keys..., average_precision): steps of recall times precision over distinct scores; 0 without positives."""
    p = roc_points(long, keys, label)
    step = F.when(F.col("_p1") > 0, F.col("n1") / F.col("_p1") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    return p.groupBy(*keys).agg(F.sum(step).alias("average_precision"))


def tpr_at_fpr(long: DataFrame, keys: list[str], most: float = 0.01, label: str = "label_a") -> DataFrame:
    """(keys..., tpr): true positive rate of the last corner of the ROC curve with false positive rate up to ``most``;
    corners are where the curve turns, so points that lie between neighbours on a line do not count."""
    p = roc_points(long, keys, label)
    turn = F.col("next0").isNull() | (F.col("next1") != F.col("n1")) | (F.col("next0") != F.col("n0"))
    return p.groupBy(*keys).agg(F.coalesce(F.max(F.when(turn & (F.col("fpr") <= most), F.col("tpr"))), F.lit(0.0)).alias("tpr"))


def threshold_scores(df: DataFrame, score: str, label: str, at: float = 0.5) -> DataFrame:
    """(accuracy, precision, recall, f1) of score >= at; ratios without rows are 0."""
    hit = F.col(score) >= at
    a = df.agg(F.count_if(hit & (F.col(label) == 1)).alias("tp"), F.count_if(hit & (F.col(label) == 0)).alias("fp"), F.count_if(~hit & (F.col(label) == 1)).alias("fn"), F.count_if(~hit & (F.col(label) == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(x, y):
        return F.when(y > 0, x / y).otherwise(0.0)

    return a.select("tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def group_auc(long: DataFrame, group: str = "label_b") -> DataFrame:
    """(feature, generator, auc columns): the pool of group 0 against each other group. Rows of group 0 are repeated
    for each group in use, a table of few rows."""
    others = long.select(F.col(group).alias("generator")).where("generator > 0").distinct()
    real = long.where(F.col(group) == 0).join(F.broadcast(others), F.col("generator") > F.col(group))
    pooled = real.select("feature", "generator", "value", F.lit(0).alias("label_a")).union(long.where(F.col(group) > 0).select("feature", F.col(group).alias("generator"), "value", F.lit(1).alias("label_a")))
    return auc(pooled, ["feature", "generator"])


def generator_stability(long: DataFrame, group: str = "label_b") -> DataFrame:
    """(feature, overall, mean_auc, worst, best, std, spread): effective AUC of group 0 against each group and all."""
    each = group_auc(long, group).groupBy("feature").agg(
        F.avg("effective_auc").alias("mean_auc"),
        F.min("effective_auc").alias("worst"),
        F.max("effective_auc").alias("best"),
        F.stddev_pop("effective_auc").alias("std"),
        (F.max("effective_auc") - F.min("effective_auc")).alias("spread"),
    )
    whole = auc(long.withColumn("label_a", (F.col(group) > 0).cast("int")), ["feature"]).select("feature", F.col("effective_auc").alias("overall"))
    return whole.join(each, "feature")


def distribution(df: DataFrame, keys: list[str], value: Column, digits: int = 4) -> DataFrame:
    """Count, ends, mean, population deviation and linear quantiles of ``value`` by ``keys``, rounded."""
    a = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    a = same_keys(a, quantiles(df.select(*keys, value.cast("double").alias("value")), keys, (0.25, 0.5, 0.75, 0.95)), keys)
    r = lambda c, n: F.round(c.cast("double"), digits).alias(n)
    return a.select(*keys, "n", *[r(F.col(c), c) for c in ("low", "high", "mean", "std")], *[r(F.col("q")[i], n) for i, n in enumerate(("p25", "median", "p75", "p95"))])


def pearson(df: DataFrame, array_col: str, dims: int, method: str = "pearson") -> DataFrame:
    """(f1, f2, r) for f1 < f2: correlations of an array column's elements, 0 where one is constant."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation

    vec = df.select(array_to_vector(F.col(array_col).cast("array<double>")).alias("v"))
    m = Correlation.corr(vec, "v", method).first()[0].toArray()
    rows = [(i, j, 0.0 if m[i, j] != m[i, j] else float(m[i, j])) for i in range(dims) for j in range(i + 1, dims)]
    return df.sparkSession.createDataFrame(rows, "f1 int, f2 int, r double")


def top_correlations(relevance: DataFrame, pairs: DataFrame, n: int = 30) -> DataFrame:
    """(f1, f2, r) of the whole square matrix of the ``n`` features of highest effective AUC (the first of equals),
    ones on its diagonal."""
    top = F.broadcast(relevance.orderBy(F.desc("effective_auc"), "feature").limit(n).select(F.col("feature").cast("int").alias("feature")))
    both = pairs.join(top, F.col("f1") == F.col("feature"), "left_semi").join(top, F.col("f2") == F.col("feature"), "left_semi")
    ones = top.select(F.col("feature").alias("f1"), F.col("feature").alias("f2"), F.lit(1.0).alias("r"))
    return both.union(both.select("f2", "f1", "r")).union(ones)


def redundant_pairs(pairs: DataFrame, branches: DataFrame, least: float = 0.9) -> DataFrame:
    """Pairs with |r| of ``least`` or more, their branches, and whether these differ; the branch table is a registry of
    at most a few hundred rows."""
    b = F.broadcast(branches)
    return (
        pairs.where(F.abs("r") >= least)
        .join(b.select(F.col("feature").alias("f1"), F.col("branch").alias("branch1")), "f1")
        .join(b.select(F.col("feature").alias("f2"), F.col("branch").alias("branch2")), "f2")
        .select("f1", "f2", "branch1", "branch2", "r", (F.col("branch1") != F.col("branch2")).alias("cross_branch"))
    )


def branch_redundancy(pairs: DataFrame, branches: DataFrame, least: float = 0.9) -> DataFrame:
    """(kind, n_pairs, mean_abs_r, max_abs_r, flagged) within each branch and between each two."""
    b = F.broadcast(branches)
    p = pairs.join(b.select(F.col("feature").alias("f1"), F.col("branch").alias("b1")), "f1").join(b.select(F.col("feature").alias("f2"), F.col("branch").alias("b2")), "f2")
    kind = F.when(F.col("b1") == F.col("b2"), F.concat(F.lit("Intra-"), "b1")).otherwise(F.concat(F.lit("Inter-"), F.least("b1", "b2"), F.lit("<->"), F.greatest("b1", "b2")))
    return p.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(F.abs("r")).alias("mean_abs_r"), F.max(F.abs("r")).alias("max_abs_r"), F.count_if(F.abs("r") >= least).alias("flagged"))


def branch_relevance(relevance: DataFrame, branches: DataFrame) -> DataFrame:
    """(branch, n, mean, max and min of effective AUC, best feature: the first of equals)."""
    return (
        relevance.join(F.broadcast(branches), "feature")
        .groupBy("branch")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("effective_auc").alias("mean_auc"), F.max("effective_auc").alias("max_auc"), F.min("effective_auc").alias("min_auc"), F.max_by("feature", F.struct(F.col("effective_auc"), -F.col("feature"))).alias("best"))
    )


def gini(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., gini): (2/n) sum(i * y_i) / sum(y) - (n + 1) / n over ascending y, held to 0..1; 0 for a tiny sum."""
    w = Window.partitionBy(*keys).orderBy(value)
    a = df.withColumn("_i", F.row_number().over(w)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col("_i") * F.col(value)).alias("iy"))
    g = 2.0 * F.col("iy") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")
    return a.select(*keys, F.when(F.col("s") < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), g))).alias("gini"))


def benford(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., ssd): squared distance of the first digits of |value| >= 1e-5 from Benford's law."""
    a = F.abs(F.col(value).cast("double"))
    digit = F.greatest(F.lit(1), F.least(F.lit(9), F.floor(a / F.pow(F.lit(10.0), F.floor(F.log10(a)).cast("double"))))).cast("int")
    n = df.where(a >= 1e-5).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(digit == d).alias(f"d{d}") for d in range(1, 10)])
    ssd = sum((F.pow(F.col(f"d{d}") / F.col("n") - F.log10(F.lit(1 + 1 / d)), F.lit(2.0)) for d in range(1, 10)), F.lit(0.0))
    return n.select(*keys, ssd.alias("ssd"))


def entropy(df: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """(keys..., entropy): bits of an equal-width histogram between the ends of each group, 0 for no spread."""
    w = Window.partitionBy(*keys)
    x = df.select(*keys, F.col(value).alias("v"), F.min(value).over(w).alias("lo"), F.max(value).over(w).alias("hi"))
    width = F.col("hi") - F.col("lo")
    b = F.when(width < 1e-12, 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width * bins), F.lit(bins - 1)))
    n = x.groupBy(*keys, b.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(w)
    return n.select(*keys, p.alias("p")).groupBy(*keys).agg(F.abs(F.sum(-F.col("p") * F.log2("p"))).alias("entropy"))


def bh_fdr(df: DataFrame, p: str, ties: list[str]) -> DataFrame:
    """``df`` with q, the Benjamini-Hochberg adjusted p; one row for each feature, so the table is small."""
    m = df.where(F.col(p).isNotNull()).count()
    up = df.withColumn("_rank", F.row_number().over(Window.orderBy(F.col(p), *ties)))
    w = Window.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return up.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * m / F.col("_rank")).over(w))).drop("_rank")


def hedges_g(long: DataFrame, keys: list[str], label: str = "label_a") -> DataFrame:
    """(keys..., g): difference of means over the pooled deviation with the small-sample correction."""
    x = [F.when((F.col(label) == k) & finite(F.col("value")), F.col("value")) for k in (0, 1)]
    a = long.groupBy(*keys).agg(*[f(x[k]).alias(f"{n}{k}") for k in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    df = F.col("n0") + F.col("n1") - 2
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / df)
    g = (F.col("m1") - F.col("m0")) / pooled * (1 - 3.0 / (4 * df - 1))
    return a.select(*keys, F.when((F.col("n0") > 1) & (F.col("n1") > 1) & (pooled > 0), g).otherwise(0.0).alias("g"))


def mann_whitney(long: DataFrame, keys: list[str], label: str = "label_a") -> DataFrame:
    """(keys..., u, cliffs_delta, z): U of class 1, Cliff's delta and the tie-corrected normal score with continuity
    correction."""
    c = value_counts(long, keys, label)
    t = F.col("n0") + F.col("n1")
    a = c.groupBy(*keys).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum(F.col("n1").cast("double") * (F.col("below0") + F.col("n0") / 2.0)).alias("u"), F.sum((t * t * t - t).cast("double")).alias("ties"))
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    n = n0 + n1
    sigma = F.sqrt(n0 * n1 / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    off = F.col("u") - n0 * n1 / 2.0
    z = F.when(sigma > 0, F.greatest(F.abs(off) - 0.5, F.lit(0.0)) / sigma).otherwise(0.0)
    return a.select(*keys, "u", (2 * F.col("u") / (n0 * n1) - 1).alias("cliffs_delta"), z.alias("z"))


def robust_histogram(df: DataFrame, keys: list[str], value: str, bins: int = 40) -> DataFrame:
    """(keys..., bin, n): histogram between the 1st and 99th percentile widened by 5 %, rows beyond it left out."""
    q = quantiles(df.select(*keys, F.col(value).cast("double").alias("value")), keys, (0.01, 0.99))
    pad = (F.col("q")[1] - F.col("q")[0]) * 0.05
    x = same_keys(df, q.select(*keys, (F.col("q")[0] - pad).alias("lo"), (F.col("q")[1] + pad).alias("hi")), keys)
    x = x.where((F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")) & (F.col("hi") > F.col("lo")))
    b = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    return x.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))

"""Statistics of the exploratory analysis: validation, effect sizes, false discovery, families, histograms, PCA."""

from __future__ import annotations

from pyspark.sql import functions as F

from .._registered import query
from ..operators import models, stats
from .features import AUC, DIMS, LONG, branches, long, rounded, vectors


@query(f"WITH {LONG} SELECT feature, count(value) AS n_valid, count(*) - count(value) AS n_missing, count(DISTINCT value) AS n_unique, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, (count(DISTINCT value) <= 1) AS constant FROM l GROUP BY 1")
def feature_validation(spark, sf_dir):
    v = F.when(stats.finite(F.col("value")), F.col("value"))
    out = long(spark, sf_dir).groupBy("feature").agg(F.count(v).alias("n_valid"), (F.count(F.lit(1)) - F.count(v)).alias("n_missing"), F.count_distinct(v).alias("n_unique"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    return rounded(out.withColumn("constant", F.col("n_unique") <= 1), "mean", "std")


#: A p-value for each feature that SQL can also make: its distance from an even AUC, scaled.
_P = "p AS (SELECT feature, round(1 - abs(2 * auc - 1), 6) AS p FROM eff)"


@query(f"""WITH {LONG}, {AUC}, {_P}, r AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS k, count(*) OVER () AS m FROM p)
SELECT feature, p, round(least(1, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def bh_fdr(spark, sf_dir):
    p = stats.auc(long(spark, sf_dir), ["feature"]).select("feature", F.round(1 - F.abs(2 * F.col("auc") - 1), 6).alias("p"))
    return rounded(stats.bh_fdr(p, "p", ["feature"]), "q")


@query(f"""WITH {LONG}, a AS (SELECT feature, count(*) FILTER (WHERE label_a = 0) AS n0, count(*) FILTER (WHERE label_a = 1) AS n1, avg(value) FILTER (WHERE label_a = 0) AS m0, avg(value) FILTER (WHERE label_a = 1) AS m1,
 var_samp(value) FILTER (WHERE label_a = 0) AS v0, var_samp(value) FILTER (WHERE label_a = 1) AS v1 FROM l GROUP BY 1)
SELECT feature, round((m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) * (1 - 3 / (4 * (n0 + n1 - 2) - 1)::DOUBLE), 6) AS g FROM a""")
def hedges_g(spark, sf_dir):
    return rounded(stats.hedges_g(long(spark, sf_dir), ["feature"]), "g")


_MW = f"""WITH {LONG}, {AUC}, t AS (SELECT feature, sum(pow(c, 3) - c) AS ties FROM (SELECT feature, value, count(*)::DOUBLE AS c FROM l GROUP BY ALL) GROUP BY 1),
m AS (SELECT feature, auc * n0 * n1 AS u, 2 * auc - 1 AS d, n0::DOUBLE AS n0, n1::DOUBLE AS n1, ties FROM eff JOIN t USING (feature))"""


@query(f"{_MW} SELECT feature, round(u, 4) AS u, round(greatest(abs(u - n0 * n1 / 2) - 0.5, 0) / sqrt(n0 * n1 / 12 * (n0 + n1 + 1 - ties / ((n0 + n1) * (n0 + n1 - 1)))), 6) AS z FROM m")
def mann_whitney_u(spark, sf_dir):
    out = stats.mann_whitney(long(spark, sf_dir), ["feature"]).select("feature", "u", "z")
    return rounded(rounded(out, "u", digits=4), "z")


@query(f"{_MW} SELECT feature, round(d, 6) AS cliffs_delta, round(abs(d), 6) AS separation FROM m")
def cliffs_delta(spark, sf_dir):
    out = stats.mann_whitney(long(spark, sf_dir), ["feature"]).select("feature", "cliffs_delta", F.abs("cliffs_delta").alias("separation"))
    return rounded(out, "cliffs_delta", "separation")


@query()
def rank_test_p_values(spark, sf_dir):
    return models.with_rank_p(stats.mann_whitney(long(spark, sf_dir), ["feature"]))


def _family(df, spark):
    return df.join(F.broadcast(branches(spark)), "feature")


@query(f"WITH {LONG}, {AUC} SELECT 'B' || (feature // 16) AS branch, count(*) AS n, round(max(effective_auc), 6) AS best, round(median(effective_auc), 6) AS median, count(*) FILTER (WHERE effective_auc >= 0.55) AS useful FROM eff GROUP BY 1")
def family_summary(spark, sf_dir):
    r = _family(stats.auc(long(spark, sf_dir), ["feature"]), spark)
    out = r.groupBy("branch").agg(F.count(F.lit(1)).alias("n"), F.max("effective_auc").alias("best"), F.median("effective_auc").alias("median"), F.count_if(F.col("effective_auc") >= 0.55).alias("useful"))
    return rounded(out, "best", "median")


@query(f"WITH {LONG}, {AUC} SELECT branch, feature, round(effective_auc, 6) AS effective_auc FROM (SELECT 'B' || (feature // 16) AS branch, feature, effective_auc, row_number() OVER (PARTITION BY feature // 16 ORDER BY effective_auc DESC, feature) AS k FROM eff) WHERE k = 1")
def family_best(spark, sf_dir):
    from ..operators import audit

    r = _family(stats.auc(long(spark, sf_dir), ["feature"]), spark).withColumn("worst_first", -F.col("effective_auc"))
    return rounded(audit.first_per_group(r, "branch", ["worst_first", "feature"], 1).select("branch", "feature", "effective_auc"), "effective_auc")


@query(f"WITH {LONG}, {AUC} SELECT feature, round(effective_auc, 6) AS effective_auc FROM eff ORDER BY eff.effective_auc DESC, feature LIMIT 30")
def top_features(spark, sf_dir):
    return rounded(stats.auc(long(spark, sf_dir), ["feature"]).orderBy(F.desc("effective_auc"), "feature").limit(30).select("feature", "effective_auc"), "effective_auc")


@query()
def pca_2d(spark, sf_dir):
    return models.pca_2d(vectors(spark, sf_dir), "embedding", DIMS)


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM (SELECT l_returnflag, l_extendedprice::DOUBLE AS v FROM lineitem) GROUP BY 1),
e AS (SELECT l_returnflag, a - (b - a) * 0.05::DOUBLE AS lo, b + (b - a) * 0.05::DOUBLE AS hi FROM q)
SELECT l_returnflag, least(floor((l_extendedprice::DOUBLE - lo) / (hi - lo) * 40), 39)::INT AS bin, count(*) AS n FROM lineitem JOIN e USING (l_returnflag) WHERE l_extendedprice::DOUBLE BETWEEN lo AND hi GROUP BY ALL""")
def robust_histogram(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    return stats.robust_histogram(d, ["l_returnflag"], "v")


@query(f"""WITH {LONG}, {AUC}, top AS (SELECT feature FROM eff ORDER BY eff.effective_auc DESC, feature LIMIT 30),
k AS (SELECT vec_id, feature, (rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0)::DOUBLE AS value FROM l WHERE feature IN (FROM top))
SELECT a.feature AS f1, b.feature AS f2, round(corr(a.value, b.value), 6) AS r FROM k a JOIN k b ON a.vec_id = b.vec_id GROUP BY ALL""")
def top_spearman(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(stats.top_correlations(stats.auc(long(spark, sf_dir), ["feature"]), stats.pearson(v, "embedding", DIMS, "spearman"), 30), "r")

"""Feature analysis over the embedding table: each dimension is a feature, 16 of them a branch, label % 6 a generator
(0 real), and rows with vec_id % 10 < 7 train."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._registered import query
from ..operators import information, models, selection, stats

DIMS = 64

#: Long form of the embeddings in DuckDB.
LONG = """
l AS (SELECT vec_id, (label % 6)::INT AS label_b, (label % 6 > 0)::INT AS label_a, i::INT AS feature, embedding[i + 1]::DOUBLE AS value
      FROM embeddings, range(64) r(i))"""
#: Effective AUC by mid-ranks; expects l.
AUC = """
ranked AS (SELECT feature, label_a, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM l),
sums AS (SELECT feature, sum(label_a)::BIGINT AS n1, sum(1 - label_a)::BIGINT AS n0, sum(CASE WHEN label_a = 1 THEN r::DOUBLE END) AS r1 FROM ranked GROUP BY feature),
aucs AS (SELECT feature, n0, n1, (r1 - n1 * (n1 + 1) / 2.0) / (n0::DOUBLE * n1) AS auc FROM sums),
eff AS (SELECT feature, n0, n1, auc, greatest(auc, 1 - auc) AS effective_auc, CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS direction FROM aucs)"""
PAIRS = """
pairs AS (SELECT a.feature AS f1, b.feature AS f2, corr(a.value, b.value) AS r FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.feature < b.feature GROUP BY ALL)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", "embedding", (F.col("label") % 6).alias("label_b"), (F.col("label") % 6 > 0).cast("int").alias("label_a"))


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.to_long(vectors(spark, sf_dir), "embedding", ["vec_id", "label_b", "label_a"])


def branches(spark: SparkSession) -> DataFrame:
    return spark.range(DIMS).select(F.col("id").cast("int").alias("feature"), F.concat(F.lit("B"), (F.col("id") / 16).cast("int")).alias("branch"))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zero, so that results compare by value."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


@query(f"WITH {LONG} SELECT vec_id, label_b, label_a, feature, value FROM l")
def long_form(spark, sf_dir):
    return long(spark, sf_dir).select("vec_id", F.col("label_b").cast("int").alias("label_b"), "label_a", "feature", "value")


@query(f"""WITH {LONG}, {AUC} SELECT feature, n0, n1, round(auc, 6) AS auc, round(effective_auc, 6) AS effective_auc, direction FROM eff""")
def relevance_auc(spark, sf_dir):
    out = stats.auc(long(spark, sf_dir), ["feature"])
    return rounded(out, "auc", "effective_auc").orderBy(F.desc("effective_auc"), "feature")


_VALIDITY = """SELECT {key} AS feature, count(*) AS total, count(value) FILTER (WHERE isfinite(value)) AS finite,
 count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS missing, count(*) FILTER (WHERE isinf(value)) AS infinite,
 round(count(value) FILTER (WHERE isfinite(value)) / count(*)::DOUBLE, 6) AS finite_rate,
 round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(var_pop(value), 6) AS variance, round(min(value), 6) AS low,
 round(quantile_cont(value, 0.25), 6) AS p25, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS high,
 (min(value) = max(value) OR var_pop(value) = 0) AS is_constant, (var_pop(value) < 1e-6) AS near_zero_variance
FROM l GROUP BY 1"""
_VNUM = ("finite_rate", "mean", "std", "variance", "low", "p25", "median", "p75", "high")


@query(f"WITH {LONG} {_VALIDITY.format(key='feature')}")
def validity_stats(spark, sf_dir):
    return rounded(stats.validity(long(spark, sf_dir), ["feature"]), *_VNUM)


_ITEMS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_LONG = "l AS (" + " UNION ALL ".join(f"SELECT l_orderkey, l_returnflag, (l_returnflag = 'R')::INT AS label_a, '{c}' AS feature, {c}::DOUBLE AS value FROM lineitem" for c in _ITEMS) + ")"


def line_long(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("label_a", (F.col("l_returnflag") == "R").cast("int"))
    return stats.columns_to_long(d, list(_ITEMS), ["l_orderkey", "l_returnflag", "label_a"])


_VALIDITY_L = _VALIDITY.format(key="feature")
for _c in ("avg(value), 6", "stddev_pop(value), 6", "var_pop(value), 6"):
    _VALIDITY_L = _VALIDITY_L.replace(f"round({_c})", f"round({_c[:-1]}4)")


@query(f"WITH {LINE_LONG} {_VALIDITY_L}")
def validity_stats_lineitem(spark, sf_dir):
    out = rounded(stats.validity(line_long(spark, sf_dir), ["feature"]), "mean", "std", "variance", digits=4)
    return rounded(out, "finite_rate", "low", "p25", "median", "p75", "high")


@query(f"""WITH {LINE_LONG}, {AUC} SELECT feature, n0, n1, round(auc, 6) AS auc, round(effective_auc, 6) AS effective_auc, direction FROM eff""")
def relevance_auc_lineitem(spark, sf_dir):
    return rounded(stats.auc(line_long(spark, sf_dir), ["feature"]), "auc", "effective_auc")


@query(f"""WITH {LONG}, a AS (SELECT feature,
 count(value) FILTER (WHERE label_a = 0) AS n0, avg(value) FILTER (WHERE label_a = 0) AS mean0, stddev_pop(value) FILTER (WHERE label_a = 0) AS std0, median(value) FILTER (WHERE label_a = 0) AS median0, var_samp(value) FILTER (WHERE label_a = 0) AS var0,
 count(value) FILTER (WHERE label_a = 1) AS n1, avg(value) FILTER (WHERE label_a = 1) AS mean1, stddev_pop(value) FILTER (WHERE label_a = 1) AS std1, median(value) FILTER (WHERE label_a = 1) AS median1, var_samp(value) FILTER (WHERE label_a = 1) AS var1
 FROM l GROUP BY 1)
SELECT feature, n0, round(mean0, 6) AS mean0, round(std0, 6) AS std0, round(median0, 6) AS median0, n1, round(mean1, 6) AS mean1, round(std1, 6) AS std1, round(median1, 6) AS median1,
 round(mean1 - mean0, 6) AS mean_difference, round((mean1 - mean0) / sqrt(var0 / n0 + var1 / n1), 6) AS t,
 round(pow(var0 / n0 + var1 / n1, 2) / (pow(var0 / n0, 2) / (n0 - 1) + pow(var1 / n1, 2) / (n1 - 1)), 4) AS df FROM a""")
def class_stats_welch(spark, sf_dir):
    out = stats.class_statistics(long(spark, sf_dir), ["feature"])
    return rounded(rounded(out, "mean0", "std0", "median0", "mean1", "std1", "median1", "mean_difference", "t"), "df", digits=4)


@query()
def class_stats_p_values(spark, sf_dir):
    """Welch's two-sided p, from t and degrees of freedom of one row a feature."""
    return models.with_welch_p(stats.class_statistics(long(spark, sf_dir), ["feature"]))


@query(f"WITH {LONG}, {PAIRS} SELECT f1, f2, round(r, 6) AS r FROM pairs")
def pearson_pairs(spark, sf_dir):
    return rounded(stats.pearson(vectors(spark, sf_dir), "embedding", DIMS), "r")


@query(f"""WITH {LONG}, k AS (SELECT vec_id, feature, (rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0)::DOUBLE AS value FROM l)
SELECT a.feature AS f1, b.feature AS f2, round(corr(a.value, b.value), 6) AS r FROM k a JOIN k b ON a.vec_id = b.vec_id AND a.feature < b.feature GROUP BY ALL""")
def spearman_pairs(spark, sf_dir):
    return rounded(stats.pearson(vectors(spark, sf_dir), "embedding", DIMS, "spearman"), "r")


@query(f"""WITH {LONG}, {PAIRS} SELECT f1, f2, 'B' || (f1 // 16) AS branch1, 'B' || (f2 // 16) AS branch2, round(r, 6) AS r, (f1 // 16 <> f2 // 16) AS cross_branch FROM pairs WHERE abs(r) >= 0.1""")
def redundant_pairs(spark, sf_dir):
    return rounded(stats.redundant_pairs(stats.pearson(vectors(spark, sf_dir), "embedding", DIMS), branches(spark), 0.1), "r")


@query(f"""WITH {LONG}, {PAIRS}, b AS (SELECT *, 'B' || (f1 // 16) AS b1, 'B' || (f2 // 16) AS b2 FROM pairs)
SELECT CASE WHEN b1 = b2 THEN 'Intra-' || b1 ELSE 'Inter-' || least(b1, b2) || '<->' || greatest(b1, b2) END AS kind, count(*) AS n_pairs,
 round(avg(abs(r)), 6) AS mean_abs_r, round(max(abs(r)), 6) AS max_abs_r, count(*) FILTER (WHERE abs(r) >= 0.1) AS flagged FROM b GROUP BY 1""")
def branch_redundancy(spark, sf_dir):
    return rounded(stats.branch_redundancy(stats.pearson(vectors(spark, sf_dir), "embedding", DIMS), branches(spark), 0.1), "mean_abs_r", "max_abs_r")


@query(f"""WITH {LONG}, {AUC} SELECT 'B' || (feature // 16) AS branch, count(*) AS n, round(avg(effective_auc), 6) AS mean_auc, round(max(effective_auc), 6) AS max_auc, round(min(effective_auc), 6) AS min_auc,
 first(feature ORDER BY effective_auc DESC, feature) AS best FROM eff GROUP BY 1""")
def branch_relevance(spark, sf_dir):
    return rounded(stats.branch_relevance(stats.auc(long(spark, sf_dir), ["feature"]), branches(spark)), "mean_auc", "max_auc", "min_auc")


@query("""WITH b AS (SELECT * FROM (VALUES (0, 'B0'), (1, 'B1'), (2, 'B2'), (3, 'B3')) t(i, b))
SELECT 'FULL_4' AS name, 'B0,B1,B2,B3' AS branches UNION ALL SELECT 'BRANCH_' || b, b FROM b
UNION ALL SELECT 'ADD_' || (SELECT string_agg(y.b, '+' ORDER BY y.i) FROM b y WHERE y.i <= x.i), (SELECT string_agg(y.b, ',' ORDER BY y.i) FROM b y WHERE y.i <= x.i) FROM b x WHERE x.i IN (1, 2)
UNION ALL SELECT 'WITHOUT_' || x.b, (SELECT string_agg(y.b, ',' ORDER BY y.i) FROM b y WHERE y.i <> x.i) FROM b x""")
def ablation_configs(spark, sf_dir):
    return selection.ablations(spark, ["B0", "B1", "B2", "B3"]).withColumn("branches", F.array_join("branches", ","))


_GROUPS = """
pool AS (SELECT feature, g.g AS generator, 0 AS y, value FROM l, (SELECT DISTINCT label_b AS g FROM l WHERE label_b > 0) g WHERE label_b = 0
  UNION ALL SELECT feature, label_b, 1, value FROM l WHERE label_b > 0),
gr AS (SELECT feature, generator, y, rank() OVER (PARTITION BY feature, generator ORDER BY value) + (count(*) OVER (PARTITION BY feature, generator, value) - 1) / 2.0 AS r FROM pool),
gs AS (SELECT feature, generator, sum(y)::BIGINT AS n1, sum(1 - y)::BIGINT AS n0, sum(CASE WHEN y = 1 THEN r::DOUBLE END) AS r1 FROM gr GROUP BY ALL),
ga AS (SELECT feature, generator, (r1 - n1 * (n1 + 1) / 2.0) / (n0::DOUBLE * n1) AS a FROM gs),
ge AS (SELECT feature, generator, greatest(a, 1 - a) AS e FROM ga)"""


@query(f"""WITH {LONG}, {AUC}, {_GROUPS}
SELECT feature, round(any_value(eff.effective_auc), 6) AS overall, round(avg(e), 6) AS mean_auc, round(min(e), 6) AS worst, round(max(e), 6) AS best, round(stddev_pop(e), 6) AS std, round(max(e) - min(e), 6) AS spread
FROM ge JOIN eff USING (feature) GROUP BY feature""")
def generator_stability(spark, sf_dir):
    return rounded(stats.generator_stability(long(spark, sf_dir)), "overall", "mean_auc", "worst", "best", "std", "spread")


@query(f"WITH {LONG}, {_GROUPS} SELECT feature, " + ", ".join(f"round(max(e) FILTER (WHERE generator = {g}), 6) AS auc_{g}" for g in range(1, 6)) + " FROM ge GROUP BY feature")
def generator_auc_wide(spark, sf_dir):
    each = rounded(stats.group_auc(long(spark, sf_dir)), "effective_auc")
    wide = each.groupBy("feature").pivot("generator", [1, 2, 3, 4, 5]).agg(F.max("effective_auc"))
    return wide.select("feature", *[F.col(str(g)).alias(f"auc_{g}") for g in range(1, 6)])


@query()
def mutual_information(spark, sf_dir):
    return information.mutual_information_of(long(spark, sf_dir), "vec_id")


def _ranking(spark, sf_dir):
    relevance = stats.auc(long(spark, sf_dir), ["feature"])
    return selection.mrmr(relevance, stats.pearson(vectors(spark, sf_dir), "embedding", DIMS, "spearman"))


@query()
def mrmr_ranking(spark, sf_dir):
    return _ranking(spark, sf_dir)


@query(f"""WITH {LONG}, {AUC}, k AS (SELECT vec_id, feature, (rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0)::DOUBLE AS value FROM l),
rel AS (SELECT feature, effective_auc / max(effective_auc) OVER () AS rel, effective_auc FROM eff),
one AS (SELECT feature, rel, effective_auc FROM rel ORDER BY rel DESC, feature LIMIT 1),
red AS (SELECT b.feature, abs(corr(a.value, b.value)) AS r FROM k a JOIN k b ON a.vec_id = b.vec_id WHERE a.feature = (SELECT feature FROM one) AND b.feature <> a.feature GROUP BY 1),
two AS (SELECT rel.feature, effective_auc, r, rel - r AS score FROM rel JOIN red USING (feature) ORDER BY score DESC, rel.feature LIMIT 1)
SELECT 1 AS rank, feature, round(effective_auc, 6) AS relevance, 0.0::DOUBLE AS redundancy, 1.0::DOUBLE AS score FROM one
UNION ALL SELECT 2, feature, round(effective_auc, 6), round(r, 6), round(score, 6) FROM two""")
def mrmr_first_two(spark, sf_dir):
    return rounded(_ranking(spark, sf_dir).where("rank <= 2").select("rank", "feature", "relevance", "redundancy", "score"), "relevance", "redundancy", "score")


@query()
def budget_subsets(spark, sf_dir):
    return selection.budget_lists(_ranking(spark, sf_dir))


@query()
def gbt_validation(spark, sf_dir):
    """Boosted trees on the training split of every budget that fits and every ablation of the branches, scored on the
    validation split."""
    budgets = tuple(b for b in selection.BUDGETS if b <= DIMS)
    return models.budget_validation(vectors(spark, sf_dir), "embedding", _ranking(spark, sf_dir), budgets, {r["feature"]: r["branch"] for r in branches(spark).collect()})


#: Scores for the curve operators: dimension 0, rounded so that ties occur; every row.
_SCORE = "l AS (SELECT 0 AS feature, (label % 6 > 0)::INT AS label_a, round(embedding[1]::DOUBLE, 2) AS value FROM embeddings)"
_CURVE = """
tot AS (SELECT sum(label_a) AS p, sum(1 - label_a) AS n FROM l),
pts AS (SELECT value AS threshold, sum(sum(label_a)) OVER w AS tp, sum(sum(1 - label_a)) OVER w AS fp, sum(label_a) AS dp FROM l GROUP BY value WINDOW w AS (ORDER BY value DESC)),
curve AS (SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, dp, tp / p::DOUBLE AS tpr, fp / n::DOUBLE AS fpr, p FROM pts, tot)"""


def _scores(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.lit(0).alias("feature"), "label_a", F.round(F.col("embedding")[0].cast("double"), 2).alias("value"))


@query(f"WITH {_SCORE}, {_CURVE} SELECT threshold, tp, fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM curve")
def roc_points(spark, sf_dir):
    return rounded(stats.roc_points(_scores(spark, sf_dir), ["feature"]).select("threshold", "tp", "fp", "tpr", "fpr"), "tpr", "fpr")


@query(f"WITH {_SCORE}, {_CURVE} SELECT round(sum(dp / p::DOUBLE * tp / (tp + fp)), 6) AS average_precision FROM curve")
def average_precision(spark, sf_dir):
    return rounded(stats.average_precision(_scores(spark, sf_dir), ["feature"]).select("average_precision"), "average_precision")


@query(f"""WITH {_SCORE}, {_CURVE}, n AS (SELECT *, lag(tp, 1, 0) OVER w AS tp0, lag(fp, 1, 0) OVER w AS fp0, lead(tp) OVER w AS tp1, lead(fp) OVER w AS fp1 FROM curve WINDOW w AS (ORDER BY threshold DESC))
SELECT round(coalesce(max(tpr), 0), 6) AS tpr FROM n WHERE fpr <= 0.05 AND (tp1 IS NULL OR tp1 - tp <> tp - tp0 OR fp1 - fp <> fp - fp0)""")
def tpr_at_fpr(spark, sf_dir):
    return rounded(stats.tpr_at_fpr(_scores(spark, sf_dir), ["feature"], 0.05).select("tpr"), "tpr")


@query(f"""WITH {_SCORE}, c AS (SELECT count(*) FILTER (WHERE value >= 0 AND label_a = 1) AS tp, count(*) FILTER (WHERE value >= 0 AND label_a = 0) AS fp, count(*) FILTER (WHERE value < 0 AND label_a = 1) AS fn, count(*) FILTER (WHERE value < 0 AND label_a = 0) AS tn FROM l)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c""")
def f1_accuracy(spark, sf_dir):
    return rounded(stats.threshold_scores(_scores(spark, sf_dir), "value", "label_a", 0.0), "accuracy", "precision", "recall", "f1")

"""The analysis plan over a feature table: validity, relevance, redundancy, stability, compression, ranking, budgets."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import information, models, selection, stats
from . import features as P

QUALITIES = (100, 95, 80, 60, 40, 20)


def feature_long(table: DataFrame, keep: list[str]) -> DataFrame:
    return stats.columns_to_long(table, [n for n in P.NAMES if n in table.columns], keep)


def compression_table(images: DataFrame, side: int, branches=P.CANONICAL) -> DataFrame:
    """(feature, auc by quality, mean, worst, retention at 60 and 20, robust). Retention is over the clean AUC, 0.5 at
    least; robust keeps 85 % of it and 0.55 at quality 60."""
    table = P.extract(images, side, branches, ["img", "label_a"], qualities=QUALITIES)
    long = stats.columns_to_long(table, [c for c in table.columns if c in P.NAMES], ["img", "label_a", "quality"])
    a = stats.auc(long, ["feature", "quality"]).groupBy("feature").pivot("quality", list(QUALITIES)).agg(F.max("effective_auc"))
    q = {k: F.col(str(k)) for k in QUALITIES}
    clean = F.greatest(q[100], F.lit(0.5))
    lossy = [q[k] for k in QUALITIES[1:]]
    return a.select(
        "feature",
        q[100].alias("auc_clean"),
        *[q[k].alias(f"auc_q{k}") for k in QUALITIES[1:]],
        (sum(lossy[1:], lossy[0]) / len(lossy)).alias("mean_auc"),
        F.least(*lossy).alias("worst_auc"),
        (q[60] / clean).alias("retention_q60"),
        (q[20] / clean).alias("retention_q20"),
        ((q[60] >= 0.85 * q[100]) & (q[60] >= 0.55)).alias("robust"),
    )


def run_analysis(train: DataFrame, valid: DataFrame, out: str, images: DataFrame | None = None, side: int = 256) -> dict:
    """Write every table of the analysis as Parquet under ``out``, a folder of the shared store, and return the paths.

    ``train`` and ``valid`` are feature tables with img, label_a, label_b; what selects features sees ``train`` alone.
    """
    began = time.time()
    spark = train.sparkSession
    names = [n for n in P.NAMES if n in train.columns]
    long = feature_long(train, ["img", "label_a"])
    branch = P.registry_table(spark).select(F.col("name").alias("feature"), F.col("index").alias("feature_index"), "branch").where(F.col("feature").isin(names))
    made: dict[str, str] = {}

    def put(name: str, df: DataFrame) -> DataFrame:
        made[name] = f"{out}/{name}"
        df.write.mode("overwrite").parquet(made[name])
        return spark.read.parquet(made[name])

    put("feature_registry", P.registry_table(spark))
    put("feature_validity", stats.validity(long, ["feature"]).join(stats.class_statistics(long, ["feature"]), "feature"))
    relevance = put("univariate_relevance", stats.auc(long, ["feature"]).join(information.mutual_information_of(long, "img").select("feature", "mi"), "feature"))
    arrays = train.select(F.array(*[F.col(n).cast("double") for n in names]).alias("v"))
    at = spark.createDataFrame(list(enumerate(names)), "i int, feature string")
    for kind in ("pearson", "spearman"):
        p = stats.pearson(arrays, "v", len(names), kind)
        p = p.join(F.broadcast(at.withColumnRenamed("feature", "n1")), F.col("f1") == F.col("i")).drop("i").join(F.broadcast(at.withColumnRenamed("feature", "n2")), F.col("f2") == F.col("i"))
        pairs = put(f"{kind}_matrix", p.select(F.col("n1").alias("f1"), F.col("n2").alias("f2"), "r"))
    put("redundancy_pairs", stats.redundant_pairs(pairs, branch))
    put("branch_redundancy", stats.branch_redundancy(pairs, branch))
    index = relevance.join(branch.select("feature", "feature_index"), "feature").select(F.col("feature_index").alias("feature"), "effective_auc")
    put("branch_relevance", stats.branch_relevance(index, branch.select(F.col("feature_index").alias("feature"), "branch")))
    put("generator_stability", stats.generator_stability(feature_long(valid, ["img", "label_b"])))
    if images is not None:
        put("compression_analysis", compression_table(images, side))
    order = {n: i for i, n in enumerate(names)}
    numbered = relevance.select(F.col("feature"), "mi")
    by = F.create_map(*[F.lit(x) for n, i in order.items() for x in (n, i)])
    ranking = selection.mrmr(numbered.select(by[F.col("feature")].alias("feature"), "mi"), pairs.select(by[F.col("f1")].alias("f1"), by[F.col("f2")].alias("f2"), "r"), "mi")
    ranking = put("mrmr_rankings", ranking.join(F.broadcast(at.withColumnRenamed("feature", "name")), F.col("feature") == F.col("i")).select("rank", F.col("name").alias("feature"), "relevance", "redundancy", "score", *[c for c in ranking.columns if c.startswith("in_budget")]).orderBy("rank"))
    put("selected_features", selection.budget_lists(ranking))
    v = F.array(*[F.col(n).cast("double") for n in names]).alias("v")
    both = train.select(F.lit(0).alias("vec_id"), "label_a", v).union(valid.select(F.lit(9).alias("vec_id"), "label_a", v))
    ranked = ranking.select("rank", by[F.col("feature")].alias("feature"))
    of = {f.name: f.branch for f in P.REGISTRY}
    budgets = tuple(b for b in selection.BUDGETS if b <= len(names)) or (len(names),)
    put("validation_results", models.budget_validation(both, "v", ranked, budgets, {i: of[n] for n, i in order.items()}))
    put("run_metadata", spark.createDataFrame([(json.dumps({"features": len(names), "elapsed_s": round(time.time() - began, 3)}),)], "json string"))
    return made

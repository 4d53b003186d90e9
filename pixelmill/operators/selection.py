"""Selection of features: greedy relevance against redundancy, budgets, and ablation configurations."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUDGETS = (8, 16, 32, 64, 111)


def greedy_ranking(relevance: np.ndarray, redundancy: np.ndarray) -> list[tuple[int, float, float]]:
    """(feature, mean redundancy to those before it, score) in order of selection. Relevance is scaled by its largest;
    the score is that less the mean |correlation| to what is selected; of equals the lowest number goes first."""
    top = float(relevance.max(initial=0.0))
    rel = relevance / top if top > 0 else np.zeros_like(relevance, dtype=float)
    left = np.ones(len(rel), bool)
    total, out = np.zeros(len(rel)), []
    for step in range(len(rel)):
        mean = total / max(step, 1)
        score = np.where(left, rel - mean, -np.inf)
        k = int(score.argmax())
        out.append((k, float(mean[k]), float(score[k])))
        left[k] = False
        total += np.abs(redundancy[k])
    return out


def mrmr(relevance: DataFrame, pairs: DataFrame, value: str = "effective_auc") -> DataFrame:
    """(rank, feature, relevance, redundancy, score, in_budget_...) from (feature, value) and (f1, f2, r). One row a
    feature and a pair of features: what reaches the driver does not grow with the rows of the corpus."""
    spark = relevance.sparkSession
    rel = {r["feature"]: float(r[value]) for r in relevance.select("feature", value).collect()}
    names = sorted(rel)
    at = {f: i for i, f in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in pairs.collect():
        i, j = at[r["f1"]], at[r["f2"]]
        m[i, j] = m[j, i] = r["r"]
    rows = [(n + 1, names[k], rel[names[k]], red, s) for n, (k, red, s) in enumerate(greedy_ranking(np.array([rel[f] for f in names]), m))]
    kind = relevance.schema["feature"].dataType.simpleString()
    out = spark.createDataFrame(rows, f"rank int, feature {kind}, relevance double, redundancy double, score double")
    return out.select("*", *[(F.col("rank") <= b).alias(f"in_budget_{b}") for b in BUDGETS])


def budget_lists(ranking: DataFrame) -> DataFrame:
    """(budget, feature_count, features): the first features of a ranking for each budget, in rank order."""
    b = ranking.sparkSession.createDataFrame([(x,) for x in BUDGETS], "budget int")
    got = ranking.join(F.broadcast(b), F.col("rank") <= F.col("budget")).groupBy("budget")
    return got.agg(F.count(F.lit(1)).cast("int").alias("feature_count"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"]).alias("features"))


def ablation_branches(branches: list[str]) -> list[tuple[str, list[str]]]:
    """(name, branches): everything, each branch alone, growing unions, and everything without one."""
    grown = list(accumulate(([b] for b in branches), lambda a, b: a + b))
    rows = [(f"FULL_{len(branches)}", branches)]
    rows += [(f"BRANCH_{b}", [b]) for b in branches]
    rows += [(f"ADD_{'+'.join(g)}", g) for g in grown[1:-1]]
    rows += [(f"WITHOUT_{b}", [x for x in branches if x != b]) for b in branches]
    return rows


def ablations(spark: SparkSession, branches: list[str]) -> DataFrame:
    """The rows of ablation_branches() as a table."""
    return spark.createDataFrame(ablation_branches(branches), "name string, branches array<string>")

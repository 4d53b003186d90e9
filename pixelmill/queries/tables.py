"""Scans, keys, subsets, joins and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .._registered import query
from ..operators import stats
from ..plans import features as P
from ..sources import corpus
from .features import rounded


@query("SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def scan_project_filter(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 45 AND l_returnflag = 'R'").select("l_orderkey", "l_quantity", "l_extendedprice")


@query("SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS f0, round(embedding[2]::DOUBLE, 6) AS f1, round(embedding[4]::DOUBLE, 6) AS f3, CASE WHEN vec_id % 10 < 7 THEN 'train' ELSE 'validation' END AS split FROM embeddings WHERE vec_id % 10 < 7")
def feature_subset_budget(spark, sf_dir):
    """Metadata and the features of a budget, for one split."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") % 10 < 7)
    picked = [F.round(F.col("embedding")[i].cast("double"), 6).alias(f"f{i}") for i in (0, 1, 3)]
    return e.select("vec_id", "label", *picked, F.when(F.col("vec_id") % 10 < 7, "train").otherwise("validation").alias("split"))


@query("SELECT printf('%s_%06d', split, sample_idx) AS image_id, sample_idx, split, doc_id FROM (SELECT 'train' AS split, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS sample_idx, doc_id FROM documents)")
def key_assignment(spark, sf_dir):
    """Stable keys in scan order."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return corpus.assign_keys(d, "train", ["doc_id"]).select("image_id", "sample_idx", "split", "doc_id")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id = 17")
def row_point_lookup(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 17").select("vec_id", "label")


@query("SELECT count(*) AS rows, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents")
def file_inventory(spark, sf_dir):
    """Rows, summed over the files that hold them."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("_metadata.file_path").alias("file"))
    by = d.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    return by.agg(F.sum("rows").alias("rows"), F.min("a").alias("first_id"), F.max("b").alias("last_id"))


@query()
def feature_registry(spark, sf_dir):
    return P.registry_table(spark)


@query("""SELECT l_partkey, round(CASE WHEN sum(v) < 1e-12 THEN 0 ELSE greatest(0, least(1, 2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*)::DOUBLE)) END, 6) AS gini
FROM (SELECT l_partkey, l_extendedprice::DOUBLE AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice) AS i FROM lineitem) GROUP BY 1""")
def gini_values(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", F.col("l_extendedprice").cast("double").alias("v"))
    return rounded(stats.gini(d, ["l_partkey"], "v"), "gini")


_D = "greatest(1, least(9, floor(v / pow(10::DOUBLE, floor(log10(v))))))"


@query(f"SELECT l_returnflag, round({' + '.join(f'pow(count(*) FILTER (WHERE d = {k}) / count(*)::DOUBLE - log10(1 + 1 / {k}::DOUBLE), 2)' for k in range(1, 10))}, 6) AS ssd FROM (SELECT l_returnflag, {_D} AS d FROM (SELECT l_returnflag, l_extendedprice::DOUBLE AS v FROM lineitem) WHERE v >= 1e-5) GROUP BY 1")
def benford_ssd(spark, sf_dir):
    return rounded(stats.benford(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_returnflag"], "l_extendedprice"), "ssd")


@query("""WITH m AS (SELECT doc_id FROM documents), l AS (SELECT doc_id FROM labels)
SELECT 'missing' AS kind, count(*) AS n FROM m WHERE doc_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT 'unexpected', count(*) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM m) UNION ALL SELECT 'matched', count(*) FROM m WHERE doc_id IN (SELECT doc_id FROM l)""")
def semi_anti_manifest(spark, sf_dir):
    """Files against a manifest: missing, unexpected and matched."""
    d, lab = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select("doc_id") for t in ("documents", "labels"))
    return corpus.manifest_check(d, lab, "doc_id")


@query("""WITH u AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'assistant'),
p AS (SELECT (a.n - u.n)::DOUBLE AS d FROM u JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)
SELECT count(*) AS pairs, round(avg(d), 4) AS mean_delta, round(avg(d) / stddev_samp(d), 6) AS dz, count(*) FILTER (WHERE d > 0) AS up, count(*) FILTER (WHERE d < 0) AS down FROM p""")
def paired_effect(spark, sf_dir):
    """Paired differences of two listings matched by key, and Cohen's dz."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.length("text").alias("n"))
    u, a = c.where("role = 'user'"), c.where("role = 'assistant'")
    p = u.alias("u").join(a.alias("a"), (F.col("a.conv_id") == F.col("u.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1)).select((F.col("a.n") - F.col("u.n")).cast("double").alias("d"))
    out = p.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("d"), 4).alias("mean_delta"), (F.avg("d") / F.stddev_samp("d")).alias("dz"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    return rounded(out, "dz")


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM events GROUP BY 1")
def event_statistics(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("std"))

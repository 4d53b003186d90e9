"""Helpers shared by the corpus operators: folds, checkpoints, calibration, graph components."""

from __future__ import annotations

import atexit
import shutil
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A session on one machine (a local master)
    without it gets a folder of its own; a cluster without it is an error, for executors would not see each other's
    files there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="corpus-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


_OWN: list[str] = []


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder of shared_folder()."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more. It does so when the driver's
    collector finds their handles, which a job of many short rounds with little garbage may put off until disks fill."""
    spark.sparkContext._jvm.System.gc()


def small_batches(df: DataFrame, rows: int = 256) -> None:
    """Hold the session's Arrow batches to ``rows`` rows: texts are long, and a Python worker has a whole batch in memory.
    A smaller setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(key, "10000"))
    if now <= 0 or now > rows:
        conf.set(key, str(rows))


def batch_bytes(df: DataFrame, size: int = 1 << 20) -> None:
    """Hold the session's Arrow batches to ``size`` bytes, whatever their rows; one row may be longer. A smaller setting
    stays."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > size:
        spark.conf.set(key, str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def single_label(labels: DataFrame, column: str) -> DataFrame:
    """One row (doc_id, y) per labelled id: repeated labels count as their mean, null ids and labels do not count."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id")
        .agg(F.avg(F.col(column).cast("double")).alias("y"))
    )


def pool_adjacent(x: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression (pool adjacent violators) of pos/n over ascending x; returns knots (x, y), both ends of each
    block, so that values between blocks are interpolated and those within one share its mean."""
    blocks: list[list[float]] = []
    for xi, ni, pi in zip(x, n, pos, strict=True):
        blocks.append([xi, xi, ni, pi])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, high, m, p = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + m, blocks[-1][3] + p]
    b = np.asarray(blocks, dtype=float).reshape(-1, 4)
    return b[:, :2].ravel(), np.repeat(b[:, 3] / b[:, 2], 2)


def fit_isotonic(scored: DataFrame, raw: str, y: str, step: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Knots of an isotonic map from ``raw`` to the mean of ``y``; the raw axis is binned by ``step`` and clipped
    to 8,000 bins, so what reaches the driver is bounded. None without rows."""
    rows = (
        scored.groupBy(F.greatest(F.lit(-4000), F.least(F.lit(4000), F.floor(F.col(raw) / step))).alias("b"))
        .agg(F.avg(raw).alias("x"), F.count(F.lit(1)).alias("n"), F.sum(y).alias("p"))
        .orderBy("b")
        .collect()
    )
    if not rows:
        return None
    return pool_adjacent(*(np.array([float(r[k]) for r in rows]) for k in ("x", "n", "p")))


def apply_isotonic(knots: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.clip(np.interp(x, knots[0], knots[1]), 0.0, 1.0)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected ``edges`` (u, v), root being the smallest node of the component.

    Alternating large-star and small-star rounds until no edge changes; every round is checkpointed. Minima are
    partial aggregates, and the joins that follow have an exchange on both sides so that a hub can be split.
    """
    e = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = checkpoint(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(moved.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(e.sparkSession)
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now

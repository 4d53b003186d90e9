"""Corpora of images: discovery, readers, keys, canonical images, feature tables and their sinks."""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans import features as P

SPLITS = ("train", "validation", "test")


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The raw table of one split: files whose names start with `split-` or `split_`, any depth and case."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split}")
    name = F.lower(F.col("_metadata.file_name"))
    d = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    d = d.where(name.startswith(f"{split}-") | name.startswith(f"{split}_"))
    if d.select("_metadata.file_name").isEmpty():
        raise FileNotFoundError(f"{folder} has no file of split {split}")
    return d


def image_bytes(image: str = "Image") -> F.Column:
    return F.col(f"{image}.bytes")


def raw_metadata(df: DataFrame, split: str) -> DataFrame:
    """Identity and labels of each row of a raw table, by file and row in it; the image itself is not read."""
    d = df.select(
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.row_index").alias("source_row"),
        F.col("Label_A").cast("int").alias("label_a"),
        F.col("Label_B").cast("int").alias("label_b"),
        F.coalesce("Caption", F.lit("")).alias("caption"),
        F.col("Image.path").alias("source_path"),
    )
    names = F.create_map(*[F.lit(x) for kv in P.GENERATORS.items() for x in kv])
    return assign_keys(d, split, ["source_file", "source_row"]).withColumn("generator_name", names[F.col("label_b")])


def assign_keys(df: DataFrame, split: str, order: list[str]) -> DataFrame:
    """``df`` with split, sample_idx from 0 in ``order``, and image_id `{split}_{index}`. Ranges of the order are
    numbered each by itself and shifted by the counts before them, so no task holds the whole table."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    r = df.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    r = r.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    before = r.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_first"))
    before = before.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    out = r.join(F.broadcast(before), "_part").withColumn("sample_idx", (F.col("_start") + F.col("_at")).cast("long"))
    return out.drop("_part", "_at", "_start").withColumn("split", F.lit(split)).withColumn("image_id", F.format_string("%s_%06d", "split", "sample_idx"))


def manifest_check(files: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """(kind, n): files that the manifest misses, entries without a file, and matches."""

    def n(df: DataFrame, kind: str) -> DataFrame:
        return df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))

    return n(files.join(manifest, key, "left_anti"), "missing").union(n(manifest.join(files, key, "left_anti"), "unexpected")).union(n(files.join(manifest, key, "left_semi"), "matched"))


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.{jpg,jpeg,png,bmp,JPG,JPEG,PNG}") -> DataFrame:
    """(name, width, height, channels, data) of image files, decoded by Spark; data is row-major BGR."""
    d = spark.read.format("image").option("dropInvalid", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return d.select(F.element_at(F.split("image.origin", "/"), -1).alias("name"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def jpeg_header(data: bytes) -> dict | None:
    """Width, height, components and quantisation tables of a JPEG, read from its markers; None for other data."""
    if data is None or data[:2] != b"\xff\xd8":
        return None
    at, out, tables = 2, {}, {}
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide, n = body[0] >> 4, 64 * (1 + (body[0] >> 4))
                tables[body[0] & 15] = list(struct.unpack(f">64{'H' if wide else 'B'}", body[1 : 1 + n]))
                body = body[1 + n :]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            out = {"height": struct.unpack(">H", body[1:3])[0], "width": struct.unpack(">H", body[3:5])[0], "components": body[5]}
        elif marker == 0xDA:
            break
        at += 2 + size
    return (out | {"tables": [tables[k] for k in sorted(tables)], "table_ids": sorted(tables)}) if out else None


def image_headers(df: DataFrame, key: str, data: str) -> DataFrame:
    """(key, bytes, width, height, components, tables, table_ids, error): errors are collected, not raised."""
    P.image_batches(df.sparkSession)

    def run(pdfs):
        for pdf in pdfs:
            rows = []
            for k, b in zip(pdf[key], pdf[data], strict=True):
                try:
                    h = jpeg_header(b)
                    err = None if h else "not a JPEG"
                except (struct.error, IndexError) as e:
                    h, err = None, str(e)
                h = h or {}
                rows.append((k, len(b or b""), h.get("width"), h.get("height"), h.get("components"), h.get("tables"), h.get("table_ids"), err))
            yield pd.DataFrame(rows, columns=["key", "bytes", "width", "height", "components", "tables", "table_ids", "error"]).astype({"width": "Int32", "height": "Int32", "components": "Int32"})

    kind = df.schema[key].dataType.simpleString()
    out = df.select(key, data).mapInPandas(run, f"key {kind}, bytes long, width int, height int, components int, tables array<array<int>>, table_ids array<int>, error string")
    return out.withColumnRenamed("key", key)


def preprocess(images: DataFrame, keep: list[str], side: int = 256) -> DataFrame:
    """(keep..., image_rgb, error): decoded BGR images (width, height, channels, data) become canonical 8-bit colour;
    a row that fails has its error and no image, so keys never shift."""
    P.image_batches(images.sparkSession)

    def run(pdfs):
        for pdf in pdfs:
            done, errors = [], []
            for w, h, c, d in zip(pdf.width, pdf.height, pdf.channels, pdf.data, strict=True):
                try:
                    x = np.frombuffer(d, np.uint8).reshape(h, w, c)
                    x = x[..., 2::-1] if c >= 3 else x
                    done.append(K.canonical(x, side).tobytes())
                    errors.append(None)
                except (ValueError, TypeError, ZeroDivisionError) as e:
                    done.append(None)
                    errors.append(str(e))
            yield pd.concat([pdf[keep].reset_index(drop=True), pd.DataFrame({"image_rgb": done, "error": errors})], axis=1)

    fields = ", ".join(f"{k} {images.schema[k].dataType.simpleString()}" for k in keep)
    return images.select(*keep, "width", "height", "channels", "data").mapInPandas(run, f"{fields}, image_rgb binary, error string")


def materialise_images(processed: DataFrame, out: str, mode: str = "errorifexists") -> dict:
    """Write the good rows, 1,000 a file, and return the manifest: rows by label and how many were skipped."""
    processed.where("error IS NULL").drop("error").write.mode(mode).option("maxRecordsPerFile", 1000).option("parquet.block.size", 96 << 20).parquet(f"{out}/images")
    good = processed.sparkSession.read.parquet(f"{out}/images")
    counts = {str(r["label_a"]): r["count"] for r in good.groupBy("label_a").count().collect()} if "label_a" in good.columns else {}
    return {"total": good.count(), "by_label_a": counts, "errors_skipped": processed.where("error IS NOT NULL").count(), "format": "parquet"}


def materialise_features(images: DataFrame, out: str, keep: list[str], side: int = 256, ranking: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write the feature table, its registry, the identity manifest, and a view and a list for each budget."""
    spark = images.sparkSession
    P.extract(images, side, P.CANONICAL, keep).write.mode(mode).parquet(f"{out}/features")
    table = spark.read.parquet(f"{out}/features")
    P.registry_table(spark).coalesce(1).write.mode(mode).csv(f"{out}/feature_registry_csv", header=True)
    P.registry_table(spark).coalesce(1).write.mode(mode).json(f"{out}/feature_registry_json")
    table.select(*keep).write.mode(mode).csv(f"{out}/manifest", header=True)
    order = ranking or list(P.NAMES)
    for b in (8, 16, 32, 64, 111):
        table.select(*keep, *order[:b]).write.mode(mode).parquet(f"{out}/features_{b}")
        spark.createDataFrame([(b, min(b, len(order)), order[:b])], "budget int, feature_count int, features array<string>").coalesce(1).write.mode(mode).json(f"{out}/selected_features_{b}")


def read_processed(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """The canonical images of a folder that materialise_images() wrote, and their counts by label."""
    d = spark.read.parquet(f"{folder}/images")
    counts = {str(r["label_a"]): r["count"] for r in d.groupBy("label_a").count().collect()} if "label_a" in d.columns else {}
    return d, {"total": d.count(), "by_label_a": counts}


def read_ranking(spark: SparkSession, path: str) -> list[str]:
    """Feature names in rank order from a CSV with rank and feature; registry order where the file is missing."""
    from pyspark.errors import AnalysisException

    try:
        d = spark.read.csv(path, header=True)
    except AnalysisException:
        return list(P.NAMES)
    return [r["feature"] for r in d.orderBy(F.col("rank").cast("int")).select("feature").collect()]


def inspect(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """(file, rows, bytes) of each Parquet file under a folder, and the schema as JSON; only footers are read."""
    d = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    files = d.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes"))
    return files, d.schema.json()


def paired_files(left: DataFrame, right: DataFrame, key: str = "name") -> tuple[DataFrame, DataFrame]:
    """Rows of both listings under one key, and the keys that only one of them has, with its side."""
    both = left.join(right, key)
    lone = left.join(right, key, "left_anti").select(key, F.lit("left").alias("side")).union(right.join(left, key, "left_anti").select(key, F.lit("right").alias("side")))
    return both, lone


class FeatureTable:
    """Reader of a feature table: features by budget, names or branches, kept apart from metadata."""

    def __init__(self, spark: SparkSession, path: str, split: str | None = None, **subset):
        whole = spark.read.parquet(path)
        self.features = [n for n in P.subset(**subset) if n in whole.columns]
        self.metadata = [c for c in whole.columns if c not in P.NAMES]
        self.df = whole.where(F.col("split") == split) if split else whole

    def to_dataframe(self) -> DataFrame:
        return self.df.select(*self.metadata, *self.features)

    def get_features(self) -> DataFrame:
        return self.df.select(*self.features)

    def get_metadata(self) -> DataFrame:
        return self.df.select(*self.metadata)

    def get_labels(self, label: str = "label_a") -> DataFrame:
        return self.df.select(label)

    def get(self, sample_idx: int) -> DataFrame:
        return self.to_dataframe().where(F.col("sample_idx") == sample_idx)

    def provenance(self, name: str) -> P.Feature:
        return P.lookup(name)

    def to_arrow(self):
        return self.get_features().toArrow()


def render_report(sections: dict[str, DataFrame], limit: int = 1000) -> tuple[str, str]:
    """(JSON, Markdown) of small result tables, ``limit`` rows of each at most."""
    import json

    data = {k: [r.asDict(recursive=True) for r in d.limit(limit).collect()] for k, d in sections.items()}
    md = io.StringIO()
    for k, rows in data.items():
        md.write(f"## {k}\n\n")
        if rows:
            head = list(rows[0])
            md.write("| " + " | ".join(head) + " |\n|" + "---|" * len(head) + "\n")
            for r in rows:
                md.write("| " + " | ".join(str(r[c]) for c in head) + " |\n")
        md.write("\n")
    return json.dumps(data, default=str, indent=2), md.getvalue()

"""Image files, keys, materialised tables, their reader, the analysis run and the stream."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.functions import kernels as K
from pixelmill.plans import analysis
from pixelmill.plans import features as P
from pixelmill.sources import corpus
from pixelmill.streaming import extraction


def png(path, x):
    h, w, _ = x.shape
    raw = b"".join(b"\0" + r.tobytes() for r in x)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def jpeg(spark, src, dst, quality):
    j = spark._jvm
    img = j.javax.imageio.ImageIO.read(j.java.io.File(str(src)))
    w = j.javax.imageio.ImageIO.getImageWritersByFormatName("jpg").next()
    p = w.getDefaultWriteParam()
    p.setCompressionMode(2)
    p.setCompressionQuality(quality / 100)
    out = j.javax.imageio.ImageIO.createImageOutputStream(j.java.io.File(str(dst)))
    w.setOutput(out)
    w.write(None, j.javax.imageio.IIOImage(img, None, None), p)
    out.close()


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(24):
        b = i % 6
        x = np.clip(rng.normal(0.5, 0.1 + 0.02 * b, (16, 16, 3)), 0, 1)
        rows.append((i, f"train_{i:06d}", int(b > 0), b, bytearray((x * 255).astype(np.uint8).tobytes())))
    return spark.createDataFrame(rows, "img long, image_id string, label_a int, label_b int, image_rgb binary")


def test_folder_of_images_is_decoded_and_made_canonical(spark, tmp_path):
    x = np.random.default_rng(1).integers(0, 256, (20, 32, 3)).astype(np.uint8)
    png(tmp_path / "a.png", x)
    (tmp_path / "b.png").write_bytes(b"not an image")
    d = corpus.read_folder(spark, str(tmp_path))
    got = corpus.preprocess(d, ["name"], 16).collect()
    assert [r["name"] for r in got] == ["a.png"] and got[0]["error"] is None
    assert (np.frombuffer(got[0]["image_rgb"], np.uint8).reshape(16, 16, 3) == K.canonical(x, 16)).all()


def test_a_bad_row_keeps_its_key(spark):
    df = spark.createDataFrame([(1, 2, 2, 3, bytearray(12)), (2, 2, 2, 3, bytearray(5)), (3, 2, 2, 3, bytearray(12))], "k int, width int, height int, channels int, data binary")
    got = {r["k"]: r for r in corpus.preprocess(df, ["k"], 4).collect()}
    assert got[2]["error"] and got[2]["image_rgb"] is None and got[3]["error"] is None


def test_jpeg_header_and_simulated_loss(spark, tmp_path):
    y, x = np.mgrid[0:64, 0:64]
    img = np.stack([128 + 60 * np.sin(x / 5), 128 + 50 * np.cos(y / 7), 128 + 40 * np.sin((x + y) / 9)], axis=2)
    img = np.clip(img + np.random.default_rng(2).normal(0, 6, img.shape), 0, 255).astype(np.uint8)
    png(tmp_path / "a.png", img)
    jpeg(spark, tmp_path / "a.png", tmp_path / "a.jpg", 90)
    h = corpus.jpeg_header((tmp_path / "a.jpg").read_bytes())
    assert (h["width"], h["height"], h["components"], len(h["tables"])) == (64, 64, 3, 2)
    assert sorted(h["tables"][0]) == sorted(K.quantisation(K.LUMA_TABLE, 90).ravel().tolist())
    r = corpus.read_folder(spark, str(tmp_path), "*.jpg").first()
    real = np.frombuffer(bytes(r["data"]), np.uint8).reshape(64, 64, 3)[..., ::-1] / 255.0
    clean = img / 255.0
    mine = K.jpeg_round_trip(clean.transpose(2, 0, 1)[None], 90)[0].transpose(1, 2, 0)
    a, b = np.abs(real - clean).mean(), np.abs(mine - clean).mean()
    assert abs(a - b) / a < 0.05
    assert corpus.jpeg_header(b"nothing") is None


def test_headers_collect_errors(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xff\xd8\xff\xc0")), (2, bytearray(b"x")), (3, None)], "k int, d binary")
    assert all(r["error"] for r in corpus.image_headers(df, "k", "d").collect())


def test_keys_are_gapless_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    got = corpus.assign_keys(df, "train", ["v"]).collect()
    assert all(r["sample_idx"] == r["v"] and r["image_id"] == f"train_{r['v']:06d}" for r in got)


def test_raw_split_reader(spark, tmp_path):
    schema = "Image struct<bytes: binary, path: string>, Label_A int, Label_B int, Caption string"
    rows = [((bytearray(b"1"), f"p{i}"), int(i % 6 > 0), i % 6, None if i % 2 else "c") for i in range(12)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "w"))
    part = next((tmp_path / "w").glob("part-*.parquet"))
    (tmp_path / "raw").mkdir()
    part.rename(tmp_path / "raw" / "train-00000.parquet")
    d = corpus.read_split(spark, str(tmp_path / "raw"), "train")
    got = corpus.raw_metadata(d, "train").orderBy("sample_idx").collect()
    assert [r["label_b"] for r in got] == [i % 6 for i in range(12)]
    assert got[1]["caption"] == "" and got[1]["generator_name"] == "SD2.1" and got[3]["source_row"] == 3
    with pytest.raises(ValueError):
        corpus.read_split(spark, str(tmp_path / "raw"), "other")
    with pytest.raises(FileNotFoundError):
        corpus.read_split(spark, str(tmp_path / "raw"), "test")


def test_materialised_features_and_reader(spark, images, tmp_path):
    out = str(tmp_path / "f")
    corpus.materialise_features(images, out, ["img", "image_id", "label_a", "label_b"], 16)
    t = corpus.FeatureTable(spark, f"{out}/features", budget=list(P.NAMES[:8]))
    assert t.to_dataframe().columns == ["img", "image_id", "label_a", "label_b", *P.NAMES[:8]]
    assert t.get_features().count() == 24 and t.provenance("LL3_energy").branch == "B"
    assert spark.read.parquet(f"{out}/features").schema["LL3_energy"].metadata["sub_branch"] == "B_HAAR"
    assert len(spark.read.parquet(f"{out}/features_16").columns) == 20
    assert "label_a" not in t.get_features().columns
    assert spark.read.csv(f"{out}/feature_registry_csv", header=True).count() == 111


def test_materialised_images_have_a_manifest(spark, images, tmp_path):
    p = images.withColumn("error", F.when(F.col("img") == 3, "bad"))
    m = corpus.materialise_images(p, str(tmp_path / "m"))
    assert m["total"] == 23 and m["errors_skipped"] == 1 and sum(m["by_label_a"].values()) == 23
    with pytest.raises(Exception):
        corpus.materialise_images(p, str(tmp_path / "m"))


def test_analysis_writes_every_table(spark, images, tmp_path):
    table = P.extract(images, 16, ("A1_FFT", "E4_GRID"), ["img", "label_a", "label_b"])
    table.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    made = analysis.run_analysis(t, t, str(tmp_path / "out"))
    assert {"feature_validity", "univariate_relevance", "pearson_matrix", "spearman_matrix", "redundancy_pairs", "branch_redundancy", "branch_relevance", "generator_stability", "mrmr_rankings", "selected_features", "validation_results", "run_metadata", "feature_registry"} <= set(made)
    assert all(spark.read.parquet(p).count() >= 0 for p in made.values())
    assert spark.read.parquet(made["mrmr_rankings"]).count() == 8


def test_stream_gives_the_rows_of_the_table(spark, images, tmp_path):
    src = str(tmp_path / "src")
    images.write.parquet(src)
    q = extraction.extract_stream(extraction.read_images(spark, src, images.schema), str(tmp_path / "o"), str(tmp_path / "c"), ["img"], 16, ("A1_FFT",))
    q.awaitTermination()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "o"))) == key(P.extract(images, 16, ("A1_FFT",), ["img"]))


def test_report(spark):
    js, md = corpus.render_report({"a": spark.createDataFrame([(1, "x")], "n int, s string")})
    assert '"n": 1' in js and "| 1 | x |" in md


def test_inspection_pairs_and_rankings(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    files, schema = corpus.inspect(spark, str(tmp_path / "t"))
    got = files.collect()
    assert [r["rows"] for r in got] == [10] and got[0]["bytes"] > 0 and '"id"' in schema
    a, b = (spark.createDataFrame([(x,) for x in v], "name string") for v in (["1", "2"], ["2", "3"]))
    both, lone = corpus.paired_files(a, b)
    assert [r["name"] for r in both.collect()] == ["2"] and sorted(map(tuple, lone.collect())) == [("1", "left"), ("3", "right")]
    spark.createDataFrame([(2, "b"), (1, "a"), (10, "c")], "rank int, feature string").coalesce(1).write.csv(str(tmp_path / "r"), header=True)
    assert corpus.read_ranking(spark, str(tmp_path / "r")) == ["a", "b", "c"]
    assert corpus.read_ranking(spark, str(tmp_path / "none")) == list(P.NAMES)

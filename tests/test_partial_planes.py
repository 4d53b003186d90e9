"""Planes that lack some of their four vectors, and ids with gaps, give the rows that DuckDB gives."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_queries import rows

from pixelmill import catalog

#: Tiles of planes 0 to 15; the other planes have four, and 30 to 39 are missing.
TILES = [(0,), (1,), (2,), (3,), (0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3), (0, 1), (2,)]
NAMES = [
    "plane_entropy",  # F5
    "plane_kurtosis",  # F6
    "uint8_entropy",  # F11
    "dct_features",  # F3
    "channel_correlation",  # F1
    "cross_difference",  # F2
    "fft_bands",  # F4
    "quaternion_wavelet",  # F7
    "residual_highpass",  # F8
    "residual_laplacian",  # F9
    "residual_median",  # F10
    "glcm_haralick",  # F12
    "gray_plane",  # F13
    "grid_discontinuity",  # F14
    "fft_radial_profile",
    "haar_level1",
    "haar_features",
    "haar_detail_ratio",
    "lbp_histogram",
    "block_dct",
    "intensity_colour",
    "ring_profile",
]


@pytest.fixture(scope="module")
def some_tiles(tmp_path_factory):
    rng = np.random.default_rng(7)
    ids = [4 * p + k for p in range(48) if not 30 <= p < 40 for k in (TILES[p] if p < len(TILES) else range(4))] + [192, 193]
    path = tmp_path_factory.mktemp("tiles")
    vectors = [rng.normal(0, 0.4, 64).astype(np.float32) for _ in ids]
    pd.DataFrame({"vec_id": ids, "embedding": vectors, "label": [i % 10 for i in ids]}).to_parquet(path / "embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_planes_that_lack_tiles(spark, some_tiles, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{some_tiles}/embeddings.parquet')")
    a, b = rows(catalog.QUERIES[name](spark, some_tiles).toPandas()), rows(con.sql(catalog.ORACLE_SQL[name]).df())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=2e-6), (x, y)


#: Queries that divide by a spread.
FLAT = [
    "plane_kurtosis",  # F6
    "channel_correlation",  # F1
    "dct_features",  # F3
    "residual_highpass",  # F8
    "residual_laplacian",  # F9
    "residual_median",  # F10
    "intensity_colour",
]


@pytest.fixture(scope="module")
def flat_planes(tmp_path_factory):
    """Plane 1 is black; the second tile of plane 2 has missing components, NaN and infinity; plane 3 is a null vector and three."""
    rng = np.random.default_rng(8)
    vectors = [rng.normal(0, 0.4, 64).astype(np.float32).tolist() for _ in range(24)]
    vectors[4:8] = [[-2.0] * 64] * 4
    vectors[9][:4] = [None, float("nan"), float("inf"), float("-inf")]
    vectors[12] = None
    path = tmp_path_factory.mktemp("flat")
    table = {"vec_id": pa.array(range(24), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([i % 10 for i in range(24)], pa.int32())}
    pq.write_table(pa.table(table), path / "embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", FLAT)
def test_flat_planes(spark, flat_planes, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{flat_planes}/embeddings.parquet')")
    a, b = rows(catalog.QUERIES[name](spark, flat_planes).toPandas()), rows(con.sql(catalog.ORACLE_SQL[name]).df())
    assert any(None in x for x in b)
    assert len(a) == len(b)
    key = sorted(con.sql(catalog.ORACLE_SQL[name]).df().columns).index("img")
    for x, y in zip(*(sorted(r, key=lambda v: v[key]) for r in (a, b)), strict=True):
        for u, v in zip(x, y, strict=True):
            assert (u is None) == (v is None) and (u is None or u == pytest.approx(v, abs=2e-6)), (x, y)


def test_repeated_id_is_an_error(spark, tmp_path):
    pd.DataFrame({"vec_id": [0, 1, 1], "embedding": [np.zeros(64, np.float32)] * 3, "label": [0, 1, 2]}).to_parquet(tmp_path / "embeddings.parquet")
    with pytest.raises(Exception, match="comes twice"):
        catalog.QUERIES["plane_entropy"](spark, str(tmp_path)).collect()


def test_ids_that_a_double_cannot_hold(spark, tmp_path):
    """planes are told apart by whole numbers."""
    rng = np.random.default_rng(9)
    ids = [i + shift for shift in (0, 2**53, 2**55, 2**62) for i in range(10)]
    pd.DataFrame({"vec_id": ids, "embedding": [rng.normal(0, 0.4, 64).astype(np.float32) for _ in ids], "label": [i % 10 for i in ids]}).to_parquet(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    a, b = catalog.QUERIES["plane_entropy"](spark, str(tmp_path)).toPandas(), con.sql(catalog.ORACLE_SQL["plane_entropy"]).df()
    assert len(b) == 12 and rows(a) == rows(b)


def test_id_below_zero_is_an_error(spark, tmp_path):
    pd.DataFrame({"vec_id": [-1, 0], "embedding": [np.zeros(64, np.float32)] * 2, "label": [0, 1]}).to_parquet(tmp_path / "embeddings.parquet")
    with pytest.raises(Exception, match="below 0"):
        catalog.QUERIES["plane_entropy"](spark, str(tmp_path)).collect()

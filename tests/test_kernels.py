"""Closed forms and invariants of the image kernels."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelmill.functions import kernels as K
from pixelmill.plans import features as P

SIDE = 256


def image(kind):
    x = np.zeros((1, 3, SIDE, SIDE))
    if kind == "ones":
        x += 1
    elif kind == "half":
        x += 0.5
    elif kind == "impulse":
        x[:, :, 128, 128] = 1
    elif kind == "step":
        x[:, :, :, 128:] = 1
    elif kind == "checkerboard":
        x[:, :, ::2, ::2] = x[:, :, 1::2, 1::2] = 1
    elif kind == "noise":
        x = np.random.default_rng(0).random(x.shape)
    elif kind == "faint":
        x = 0.5 + 1e-9 * np.random.default_rng(1).random(x.shape)
    return x


@pytest.mark.parametrize("kind", ["zeros", "ones", "half", "impulse", "step", "checkerboard", "noise", "faint"])
def test_all_features_are_finite_named_and_repeatable(kind):
    x = image(kind)
    got = P.compute(x, P.resolve(P.CANONICAL))
    assert list(got) == list(P.NAMES)
    assert all(np.isfinite(v).all() for v in got.values())
    again = P.compute(x, P.resolve(P.CANONICAL))
    assert all((got[k] == again[k]).all() for k in got)


def test_registry_counts():
    from collections import Counter

    assert Counter(f.branch for f in P.REGISTRY) == {"A": 34, "B": 30, "C_LBP": 16, "D_MFR": 5, "E": 26}
    assert Counter(f.sub_branch for f in P.REGISTRY) == {"A1_FFT": 4, "A2_SYNTH": 30, "B_HAAR": 30, "C_LBP": 16, "D_MFR": 5, "E1_DCT": 10, "E2_RESP": 8, "E3_PHASE": 4, "E4_GRID": 4}


def test_cross_difference_of_two_by_two():
    assert K.cross_difference(np.array([[[1.0, 2.0], [3.0, 7.0]]]))[0, 0, 0] == 3.0


def test_band_ratios_sum_to_one():
    f = K.fft_features(image("noise")[:, 0])
    assert np.isclose(f["fft_low_freq_ratio"] + f["fft_mid_freq_ratio"] + f["fft_high_freq_ratio"], 1, atol=1e-9)


def test_haar_keeps_energy_and_rejects_odd_sides():
    g = image("noise")[:, 0]
    assert np.isclose(sum((b**2).sum() for b in K.haar(g).values()), (g**2).sum(), rtol=1e-12)
    with pytest.raises(ValueError):
        K.haar(np.zeros((1, 3, 4)))


def test_lbp_of_flat_spot_and_checkerboard():
    assert (K.lbp_codes(np.full((1, 8, 8), 0.5)) == 8).all()
    spot = np.zeros((1, 5, 5))
    spot[0, 2, 2] = 1
    assert K.lbp_codes(spot)[0, 2, 2] == 0
    assert K.lbp_codes(image("checkerboard")[:, 0])[0, 100, 100] == 9


def test_lbp_mask_of_few_pixels_is_an_even_spread():
    f = K.lbp_features(np.zeros((1, 8, 8)), np.zeros((1, 8, 8), bool), "lbp_edge")
    assert np.allclose([f[f"lbp_edge_bin_{i}"][0] for i in range(9)], 0.1) and f["lbp_edge_pixel_density"][0] == 0
    assert np.isclose(f["lbp_edge_std_code"][0], np.std(np.arange(10), ddof=1))


def test_laplacian_and_gaussian_of_an_impulse():
    g = image("impulse")[:, 0]
    lap = K.laplacian_residual(g)[0]
    assert lap[128, 128] == -8 and lap[127, 127] == 1 and lap[128, 129] == 1
    k = np.exp(-(np.arange(-2, 3) ** 2) / 2)
    assert np.isclose(K.highpass_residual(g)[0, 128, 128], 1 - (k[2] / k.sum()) ** 2)


def test_median_residual_against_a_plain_one():
    g = np.random.default_rng(3).random((1, 9, 9))
    p = np.pad(g[0], 1, mode="edge")
    want = [[g[0, y, x] - np.median(p[y : y + 3, x : x + 3]) for x in range(9)] for y in range(9)]
    assert np.allclose(K.median_residual(g)[0], want)


def test_entropy_of_uniform_values_and_sign():
    x = np.arange(256.0)[None]
    assert np.isclose(K.histogram_entropy(x)[0], 8)
    assert np.isclose(K.histogram_entropy(-x)[0], 8)
    assert K.histogram_entropy(np.ones((1, 9)))[0] == 0


def test_glcm_is_symmetric_and_sums_to_one():
    p = K.cooccurrence(image("noise")[:, 0])
    assert np.allclose(p, p.swapaxes(-1, -2)) and np.allclose(p.sum(axis=(-1, -2)), 1)
    assert np.allclose(K.haralick(K.cooccurrence(np.full((1, 8, 8), 0.3)))["correlation"], 1)


def test_dct_round_trip_and_flat_block():
    g = image("noise")[:, 0]
    assert np.allclose(K.inverse_block_dct(K.block_dct(g), SIDE, SIDE), g)
    f = K.dct_features(image("half")[:, 0])
    assert f["dct_sparsity_ratio"][0] == 1 and abs(f["dct_ac_energy"][0]) < 1e-20


def test_jpeg_tables_and_losses():
    assert K.quantisation(K.LUMA_TABLE, 50)[0, 0] == 16 and K.quantisation(K.LUMA_TABLE, 90)[0, 0] == 3
    x = np.rint(image("noise") * 255) / 255
    err = {q: np.abs(x - K.jpeg_round_trip(x, q)).mean() for q in (95, 60, 20)}
    assert 0 < err[95] < err[60] < err[20]
    assert (K.jpeg_round_trip(x, 100) == x).all()
    flat = np.full((1, 3, 16, 16), 128 / 255)
    assert np.abs(K.jpeg_round_trip(flat, 75) - flat).max() < 2 / 255


def test_phase_of_a_flat_image():
    f = K.phase_features(image("half")[:, 0], K.recompression(image("half")))
    assert f["phase_corr_q90"][0] == 1 and f["phase_diff_energy_q90"][0] < 1e-20


def test_grid_sees_block_edges():
    g = np.repeat(np.repeat(np.random.default_rng(5).random((1, 4, 4)), 8, 1), 8, 2)
    assert K.grid_features(g)["grid_strength"][0] > 1000


def test_channels_do_not_mix():
    x = image("noise")
    y = x.copy()
    y[:, 0] = 0
    a, b = K.periodicity_features(x), K.periodicity_features(y)
    assert all((a[k] == b[k]).all() for k in a if not k.startswith("synth_r"))


def test_canny_finds_a_step_and_nothing_in_flat():
    e = K.canny(image("step")[:, 0])
    assert e[0, 100].sum() >= 1 and K.canny(image("half")[:, 0]).sum() == 0


def test_area_resize_averages_blocks():
    x = np.random.default_rng(2).integers(0, 256, (64, 64, 3)).astype(np.uint8)
    want = x.reshape(16, 4, 16, 4, 3).mean(axis=(1, 3))
    assert np.abs(K.canonical(x, 16) - want).max() <= 0.5 + 1e-9
    assert K.canonical(np.full((30, 50), 7, np.uint8), 64).shape == (64, 64, 3)


def test_gray_needs_one_or_three_channels():
    with pytest.raises(ValueError):
        K.gray(np.zeros((1, 2, 4, 4)))
    assert np.allclose(K.gray(np.ones((1, 3, 2, 2))), 1)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0, 1e6), min_size=2, max_size=50))
def test_gini_is_within_bounds(v):
    assert 0 <= K.gini(np.array([v]))[0] <= 1


def test_plan_resolution():
    assert P.resolve(("a", "A", "b")) == ("A1_FFT", "A2_SYNTH", "B_HAAR")
    assert P.resolve(("D",)) == ("D_HIGHPASS", "D_LAPLACIAN", "D_MFR")
    for bad in (("C",), ("X",), (), ("C_LBP", "C_GLCM")):
        with pytest.raises(ValueError):
            P.resolve(bad)
    with pytest.raises(KeyError):
        P.subset(names=["nothing"])
    with pytest.raises(ValueError):
        P.subset(branches=["none"])
    assert P.subset(budget=["fft_low_freq_ratio"], names=["LL3_energy"]) == ["fft_low_freq_ratio"]


@pytest.mark.parametrize("kind", ["zeros", "half", "impulse", "step", "noise"])
def test_exploratory_features_are_finite(kind):
    from pixelmill.functions import exploratory as X

    x = image(kind)[:, :, :64, :64]
    got = P.compute(x, tuple(X.EXTRACTORS))
    assert all(np.isfinite(v).all() for v in got.values())
    assert sum(k.startswith("qwt_") for k in got) == 145


def test_pieces_of_a_mask():
    from pixelmill.functions import exploratory as X

    m = np.zeros((2, 6, 6), bool)
    m[0, 0, 0] = m[0, 1, 1] = m[0, 4, 4] = True
    assert X.pieces(m).tolist() == [2, 0]


def test_pyramid_band_of_a_flat_image_is_empty():
    from pixelmill.functions import exploratory as X

    assert all(abs(v[0]) < 1e-12 for v in X.directional_features(np.full((1, 32, 32), 0.4)).values())
